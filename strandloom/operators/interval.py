"""Interval joins over binned equi-joins, and set algebra of intervals.

``interval_join`` turns an overlap condition into an equi-join: both sides list the bins they touch (end bin
included, so that touching empty regions meet), join on contig and bin, and each pair is emitted in one
bin only, the one that holds the later begin.  Any pair that overlaps, contains or touches shares that bin.
Catalyst picks broadcast or sort-merge, and adaptive execution splits crowded bins.

Pairs grow with the depth.  Counts and sums over partners do not form them: :func:`sum_overlapped` takes differences of
running sums at the ends of a region.  Other aggregates form the pairs of distinct regions only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import regions as R
from .scan import running, running_sums, tile_of

BIN = 128
#: The left row's number while its matches are gathered.
_ID = "_left_id"


def bins(r: R.Region, width: int) -> Column:
    return F.sequence(F.floor(r.begin / width).cast("long"), F.floor(r.end / width).cast("long"))


def interval_join(left: DataFrame, right: DataFrame, *, on: Sequence[str] = ("contig",), predicate: Callable[[R.Region, R.Region], Column] = R.overlaps,
                  how: str = "inner", width: int = BIN, spread: bool = False) -> DataFrame:
    """Pairs ``l``, ``r`` (structs of the rows) whose regions meet ``predicate``; ``how`` is inner or left.  ``spread`` keeps the
    planner from broadcasting a side whose statistics say less than it holds (rows that Python makes).

    The predicate must imply that the regions overlap or touch.  ``left`` gives every left row at least once,
    with ``r`` null in bins without a partner: aggregate it with :func:`per_left`.
    """
    # flat columns up to the end, so that only those that are used are read and shuffled
    a = left.select(*[F.col(f"`{c}`").alias(f"_l_{c}") for c in left.columns])
    b = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}") for c in right.columns])
    x, y = (R.Region(F.col(f"{p}start_pos"), F.col(f"{p}end_pos")) for p in ("_l_", "_r_"))
    a = a.withColumn("_bin", (F.explode if how == "inner" else F.explode_outer)(bins(x, width)))
    b = b.withColumn("_bin_r", F.explode(bins(y, width)))
    once = F.col("_bin") == F.greatest(F.floor(x.begin / width), F.floor(y.begin / width))
    keys = F.lit(True)
    for k in on:
        keys = keys & (F.col(f"_l_{k}") == F.col(f"_r_{k}"))
    pairs = a.join(b.hint("merge") if spread else b, keys & (F.col("_bin") == F.col("_bin_r")) & once & predicate(x, y), how)
    own = F.struct(*[F.col(f"_l_{c}").alias(c) for c in left.columns])
    other = F.struct(*[F.col(f"_r_{c}").alias(c) for c in right.columns])
    return pairs.select(own.alias("l"), (other if how == "inner" else F.when(F.col("_bin_r").isNotNull(), other)).alias("r"))


def per_left(left: DataFrame, right: DataFrame, aggs: dict[str, Column], *, on: Sequence[str] = ("contig",), **options) -> DataFrame:
    """Every left row once, with aggregates over its partners (columns ``r``, and ``l`` with ``on`` and the region; ``r`` is null without partner).

    Left rows of one region have the same partners, so that pairs are formed for distinct regions only.
    """
    keys = list(dict.fromkeys([*on, "start_pos", "end_pos"]))
    x = interval_join(left.select(*keys).distinct(), right, on=on, how="left", **options)
    x = x.groupBy(*[F.col(f"l.`{k}`").alias(f"_g_{k}") for k in keys]).agg(*[c.alias(f"_a_{k}") for k, c in aggs.items()])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_g_{k}"))
    return left.join(x, same, "left").select(*[F.col(f"`{c}`") for c in left.columns if c not in aggs], *[F.col(f"_a_{k}").alias(k) for k in aggs])


# --- sums over partners without pairs ---
# Ends are doubled so that the rules for empty regions are comparisons: an item overlaps a region if its begin is at most the region's
# upper and its end above the region's lower code.

def _item_ends(r: R.Region) -> tuple[Column, Column]:
    empty = (r.begin == r.end).cast("long")
    return 2 * r.begin - empty, 2 * r.end + empty


def _upper(r: R.Region) -> Column:
    return 2 * r.end - (r.begin != r.end).cast("long")


def _lower(r: R.Region) -> Column:
    return 2 * r.begin - (r.begin == r.end).cast("long")


def _sums_between(left: DataFrame, items: DataFrame, names: list[str], on: Sequence[str], *, inside: bool, correct: bool, width: int = 2 * BIN) -> DataFrame:
    """Left rows (``_x``, ``_y``) with sums of ``names`` over the items (``_begin``, ``_end``) of the same keys.

    Either those that begin at or before ``_x`` and end behind ``_y``, or (``inside``) those that begin behind ``_x`` and end at or
    before ``_y``.  Both are differences of two running sums, but for items of the other kind, which are subtracted twice:
    ``correct`` adds these.  They are the items that fit between ``_x`` and ``_y`` (or that are longer than the left region), whose
    pairs are formed for distinct regions and items of suitable size.
    """
    on = list(on)
    zero = [F.lit(0).alias(f"{side}{n}") for side in "be" for n in names]
    cell = lambda at, side: F.struct(F.col(at).alias("_at"), *[(F.col(n) if s == side else F.lit(0)).cast("long").alias(f"{s}{n}") for s in "be" for n in names])
    points = items.select(*on, F.explode(F.array(cell("_begin", "b"), cell("_end", "e"))).alias("_p")).select(*on, "_p.*")
    asked = left.select(*on, F.explode(F.array("_x", "_y")).alias("_at"), *zero)
    columns = [f"{s}{n}" for s in "be" for n in names]
    steps = points.unionByName(asked).groupBy(*on, "_at").agg(*[F.sum(c).alias(c) for c in columns])
    upto = running_sums(steps, on, "_at", columns)
    begun = upto.select(*on, F.col("_at").alias("_x"), *[f"b{n}" for n in names])
    ended = upto.select(*on, F.col("_at").alias("_y"), *[f"e{n}" for n in names])
    regions = left.select(*on, "_x", "_y").distinct()
    x = regions.join(begun, [*on, "_x"]).join(ended, [*on, "_y"])
    total = {n: (F.col(f"e{n}") - F.col(f"b{n}")) * (1 if inside else -1) for n in names}
    if correct:
        more = [f"_more_{n}" for n in names]
        shapes = items.groupBy(*on, "_begin", "_end").agg(*[F.sum(n).alias(m) for n, m in zip(names, more)])
        at = lambda c: F.floor(c / width).cast("long")
        size, gap = F.col("_end") - F.col("_begin"), F.col("_y") - F.col("_x")
        if inside:
            longest = F.broadcast(items.agg(F.max(size).alias("_most")))
            a = regions.crossJoin(longest).where(gap < F.col("_most")).select(*on, "_x", "_y", at(F.col("_x") + 1).alias("_bin"))
            b = shapes.withColumn("_bin", F.explode(F.sequence(at(F.col("_begin")), at(F.col("_end")))))
            test = (F.col("_begin") <= F.col("_x")) & (F.col("_end") > F.col("_y"))
        else:
            longest = F.broadcast(left.agg(F.max(gap).alias("_most")))
            a = regions.where(gap > 2).withColumn("_bin", F.explode(F.sequence(at(F.col("_x")), at(F.col("_y")))))
            b = shapes.crossJoin(longest).where(size < F.col("_most")).drop("_most").withColumn("_bin", at(F.col("_begin")))
            test = (F.col("_begin") > F.col("_x")) & (F.col("_end") <= F.col("_y"))
        pairs = a.join(b, [*on, "_bin"]).where(test).groupBy(*on, "_x", "_y").agg(*[F.sum(m).alias(m) for m in more])
        x = x.join(pairs, [*on, "_x", "_y"], "left")
        total = {n: c + F.coalesce(f"_more_{n}", F.lit(0)) for n, c in total.items()}
    x = x.select(*on, "_x", "_y", *[c.alias(f"_sum_{n}") for n, c in total.items()])
    kept = [c for c in left.columns if c not in {"_x", "_y", *names}]
    return left.join(x, [*on, "_x", "_y"], "left").select(*kept, *[F.coalesce(f"_sum_{n}", F.lit(0)).cast("long").alias(n) for n in names])


def sum_overlapped(left: DataFrame, right: DataFrame, sums: dict[str, Column], *, on: Sequence[str] = ("contig",), relation: str = "overlaps") -> DataFrame:
    """Left rows with sums of whole numbers over their partners, 0 without any; nulls add nothing.

    ``sums`` are columns over ``right``.  Partners ``overlaps`` the left region, are ``spanning`` it (overlap and contain it), or
    are ``contained`` in it.
    """
    own, item = R.Region.of(), R.Region.of()
    if relation == "contained":
        x, y, begin, end = 2 * own.begin - 1, 2 * own.end, 2 * item.begin, 2 * item.end
    else:
        begin, end = _item_ends(item)
        x, y = (_upper(own), _lower(own)) if relation == "overlaps" else (2 * own.begin, 2 * own.end - 1)
    items = right.select(*on, begin.cast("long").alias("_begin"), end.cast("long").alias("_end"), *[F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in sums.items()])
    items = items.where("_begin is not null and _end is not null")
    return _sums_between(left.withColumn("_x", x.cast("long")).withColumn("_y", y.cast("long")), items, list(sums), on, inside=relation == "contained", correct=relation != "overlaps")


def copy_overlapped(left: DataFrame, right: DataFrame, **options) -> DataFrame:
    """Left rows with at least one partner: a semi-join of binned rows, which stops at a row's first partner in a bin."""
    hits = _binned(left, right, "left_semi", **options)
    return hits.dropDuplicates([_ID]).select(*left.columns)


def copy_nonoverlapped(left: DataFrame, right: DataFrame, **options) -> DataFrame:
    """Left rows without partner: an anti-join of binned rows; a row stays if none of its bins has a partner."""
    free = _binned(left, right, "left_anti", **options)
    kept = [F.first(F.col(f"`{c}`")).alias(c) for c in left.columns]
    x = free.groupBy(_ID).agg(F.count(F.lit(1)).alias("_free"), F.first("_bins").alias("_bins"), *kept)
    return x.where("_free = _bins").select(*left.columns)


def _binned(left: DataFrame, right: DataFrame, how: str, *, on: Sequence[str] = ("contig",), predicate: Callable[[R.Region, R.Region], Column] = R.overlaps,
            width: int = BIN) -> DataFrame:
    """Left rows by bin, with their number ``_ID`` and the count ``_bins`` of their bins, that have (or lack) a partner in the bin.

    A pair may meet in several bins, which neither kind of join minds.
    """
    a = left.withColumn(_ID, F.monotonically_increasing_id()).withColumn("_all", bins(R.Region.of(), width))
    a = a.withColumn("_bins", F.size("_all")).withColumn("_bin", F.explode("_all")).drop("_all")
    b = right.select(*[F.col(f"`{k}`").alias(f"_r_{k}") for k in dict.fromkeys([*on, "start_pos", "end_pos"])])
    x, y = R.Region.of(), R.Region(F.col("_r_start_pos"), F.col("_r_end_pos"))
    b = b.withColumn("_bin_r", F.explode(bins(y, width)))
    keys = F.col("_bin") == F.col("_bin_r")
    for k in on:
        keys = keys & (F.col(f"`{k}`") == F.col(f"_r_{k}"))
    return a.join(b, keys & predicate(x, y), how)


def count_overlapped(left: DataFrame, right: DataFrame, name: str = "n", *, on: Sequence[str] = ("contig",), relation: str = "overlaps") -> DataFrame:
    """Left rows with the number of their partners, zero included."""
    return sum_overlapped(left, right, {name: F.lit(1)}, on=on, relation=relation)


def has_overlapped(left: DataFrame, right: DataFrame, name: str = "found", **options) -> DataFrame:
    return per_left(left, right, {name: F.count("r") > 0}, **options)


def best_overlapped(left: DataFrame, right: DataFrame, fields: dict[str, Column], *, largest: bool = True, ties: list[Column] | None = None,
                    **options) -> DataFrame:
    """Left rows with ``fields`` of the partner that has the largest (or smallest) overlap; ties by ``ties`` ascending."""
    size = R.overlap_size(R.Region.of("l"), R.Region.of("r"))
    if ties:  # of partners with one region the first by the ties is the only one that can win
        on = list(options.get("on", ("contig",)))
        whole = right.select(F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("r"))
        right = whole.groupBy(*[F.col(f"r.`{k}`").alias(f"_g_{k}") for k in dict.fromkeys([*on, "start_pos", "end_pos"])]).agg(
            F.min_by("r", F.struct(*[c.alias(f"t{i}") for i, c in enumerate(ties)])).alias("r")).select("r.*")
    rank = F.when(F.col("r").isNotNull(), F.struct((-size if largest else size).alias("s"), *[c.alias(f"t{i}") for i, c in enumerate(ties or [])]))
    chosen = F.min_by(F.struct(*[c.alias(k) for k, c in fields.items()]), rank)
    return per_left(left, right, {"_best": chosen}, **options).select("*", *[F.col(f"_best.{k}").alias(k) for k in fields]).drop("_best")


def count_shared(left_pairs: DataFrame, items: DataFrame, item_id: list[str] | None = None) -> DataFrame:
    """Pairs of regions (``first``, ``second`` structs on one contig) with the number of items overlapping both.

    Such items begin before the lesser upper end and end behind the greater lower end of both; those between regions that lie
    apart are taken out again.  Rows with one ``item_id`` (if given) count once.
    """
    a, b = R.Region.of("first"), R.Region.of("second")
    p = left_pairs.withColumn("contig", F.col("first.contig")).withColumn("_x", F.least(_upper(a), _upper(b))).withColumn("_y", F.greatest(_lower(a), _lower(b)))
    begin, end = _item_ends(R.Region.of())
    if item_id is not None:
        items = items.select(*dict.fromkeys([*item_id, "contig", "start_pos", "end_pos"])).distinct()
    x = items.select("contig", begin.alias("_begin"), end.alias("_end"), F.lit(1).alias("n_shared")).where("_begin is not null and _end is not null")
    return _sums_between(p, x, ["n_shared"], ["contig"], inside=False, correct=True).select(*left_pairs.columns, "n_shared")


def first_after(left: DataFrame, right: DataFrame, fields: dict[str, Column], *, keys: list[str] = ("contig",), tile: int = 1 << 16) -> DataFrame:
    """As-of join: for each left row, ``fields`` of the right row with the least begin at or after the left end (ties: least fields).

    One pass over the union of both sides, from the right: within tiles the nearest row is a running value, and across
    tiles a small table names the first right row of each tile and of the next tile that has one.  Columns stay flat, so
    that only those in use are read and shuffled.
    """
    keys = list(keys)
    mine = [c for c in left.columns if c not in keys]
    payload = F.struct(F.col("start_pos").alias("_b"), *[c.alias(k) for k, c in fields.items()])
    r = right.select(*keys, F.col("start_pos").alias("_at"), F.lit(1).alias("_side"), payload.alias("_r"),
                     *[F.lit(None).cast(left.schema[c].dataType).alias(f"_l_{c}") for c in mine])
    l = left.select(*keys, F.col("end_pos").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"),
                    *[F.col(f"`{c}`").alias(f"_l_{c}") for c in mine])
    x = l.unionByName(r).withColumn("_tile", F.floor(F.col("_at") / tile))
    w = W.partitionBy(*keys, "_tile").orderBy(F.desc("_at"), F.desc("_side"), F.desc("_r")).rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumn("_hit", F.last("_r", ignorenulls=True).over(w)).where("_side = 0")
    heads = r.withColumn("_tile", F.floor(F.col("_at") / tile)).groupBy(*keys, "_tile").agg(F.min("_r").alias("_head"))
    tiles = l.select(*keys, F.floor(F.col("_at") / tile).alias("_tile")).distinct().withColumn("_head", F.lit(None).cast(heads.schema["_head"].dataType)).unionByName(heads)
    tiles = tiles.groupBy(*keys, "_tile").agg(F.max("_head").alias("_head"))
    later = W.partitionBy(*keys).orderBy(F.desc("_tile")).rowsBetween(W.unboundedPreceding, -1)
    tiles = tiles.withColumn("_later", F.last("_head", ignorenulls=True).over(later)).drop("_head")
    out = x.join(tiles, [*keys, "_tile"], "left").withColumn("_best", F.coalesce("_hit", "_later"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_l_{c}").alias(c) for c in left.columns], *[F.col(f"_best.{k}").alias(k) for k in fields])


def find_first_shared(regions: DataFrame, items: DataFrame, region_id: str, *, keys: list[str] = ("contig",)) -> DataFrame:
    """For each region, the first later region (by begin, end, id) that shares an item with it: ``first_shared``, null if none.

    An item joins the distinct regions it overlaps in order; consecutive ones of an item suffice, since the first later region
    that shares an item with a region is its successor along some item.  A region that any item overlaps shares it with
    the next id of its own region, if there is one.  Items of one region are one.
    """
    keys = list(keys)
    place = [*keys, "start_pos", "end_pos"]
    ids = regions.select(*place, F.col(f"`{region_id}`").alias("_id")).distinct()
    shapes = ids.groupBy(*place).agg(F.min("_id").alias("id"))
    hits = interval_join(items.select(*place).distinct(), shapes, on=keys)
    w = W.partitionBy(*[F.col(f"l.{k}") for k in place]).orderBy("_at")
    hits = hits.withColumn("_at", F.struct("r.start_pos", "r.end_pos", "r.id"))
    links = hits.select(*[F.col(f"r.{k}").alias(k) for k in place], F.lead("_at").over(w).alias("_next")).groupBy(*place).agg(F.min("_next").alias("_next"))
    ids = ids.withColumn("_same", F.lead("_id").over(W.partitionBy(*place).orderBy("_id"))).join(links, place)
    found = ids.select(*place, F.col("_id").alias(region_id), F.coalesce("_same", "_next.id").alias("first_shared"))
    return regions.join(found, [*place, region_id], "left").select(*regions.columns, "first_shared")


def has_coverage(regions: DataFrame, items: DataFrame, name: str = "covered", **options) -> DataFrame:
    """Regions with whether any non-empty item covers one of their positions."""
    return has_overlapped(regions, items.where("end_pos > start_pos"), name, predicate=lambda a, b: R.overlap_size(a, b) > 0, **options)


def touches_islands(df: DataFrame, disjoint: DataFrame, name: str, keys: list[str] = ("contig",), *, tile: int = 1 << 12) -> DataFrame:
    """Rows with whether one of the regions of ``disjoint`` (islands, not empty) overlaps them.

    Only the last island that begins up to a row's end can: it begins in the tile of that end, or is the last before the tile.
    Islands by tile are a small table, so that rows are not shuffled while it can be broadcast.
    """
    keys = list(keys)
    own = disjoint.select(*keys, F.struct("start_pos", "end_pos").alias("_i"), tile_of(F.col("start_pos"), tile).alias("_tile"))
    asked = df.select(*keys, tile_of(F.col("end_pos"), tile).alias("_tile")).distinct()
    tiles = own.unionByName(asked, allowMissingColumns=True).groupBy(*keys, "_tile").agg(F.collect_list("_i").alias("_own"), F.max("_i").alias("_last"))
    before = W.partitionBy(*keys).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    near = F.concat(F.col("_own"), F.array_compact(F.array(F.last("_last", ignorenulls=True).over(before))))
    tiles = tiles.select(*keys, "_tile", near.alias("_near"))
    me = R.Region.of()
    found = F.exists("_near", lambda i: R.overlaps(R.Region(i["start_pos"], i["end_pos"]), me))
    x = df.withColumn("_tile", tile_of(F.col("end_pos"), tile)).join(tiles, [*keys, "_tile"], "left")
    return x.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(found, F.lit(False)).alias(name))


def join_if(df: DataFrame, test: Callable[[Column, Column], Column], columns: Sequence[str], keys: list[str] = ("contig",)) -> DataFrame:
    """Runs of regions, in order, each of which ``test`` accepts beside its predecessor; tests see structs of ``columns``.

    The window orders regions of one key, which should be few, as islands are (see :func:`islands` for many).
    """
    keys = list(keys)
    me = F.struct(*columns)
    order = W.partitionBy(*keys).orderBy("start_pos", "end_pos")
    x = df.withColumn("_prev", F.lag(me).over(order)).withColumn("_me", me)
    x = x.withColumn("_new", F.when(F.coalesce(test(F.col("_prev"), F.col("_me")), F.lit(False)), 0).otherwise(1))
    x = x.withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return x.groupBy(*keys, "_run").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count(F.lit(1)).alias("n")).drop("_run")


def bidirectionally_sorted_ranges(df: DataFrame, keys: list[str] = ("contig",)) -> DataFrame:
    """Add ``range_no``: a new range begins where an end falls behind the largest end of the range so far.

    An end that falls behind all earlier ends of the range also falls behind its neighbour's, for within a range ends ascend.
    """
    keys = list(keys)
    order = W.partitionBy(*keys).orderBy("start_pos", "end_pos")
    x = df.withColumn("_new", F.when(F.col("end_pos") < F.lag("end_pos").over(order), 1).otherwise(0))
    return x.withColumn("range_no", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_new")


def islands(df: DataFrame, keys: list[str] = ("contig",), *, merge_adjacent: bool = True, gap: int = 0, aggs: dict[str, Column] | None = None,
            tile: int = 1 << 16) -> DataFrame:
    """Unions of intervals.  A new island begins where ``begin`` is past the running end.

    ``merge_adjacent`` joins intervals that only touch (covered regions); without it they stay apart unless one of
    them is empty (mutually exclusive regions).  ``gap`` joins intervals that are up to as many positions apart.
    """
    keys = list(keys)
    order = ["end_pos"]
    x = running(df, keys, "start_pos", F.col("end_pos"), "_reach", how="max", order=order, inclusive=False, tile=tile)
    if merge_adjacent or gap:
        new = F.col("start_pos") > F.col("_reach") + gap
    else:
        new = (F.col("start_pos") > F.col("_reach")) | ((F.col("start_pos") == F.col("_reach")) & (F.col("start_pos") < F.col("end_pos")))
    x = x.withColumn("_new", F.when(F.col("_reach").isNull() | new, 1).otherwise(0))
    x = running(x, keys, "start_pos", F.col("_new"), "_island", order=[*order, F.desc("_new")], tile=tile)
    return x.groupBy(*keys, "_island").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"),
                                           *[c.alias(k) for k, c in (aggs or {}).items()]).drop("_island")


def covered_regions(df: DataFrame, keys: list[str] = ("contig",), **options) -> DataFrame:
    return islands(df, keys, merge_adjacent=True, **options)


def mutually_exclusive_regions(df: DataFrame, keys: list[str] = ("contig",), **options) -> DataFrame:
    return islands(df, keys, merge_adjacent=False, **options)


def intervening_regions(df: DataFrame, keys: list[str] = ("contig",), within: DataFrame | None = None) -> DataFrame:
    """Gaps between covered regions, or the positions of ``within`` (regions of the same keys) that none covers.

    The window orders islands, which are few, not the intervals.
    """
    keys = list(keys)
    if within is not None:
        return subtract(within.select(*keys, "start_pos", "end_pos"), df, keys)
    own = covered_regions(df, keys)
    w = W.partitionBy(*keys).orderBy("start_pos")
    return own.select(*keys, F.col("end_pos").alias("start_pos"), F.lead("start_pos").over(w).alias("end_pos")).where("end_pos is not null")


def subtract(include: DataFrame, exclude: DataFrame, keys: list[str] = ("contig",)) -> DataFrame:
    """Covered positions of ``include`` that ``exclude`` does not cover: a sweep over signed ends."""
    keys = list(keys)
    def ends(df: DataFrame, a: int, b: int) -> DataFrame:
        return df.where("end_pos > start_pos").select(*keys, F.explode(F.array(
            F.struct(F.col("start_pos").alias("pos"), F.lit(a).alias("inc"), F.lit(b).alias("exc")),
            F.struct(F.col("end_pos").alias("pos"), F.lit(-a).alias("inc"), F.lit(-b).alias("exc")))).alias("e")).select(*keys, "e.*")
    from .scan import following

    x = ends(include, 1, 0).unionByName(ends(exclude, 0, 1)).groupBy(*keys, "pos").agg(F.sum("inc").alias("inc"), F.sum("exc").alias("exc"))
    x = running(running(x, keys, "pos", F.col("inc"), "n_inc"), keys, "pos", F.col("exc"), "n_exc")
    x = following(x, keys, "pos", "end_pos").where("n_inc > 0 and n_exc = 0 and end_pos is not null")
    return covered_regions(x.select(*keys, F.col("pos").alias("start_pos"), "end_pos"), keys)


def decompose(df: DataFrame, n: int = 1, overlap: int = 0) -> DataFrame:
    """Windows of ``n`` positions every ``n - overlap``, the last one cut at the region's end."""
    step = n - overlap
    x = df.where("end_pos > start_pos").withColumn("_at", F.explode(F.expr(f"sequence(start_pos, end_pos - 1, cast({step} as bigint))")))
    return x.withColumn("end_pos", F.least(F.col("_at") + n, F.col("end_pos"))).withColumn("start_pos", F.col("_at")).drop("_at")


def positional_seeds(df: DataFrame, keys: list[str] = ("contig",)) -> DataFrame:
    """Number of intervals that begin at each position that has one."""
    return df.groupBy(*keys, F.col("start_pos").alias("pos")).agg(F.count(F.lit(1)).alias("n"))


def is_bidirectionally_sorted(df: DataFrame, keys: list[str] = ("contig",)) -> DataFrame:
    """Per key: whether no interval lies inside an earlier one, i.e. ends ascend with begins."""
    x = running(df, list(keys), "start_pos", F.col("end_pos"), "_reach", how="max", order=["end_pos"], inclusive=False)
    return x.groupBy(*keys).agg(F.bool_and(F.col("_reach").isNull() | (F.col("end_pos") >= F.col("_reach"))).alias("sorted_both_ways"))
