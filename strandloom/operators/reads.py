"""The read pipeline: filters, transforms, duplicate removal, fragmentation, downsampling.

Reads are rows with ``contig, start_pos, end_pos, seq, quals, cigar, mq`` and flag columns (see ``READ_SCHEMA``).
A filter is a Boolean column; a masking transform sets base qualities to 0 and never edits the sequence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import sequences as S
from .interval import touches_islands

READ_SCHEMA = (
    "name STRING, sample STRING, read_group STRING, contig STRING, start_pos BIGINT, end_pos BIGINT, seq STRING, quals ARRAY<SMALLINT>, "
    "cigar ARRAY<STRUCT<size:INT,flag:STRING>>, mq SMALLINT, barcode STRING, multiple_segment_template BOOLEAN, all_segments_aligned BOOLEAN, "
    "unmapped BOOLEAN, reverse BOOLEAN, secondary BOOLEAN, qc_fail BOOLEAN, duplicate BOOLEAN, supplementary BOOLEAN, first_segment BOOLEAN, "
    "last_segment BOOLEAN, mate STRUCT<contig:STRING,begin:BIGINT,tlen:BIGINT,unmapped:BOOLEAN,reverse:BOOLEAN>, tags MAP<STRING,STRING>, "
    "supp ARRAY<STRUCT<contig:STRING,start_pos:BIGINT,end_pos:BIGINT,cigar:STRING,forward:BOOLEAN,mq:SMALLINT>>")

col = F.col
FILTERS: dict[str, Callable[..., Column]] = {}


def read_filter(fn: Callable[..., Column]) -> Callable[..., Column]:
    FILTERS[fn.__name__] = fn
    return fn


def _no_mate() -> Column:
    return col("mate").isNull()


@read_filter
def has_well_formed_cigar() -> Column:
    one_clip = (F.size("cigar") == 1) & F.get(col("cigar"), F.lit(0))["flag"].isin("S", "H")
    return C.is_valid(col("cigar")) & C.is_minimal(col("cigar")) & ~one_clip


@read_filter
def has_valid_base_qualities() -> Column:
    return F.length("seq") == F.size("quals")


@read_filter
def is_not_secondary_alignment() -> Column:
    return ~col("secondary")


@read_filter
def is_not_supplementary_alignment() -> Column:
    return ~col("supplementary")


@read_filter
def is_good_mapping_quality(q: int = 5) -> Column:
    return col("mq") >= q


def _good_bases(q: int) -> Column:
    return F.size(F.filter("quals", lambda x: x >= q))


@read_filter
def has_sufficient_good_base_fraction(q: int, fraction: float) -> Column:
    return _good_bases(q) / F.greatest(F.length("seq"), F.lit(1)) >= fraction


@read_filter
def has_sufficient_good_quality_bases(q: int = 20, n: int = 20) -> Column:
    return _good_bases(q) >= n


@read_filter
def is_mapped() -> Column:
    return ~col("unmapped")


@read_filter
def is_not_chimeric() -> Column:
    """No other segment at all."""
    return _no_mate()


@read_filter
def is_next_segment_mapped() -> Column:
    return _no_mate() | ~col("mate.unmapped")


@read_filter
def is_not_marked_duplicate() -> Column:
    return ~col("duplicate")


@read_filter
def is_short(n: int = 10000) -> Column:
    return F.length("seq") <= n


@read_filter
def is_long(n: int = 0) -> Column:
    return F.length("seq") >= n


@read_filter
def is_not_contaminated() -> Column:
    """Without a mate, or the template is longer than the read's region."""
    return _no_mate() | (F.abs("mate.tlen") > col("end_pos") - col("start_pos"))


@read_filter
def is_not_marked_qc_fail() -> Column:
    return ~col("qc_fail")


@read_filter
def is_proper_template() -> Column:
    return _no_mate() | col("all_segments_aligned")


@read_filter
def is_local_template() -> Column:
    return _no_mate() | (col("mate.contig") == col("contig"))


def _no_supplementary_on(test: Callable[[Column], Column], min_mq: int) -> Column:
    return ~F.coalesce(F.exists("supp", lambda s: test(s["contig"]) & (s["mq"] >= min_mq)), F.lit(False))


@read_filter
def no_unlocalized_supplementary_alignments(min_mq: int = 5) -> Column:
    return _no_supplementary_on(lambda c: c.endswith("_random"), min_mq)


@read_filter
def no_unplaced_supplementary_alignments(min_mq: int = 5) -> Column:
    return _no_supplementary_on(lambda c: c.startswith("chrU_"), min_mq)


@read_filter
def no_decoy_supplementary_alignments(min_mq: int = 5) -> Column:
    return _no_supplementary_on(lambda c: c.endswith("_decoy"), min_mq)


@read_filter
def has_tag(tag: str, value: str | None = None) -> Column:
    v = F.try_element_at("tags", F.lit(tag))
    return F.coalesce(v.isNotNull() if value is None else v == value, F.lit(False))


@read_filter
def not_has_tag(tag: str, value: str | None = None) -> Column:
    return ~has_tag(tag, value)


#: Applied even where read preprocessing is switched off.
MANDATORY = ("has_well_formed_cigar", "has_valid_base_qualities")
DEFAULT = (*MANDATORY, "is_not_secondary_alignment", "is_good_mapping_quality", "has_sufficient_good_quality_bases", "is_mapped",
           "is_not_marked_duplicate", "is_short", "is_not_marked_qc_fail", "is_not_supplementary_alignment",
           "no_unlocalized_supplementary_alignments", "no_unplaced_supplementary_alignments", "no_decoy_supplementary_alignments")

#: Filters that walk over sequences, qualities or operations, the cheaper ones first.
COSTLY = ("no_unlocalized_supplementary_alignments", "no_unplaced_supplementary_alignments", "no_decoy_supplementary_alignments", "is_short", "is_long", "has_valid_base_qualities",
          "has_sufficient_good_quality_bases", "has_sufficient_good_base_fraction", "has_well_formed_cigar")


def apply_filters(reads: DataFrame, names: Iterable[str] = DEFAULT, params: dict[str, tuple] | None = None) -> DataFrame:
    """Reads that pass all the named filters, in one projection-free ``where``; those that read whole arrays come last."""
    test = F.lit(True)
    for n in sorted(names, key=lambda n: COSTLY.index(n) + 1 if n in COSTLY else 0):
        test = test & F.coalesce(FILTERS[n](*(params or {}).get(n, ())), F.lit(False))
    return reads.where(test)


def failure_counts(reads: DataFrame, names: Iterable[str] = DEFAULT, params: dict[str, tuple] | None = None) -> DataFrame:
    """Reads that fail, by the first filter in order that they fail (``filter, n``)."""
    first = F.coalesce(*[F.when(~F.coalesce(FILTERS[n](*(params or {}).get(n, ())), F.lit(False)), n) for n in names])
    return reads.select(first.alias("filter")).where("filter is not null").groupBy("filter").agg(F.count(F.lit(1)).alias("n"))


# --- duplicates ---

def five_prime(reverse: Column | None = None) -> Column:
    """Where the read begins in the direction it was sequenced."""
    return F.when(col("reverse") if reverse is None else reverse, col("end_pos")).otherwise(col("start_pos"))


def duplicate_key(policy: str = "relaxed") -> list[Column]:
    """What duplicates have in common.

    ``relaxed`` compares strand, region and cigar, ``aggressive`` strand, contig and five-prime position; both with
    the sample and the mate's contig, state and template length.
    """
    mate = F.coalesce(F.concat_ws("|", "mate.contig", col("mate.unmapped").cast("string"), col("mate.reverse").cast("string"), col("mate.tlen").cast("string")), F.lit(""))
    key = [col("sample"), col("reverse"), col("contig"), F.when(col("mate").isNotNull(), mate).otherwise("none")]
    return key + ([col("start_pos"), col("end_pos"), C.to_text(col("cigar"))] if policy == "relaxed" else [five_prime()])


def remove_duplicates(reads: DataFrame, *, policy: str = "relaxed", id_cols: list[str] = ("name",)) -> DataFrame:
    """Of each group of duplicates the read with the largest sum of base qualities stays; ties by ``id_cols``, then by place and cigar.

    Zero-width reads are never duplicates.
    """
    insertion = (col("start_pos") == col("end_pos"))
    score = F.aggregate("quals", F.lit(0), lambda a, q: a + q)
    best = F.row_number().over(W.partitionBy(*duplicate_key(policy)).orderBy(score.desc(), *[col(c) for c in id_cols], "start_pos", "end_pos", C.to_text(col("cigar"))))
    whole = reads.where(~insertion).withColumn("_rank", best).where("_rank = 1").drop("_rank")
    return whole.unionByName(reads.where(insertion))


def with_duplicate_groups(reads: DataFrame, *, policy: str = "relaxed", name: str = "dup_group") -> DataFrame:
    """Add the group of duplicates a read is in; null for reads without a duplicate."""
    key = duplicate_key(policy)
    n = F.count(F.lit(1)).over(W.partitionBy(*key))
    return reads.withColumn(name, F.when((n > 1) & (col("start_pos") < col("end_pos")), F.xxhash64(*key)))


def copy_to_region(reads: DataFrame, begin: Column, end: Column) -> DataFrame:
    """Each read cut to [begin, end) of the reference: region, bases, qualities and cigar; reads outside of it go."""
    b, e = F.greatest("start_pos", begin), F.least("end_pos", end)
    x = reads.where((e > b) | ((e == b) & (col("start_pos") <= b))).withColumn("_b", b).withColumn("_e", e)
    cut = C.section(col("cigar"), col("start_pos"), col("_b"), col("_e"))
    x = x.withColumn("_cut", cut).withColumn("cigar", C.subregion(col("cigar"), col("start_pos"), col("_b"), col("_e")))
    x = x.withColumn("seq", F.substr("seq", col("_cut.off") + 1, col("_cut.size"))).withColumn("quals", F.slice("quals", col("_cut.off") + 1, col("_cut.size")))
    return x.withColumn("start_pos", col("_b")).withColumn("end_pos", col("_e")).drop("_b", "_e", "_cut")


# --- transforms ---

def _mask(test: Callable[[Column, Column], Column]) -> Column:
    return F.transform("quals", lambda q, i: F.when(test(q, i), F.lit(0).cast("smallint")).otherwise(q))


def _n() -> Column:
    return F.size("quals")


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of values that it uses at every base but that are worked out once a read."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def _mask_ends(front: Column | int, back: Column | int, part: Callable[[Column], Column] | None = None) -> Column:
    """Qualities with the first ``front`` and the last ``back`` at 0, or changed by ``part`` (which maps an array)."""
    count = lambda n: F.greatest(F.coalesce((F.lit(n) if isinstance(n, int) else n).cast("int"), F.lit(0)), F.lit(0))
    zeros = lambda xs: F.array_repeat(F.lit(0).cast("smallint"), F.size(xs))

    def masked(v: Column) -> Column:
        a = F.least(v["a"], _n())
        b = F.least(v["b"], _n() - a)
        piece = lambda begin, n: F.slice("quals", begin + 1, n)
        return F.concat((part or zeros)(piece(F.lit(0), a)), piece(a, _n() - a - b), (part or zeros)(piece(_n() - b, b)))

    return F.when(col("quals").isNotNull(), _let({"a": count(front), "b": count(back)}, masked))


class _Quality:
    """Stands for reads where only the qualities that a mask leaves are wanted."""

    def withColumn(self, name: str, value: Column) -> Column:  # noqa: N802
        return value


def masked_quality(mask: Callable[[DataFrame], DataFrame]) -> Column:
    """The qualities that ``mask`` leaves, as a column beside the reads' own (masks of single reads only)."""
    return mask(_Quality())


def capitalise_bases(reads: DataFrame) -> DataFrame:
    return reads.withColumn("seq", S.capitalise(col("seq")))


def cap_base_qualities(reads: DataFrame, most: int) -> DataFrame:
    return reads.withColumn("quals", F.transform("quals", lambda q: F.least(q, F.lit(most).cast("smallint"))))


def mask_overlapped_segment(reads: DataFrame) -> DataFrame:
    """Forward reads: the bases at the end that lie past the mate's begin."""
    n = F.when(~col("reverse") & (col("mate.contig") == col("contig")) & ~col("mate.unmapped"), F.greatest(col("end_pos") - col("mate.begin"), F.lit(0)))
    return reads.withColumn("quals", _mask_ends(0, n))


def mask_adapters(reads: DataFrame) -> DataFrame:
    """Proper pairs whose insert is shorter than the read: the three-prime bases beyond the insert."""
    insert = F.abs("mate.tlen")
    n = F.when((col("mate.contig") == col("contig")) & col("all_segments_aligned") & (insert < F.length("seq")), F.length("seq") - insert)
    return reads.withColumn("quals", _tail(F.coalesce(n, F.lit(0))))


def _tail(n: Column) -> Column:
    """The last ``n`` bases in the direction of sequencing."""
    return _mask_ends(F.when(col("reverse"), n), F.when(F.coalesce("reverse", F.lit(False)), 0).otherwise(n))


def mask_tail(reads: DataFrame, n: int) -> DataFrame:
    return reads.withColumn("quals", _tail(F.lit(n)))


def mask_low_quality_tails(reads: DataFrame, q: int) -> DataFrame:
    """From the three-prime end up to the first base of quality ``q``."""
    towards = F.when(col("reverse"), col("quals")).otherwise(F.reverse("quals"))
    n = F.array_position(F.concat(F.transform(towards, lambda x: x >= q), F.array(F.lit(True))), True) - 1
    return reads.withColumn("quals", _tail(n))


def _clips() -> tuple[Column, Column]:
    return C.soft_clip_sizes(col("cigar"))


def mask_soft_clipped(reads: DataFrame) -> DataFrame:
    return mask_soft_clipped_boundary_bases(reads, 0)


def _clipped_ends(n: int, part: Callable[[Column], Column] | None = None) -> Column:
    """The soft-clipped ends and the ``n`` bases next to each.  Ends may meet, where ``part`` is the same for both."""
    a, b = _clips()
    return _mask_ends(F.when(a > 0, a + n), F.when(b > 0, b + n), part)


def mask_soft_clipped_boundary_bases(reads: DataFrame, n: int) -> DataFrame:
    """Soft-clipped bases and the ``n`` next to them."""
    return reads.withColumn("quals", _clipped_ends(n))


def mask_low_quality_soft_clipped_bases(reads: DataFrame, q: int) -> DataFrame:
    return mask_low_quality_soft_clipped_boundary_bases(reads, 0, q)


def mask_low_quality_soft_clipped_boundary_bases(reads: DataFrame, n: int = 2, q: int = 3) -> DataFrame:
    low = lambda xs: F.transform(xs, lambda x: F.when(x < q, F.lit(0).cast("smallint")).otherwise(x))
    return reads.withColumn("quals", _clipped_ends(n, low))


def mask_low_average_quality_soft_clipped_tails(reads: DataFrame, q: int = 10, min_length: int = 5) -> DataFrame:
    """A soft-clipped end of at least ``min_length`` bases whose mean quality is below ``q``."""
    a, b = _clips()
    mean = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x) / F.greatest(F.size(xs), F.lit(1))
    bad_a = (a >= min_length) & (mean(F.slice("quals", 1, a)) < q)
    bad_b = (b >= min_length) & (mean(F.slice("quals", F.greatest(_n() - b + 1, F.lit(1)), b)) < q)
    return reads.withColumn("quals", _mask_ends(F.when(bad_a, a), F.when(bad_b, b)))


def clear_annotations(reads: DataFrame) -> DataFrame:
    return reads.withColumn("tags", F.create_map().cast("map<string,string>"))




def mask_inverted_soft_clipped_ends(reads: DataFrame, window: Column, min_length: int = 10) -> DataFrame:
    """Soft-clipped ends whose reverse complement occurs in ``window``, the reference around the read."""
    a, b = _clips()
    seq = col("seq")
    head = S.reverse_complement(F.substr(seq, F.lit(1), a))
    tail = S.reverse_complement(F.substr(seq, F.length(seq) - b + 1, F.length(seq)))
    bad_a, bad_b = (a >= min_length) & window.contains(head), (b >= min_length) & window.contains(tail)
    return reads.withColumn("quals", _mask_ends(F.when(bad_a, a), F.when(bad_b, b)))


def mask_3prime_shifted_soft_clipped_heads(reads: DataFrame, window: Column, min_length: int = 10) -> DataFrame:
    """Soft-clipped five-prime ends that occur as they are in ``window``, the reference on the three-prime side."""
    a, b = _clips()
    seq = col("seq")
    bad = F.when(col("reverse"), (b >= min_length) & window.contains(F.substr(seq, F.length(seq) - b + 1, F.length(seq)))).otherwise(
        (a >= min_length) & window.contains(F.substr(seq, F.lit(1), a)))
    back = F.coalesce("reverse", F.lit(False))
    return reads.withColumn("quals", _mask_ends(F.when(bad & ~back, a), F.when(bad & back, b)))


# --- templates: a read sees its mate through a window over (sample, name) ---

def with_mate(reads: DataFrame) -> DataFrame:
    """Add ``_other``: the other read of a template of two, null for other sizes.  Masks of templates add it for themselves if it is
    missing, so that several of them can share it; :func:`without_mate` takes it away."""
    order = W.partitionBy("sample", "name").orderBy("start_pos", "end_pos", "reverse")
    n = F.count(F.lit(1)).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    me = F.struct("start_pos", "end_pos", "reverse", "quals")
    return reads.withColumn("_other", F.when(n == 2, F.coalesce(F.lead(me).over(order), F.lag(me).over(order))))


def without_mate(reads: DataFrame) -> DataFrame:
    return reads.drop("_other")


def _masked(reads: DataFrame, quals: Callable[[], Column]) -> DataFrame:
    own = "_other" not in reads.columns
    x = (with_mate(reads) if own else reads).withColumn("quals", quals())
    return without_mate(x) if own else x


def mask_template_adapters(reads: DataFrame) -> DataFrame:
    """Templates of two reads on opposite strands: bases of one beyond the far end of the other (other sizes are left alone)."""
    o = col("_other")
    over = F.when(o.isNotNull() & (col("reverse") != o["reverse"]),
                  F.when(col("reverse"), F.greatest(o["start_pos"] - col("start_pos"), F.lit(0))).otherwise(F.greatest(col("end_pos") - o["end_pos"], F.lit(0))))
    return _masked(reads, lambda: _tail(F.coalesce(over, F.lit(0))))


def mask_strand_of_duplicated_bases(reads: DataFrame) -> DataFrame:
    """Bases that both reads of a template cover: the one of lower quality; ties alternate, the reverse read first."""
    o = col("_other")
    begin, end = F.greatest("start_pos", o["start_pos"]), F.least("end_pos", o["end_pos"])

    def test(q: Column, i: Column) -> Column:
        pos = col("start_pos") + i
        theirs = F.get(o["quals"], (pos - o["start_pos"]).cast("int"))
        turn = (pos - begin) % 2 == 0
        lose_tie = F.when(col("reverse"), turn).otherwise(~turn)
        return (pos >= begin) & (pos < end) & F.coalesce((q < theirs) | ((q == theirs) & lose_tie), F.lit(False))

    return _masked(reads, lambda: F.when(o.isNotNull() & (col("reverse") != o["reverse"]) & (begin < end), _mask(test)).otherwise(col("quals")))


def mask_clipped_duplicated_bases(reads: DataFrame) -> DataFrame:
    """Soft-clipped bases that the other read of the template covers."""
    a, b = _clips()
    o = col("_other")
    inside = lambda i: (col("start_pos") + i >= o["start_pos"]) & (col("start_pos") + i < o["end_pos"])
    masked = _let({"a": a, "b": b}, lambda v: _mask(lambda q, i: ((i < v["a"]) | (i >= _n() - v["b"])) & inside(i)))
    return _masked(reads, lambda: F.when(o.isNotNull() & C.is_soft_clipped(col("cigar")), masked).otherwise(col("quals")))


def fragment(reads: DataFrame, length: int) -> DataFrame:
    """Reads cut into pieces of ``length`` bases (the last may be shorter), with ``fragment`` from 0.

    Only the gapless parts of the columns are cut: sequence, qualities and region (one reference position a base).
    """
    n = F.length("seq")
    x = reads.select("*", F.posexplode(F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(length))).otherwise(F.array(F.lit(0)))).alias("fragment", "_at"))
    begin = col("start_pos") + col("_at")
    size = F.least(F.lit(length), n - col("_at"))
    out = x.withColumn("end_pos", F.when(n > 0, begin + size).otherwise(col("end_pos"))).withColumn("start_pos", begin).withColumn(
        "seq", F.substr("seq", col("_at") + 1, F.lit(length)))
    if "quals" in reads.columns:
        out = out.withColumn("quals", F.slice("quals", col("_at") + 1, length))
    return out.drop("_at")


def link_templates(reads: DataFrame, linkage: str = "paired") -> DataFrame:
    """Groups of linked reads: by name, by barcode (reads without one by name), or each on its own."""
    key = {"none": F.concat_ws("/", "name", F.monotonically_increasing_id().cast("string")), "paired": col("name"),
           "linked": F.coalesce("barcode", "name")}[linkage]
    members = F.sort_array(F.collect_list(F.struct("contig", "start_pos", "end_pos", "name", "seq", "mq")))
    return reads.groupBy("sample", key.alias("template")).agg(members.alias("reads"))


def downsample(reads: DataFrame, *, trigger: int = 1000, target: int = 500, keys: list[str] = ("sample", "contig"), order: Column | None = None,
               tile: int = 1 << 12) -> DataFrame:
    """Thin out regions deeper than ``target`` that reach more than ``trigger`` somewhere.

    A read of such a region stays if, at one of its positions at least, fewer than ``target`` of the reads there come before
    it in a hash order.  So every position keeps at least min(depth, target) reads, the choice depends only on the rows,
    and reads outside of such regions are untouched.
    """
    from .coverage import depth_runs

    keys = list(keys)
    runs = depth_runs(reads, keys)
    deep = runs.where(col("depth") > target)
    from .interval import covered_regions

    regions = covered_regions(deep, keys, aggs={"peak": F.max("depth")}).where(col("peak") > trigger)
    x = touches_islands(reads.withColumn("_order", F.xxhash64("name", "start_pos", "end_pos") if order is None else order), regions, "_deep", keys)
    # a tile's reads come in the order of the hash; a position counts up to ``target`` only, so that a tile holds one number a position
    hot = x.where("_deep").withColumn("_row", F.monotonically_increasing_id())
    last = F.greatest(col("end_pos") - 1, col("start_pos"))
    tiles = hot.withColumn("_tile", F.explode(F.sequence(F.floor(col("start_pos") / tile), F.floor(last / tile))))
    dealt = tiles.repartition(*keys, "_tile").sortWithinPartitions(*keys, "_tile", "_order", "name", "_row")
    kept = dealt.mapInPandas(_first_over_positions(keys, target, tile), dealt.schema).dropDuplicates(["_row"])
    return x.where("not _deep").unionByName(kept.drop("_row", "_tile")).drop("_deep", "_order")


def _first_over_positions(keys: list[str], target: int, tile: int) -> Callable[[Iterator], Iterator]:
    """Of rows by keys and tile, those that find fewer than ``target`` earlier rows at one of their positions in the tile."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np

        group, seen = None, np.zeros(tile, np.int64)
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            origin = pdf["_tile"].to_numpy() * tile
            begin = np.clip(pdf["start_pos"].to_numpy() - origin, 0, tile)
            end = np.clip(np.maximum(pdf["end_pos"].to_numpy(), pdf["start_pos"].to_numpy() + 1) - origin, 0, tile)
            for cell, rows in pdf.groupby([*keys, "_tile"], sort=False, dropna=False).indices.items():
                if cell != group:
                    group = cell
                    seen[:] = 0
                for at in np.array_split(rows, range(1024, len(rows), 1024)):
                    # positions that are full stay full, and rows over full positions alone change nothing
                    open_ = np.concatenate([[0], np.cumsum(seen < target)])
                    for i in at[open_[end[at]] > open_[begin[at]]]:
                        part = seen[begin[i]:end[i]]
                        keep[i] = part.min() < target
                        part += 1
            yield pdf[keep]
    return run
