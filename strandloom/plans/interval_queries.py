"""Queries over the interval join and set-algebra operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import regions as R
from ..operators import coverage as V
from ..operators import interval as I
from .registry import register

col = F.col


def overlap_sql(a: str, b: str) -> str:
    """The overlap rule with empty regions."""
    n = f"(least({a}.end_pos, {b}.end_pos) - greatest({a}.start_pos, {b}.start_pos))"
    return f"({a}.contig = {b}.contig AND ({n} > 0 OR ({n} = 0 AND ({a}.start_pos = {a}.end_pos OR {b}.start_pos = {b}.end_pos))))"


def _good(t):
    return t("reads").where("mq >= 40 and not is_duplicate")


GOOD = "good AS (SELECT * FROM reads WHERE mq >= 40 AND NOT is_duplicate)"

# --- region algebra ---

register("region_algebra", lambda t: (lambda x: x.select(
    "a_id", "b_id", R.is_before(R.Region(col("ab"), col("ae")), R.Region(col("bb"), col("be"))).alias("is_before"),
    R.is_after(R.Region(col("ab"), col("ae")), R.Region(col("bb"), col("be"))).alias("is_after"),
    R.are_adjacent(R.Region(col("ab"), col("ae")), R.Region(col("bb"), col("be"))).alias("adjacent"),
    R.overlap_size(R.Region(col("ab"), col("ae")), R.Region(col("bb"), col("be"))).alias("overlap_size"),
    R.overlaps(R.Region(col("ab"), col("ae")), R.Region(col("bb"), col("be"))).alias("overlaps"),
    R.contains(R.Region(col("ab"), col("ae")), R.Region(col("bb"), col("be"))).alias("contains"),
    R.inner_distance(R.Region(col("ab"), col("ae")), R.Region(col("bb"), col("be"))).alias("inner_distance"),
    R.outer_distance(R.Region(col("ab"), col("ae")), R.Region(col("bb"), col("be"))).alias("outer_distance"),
    R.left_overhang_size(R.Region(col("ab"), col("ae")), R.Region(col("bb"), col("be"))).alias("left_overhang"),
    R.right_overhang_size(R.Region(col("ab"), col("ae")), R.Region(col("bb"), col("be"))).alias("right_overhang"),
    R.encompassing_region(R.Region(col("ab"), col("ae")), R.Region(col("bb"), col("be"))).begin.alias("enc_begin"),
    R.encompassing_region(R.Region(col("ab"), col("ae")), R.Region(col("bb"), col("be"))).end.alias("enc_end"),
    R.overlapped_region(R.Region(col("ab"), col("ae")), R.Region(col("bb"), col("be"))).begin.alias("ov_begin"),
    R.intervening_region(R.Region(col("ab"), col("ae")), R.Region(col("bb"), col("be"))).end.alias("gap_end"),
    R.head_region(R.Region(col("ab"), col("ae")), 2).end.alias("head_end"),
    R.tail_region(R.Region(col("ab"), col("ae")), 2).begin.alias("tail_begin"),
    R.expand(R.Region(col("ab"), col("ae")), 3).begin.alias("expanded_begin"),
))(t("part").selectExpr("p_partkey a_id", "p_partkey % 13 ab", "p_partkey % 13 + p_size % 5 ae").join(
    t("part").selectExpr("p_partkey b_id", "p_partkey % 11 bb", "p_partkey % 11 + p_size % 4 be"), F.expr("a_id div 12 = b_id div 12"))), """
WITH x AS (SELECT * FROM (SELECT p_partkey a_id, p_partkey % 13 ab, p_partkey % 13 + p_size % 5 ae FROM part) JOIN
  (SELECT p_partkey b_id, p_partkey % 11 bb, p_partkey % 11 + p_size % 4 be FROM part) ON a_id // 12 = b_id // 12),
y AS (SELECT *, least(ae, be) - greatest(ab, bb) AS n FROM x),
z AS (SELECT *, n > 0 OR (n = 0 AND (ab = ae OR bb = be)) AS ov, NOT (ab = bb AND ae = be) AS differ FROM y)
SELECT a_id, b_id, ae <= bb AND differ AS is_before, be <= ab AND differ AS is_after, ab = be OR ae = bb AS adjacent,
  n AS overlap_size, ov AS overlaps, ab <= bb AND be <= ae AS contains,
  CASE WHEN ov THEN 0 WHEN ae <= bb AND differ THEN bb - ae ELSE be - ab END AS inner_distance,
  CASE WHEN (ab <= bb AND be <= ae) OR (bb <= ab AND ae <= be) THEN 0 ELSE be - ab END AS outer_distance,
  greatest(bb - ab, 0) AS left_overhang, greatest(ae - be, 0) AS right_overhang, least(ab, bb) AS enc_begin, greatest(ae, be) AS enc_end,
  CASE WHEN ov THEN greatest(ab, bb) END AS ov_begin, CASE WHEN ab <= bb AND NOT ov THEN bb END AS gap_end,
  least(ab + 2, ae) AS head_end, greatest(ae - 2, 0) AS tail_begin, greatest(ab - 3, 0) AS expanded_begin FROM z""")

# --- joins ---

register("overlap_join", lambda t: I.interval_join(t("reads"), t("sites")).select(
    "l.read_id", "l.name", "r.site_id", R.overlap_size(R.Region.of("l"), R.Region.of("r")).alias("overlap")), f"""
SELECT a.read_id, a.name, b.site_id, least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos) AS overlap
FROM reads a JOIN sites b ON {overlap_sql('a', 'b')}""", ("reads", "sites"))
register("copy_overlapped", lambda t: I.copy_overlapped(t("sites"), _good(t)).select("site_id", "contig", "start_pos", "end_pos"), f"""
WITH {GOOD} SELECT site_id, contig, start_pos, end_pos FROM sites s WHERE EXISTS (SELECT 1 FROM good g WHERE {overlap_sql('s', 'g')})""", ("reads", "sites"))
register("copy_nonoverlapped", lambda t: I.copy_nonoverlapped(t("sites"), _good(t)).select("site_id", "contig", "start_pos", "end_pos"), f"""
WITH {GOOD} SELECT site_id, contig, start_pos, end_pos FROM sites s WHERE NOT EXISTS (SELECT 1 FROM good g WHERE {overlap_sql('s', 'g')})""", ("reads", "sites"))
register("has_overlapped", lambda t: I.has_overlapped(t("sites"), _good(t)).select("site_id", "found"), f"""
WITH {GOOD} SELECT site_id, EXISTS (SELECT 1 FROM good g WHERE {overlap_sql('s', 'g')}) AS found FROM sites s""", ("reads", "sites"))
register("count_overlapped", lambda t: I.count_overlapped(t("sites"), t("reads"), "n_reads").select("site_id", "n_reads"), f"""
SELECT s.site_id, count(r.read_id) AS n_reads FROM sites s LEFT JOIN reads r ON {overlap_sql('s', 'r')} GROUP BY s.site_id""", ("reads", "sites"))


def _best(largest: bool):
    return lambda t: I.best_overlapped(
        t("sites"), t("reads").select("read_id", "contig", "start_pos", "end_pos"), {"read_id": col("r.read_id"), "overlap": R.overlap_size(R.Region.of("l"), R.Region.of("r"))},
        largest=largest, ties=[col("r.read_id")]).select("site_id", "read_id", "overlap")


for _name, _largest, _order in (("max_overlapped", True, "DESC"), ("min_overlapped", False, "ASC")):
    register(_name, _best(_largest), f"""
WITH p AS (SELECT s.site_id, r.read_id, least(s.end_pos, r.end_pos) - greatest(s.start_pos, r.start_pos) AS overlap FROM sites s JOIN reads r ON {overlap_sql('s', 'r')}),
q AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY overlap {_order}, read_id) AS k FROM p)
SELECT s.site_id, q.read_id, q.overlap FROM sites s LEFT JOIN q ON s.site_id = q.site_id AND k = 1""", ("reads", "sites"))

register("has_exact_overlap", lambda t: t("sites").join(
    t("reads").select("contig", "start_pos", (col("start_pos") + F.pmod("read_id", F.lit(4))).alias("end_pos")).distinct(),
    ["contig", "start_pos", "end_pos"], "left_semi").select("site_id"), """
SELECT site_id FROM sites s WHERE EXISTS (SELECT 1 FROM reads r WHERE r.contig = s.contig AND r.start_pos = s.start_pos AND r.start_pos + r.read_id % 4 = s.end_pos)""", ("reads", "sites"))
_CONTAINED = "a.contig = b.contig AND a.start_pos <= b.start_pos AND b.end_pos <= a.end_pos"
register("contained_count", lambda t: I.count_overlapped(t("reads").where("mq > 50").select("read_id", "name", "contig", "start_pos", "end_pos"), t("sites"), relation="contained").groupBy(
    "read_id", "name").agg(F.max("n").alias("n_contained")), f"""
SELECT read_id, name, max(n) AS n_contained FROM (SELECT a.rid, a.read_id, a.name, count(b.site_id) AS n
  FROM (SELECT *, row_number() OVER () AS rid FROM reads WHERE mq > 50) a LEFT JOIN sites b ON {_CONTAINED} GROUP BY a.rid, a.read_id, a.name)
GROUP BY read_id, name""", ("reads", "sites"))
register("copy_contained", lambda t: I.copy_overlapped(t("sites"), t("reads"), predicate=lambda a, b: R.contains(b, a)).select("site_id"),
         "SELECT site_id FROM sites b WHERE EXISTS (SELECT 1 FROM reads a WHERE " + _CONTAINED + ")", ("reads", "sites"))
register("copy_noncontained", lambda t: I.copy_nonoverlapped(t("sites"), t("reads"), predicate=lambda a, b: R.contains(b, a)).select("site_id"),
         "SELECT site_id FROM sites b WHERE NOT EXISTS (SELECT 1 FROM reads a WHERE " + _CONTAINED + ")", ("reads", "sites"))
register("count_spanning", lambda t: I.count_overlapped(t("sites"), t("reads"), "n_spanning", relation="spanning").select("site_id", "n_spanning"), f"""
SELECT b.site_id, count(a.read_id) AS n_spanning FROM sites b LEFT JOIN reads a ON {_CONTAINED} AND {overlap_sql('a', 'b')} GROUP BY b.site_id""", ("reads", "sites"))


def _pairs(t):
    w = W.partitionBy("contig").orderBy("start_pos", "call_id")
    me = F.struct("call_id", "contig", "start_pos", "end_pos")
    return t("calls").select(me.alias("first"), F.lead(me).over(w).alias("second")).where("second is not null")


register("count_shared", lambda t: I.count_shared(_pairs(t), t("reads")).select(
    col("first.call_id").alias("call_id"), "n_shared"), f"""
WITH nx AS (SELECT call_id, contig, start_pos, end_pos, lead(call_id) OVER w AS id2, lead(start_pos) OVER w AS s2, lead(end_pos) OVER w AS e2
  FROM calls WINDOW w AS (PARTITION BY contig ORDER BY start_pos, call_id)),
hits AS (SELECT c.call_id, r.read_id, r.name, r.sample FROM nx c JOIN reads r ON {overlap_sql('c', 'r')}
  WHERE c.id2 IS NOT NULL AND least(r.end_pos, c.e2) - greatest(r.start_pos, c.s2) > 0)
SELECT c.call_id, count(h.read_id) AS n_shared FROM nx c LEFT JOIN hits h ON h.call_id = c.call_id WHERE c.id2 IS NOT NULL GROUP BY c.call_id""", ("reads", "calls"))
register("first_after", lambda t: I.first_after(t("sites"), t("calls"), {"call_id": col("call_id"), "next_begin": col("start_pos")}).select(
    "site_id", "call_id", "next_begin"), """
SELECT s.site_id, c.call_id, c.start_pos AS next_begin FROM sites s LEFT JOIN LATERAL (
  SELECT call_id, start_pos FROM calls c WHERE c.contig = s.contig AND c.start_pos >= s.end_pos ORDER BY start_pos, call_id LIMIT 1) c ON true""", ("sites", "calls"))
register("adjacent_overlaps", lambda t: t("calls").withColumn("prev_end", F.lag("end_pos").over(W.partitionBy("contig").orderBy("start_pos", "call_id")))
         .groupBy("contig").agg(F.count_if(col("start_pos") < col("prev_end")).alias("n_overlapping"), F.count_if(col("start_pos") == col("prev_end")).alias("n_adjacent"),
                                F.count(F.lit(1)).alias("n")), """
SELECT contig, count(*) FILTER (WHERE start_pos < prev_end) AS n_overlapping, count(*) FILTER (WHERE start_pos = prev_end) AS n_adjacent, count(*) AS n
FROM (SELECT *, lag(end_pos) OVER (PARTITION BY contig ORDER BY start_pos, call_id) AS prev_end FROM calls) GROUP BY contig""", ("calls",))

# --- set algebra ---

_ISLANDS = """
WITH m AS (SELECT *, max(end_pos) OVER (PARTITION BY contig ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
n AS (SELECT *, CASE WHEN reach IS NULL OR {new} THEN 1 ELSE 0 END AS fresh FROM m),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY start_pos, end_pos, fresh DESC ROWS UNBOUNDED PRECEDING) AS island FROM n),
islands AS (SELECT contig, island, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n FROM k GROUP BY contig, island)
"""


def _islands(src: str, new: str) -> str:
    return _ISLANDS.format(src=src, new=new)


def _n():
    return {"n": F.count(F.lit(1))}


register("covered_regions", lambda t: I.covered_regions(t("sites"), aggs=_n()), _islands("sites", "start_pos > reach") +
         "SELECT contig, start_pos, end_pos, n FROM islands", ("sites",))
register("covered_regions_reads", lambda t: I.covered_regions(t("reads"), ["contig"], aggs=_n()), _islands("reads", "start_pos > reach") +
         "SELECT contig, start_pos, end_pos, n FROM islands", ("reads",))
register("mutually_exclusive_regions", lambda t: I.mutually_exclusive_regions(t("calls"), aggs=_n()),
         _islands("calls", "start_pos > reach OR (start_pos = reach AND start_pos < end_pos)") + "SELECT contig, start_pos, end_pos, n FROM islands", ("calls",))
register("join_within_gap", lambda t: I.islands(t("sites"), gap=20, aggs=_n()), _islands("sites", "start_pos > reach + 20") +
         "SELECT contig, start_pos, end_pos, n FROM islands", ("sites",))
register("intervening_regions", lambda t: I.intervening_regions(t("sites")), _islands("sites", "start_pos > reach") + """
SELECT contig, end_pos AS start_pos, nxt AS end_pos FROM (SELECT *, lead(start_pos) OVER (PARTITION BY contig ORDER BY start_pos) AS nxt FROM islands) WHERE nxt IS NOT NULL""", ("sites",))
register("covered_sizes", lambda t: I.covered_regions(t("reads")).groupBy("contig").agg(F.count(F.lit(1)).alias("n_regions"), F.sum(col("end_pos") - col("start_pos")).alias("n_positions")),
         _islands("reads", "start_pos > reach") + "SELECT contig, count(*) AS n_regions, CAST(sum(end_pos - start_pos) AS BIGINT) AS n_positions FROM islands GROUP BY contig", ("reads",))
_POS = "SELECT DISTINCT contig, unnest(range(start_pos, end_pos)) AS p FROM {src}"
register("search_regions", lambda t: I.subtract(
    t("reads").select("contig", "start_pos", "end_pos"), t("sites").select("contig", (col("start_pos") - 5).alias("start_pos"), (col("end_pos") + 5).alias("end_pos")))
    .groupBy("contig").agg(F.count(F.lit(1)).alias("n_regions"), F.sum(col("end_pos") - col("start_pos")).alias("n_positions"), F.min("start_pos").alias("first"), F.max("end_pos").alias("last")), f"""
WITH inc AS ({_POS.format(src='reads')}), exc AS (SELECT DISTINCT contig, unnest(range(start_pos - 5, end_pos + 5)) AS p FROM sites),
d AS (SELECT * FROM inc EXCEPT SELECT * FROM exc), e AS (SELECT *, p - row_number() OVER (PARTITION BY contig ORDER BY p) AS g FROM d),
r AS (SELECT contig, g, min(p) AS start_pos, max(p) + 1 AS end_pos FROM e GROUP BY contig, g)
SELECT contig, count(*) AS n_regions, CAST(sum(end_pos - start_pos) AS BIGINT) AS n_positions, min(start_pos) AS first, max(end_pos) AS last FROM r GROUP BY contig""", ("reads", "sites"))
register("decompose_windows", lambda t: I.decompose(t("sites").withColumn("end_pos", col("start_pos") + 1500 + col("site_id") % 100), 600, 200).select("site_id", "start_pos", "end_pos"), """
SELECT site_id, b AS start_pos, least(b + 600, e) AS end_pos FROM (SELECT site_id, start_pos + 1500 + site_id % 100 AS e, unnest(range(start_pos, start_pos + 1500 + site_id % 100, 400)) AS b FROM sites)""", ("sites",))
register("decompose_positions", lambda t: I.decompose(t("sites")).select("site_id", "start_pos", "end_pos"),
         "SELECT site_id, p AS start_pos, p + 1 AS end_pos FROM (SELECT site_id, unnest(range(start_pos, end_pos)) AS p FROM sites)", ("sites",))
register("positional_seeds", lambda t: I.positional_seeds(t("reads")), "SELECT contig, start_pos AS pos, count(*) AS n FROM reads GROUP BY contig, start_pos", ("reads",))
register("segment_by_region", lambda t: t("reads").groupBy("contig", "start_pos", "end_pos").agg(F.count(F.lit(1)).alias("n"), F.max("mq").alias("max_mq")),
         "SELECT contig, start_pos, end_pos, count(*) AS n, max(mq) AS max_mq FROM reads GROUP BY contig, start_pos, end_pos", ("reads",))
register("segment_by_end", lambda t: t("reads").groupBy("contig", "end_pos").agg(F.count(F.lit(1)).alias("n"), F.min("start_pos").alias("first_begin")),
         "SELECT contig, end_pos, count(*) AS n, min(start_pos) AS first_begin FROM reads GROUP BY contig, end_pos", ("reads",))
register("extreme_mappables", lambda t: t("reads").groupBy("sample", "contig").agg(
    F.min_by("read_id", F.struct("start_pos", "end_pos", "read_id")).alias("leftmost"), F.max_by("read_id", F.struct("end_pos", "start_pos", "read_id")).alias("rightmost"),
    F.max_by("read_id", F.struct(col("end_pos") - col("start_pos"), "read_id")).alias("largest"), F.min_by("read_id", F.struct(col("end_pos") - col("start_pos"), "read_id")).alias("smallest"),
    F.min("start_pos").alias("enc_begin"), F.max("end_pos").alias("enc_end"), F.sum(col("end_pos") - col("start_pos")).alias("sum_sizes")), """
SELECT sample, contig, arg_min(read_id, (start_pos, end_pos, read_id)) AS leftmost, arg_max(read_id, (end_pos, start_pos, read_id)) AS rightmost,
  arg_max(read_id, (end_pos - start_pos, read_id)) AS largest, arg_min(read_id, (end_pos - start_pos, read_id)) AS smallest,
  min(start_pos) AS enc_begin, max(end_pos) AS enc_end, CAST(sum(end_pos - start_pos) AS BIGINT) AS sum_sizes FROM reads GROUP BY sample, contig""", ("reads",))
register("bidirectionally_sorted", lambda t: I.is_bidirectionally_sorted(t("reads"), ["sample", "contig"]), """
SELECT sample, contig, bool_and(reach IS NULL OR end_pos >= reach) AS sorted_both_ways FROM (
  SELECT *, max(end_pos) OVER (PARTITION BY sample, contig ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM reads)
GROUP BY sample, contig""", ("reads",))

# --- coverage ---

_DEPTH = """
WITH ev AS (SELECT contig, start_pos AS p, 1 AS d FROM reads UNION ALL SELECT contig, end_pos, -1 FROM reads),
st AS (SELECT contig, p, sum(d) AS d FROM ev GROUP BY contig, p),
run AS (SELECT contig, p AS start_pos, lead(p) OVER (PARTITION BY contig ORDER BY p) AS end_pos, CAST(sum(d) OVER (PARTITION BY contig ORDER BY p) AS BIGINT) AS depth FROM st),
runs AS (SELECT * FROM run WHERE end_pos IS NOT NULL)
"""
register("depth_runs", lambda t: V.depth_runs(t("reads")), _DEPTH + "SELECT contig, start_pos, end_pos, depth FROM runs", ("reads",))
register("depth_stats", lambda t: V.depth_stats(V.depth_runs(t("reads"))).select(
    "contig", "n_positions", "sum_depth", "max_depth", "min_depth", F.round("mean_depth", 6).alias("mean_depth"), F.round("stdev_depth", 6).alias("stdev_depth")), _DEPTH + """
SELECT contig, CAST(sum(end_pos - start_pos) AS BIGINT) AS n_positions, CAST(sum(depth * (end_pos - start_pos)) AS BIGINT) AS sum_depth, max(depth) AS max_depth, min(depth) AS min_depth,
  round(sum(depth * (end_pos - start_pos)) / sum(end_pos - start_pos), 6) AS mean_depth,
  round(sqrt(greatest(sum(depth * depth * (end_pos - start_pos)) / sum(end_pos - start_pos) - pow(sum(depth * (end_pos - start_pos)) / sum(end_pos - start_pos), 2), 0)), 6) AS stdev_depth
FROM runs GROUP BY contig""", ("reads",))
register("high_coverage_regions", lambda t: V.high_coverage_regions(V.depth_runs(t("reads")), 12), _DEPTH + """,
hot AS (SELECT *, CASE WHEN start_pos > max(end_pos) OVER (PARTITION BY contig ORDER BY start_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM runs WHERE depth > 12),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY start_pos) AS k FROM hot)
SELECT contig, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM isl GROUP BY contig, k""", ("reads",))
register("site_max_depth", lambda t: V.depth_at(t("calls"), _good(t)).select("call_id", "max_depth"), f"""
WITH {GOOD} SELECT c.call_id, count(g.read_id) AS max_depth FROM calls c LEFT JOIN good g ON {overlap_sql('c', 'g')} GROUP BY c.call_id""", ("reads", "calls"))
register("sample_depth_sum", lambda t: (lambda d: d.groupBy("contig").agg(F.sum("max_depth").alias("sum_of_max"), F.count(F.lit(1)).alias("n_samples")))(
    V.depth_stats(V.depth_runs(t("reads"), ["sample", "contig"]), ["sample", "contig"])), """
WITH ev AS (SELECT sample, contig, start_pos AS p, 1 AS d FROM reads UNION ALL SELECT sample, contig, end_pos, -1 FROM reads),
st AS (SELECT sample, contig, p, sum(d) AS d FROM ev GROUP BY ALL), r AS (SELECT sample, contig, sum(d) OVER (PARTITION BY sample, contig ORDER BY p) AS depth FROM st),
m AS (SELECT sample, contig, max(depth) AS x FROM r GROUP BY ALL)
SELECT contig, CAST(sum(x) AS BIGINT) AS sum_of_max, count(*) AS n_samples FROM m GROUP BY contig""", ("reads",))
