"""Queries over normal forms of variants, set operations on calls, and interval operators beside the joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import coverage as V
from ..operators import interval as I
from ..operators import variants as N
from .call_queries import _REFERENCE, reference
from .interval_queries import GOOD, _DEPTH, _good, overlap_sql
from .registry import register

col = F.col


def variants(t):
    """Deletions of one to three bases that the reference holds, insertions of the bases in front of them, and replacements."""
    near = t("sites").select("site_id", "contig", (col("start_pos") % 20000 + 300).alias("start_pos")).withColumn("end_pos", col("start_pos") + 1 + col("site_id") % 3)
    from ..sources.text_formats import fetch_sequences

    x = fetch_sequences(near, reference(t), chunk=256, id_cols=["site_id"]).where(~col("ref_seq").contains("N"))
    kind = col("site_id") % 4
    ref = F.when(kind == 1, F.lit("")).otherwise(col("ref_seq"))
    alt = F.when(kind == 0, F.lit("")).when(kind == 1, col("ref_seq")).when(kind == 2, F.concat(F.substring("ref_seq", 1, 1), col("ref_seq"))).otherwise(F.reverse("ref_seq"))
    return x.select("site_id", "contig", "start_pos", (col("start_pos") + F.length(ref)).alias("end_pos"), ref.alias("ref"), alt.alias("alt"))


_VARIANTS = f"""{_REFERENCE},
v0 AS (SELECT site_id, contig, start_pos % 20000 + 300 AS s, 1 + site_id % 3 AS n FROM sites),
v1 AS (SELECT v0.*, string_agg(b, '' ORDER BY p) AS seq FROM v0 JOIN bs ON bs.contig = v0.contig AND p >= s AND p < s + n GROUP BY ALL HAVING count(*) = n),
va AS (SELECT site_id, contig, s AS start_pos, CASE WHEN site_id % 4 = 1 THEN '' ELSE seq END AS ref, CASE site_id % 4 WHEN 0 THEN '' WHEN 1 THEN seq WHEN 2 THEN seq[1:1] || seq ELSE reverse(seq) END AS alt FROM v1),
wd AS (SELECT va.*, w.seq AS before FROM va JOIN (SELECT va.site_id, string_agg(b, '' ORDER BY p) AS seq FROM va JOIN bs ON bs.contig = va.contig AND p >= start_pos - 300 AND p < start_pos GROUP BY va.site_id) w USING (site_id)),
sh AS (SELECT *, before || ref AS r, before || alt AS a FROM wd),
sn AS (SELECT *, CASE WHEN length(ref) = length(alt) THEN 0 ELSE (SELECT coalesce(min(j), least(length(r), length(a))) FROM (SELECT unnest(range(0, 301)) AS j) WHERE substring(reverse(r), CAST(j + 1 AS INT), 1) <> substring(reverse(a), CAST(j + 1 AS INT), 1)) END AS k FROM sh),
la AS (SELECT site_id, contig, start_pos - k AS start_pos, substring(r, CAST(length(before) - k + 1 AS INT), CAST(length(ref) AS INT)) AS ref, substring(a, CAST(length(before) - k + 1 AS INT), CAST(length(alt) AS INT)) AS alt FROM sn),
pb AS (SELECT la.*, bs.b AS base FROM la JOIN bs ON bs.contig = la.contig AND bs.p = la.start_pos - 1),
f1 AS (SELECT *, least(length(ref), length(alt)) AS m, (SELECT coalesce(min(j), least(length(ref), length(alt))) FROM (SELECT unnest(range(0, 5)) AS j) WHERE j < least(length(ref), length(alt)) AND substring(ref, CAST(j + 1 AS INT), 1) <> substring(alt, CAST(j + 1 AS INT), 1)) AS f FROM pb),
f2 AS (SELECT *, substring(ref, CAST(f + 1 AS INT)) AS r2, substring(alt, CAST(f + 1 AS INT)) AS a2 FROM f1),
f3 AS (SELECT *, least((SELECT coalesce(min(j), least(length(r2), length(a2))) FROM (SELECT unnest(range(0, 5)) AS j) WHERE j < least(length(r2), length(a2)) AND substring(reverse(r2), CAST(j + 1 AS INT), 1) <> substring(reverse(a2), CAST(j + 1 AS INT), 1)), m - f, greatest(m - 1, 0)) AS k FROM f2),
f4 AS (SELECT *, CASE WHEN f = m THEN m - 1 ELSE f END AS ff, CASE WHEN f = m THEN 0 ELSE k END AS kk FROM f3),
nm AS (SELECT site_id, contig, CASE WHEN m = 0 THEN start_pos - 1 ELSE start_pos + ff END AS start_pos, CASE WHEN m = 0 THEN base || ref ELSE substring(ref, CAST(ff + 1 AS INT), CAST(length(ref) - ff - kk AS INT)) END AS ref,
  CASE WHEN m = 0 THEN base || alt ELSE substring(alt, CAST(ff + 1 AS INT), CAST(length(alt) - ff - kk AS INT)) END AS alt FROM f4)"""
register("left_align", lambda t: N.left_align(variants(t), reference(t), chunk=256, window=16).select("site_id", "contig", "start_pos", "end_pos", "ref", "alt"), f"""
WITH {_VARIANTS} SELECT site_id, contig, start_pos, start_pos + length(ref) AS end_pos, ref, alt FROM la""", ("sites",))
register("normalise_variants", lambda t: N.normalise(variants(t), reference(t), chunk=256).select("site_id", "contig", "start_pos", "end_pos", "ref", "alt"), f"""
WITH {_VARIANTS} SELECT site_id, contig, start_pos, start_pos + length(ref) AS end_pos, ref, alt FROM nm""", ("sites",))
register("unique_left_align", lambda t: N.unique_left_align(variants(t), reference(t), chunk=256), f"""
WITH {_VARIANTS} SELECT DISTINCT contig, start_pos, start_pos + length(ref) AS end_pos, ref, alt FROM la""", ("sites",))
register("parsimonise_together", lambda t: N.parsimonise_together(variants(t).withColumn("g", F.floor(col("site_id") / 3)), reference(t), ["g"], chunk=256).select("site_id", "start_pos", "end_pos", "ref", "alt"), f"""
WITH {_VARIANTS}, g AS (SELECT va.*, bool_or(ref = '' OR alt = '') OVER (PARTITION BY site_id // 3) AS pad, bs.b FROM va JOIN bs ON bs.contig = va.contig AND bs.p = va.start_pos - 1)
SELECT site_id, CASE WHEN pad THEN start_pos - 1 ELSE start_pos END AS start_pos, start_pos + length(ref) AS end_pos, CASE WHEN pad THEN b || ref ELSE ref END AS ref, CASE WHEN pad THEN b || alt ELSE alt END AS alt FROM g""", ("sites",))
register("novel_variants", lambda t: N.novel_variants(variants(t).where("site_id % 2 = 0"), variants(t).where("site_id % 3 = 0")).select("contig", "start_pos", "ref", "alt"), f"""
WITH {_VARIANTS} SELECT contig, start_pos, ref, alt FROM va WHERE site_id % 2 = 0 EXCEPT SELECT contig, start_pos, ref, alt FROM va WHERE site_id % 3 = 0""", ("sites",))
register("haplotype_difference", lambda t: (lambda h: N.haplotype_difference(h.where("site_id % 2 = 0"), h.where("site_id % 2 = 1").withColumn("site_id", col("site_id") - 1), ["site_id"]).select(
    "site_id", F.concat_ws(",", F.transform(F.array_sort("allele_ids"), lambda a: a.cast("string"))).alias("alleles")))(t("sites").select(
        "site_id", F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: F.shiftright("site_id", 1).bitwiseXOR(col("site_id") * 5).cast("int").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) > 0).alias("allele_ids"))), """
WITH h AS (SELECT site_id, list_filter(range(8), lambda i: (xor(site_id >> 1, site_id * 5) & (1 << i)) > 0) AS al FROM sites)
SELECT a.site_id, array_to_string(list_filter(a.al, lambda x: NOT list_contains(coalesce(b.al, []), x)), ',') AS alleles FROM h a LEFT JOIN h b ON b.site_id = a.site_id + 1 WHERE a.site_id % 2 = 0""", ("sites",))


def connecting(t):
    x = t("calls").withColumn("end_pos", col("end_pos") + col("call_id") % 60).withColumn("window", F.floor(col("start_pos") / 1000)).withColumn("is_refcall", col("call_id") % 3 == 0)
    return N.resolve_connecting(x.select("call_id", "contig", "start_pos", "end_pos", "window", "is_refcall")).select("call_id", "window", "is_refcall")


register("connect_resolution", connecting, f"""
WITH c AS (SELECT call_id, contig, start_pos, end_pos + call_id % 60 AS end_pos, start_pos // 1000 AS wn, call_id % 3 = 0 AS is_refcall FROM calls),
k AS (SELECT * FROM c a WHERE NOT is_refcall AND NOT EXISTS (SELECT 1 FROM c b WHERE NOT b.is_refcall AND b.wn = a.wn + 1 AND {overlap_sql('a', 'b')}))
SELECT call_id, wn AS window, is_refcall FROM k UNION ALL SELECT call_id, wn, is_refcall FROM c a WHERE is_refcall AND NOT EXISTS (SELECT 1 FROM k b WHERE {overlap_sql('a', 'b')})""", ("calls",))

# --- interval operators ---
register("find_first_shared", lambda t: I.find_first_shared(t("calls").withColumn("end_pos", col("end_pos") + 2), t("reads").where("mq >= 40").select("read_id", "name", "contig", "start_pos", "end_pos"), "call_id").select("call_id", "first_shared"), f"""
WITH c AS (SELECT call_id, contig, start_pos, end_pos + 2 AS end_pos FROM calls), h AS (SELECT DISTINCT c.*, r.read_id, r.name, r.start_pos AS rs, r.end_pos AS re FROM c JOIN reads r ON mq >= 40 AND {overlap_sql('c', 'r')}),
p AS (SELECT a.call_id, b.call_id AS other, row_number() OVER (PARTITION BY a.call_id ORDER BY b.start_pos, b.end_pos, b.call_id) AS k FROM h a JOIN h b ON a.read_id = b.read_id AND a.name = b.name AND a.contig = b.contig AND a.rs = b.rs AND a.re = b.re
  AND (b.start_pos, b.end_pos, b.call_id) > (a.start_pos, a.end_pos, a.call_id))
SELECT c.call_id, p.other AS first_shared FROM c LEFT JOIN p ON p.call_id = c.call_id AND k = 1""", ("reads", "calls"))
register("has_coverage", lambda t: I.has_coverage(t("sites"), _good(t)).select("site_id", "covered"), f"""
WITH {GOOD} SELECT site_id, EXISTS (SELECT 1 FROM good g WHERE g.contig = s.contig AND least(g.end_pos, s.end_pos) > greatest(g.start_pos, s.start_pos)) AS covered FROM sites s""", ("reads", "sites"))
register("join_if", lambda t: I.join_if(I.covered_regions(t("sites")), lambda a, b: (b["start_pos"] - a["end_pos"] < 40) & (a["end_pos"] % 2 == b["start_pos"] % 2), ["start_pos", "end_pos"]), """
WITH m AS (SELECT *, max(end_pos) OVER (PARTITION BY contig ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sites),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_pos > reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS island FROM m),
i AS (SELECT contig, island, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM n GROUP BY contig, island),
l AS (SELECT *, lag(end_pos) OVER w AS pe FROM i WINDOW w AS (PARTITION BY contig ORDER BY start_pos)),
r AS (SELECT *, sum(CASE WHEN start_pos - pe < 40 AND pe % 2 = start_pos % 2 THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY start_pos) AS run FROM l)
SELECT contig, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n FROM r GROUP BY contig, run""", ("sites",))
register("bidirectionally_sorted_ranges", lambda t: I.bidirectionally_sorted_ranges(t("calls").withColumn("end_pos", col("end_pos") + col("call_id") % 70).select("contig", "start_pos", "end_pos").distinct()).groupBy(
    "contig", "range_no").agg(F.min("start_pos").alias("begin"), F.max("end_pos").alias("end_"), F.count(F.lit(1)).alias("n")).drop("range_no"), """
WITH c AS (SELECT DISTINCT contig, start_pos, end_pos + call_id % 70 AS end_pos FROM calls),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY start_pos, end_pos) AS k FROM (SELECT *, CASE WHEN end_pos < lag(end_pos) OVER (PARTITION BY contig ORDER BY start_pos, end_pos) THEN 1 ELSE 0 END AS fresh FROM c))
SELECT contig, min(start_pos) AS begin, max(end_pos) AS end_, count(*) AS n FROM r GROUP BY contig, k""", ("calls",))
register("intervening_within", lambda t: I.intervening_regions(t("calls"), within=t("sites").withColumn("end_pos", col("end_pos") + 150)).groupBy("contig").agg(
    F.count(F.lit(1)).alias("n"), F.sum(col("end_pos") - col("start_pos")).alias("n_positions"), F.min("start_pos").alias("first")), """
WITH a AS (SELECT DISTINCT contig, unnest(range(start_pos, end_pos + 150)) AS p FROM sites), b AS (SELECT DISTINCT contig, start_pos AS p FROM calls), d AS (SELECT * FROM a EXCEPT SELECT * FROM b),
e AS (SELECT *, p - row_number() OVER (PARTITION BY contig ORDER BY p) AS g FROM d), r AS (SELECT contig, g, min(p) AS s, max(p) + 1 AS e FROM e GROUP BY contig, g)
SELECT contig, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS n_positions, min(s) AS first FROM r GROUP BY contig""", ("calls", "sites"))
register("uniform_coverage_regions", lambda t: V.uniform_coverage_regions(V.depth_runs(t("reads")), 1), _DEPTH + """,
l AS (SELECT *, CASE WHEN abs(depth - lag(depth) OVER (PARTITION BY contig ORDER BY start_pos)) <= 1 THEN 0 ELSE 1 END AS fresh FROM runs),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY start_pos) AS run FROM l)
SELECT contig, min(start_pos) AS start_pos, max(end_pos) AS end_pos, min(depth) AS min_depth, max(depth) AS max_depth FROM k GROUP BY contig, run""", ("reads",))
register("refetch_covered", lambda t: (lambda r: I.count_overlapped(r, t("reads"), "n_reads"))(I.covered_regions(t("sites").withColumn("end_pos", col("end_pos") + 20))), f"""
WITH m AS (SELECT contig, start_pos, end_pos + 20 AS end_pos, max(end_pos + 20) OVER (PARTITION BY contig ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sites),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_pos > reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS island FROM m),
i AS (SELECT contig, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM n GROUP BY contig, island)
SELECT i.contig, i.start_pos, i.end_pos, count(r.read_id) AS n_reads FROM i LEFT JOIN reads r ON {overlap_sql('i', 'r')} GROUP BY ALL""", ("reads", "sites"))
register("sample_coverage_counts", lambda t: (lambda d: d.groupBy("contig").agg(F.count_if(col("max_depth") > 0).alias("n_samples"), F.sum("max_depth").alias("sum_max"), F.sum("min_depth").alias("sum_min")))(
    V.depth_stats(V.depth_runs(t("reads"), ["sample", "contig"]), ["sample", "contig"])), """
WITH ev AS (SELECT sample, contig, start_pos AS p, 1 AS d FROM reads UNION ALL SELECT sample, contig, end_pos, -1 FROM reads), st AS (SELECT sample, contig, p, sum(d) AS d FROM ev GROUP BY ALL),
r AS (SELECT sample, contig, sum(d) OVER (PARTITION BY sample, contig ORDER BY p) AS depth, lead(p) OVER (PARTITION BY sample, contig ORDER BY p) AS nx FROM st),
m AS (SELECT sample, contig, max(depth) AS hi, min(depth) AS lo FROM r WHERE nx IS NOT NULL GROUP BY ALL)
SELECT contig, count(*) FILTER (WHERE hi > 0) AS n_samples, CAST(sum(hi) AS BIGINT) AS sum_max, CAST(sum(lo) AS BIGINT) AS sum_min FROM m GROUP BY contig""", ("reads",))
del W
