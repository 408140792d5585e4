"""Queries over variants, measures, call filters, genotype models and phasing."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import alleles as A
from ..functions import cigar as C
from ..functions import numeric as N
from ..operators import interval as I
from ..operators.coverage import depth_at
from ..operators.reads import with_duplicate_groups
from ..sources.derive import ALIGNED_SQL, aligned
from . import filters as X
from . import genotypes as G
from . import measures as M
from . import phasing as P
from .facets import contamination, support_rows, suspects, with_phase_length, with_reference_context, with_repeat_context
from .haplotypes import repeat_table
from .interval_queries import overlap_sql
from .registry import register

col = F.col


def R6(c, name):
    return F.round(c, 6).alias(name)


# --- flagship: depth, mapping quality and strand of sites, filtered by an expression ---

def depth_filter(t):
    reads = t("reads").where("mq >= 5 and not is_duplicate")
    x = I.sum_overlapped(t("sites"), reads, {"DP": F.lit(1), "_squares": col("mq").cast("long") * col("mq"), "n_forward": col("is_forward"), "n_reverse": ~col("is_forward")})
    x = x.withColumn("MQ", F.when(col("DP") > 0, F.sqrt(col("_squares") / col("DP"))))
    x = X.threshold_filter(x, "DP < 2 | MQ < 20")
    return x.select("site_id", "contig", "start_pos", "end_pos", "DP", R6(col("MQ"), "MQ"), "n_forward", "n_reverse",
                    F.when(F.size("filter") == 0, "PASS").otherwise(F.array_join("filter", ";")).alias("filter"))


register("depth_filter", depth_filter, f"""
WITH good AS (SELECT * FROM reads WHERE mq >= 5 AND NOT is_duplicate),
x AS (SELECT s.site_id, s.contig, s.start_pos, s.end_pos, count(r.read_id) AS dp, sqrt(avg(r.mq * r.mq)) AS rms,
  count(*) FILTER (WHERE r.is_forward) AS n_forward, count(*) FILTER (WHERE NOT r.is_forward) AS n_reverse
  FROM sites s LEFT JOIN good r ON {overlap_sql('s', 'r')} GROUP BY ALL)
SELECT site_id, contig, start_pos, end_pos, dp AS DP, round(rms, 6) AS MQ, n_forward, n_reverse,
  CASE WHEN dp < 2 AND rms < 20 THEN 'DP;MQ' WHEN dp < 2 THEN 'DP' WHEN rms < 20 THEN 'MQ' ELSE 'PASS' END AS filter FROM x""", ("reads", "sites"))
register("call_thresholds", lambda t: X.threshold_filter(t("calls").select("call_id", col("qual").alias("QUAL"), col("gq").alias("GQ"), col("pp").alias("PP"), col("mp").alias("MP")),
         "QUAL < 10 | GQ < 20 | PP <= 5.5 | MP == 3", "QUAL < 2").select("call_id", F.array_join("filter", ";").alias("filter")), """
SELECT call_id, concat_ws(';', CASE WHEN qual < 10 THEN 'q10' END, CASE WHEN gq < 20 THEN 'GQ' END, CASE WHEN pp <= 5.5 THEN 'LPP' END, CASE WHEN mp = 3 THEN 'MP' END) AS filter
FROM calls WHERE NOT qual < 2""", ("calls",))
register("conditional_thresholds", lambda t: X.conditional_filter(
    t("calls").select("call_id", col("qual").alias("QUAL"), col("gq").alias("GQ"), col("is_somatic").alias("SOMATIC"), ((col("gt1") == 0) & (col("gt2") == 0)).alias("REFCALL")),
    X.germline_somatic_chooser(), {"somatic": "QUAL < 150 | GQ < 40", "refcall": "GQ < 10", "germline": "QUAL < 50 | GQ < 5"}).select("call_id", F.array_join("filter", ";").alias("filter")), """
SELECT call_id, CASE WHEN is_somatic THEN concat_ws(';', CASE WHEN qual < 150 THEN 'LQ' END, CASE WHEN gq < 40 THEN 'GQ' END)
  WHEN gt1 = 0 AND gt2 = 0 THEN concat_ws(';', CASE WHEN gq < 10 THEN 'GQ' END)
  ELSE concat_ws(';', CASE WHEN qual < 50 THEN 'LQ' END, CASE WHEN gq < 5 THEN 'GQ' END) END AS filter FROM calls""", ("calls",))
register("merge_sample_filters", lambda t: X.merge_samples(X.threshold_filter(
    t("calls").select((col("call_id") % 500).alias("call_id"), col("qual").alias("QUAL"), col("gq").alias("GQ")), "QUAL < 200 | GQ < 30"), quality="GQ").select(
    "call_id", "is_filtered", F.array_join("reasons", ";").alias("reasons"), R6(col("joint_quality"), "joint_quality")), """
WITH x AS (SELECT call_id % 500 AS call_id, qual < 200 AS lq, gq < 30 AS lg, gq FROM calls)
SELECT call_id, bool_and(lq OR lg) AS is_filtered, concat_ws(';', CASE WHEN bool_or(lg) THEN 'GQ' END, CASE WHEN bool_or(lq) THEN 'LQ' END) AS reasons,
  round(CASE WHEN min(gq) <= 0 THEN 0 ELSE -10 * log10(1 - exp(avg(ln(1 - pow(10, -gq / 10.0)) ) FILTER (WHERE gq > 0))) END, 6) AS joint_quality FROM x GROUP BY call_id""", ("calls",))

# --- measures over overlapping reads and an allele support table ---


def facets(t):
    """Calls of one to three bases with two alternatives; genotypes that differ by sample, somatic ones with a third allele;
    reads with clips and indels; support by the first base that a read shows on the call (a T is ambiguous)."""
    ref = F.substr(F.lit("ACG"), F.lit(1), (col("call_id") % 3 + 1).cast("int"))
    calls = t("calls").select(
        "call_id", "contig", "start_pos", (col("end_pos") + col("call_id") % 3).alias("end_pos"), ref.alias("ref"),
        F.array(F.concat(F.lit("G"), F.substr(ref, F.lit(2))), F.when(col("call_id") % 7 == 0, "C").otherwise(F.concat(F.lit("C"), F.substr(ref, F.lit(2))))).alias("alts"),
        "qual", "pp", "mp", "is_somatic", (col("call_id") % 11 == 0).alias("is_denovo"), (col("pp") / 2).alias("ppp"))
    gts = t("calls").select("call_id", "gt1", "gt2", "gq", "is_somatic", "mp", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i"))
    own = F.array((col("gt1") + col("i")) % 3, col("gt2"))
    gts = gts.select("call_id", F.concat(F.lit("S"), col("i").cast("string")).alias("sample"),
                     F.when(col("is_somatic") & (col("i") == 2), F.concat(own, F.array(F.lit(2)))).otherwise(own).alias("gt"), "gq", F.lit(2).alias("ploidy"),
                     F.when(col("i") > 0, col("mp") + col("i")).alias("gt_mp"), (col("i") == 0).alias("is_child"))
    raw = aligned(t)
    reads = with_duplicate_groups(raw.where("mq >= 20"), policy="aggressive").withColumn("ln_likelihood", -(col("read_id") % 37) / 3.0).withColumn("gapless", C.is_gapless(col("cigar")))
    reads = reads.withColumn("read_non_matches", C.sum_non_matches(col("cigar"))).withColumn("expected_errors", M.expected_errors())
    return calls, gts, reads, raw


def support_of(calls, reads):
    x = I.interval_join(calls, reads)
    cut = C.section(col("r.cigar"), col("r.start_pos"), col("l.start_pos"), col("l.end_pos"), gapless=col("r.gapless"), stop=col("r.end_pos"))
    base = F.substr("r.seq", cut["off"] + 1, F.least(cut["size"], F.lit(1)))
    x = x.withColumn("base", base).withColumn("allele", F.when(col("base") == "A", 0).when(col("base") == "G", 1).when(col("base") == "C", 2))
    ambiguous = x.where("base = 'T'").select(col("l.call_id").alias("call_id"), col("r.sample").alias("sample"))
    return support_rows(x.where("allele is not null")).withColumn("is_somatic_allele", col("allele") == 2), ambiguous


def _measures(names):
    def plan(t):
        calls, gts, reads, raw = facets(t)
        support, ambiguous = support_of(calls, reads)
        return M.evaluate(M.Facets(calls, gts, reads, raw, support, ambiguous), names)
    return plan


def _offset_sql(pos: str) -> str:
    """Bases of a read in front of a reference position behind whose base insertions count."""
    turn = "(start_pos + front + m1)"
    return (f"least(greatest({pos} - start_pos, 0), front + m1) + CASE WHEN ins > 0 AND {turn} <= {pos} THEN ins ELSE 0 END"
            f" + least(greatest({pos} - {turn} - del, 0), m2 + back)")


_OV = ALIGNED_SQL + f""",
rd AS (SELECT *, ins + del AS non_match, concat_ws('|', sample, reverse, contig, CASE WHEN reverse THEN end_pos ELSE start_pos END, CASE WHEN has_mate THEN
    concat_ws('|', mate_contig, mate_unmapped, mate_reverse, tlen) ELSE 'none' END) AS dup_key FROM al WHERE mq >= 20),
rg AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY dup_key) > 1 AND start_pos < end_pos THEN dup_key END AS dup_group FROM rd),
c0 AS (SELECT call_id, contig, start_pos, end_pos + call_id % 3 AS end_pos, substring('ACG', 1, CAST(1 + call_id % 3 AS INT)) AS ref, qual, pp, mp, is_somatic, call_id % 11 = 0 AS is_denovo, gt1, gt2, gq FROM calls),
ca AS (SELECT *, ['G' || substring(ref, 2), CASE WHEN call_id % 7 = 0 THEN 'C' ELSE 'C' || substring(ref, 2) END] AS alts FROM c0),
gt AS (SELECT ca.*, 'S' || CAST(i AS VARCHAR) AS sample, i, list_concat([(gt1 + i) % 3, gt2], CASE WHEN is_somatic AND i = 2 THEN [2] ELSE [] END) AS gt FROM ca, (SELECT unnest([0, 1, 2]) AS i)),
ov AS (SELECT c.call_id, c.start_pos AS cs, c.end_pos AS ce, c.ref, c.alts, r.* FROM ca c JOIN rg r ON {overlap_sql('c', 'r')}),
o2 AS (SELECT *, {_offset_sql('cs')} AS off, {_offset_sql('ce')} AS upto FROM ov),
o3 AS (SELECT *, substring(seq, CAST(off + 1 AS INT), CAST(upto - off AS INT)) AS sec FROM o2),
o4 AS (SELECT *, CASE sec[1:1] WHEN 'A' THEN 0 WHEN 'G' THEN 1 WHEN 'C' THEN 2 END AS a FROM o3),
o5 AS (SELECT o4.*, gt.gt, is_somatic, list_concat([o4.ref], o4.alts)[a + 1] AS allele_seq, o4.start_pos <= cs AND ce <= o4.end_pos AS inside FROM o4 JOIN gt ON gt.call_id = o4.call_id AND gt.sample = o4.sample
  WHERE a IS NOT NULL AND list_contains(gt.gt, a)),
o6 AS (SELECT *, NOT inside AND start_pos >= cs AS backwards, CAST(least(length(sec), length(allele_seq)) AS INT) AS nc FROM o5),
sp AS (SELECT *, CASE WHEN backwards THEN right(sec, nc) ELSE left(sec, nc) END AS s1, CASE WHEN backwards THEN right(allele_seq, nc) ELSE left(allele_seq, nc) END AS s2 FROM o6),
ps AS (SELECT call_id, contig, unnest(range(start_pos, end_pos)) AS p FROM ca),
dp AS (SELECT call_id, sample, max(n) AS dp, max(n_raw) AS raw FROM (SELECT call_id, p, r.sample, count(*) FILTER (WHERE mq >= 20) AS n, count(*) AS n_raw
  FROM ps JOIN al r ON r.contig = ps.contig AND r.start_pos <= p AND p < r.end_pos GROUP BY ALL) GROUP BY ALL),
rs AS (SELECT call_id, sample, count(*) AS n, max(length(seq)) AS mrl, count(*) FILTER (WHERE sec[1:1] = 'T') AS amb, count(*) FILTER (WHERE NOT reverse) AS fw, count(*) FILTER (WHERE reverse) AS rv FROM o3 GROUP BY ALL)"""
_BY_SAMPLE = ["DP", "QD", "GQ", "GQD", "PPD", "MP", "MPD", "FRF", "MRL", "ARF", "ADP", "REFCALL", "SOMATIC", "SHC", "CC", "PP", "PPP", "VL", "DENOVO", "MC", "MF", "BMC", "BMF", "BMQ", "SMQ", "MRC"]
register("call_measures_by_sample", lambda t: _measures(_BY_SAMPLE)(t).select(
    "call_id", "sample", *[F.round(c, 6).alias(c.lower()) for c in ("QD", "GQD", "PPD", "MP", "MPD", "FRF", "ARF", "CC", "PP", "PPP", "MF", "BMF", "SMQ", "GQ")],
    *[col(c).cast("long").alias(c.lower()) for c in ("DP", "MRL", "ADP", "SHC", "VL", "MC", "BMC", "BMQ", "MRC")], *[col(c).alias(c.lower()) for c in ("REFCALL", "SOMATIC", "DENOVO")]), f"""
WITH {_OV},
m AS (SELECT call_id, sample, count(*) AS adp, count(*) FILTER (WHERE CASE WHEN inside THEN sec <> allele_seq ELSE length(sec) > length(allele_seq) OR s1 <> s2 END) AS mc,
  CAST(sum(list_sum(list_transform(range(1, nc + 1), lambda i: CAST(s1[i:i] <> s2[i:i] AS INT)))) AS BIGINT) AS bmc,
  median(list_min(list_transform(list_filter(range(1, nc + 1), lambda i: s1[i:i] <> s2[i:i]), lambda i: quals[CAST(off + i + CASE WHEN backwards THEN greatest(least(greatest(upto - off, 1), n_quals - off), 0) - nc ELSE 0 END AS INT)]))) AS bmq,
  median(mq) FILTER (WHERE a = 2 AND is_somatic) AS smq, count(*) FILTER (WHERE non_match > 5 * ceil(list_sum(list_transform(quals, lambda q: pow(10.0, -(q // 10)))))) AS mrc FROM sp GROUP BY ALL),
x AS (SELECT gt.*, coalesce(dp.dp, 0) AS d, coalesce(dp.raw, 0) AS dr, rs.n, rs.mrl, coalesce(rs.amb, 0) AS amb, coalesce(m.adp, 0) AS adp, coalesce(m.mc, 0) AS mc, coalesce(m.bmc, 0) AS bmc, m.bmq, m.smq, coalesce(m.mrc, 0) AS mrc,
  CASE WHEN i > 0 THEN mp + i ELSE mp END AS own_mp, list_max(list_transform(gt.gt, lambda g: greatest(length(list_concat([ref], alts)[g + 1]), end_pos - start_pos))) AS vl
  FROM gt LEFT JOIN dp ON dp.call_id = gt.call_id AND dp.sample = gt.sample LEFT JOIN rs ON rs.call_id = gt.call_id AND rs.sample = gt.sample LEFT JOIN m ON m.call_id = gt.call_id AND m.sample = gt.sample)
SELECT call_id, sample, round(CASE WHEN d > 0 THEN qual / d END, 6) AS qd, round(CASE WHEN d > 0 THEN gq / d END, 6) AS gqd, round(CASE WHEN d > 0 THEN pp / d END, 6) AS ppd, own_mp AS mp,
  round(CASE WHEN d > 0 THEN own_mp / d END, 6) AS mpd, round(CASE WHEN dr > 0 THEN 1 - d / dr ELSE 0 END, 6) AS frf, round(amb / n, 6) AS arf, round(CASE WHEN qual <= 0 THEN 0 ELSE pp / qual END, 6) AS cc,
  pp, pp / 2 AS ppp, round(CASE WHEN d > 0 THEN mc / d ELSE 0 END, 6) AS mf, round(CASE WHEN d * vl > 0 THEN bmc / (d * vl) ELSE 0 END, 6) AS bmf, smq, CAST(gq AS DOUBLE) AS gq,
  d AS dp, mrl, adp, CASE WHEN is_somatic THEN len(gt) - 2 ELSE 0 END AS shc, vl, mc, bmc, CAST(floor(bmq) AS BIGINT) AS bmq, mrc,
  list_max(gt) = 0 AS refcall, is_somatic AND len(gt) > 2 AND list_max(gt) > 0 AS somatic, is_denovo AND i = 0 AS denovo FROM x""", ("aligned", "calls"))
register("call_measures_pooled", lambda t: _measures(["MQ", "MQ0", "CRF"])(t).select("call_id", "sample", R6(col("MQ"), "mq"), col("MQ0").alias("mq0"), R6(col("CRF"), "crf")), f"""
WITH {_OV}, p AS (SELECT call_id, sqrt(avg(mq * mq)) AS mq, count(*) FILTER (WHERE mq = 0) AS mq0, count(*) FILTER (WHERE (front + back) / len > 0.25) / count(*) AS crf FROM ov GROUP BY call_id)
SELECT gt.call_id, sample, round(p.mq, 6) AS mq, coalesce(mq0, 0) AS mq0, round(crf, 6) AS crf FROM gt LEFT JOIN p ON p.call_id = gt.call_id""", ("aligned", "calls"))
_BY_ALLELE = ["AD", "AF", "AFB", "AMQ", "AC", "ITV", "BQ", "ER", "ERS", "DAD", "DAF", "MHL"]
_ALLELES = """
al3 AS (SELECT gt.*, a, list_concat([ref], alts)[a + 1] AS seq_a, list_contains(gt, a) AS called FROM gt, (SELECT unnest([0, 1, 2]) AS a)),
u AS (SELECT call_id, sample, a, count(*) AS ad, median(mq) AS amq, median(list_min(quals[CAST(off + 1 AS INT):CAST(off + greatest(upto - off, 1) AS INT)])) AS bq, sum(non_match) / sum(len) AS er,
  stddev_pop(non_match / len) AS ers, floor(avg(floor(read_id % 37 / 3.0 * 10 / ln(10)))) AS mhl FROM sp GROUP BY ALL),
dg AS (SELECT call_id, sample, a, CAST(sum(CASE WHEN n > 1 THEN n - 1 ELSE 1 END) AS BIGINT) AS dad FROM (SELECT call_id, sample, a, dup_group, count(*) AS n FROM sp WHERE dup_group IS NOT NULL GROUP BY ALL) GROUP BY ALL),
ad AS (SELECT call_id, sample, count(*) AS adp FROM sp GROUP BY ALL),
y AS (SELECT al3.*, CASE WHEN called THEN coalesce(u.ad, 0) END AS ad, amq, bq, er, ers, mhl, CASE WHEN called THEN coalesce(dad, 0) END AS dad, coalesce(ad.adp, 0) AS adp, len(list_filter(gt, lambda g: g = al3.a)) AS copies
  FROM al3 LEFT JOIN u ON u.call_id = al3.call_id AND u.sample = al3.sample AND u.a = al3.a LEFT JOIN dg ON dg.call_id = al3.call_id AND dg.sample = al3.sample AND dg.a = al3.a
  LEFT JOIN ad ON ad.call_id = al3.call_id AND ad.sample = al3.sample),
z AS (SELECT *, CASE WHEN called THEN CASE WHEN adp = 0 THEN 1.0 ELSE ad / adp END END AS af FROM y)"""
register("call_measures_by_allele", lambda t: _measures(_BY_ALLELE)(t).select(
    "call_id", "sample", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(2)).alias("i"), *_BY_ALLELE)).alias("z")).select(
    "call_id", "sample", col("z.i").cast("long").alias("allele"), *[F.round(f"z.{c}", 6).alias(c.lower()) for c in ("AF", "AFB", "AMQ", "ER", "ERS", "DAF")],
    *[col(f"z.{c}").cast("long").alias(c.lower()) for c in ("AD", "AC", "BQ", "DAD", "MHL")], col("z.ITV").alias("itv")), f"""
WITH {_OV}, {_ALLELES}
SELECT call_id, sample, CAST(a AS BIGINT) AS allele, round(af, 6) AS af, round(abs(copies / len(gt) - af), 6) AS afb, amq, round(er, 6) AS er, round(ers, 6) AS ers,
  round(CASE WHEN ad > 0 THEN dad / ad WHEN called THEN 0 END, 6) AS daf, ad, CASE WHEN a > 0 THEN copies END AS ac, CASE WHEN length(seq_a) = length(ref) THEN CAST(floor(bq) AS BIGINT) END AS bq, dad, CAST(mhl AS BIGINT) AS mhl,
  CASE WHEN a > 0 THEN length(ref) = 1 AND a = 2 END AS itv FROM z""", ("aligned", "calls"))
_CDF = "list_sum(list_transform(range({a}, {a} + {b}), lambda j: exp(lgamma({a} + {b}) - lgamma(j + 1) - lgamma({a} + {b} - j) + j * ln({x}) + ({a} + {b} - 1 - j) * ln(1 - {x}))))"
_TAIL = ("exp({a} * ln(0.01) + {b} * ln(0.99) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b})) * (1 + list_sum(list_transform(range(0, 40), "
         "lambda n: exp(lgamma({a} + 1) + lgamma({a} + {b} + n + 1) - lgamma({a} + n + 2) - lgamma({a} + {b}) + (n + 1) * ln(0.01)))))")
_BIAS = ["SB", "SD", "MQD", "RSB", "REB", "RTB", "SF", "DPC"]
register("call_measures_bias", lambda t: _measures(_BIAS)(t).select("call_id", "sample", *[F.round(col(c).cast("double"), 5).alias(c.lower()) for c in _BIAS]), f"""
WITH {_OV},
h AS (SELECT *, (end_pos - start_pos) // 2 AS half, greatest(floor(len * 0.03), 1) AS eb FROM sp),
k AS (SELECT *, ce - cs >= half AS large, least(ce, end_pos) > greatest(cs, start_pos + half) AS rhs, cs >= start_pos AND ce <= start_pos + eb AS head, cs >= end_pos - eb AND ce <= end_pos AS tail FROM h),
c AS (SELECT call_id, sample, a, count(*) AS n, count(*) FILTER (WHERE NOT reverse) AS nf, count(*) FILTER (WHERE reverse) AS nr, median(mq) AS mq, count(*) FILTER (WHERE supplementary) AS ns,
  count(*) FILTER (WHERE large OR NOT rhs) AS nl, count(*) FILTER (WHERE large OR rhs) AS nri, count(*) FILTER (WHERE inside AND (head OR tail)) AS ne, count(*) FILTER (WHERE inside AND NOT (head OR tail)) AS nm,
  count(*) FILTER (WHERE inside AND CASE WHEN reverse THEN head ELSE tail END) AS nt, count(*) FILTER (WHERE inside AND NOT CASE WHEN reverse THEN head ELSE tail END) AS nh FROM k GROUP BY ALL),
g AS (SELECT call_id, sample, gt, unnest(list_distinct(gt)) AS a FROM gt),
e AS (SELECT g.*, coalesce(n, 0) AS n, coalesce(nf, 0) AS nf, coalesce(nr, 0) AS nr, mq, coalesce(ns, 0) AS ns, coalesce(nl, 0) + 1 AS b1, coalesce(nri, 0) + 1 AS b2, coalesce(nm, 0) + 1 AS b3, coalesce(ne, 0) + 1 AS b4,
  coalesce(nh, 0) + 1 AS b5, coalesce(nt, 0) + 1 AS b6 FROM g LEFT JOIN c ON c.call_id = g.call_id AND c.sample = g.sample AND c.a = g.a),
f AS (SELECT call_id, sample, max(floor(mq)) - min(floor(mq)) AS mqd, max({_CDF.format(a='b1', b='b2', x='0.25')} + 1 - {_CDF.format(a='b1', b='b2', x='0.75')}) AS rsb,
  max({_CDF.format(a='b3', b='b4', x='0.09')}) AS reb, max({_CDF.format(a='b5', b='b6', x='0.09')}) AS rtb, max(CASE WHEN a = 1 AND n > 0 THEN ns / n END) AS x1, max(CASE WHEN a = 2 AND n > 0 THEN ns / n END) AS x2
  FROM e GROUP BY ALL),
fr AS (SELECT DISTINCT nf, nr FROM e),
w0 AS (SELECT nf, nr, i, nf * ln((i + 0.5) / 200) + nr * ln(1 - (i + 0.5) / 200) AS l FROM fr, (SELECT unnest(range(200)) AS i)),
w1 AS (SELECT *, exp(l - max(l) OVER (PARTITION BY nf, nr)) AS v FROM w0),
w AS (SELECT nf, nr, i, v / sum(v) OVER (PARTITION BY nf, nr) AS w, sum(v) OVER (PARTITION BY nf, nr ORDER BY i) / sum(v) OVER (PARTITION BY nf, nr) AS cum FROM w1),
pr AS (SELECT x.call_id, x.sample, x.nf AS f1, x.nr AS r1, y.nf AS f2, y.nr AS r2 FROM e x JOIN e y ON x.call_id = y.call_id AND x.sample = y.sample AND x.a < y.a),
q AS (SELECT DISTINCT f1, r1, f2, r2 FROM pr),
df AS (SELECT f1, r1, f2, r2, sum(a.w * (coalesce(lo.cum, 0) + 1 - coalesce(hi.cum, 1))) AS p FROM q JOIN w a ON a.nf = f1 AND a.nr = r1 LEFT JOIN w lo ON lo.nf = f2 AND lo.nr = r2 AND lo.i = a.i - 51
  LEFT JOIN w hi ON hi.nf = f2 AND hi.nr = r2 AND hi.i = a.i + 50 GROUP BY ALL),
sb AS (SELECT call_id, sample, max(p) AS sb FROM pr JOIN df USING (f1, r1, f2, r2) GROUP BY ALL),
dq AS (SELECT call_id, sample, dup_group, a, count(DISTINCT name) AS n FROM sp WHERE dup_group IS NOT NULL GROUP BY ALL),
dn AS (SELECT call_id, sample, dup_group, CASE WHEN count(*) < 2 THEN 1.0 ELSE 1 - least(log2(sum(n)) - sum(n * log2(n)) / sum(n), 1) END AS c FROM dq GROUP BY ALL),
dm AS (SELECT call_id, sample, min(c) AS dpc FROM dn GROUP BY ALL),
x AS (SELECT gt.*, coalesce(rs.fw, 0) + 0.5 AS fa, coalesce(rs.rv, 0) + 0.5 AS ra FROM gt LEFT JOIN rs ON rs.call_id = gt.call_id AND rs.sample = gt.sample)
SELECT x.call_id, x.sample, round(CASE WHEN len(list_distinct(gt)) > 1 THEN sb.sb END, 5) AS sb, round({_TAIL.format(a='fa', b='ra')} + {_TAIL.format(a='ra', b='fa')}, 5) AS sd,
  CASE WHEN len(list_distinct(gt)) > 1 THEN mqd END AS mqd, round(rsb, 5) AS rsb, round(reb, 5) AS reb, round(rtb, 5) AS rtb,
  round(CASE WHEN list_max(gt) > 0 THEN coalesce(x1, 0) + CASE WHEN x2 IS NULL THEN 0 ELSE greatest(coalesce(x1, 0), x2) END END, 5) AS sf, round(CASE WHEN list_max(gt) > 0 THEN dm.dpc END, 5) AS dpc
FROM x LEFT JOIN dm ON dm.call_id = x.call_id AND dm.sample = x.sample LEFT JOIN f ON f.call_id = x.call_id AND f.sample = x.sample LEFT JOIN sb ON sb.call_id = x.call_id AND sb.sample = x.sample""", ("aligned", "calls"))
register("forest_features", lambda t: X.features(_measures(["QUAL", "DP", "MQ", "AD", "AF", "GQ"])(t), ["QUAL", "DP", "MQ", "AD", "AF", "GQ"]).select(
    "call_id", "sample", "QUAL", "DP", R6(col("MQ"), "MQ"), "AD", R6(col("AF"), "AF"), "GQ"), f"""
WITH {_OV}, {_ALLELES}, p AS (SELECT call_id, sqrt(avg(mq * mq)) AS mq FROM ov GROUP BY call_id),
v AS (SELECT call_id, sample, min(ad) FILTER (WHERE a > 0) AS ad, min(af) FILTER (WHERE a > 0) AS af FROM z GROUP BY ALL)
SELECT gt.call_id, gt.sample, qual AS QUAL, CAST(coalesce(dp.dp, 0) AS DOUBLE) AS DP, round(coalesce(p.mq, -1.0), 6) AS MQ, CAST(coalesce(v.ad, -1) AS DOUBLE) AS AD, round(coalesce(v.af, -1.0), 6) AS AF, CAST(gq AS DOUBLE) AS GQ
FROM gt LEFT JOIN dp ON dp.call_id = gt.call_id AND dp.sample = gt.sample LEFT JOIN p ON p.call_id = gt.call_id LEFT JOIN v ON v.call_id = gt.call_id AND v.sample = gt.sample""", ("aligned", "calls"))
register("call_depth_and_counts", lambda t: depth_at(I.count_overlapped(t("calls").withColumn("end_pos", col("end_pos") + col("call_id") % 3), t("reads")), t("reads")).select("call_id", "max_depth", "n"), f"""
WITH c AS (SELECT call_id, contig, start_pos, end_pos + call_id % 3 AS end_pos FROM calls), p AS (SELECT call_id, contig, unnest(range(start_pos, end_pos)) AS p FROM c),
d AS (SELECT call_id, max(n) AS n FROM (SELECT call_id, p, count(*) AS n FROM p JOIN reads r ON r.contig = p.contig AND r.start_pos <= p AND p < r.end_pos GROUP BY ALL) GROUP BY call_id),
n AS (SELECT c.call_id, count(r.read_id) AS n FROM c LEFT JOIN reads r ON {overlap_sql('c', 'r')} GROUP BY c.call_id)
SELECT call_id, coalesce(d.n, 0) AS max_depth, n.n FROM n LEFT JOIN d USING (call_id)""", ("reads", "calls"))

# --- measures from the reference, repeats, phase blocks and contamination ---


def reference(t):
    """Pieces of 256 bases, as many as there are parts; contigs end where the pieces do."""
    bases = F.concat(*[F.md5(F.concat(F.lit(f"{i}/"), col("p_partkey").cast("string"))) for i in range(8)])
    k = F.floor(col("p_partkey") / 5)
    return t("part").select((col("p_partkey") % 5).cast("string").alias("contig"), k.cast("int").alias("chunk"), (k * 256).alias("chunk_start"), F.translate(bases, "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))


_REFERENCE = """rf AS (SELECT CAST(p_partkey % 5 AS VARCHAR) AS contig, p_partkey // 5 AS chunk, translate(md5('0/' || CAST(p_partkey AS VARCHAR)) || md5('1/' || CAST(p_partkey AS VARCHAR)) || md5('2/' || CAST(p_partkey AS VARCHAR)) ||
  md5('3/' || CAST(p_partkey AS VARCHAR)) || md5('4/' || CAST(p_partkey AS VARCHAR)) || md5('5/' || CAST(p_partkey AS VARCHAR)) || md5('6/' || CAST(p_partkey AS VARCHAR)) || md5('7/' || CAST(p_partkey AS VARCHAR)),
  '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM part),
bs AS (SELECT contig, chunk * 256 + i - 1 AS p, seq[i:i] AS b FROM (SELECT *, unnest(range(1, 257)) AS i FROM rf))"""
_REPEATS = """rp AS (WITH nx AS (SELECT contig, p, b, lead(b, 1) OVER w AS n1, lead(b, 2) OVER w AS n2, lead(b, 3) OVER w AS n3 FROM bs WINDOW w AS (PARTITION BY contig ORDER BY p)),
  eq AS (SELECT contig, p, b, n1, n2, q FROM nx, (SELECT unnest([1, 2, 3]) AS q) WHERE b = CASE q WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE n3 END),
  isl AS (SELECT *, p - row_number() OVER (PARTITION BY contig, q ORDER BY p) AS g FROM eq),
  run AS (SELECT contig, q, min(p) AS s, max(p) + 1 + q AS e, arg_min(b, p) AS x, arg_min(n1, p) AS y, arg_min(n2, p) AS z FROM isl GROUP BY contig, q, g HAVING count(*) >= 2 * q)
  SELECT contig, s AS start_pos, e AS end_pos, CAST(q AS BIGINT) AS period FROM run WHERE q = 1 OR NOT (x = y AND (q = 2 OR y = z)))"""


def repeats(t):
    return repeat_table(reference(t), max_period=3, min_periods=3)


register("reference_repeats", lambda t: repeats(t).withColumn("period", col("period").cast("long")), f"""
WITH {_REFERENCE}, {_REPEATS} SELECT contig, start_pos, end_pos, period FROM rp""")


def context_calls(t):
    calls, gts, *_ = facets(t)
    calls = with_repeat_context(with_reference_context(calls, reference(t), chunk=256), repeats(t), gts)
    return M.evaluate(M.Facets(calls, gts), ["GC", "STRL", "STRP"]).where("sample = 'S0'").select("call_id", R6(col("GC"), "gc"), col("STRL").cast("long").alias("strl"), col("STRP").cast("long").alias("strp"))


register("call_context_measures", context_calls, f"""
WITH {_OV}, {_REFERENCE}, {_REPEATS},
cx AS (SELECT call_id, count(*) FILTER (WHERE b IN ('G', 'C')) AS gc FROM (SELECT call_id, b FROM ca JOIN bs ON bs.contig = ca.contig AND p >= greatest(start_pos - 50, 0) AND p < end_pos + 50) GROUP BY call_id),
cg AS (SELECT call_id, list_distinct(flatten(list(gt))) AS called FROM gt GROUP BY call_id),
al2 AS (SELECT ca.call_id, unnest(called) AS a FROM ca JOIN cg USING (call_id)),
ar AS (SELECT call_id, ca.contig, start_pos + CASE WHEN a > 0 AND length(alts[a]) <> length(ref) AND alts[a][1:1] = ref[1:1] OR a = 0 AND len(list_filter(alts, lambda x: length(x) <> length(ref) AND x[1:1] = ref[1:1])) > 0 THEN 1 ELSE 0 END AS b,
  end_pos AS e FROM ca JOIN al2 USING (call_id)),
jn AS (SELECT c.call_id, c.start_pos AS cs, c.end_pos AS ce, r.* FROM ca c JOIN rp r ON r.contig = c.contig AND r.start_pos <= c.end_pos + 1 AND r.end_pos >= greatest(c.start_pos - 1, 0)),
ht AS (SELECT jn.*, EXISTS (SELECT 1 FROM ar WHERE ar.call_id = jn.call_id AND (least(ar.e, jn.end_pos) - greatest(ar.b, jn.start_pos) > 0 OR least(ar.e, jn.end_pos) = greatest(ar.b, jn.start_pos) AND ar.b = ar.e)) AS hit FROM jn
  WHERE least(jn.end_pos, ce + 1) - greatest(jn.start_pos, greatest(cs - 1, 0)) > 0),
ch AS (SELECT call_id, end_pos - start_pos AS size, period, row_number() OVER (PARTITION BY call_id ORDER BY least(end_pos, ce) - greatest(greatest(start_pos - 1, 0), cs) DESC, end_pos DESC, start_pos, period) AS k FROM ht
  WHERE hit AND greatest(start_pos - 1, 0) <= cs AND ce <= end_pos + 1),
fb AS (SELECT call_id, end_pos - start_pos AS size, period, hit, row_number() OVER (PARTITION BY call_id ORDER BY least(end_pos, ce) - greatest(start_pos, cs) DESC, start_pos, end_pos, period) AS k FROM ht WHERE least(end_pos, ce) - greatest(start_pos, cs) > 0)
SELECT ca.call_id, round(coalesce(gc, 0) / (end_pos + 50 - greatest(start_pos - 50, 0)), 6) AS gc, coalesce(ch.size, CASE WHEN NOT fb.hit THEN fb.size END, 0) AS strl, coalesce(ch.period, CASE WHEN NOT fb.hit THEN fb.period END, 0) AS strp
FROM ca LEFT JOIN cx USING (call_id) LEFT JOIN ch ON ch.call_id = ca.call_id AND ch.k = 1 LEFT JOIN fb ON fb.call_id = ca.call_id AND fb.k = 1""", ("aligned", "calls", "sites"))


def phase_lengths(t):
    calls, gts, *_ = facets(t)
    gts = gts.withColumn("phase_set", F.when(col("call_id") % 4 > 0, F.floor(col("call_id") / 16)))
    return M.evaluate(M.Facets(calls, with_phase_length(gts, calls)), ["PLN"]).select("call_id", "sample", col("PLN").alias("pln"))


register("call_phase_lengths", phase_lengths, """
WITH g AS (SELECT call_id, contig, start_pos, end_pos + call_id % 3 AS end_pos, CASE WHEN call_id % 4 > 0 THEN call_id // 16 END AS ps, s FROM calls, (SELECT unnest(['S0', 'S1', 'S2']) AS s))
SELECT call_id, s AS sample, CASE WHEN ps IS NULL THEN end_pos - start_pos ELSE max(end_pos) OVER w - min(start_pos) OVER w END AS pln FROM g WINDOW w AS (PARTITION BY s, contig, ps)""", ("calls",))


def contaminations(t):
    """Each block as a call; the third sample is the child, or the tumour, and the others are parents, or normals."""
    lk = likelihoods(t).withColumnRenamed("block_id", "call_id")
    gts = lk.select("call_id").distinct().select("call_id", F.explode(F.array(*[F.struct(F.lit(s).alias("sample"), h.alias("haplotype_ids")) for s, h in (
        ("S0", F.array(F.lit(0), (col("call_id") % 2).cast("int"))), ("S1", F.array(F.lit(0), F.lit(1))), ("S2", F.array((col("call_id") % 2).cast("int"), F.lit(2))))])).alias("g")).select("call_id", "g.*")
    watched = col("sample") != "S2"
    share = contamination(lk, gts.where(watched), suspects(gts, watched))
    calls = gts.select("call_id").distinct().join(share, "call_id", "left").select(
        "call_id", F.lit("A").alias("ref"), F.array(F.lit("G")).alias("alts"), (col("call_id") % 3 > 0).alias("is_denovo"), (col("call_id") % 3 == 0).alias("is_somatic"),
        col("contamination").alias("denovo_contamination"), col("contamination").alias("normal_contamination"))
    return M.evaluate(M.Facets(calls, gts.withColumn("gt", col("haplotype_ids"))), ["DC", "NC"]).where("sample = 'S2'").select("call_id", R6(col("DC"), "dc"), R6(col("NC"), "nc"))


# --- variants ---
register("variant_classes", lambda t: t("sites").select("site_id", A.variant_class(col("ref"), col("alt")).alias("kind"), A.indel_size(col("ref"), col("alt")).cast("long").alias("indel_size"),
         A.is_simple_insertion(col("ref"), col("alt")).alias("simple_insertion"), A.is_simple_deletion(col("ref"), col("alt")).alias("simple_deletion"),
         F.coalesce(A.can_trim(col("ref"), col("alt")), F.lit(False)).alias("can_trim")), """
SELECT site_id, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN CASE WHEN ref || alt IN ('AG', 'GA', 'CT', 'TC') THEN 'transition' WHEN ref <> alt THEN 'transversion' ELSE 'reference' END
  WHEN length(ref) = length(alt) AND length(ref) > 1 THEN 'mnv' WHEN length(alt) > length(ref) THEN 'insertion' WHEN length(alt) < length(ref) THEN 'deletion' ELSE 'empty' END AS kind,
  abs(length(ref) - length(alt)) AS indel_size, length(alt) > length(ref) AND length(ref) = 0 AS simple_insertion, length(alt) < length(ref) AND length(alt) = 0 AS simple_deletion,
  length(ref) > 0 AND length(alt) > 0 AND (ref[1:1] = alt[1:1] OR ref[-1:] = alt[-1:]) AS can_trim FROM sites""", ("sites",))
register("variant_trim", lambda t: t("sites").select("site_id", A.trim(col("start_pos"), col("ref"), col("alt")).alias("v")).select("site_id", "v.start_pos", "v.end_pos", "v.ref", "v.alt"), """
WITH f AS (SELECT *, CASE WHEN ref[1:1] <> alt[1:1] OR length(ref) = 0 OR length(alt) = 0 THEN 0 WHEN ref[2:2] <> alt[2:2] OR length(ref) = 1 OR length(alt) = 1 THEN 1
  WHEN ref[3:3] <> alt[3:3] OR length(ref) = 2 OR length(alt) = 2 THEN 2 ELSE 3 END AS k FROM sites),
g AS (SELECT site_id, start_pos + k AS b, substring(ref, k + 1) AS r, substring(alt, k + 1) AS a FROM f),
h AS (SELECT *, CASE WHEN length(r) = 0 OR length(a) = 0 OR r[-1:] <> a[-1:] THEN 0 WHEN length(r) = 1 OR length(a) = 1 OR r[-2:-2] <> a[-2:-2] THEN 1 ELSE 2 END AS j FROM g)
SELECT site_id, b AS start_pos, b + length(r) - j AS end_pos, substring(r, 1, CAST(length(r) - j AS INT)) AS ref, substring(a, 1, CAST(length(a) - j AS INT)) AS alt FROM h""", ("sites",))
register("split_mnv", lambda t: t("sites").where("length(ref) = length(alt) and length(ref) > 1").select("site_id", F.explode(A.split_mnv(col("start_pos"), col("ref"), col("alt"))).alias("v")).select(
    "site_id", "v.start_pos", "v.ref", "v.alt"), """
SELECT site_id, start_pos + i - 1 AS start_pos, ref[i:i] AS ref, alt[i:i] AS alt FROM (SELECT *, unnest(range(1, length(ref) + 1)) AS i FROM sites WHERE length(ref) = length(alt) AND length(ref) > 1)
WHERE ref[i:i] <> alt[i:i]""", ("sites",))
register("positional_reference_alleles", lambda t: t("sites").select("site_id", F.explode(A.positional_alleles(col("start_pos"), col("ref"))).alias("a")).select("site_id", "a.start_pos", "a.seq"),
         "SELECT site_id, start_pos + i - 1 AS start_pos, ref[i:i] AS seq FROM (SELECT *, unnest(range(1, length(ref) + 1)) AS i FROM sites)", ("sites",))
register("unique_variants", lambda t: t("sites").select("contig", F.pmod("start_pos", F.lit(500)).alias("start_pos"), "ref", "alt").where("ref <> alt").dropDuplicates(),
         "SELECT DISTINCT contig, start_pos % 500 AS start_pos, ref, alt FROM sites WHERE ref <> alt", ("sites",))

# --- pileup candidates ---


def pileup(t):
    """Mismatches of reads with a constant-period reference, gathered by position and base."""
    from .candidates import pileup_observations
    reads = t("reads").where("mq >= 30 and length(seq) > 0").withColumn("reverse", ~col("is_forward"))
    return pileup_observations(reads, lambda pos: F.substr(F.lit("ACGT"), (F.pmod(pos, F.lit(4)) + 1).cast("int"), F.lit(1)))


_PILE = """
WITH b AS (SELECT contig, sample, start_pos + i - 1 AS pos, seq[i:i] AS alt, mq, is_forward FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM reads WHERE mq >= 30)),
m AS (SELECT *, 'ACGT'[pos % 4 + 1:pos % 4 + 1] AS ref FROM b)
SELECT contig, sample, pos AS start_pos, ref, alt, count(*) AS n_obs, count(*) FILTER (WHERE is_forward) AS n_forward, CAST(sum(mq) AS BIGINT) AS sum_mq FROM m WHERE ref <> alt GROUP BY ALL"""
register("pileup_candidates", lambda t: pileup(t).select("contig", "sample", "start_pos", "ref", "alt", "n_obs", "n_forward", "sum_mq"), _PILE, ("reads",))
register("pileup_included", lambda t: pileup(t).where("n_obs >= 3 and n_forward between 1 and n_obs - 1").groupBy("contig").agg(F.count(F.lit(1)).alias("n")),
         f"SELECT contig, count(*) AS n FROM ({_PILE.strip()}) WHERE n_obs >= 3 AND n_forward BETWEEN 1 AND n_obs - 1 GROUP BY contig".replace("(WITH", "(WITH"), ("reads",))

# --- genotype models ---


def likelihoods(t):
    """Rows of one name and number are one read: they meet before the haplotypes multiply them, and stay together by read."""
    r = t("reads").groupBy((col("read_id") % 400).alias("block_id"), "sample", F.concat_ws("/", "name", col("read_id").cast("string")).alias("read_id")).agg(F.max("read_id").alias("k"))
    h = r.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("haplotype_id"))
    return h.select("block_id", "sample", "read_id", "haplotype_id", (-((col("k") * (col("haplotype_id") + 3) * 7) % 53) / F.lit(10.0)).alias("ln_p"))


_LIK = """
lk AS (SELECT read_id % 400 AS block_id, sample, name || '/' || CAST(read_id AS VARCHAR) AS read_id, h AS haplotype_id, max(-((read_id * (h + 3) * 7) % 53) / 10.0) AS ln_p
  FROM reads, (SELECT unnest([0, 1, 2]) AS h) GROUP BY ALL),
g2 AS (SELECT a.block_id, a.sample, a.haplotype_id AS x, b.haplotype_id AS y, sum(greatest(a.ln_p, b.ln_p) + ln(1 + exp(-abs(a.ln_p - b.ln_p))) - ln(2)) AS ln_l
  FROM lk a JOIN lk b ON a.block_id = b.block_id AND a.sample = b.sample AND a.read_id = b.read_id AND a.haplotype_id <= b.haplotype_id GROUP BY ALL),
jn AS (SELECT *, ln_l + CASE WHEN x = y THEN 0 ELSE ln(2) END + ln(CASE x WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.2 END) + ln(CASE y WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.2 END) AS ln_j FROM g2),
mx AS (SELECT *, exp(ln_j - max(ln_j) OVER (PARTITION BY block_id, sample)) AS e FROM jn),
ps AS (SELECT *, e / sum(e) OVER (PARTITION BY block_id, sample) AS posterior FROM mx)"""


def posteriors(t):
    lk = likelihoods(t)
    gts = G.genotypes(lk, 2)
    freq = F.create_map(F.lit(0), F.lit(0.5), F.lit(1), F.lit(0.3), F.lit(2), F.lit(0.2))
    priors = gts.select("block_id", "haplotype_ids", G.hardy_weinberg_ln_prior(col("haplotype_ids"), freq).alias("ln_prior"))
    return G.individual_posteriors(G.genotype_likelihoods(gts, lk), priors)


register("genotype_enumeration", lambda t: G.genotypes(likelihoods(t), 3).select("block_id", F.concat_ws("/", F.transform("haplotype_ids", lambda h: h.cast("string"))).alias("genotype")), f"""
WITH {_LIK}, h AS (SELECT DISTINCT block_id, haplotype_id AS h FROM lk)
SELECT a.block_id, concat_ws('/', a.h, b.h, c.h) AS genotype FROM h a JOIN h b ON a.block_id = b.block_id AND a.h <= b.h JOIN h c ON c.block_id = a.block_id AND b.h <= c.h""", ("reads",))
register("genotype_likelihoods", lambda t: (lambda lk: G.genotype_likelihoods(G.genotypes(lk, 2), lk))(likelihoods(t)).select(
    "block_id", "sample", F.concat_ws("/", F.transform("haplotype_ids", lambda h: h.cast("string"))).alias("genotype"), R6(col("ln_likelihood"), "ln_likelihood")), f"""
WITH {_LIK} SELECT block_id, sample, concat_ws('/', x, y) AS genotype, round(ln_l, 6) AS ln_likelihood FROM g2""", ("reads",))
register("genotype_posteriors", lambda t: posteriors(t).select("block_id", "sample", F.concat_ws("/", F.transform("haplotype_ids", lambda h: h.cast("string"))).alias("genotype"), R6(col("posterior"), "posterior")), f"""
WITH {_LIK} SELECT block_id, sample, concat_ws('/', x, y) AS genotype, round(posterior, 6) AS posterior FROM ps""", ("reads",))
register("allele_posteriors", lambda t: G.allele_posteriors(posteriors(t), t("reads").select((col("read_id") % 400).alias("block_id")).distinct().select(
    "block_id", F.explode(F.array(F.struct(F.lit(1).alias("haplotype_id"), F.lit(7).alias("allele_id")), F.struct(F.lit(2).alias("haplotype_id"), F.lit(7).alias("allele_id")), F.struct(F.lit(2).alias("haplotype_id"), F.lit(9).alias("allele_id")))).alias("c")).select("block_id", "c.*")).select(
    "block_id", "sample", "allele_id", R6(col("posterior"), "posterior"), R6(col("homozygous"), "homozygous")), f"""
WITH {_LIK} SELECT block_id, sample, al AS allele_id, round(sum(posterior), 6) AS posterior, round(sum(CASE WHEN hom THEN posterior ELSE 0 END), 6) AS homozygous FROM (
  SELECT block_id, sample, posterior, 7 AS al, x >= 1 AS hom FROM ps WHERE y >= 1 UNION ALL SELECT block_id, sample, posterior, 9, x = 2 FROM ps WHERE y = 2) GROUP BY block_id, sample, al""", ("reads",))
register("genotype_evidence", lambda t: (lambda lk: (lambda gts: G.evidence(G.genotype_likelihoods(gts, lk), gts.withColumn("ln_prior", F.lit(0.0))))(G.genotypes(lk, 2)))(likelihoods(t)).select(
    "block_id", "sample", R6(col("ln_evidence"), "ln_evidence")), f"""
WITH {_LIK} SELECT block_id, sample, round(max(ln_l) + ln(sum(exp(ln_l - m))), 6) AS ln_evidence FROM (SELECT *, max(ln_l) OVER (PARTITION BY block_id, sample) AS m FROM g2) GROUP BY block_id, sample""", ("reads",))
register("read_assignment", lambda t: P.assign_reads(likelihoods(t)).groupBy("block_id", "sample").agg(
    F.count_if("is_ambiguous").alias("n_ambiguous"), F.count(F.lit(1)).alias("n")), f"""
WITH {_LIK}, b AS (SELECT block_id, sample, read_id, ln_p, max(ln_p) OVER (PARTITION BY block_id, sample, read_id) AS m FROM lk),
t AS (SELECT block_id, sample, read_id, count(*) AS ties FROM b WHERE abs(ln_p - m) < 1e-9 GROUP BY ALL)
SELECT block_id, sample, count(*) FILTER (WHERE ties > 1) AS n_ambiguous, count(*) AS n FROM t GROUP BY block_id, sample""", ("reads",))

register("call_contamination", contaminations, f"""
WITH {_LIK},
pv AS (SELECT block_id, sample, read_id, max(ln_p) FILTER (WHERE haplotype_id = 0) AS l0, max(ln_p) FILTER (WHERE haplotype_id = 1) AS l1, max(ln_p) FILTER (WHERE haplotype_id = 2) - 1.0 AS l2 FROM lk WHERE sample <> 'S2' GROUP BY ALL),
ow AS (SELECT *, CASE WHEN sample = 'S0' AND block_id % 2 = 0 THEN l0 WHEN abs(l0 - l1) < 1e-9 THEN l0 ELSE greatest(l0, l1) END AS best FROM pv),
sh AS (SELECT block_id, count(*) FILTER (WHERE l2 - best >= 1e-9) / count(*) AS share FROM ow GROUP BY block_id),
bl AS (SELECT DISTINCT block_id FROM lk)
SELECT block_id AS call_id, round(CASE WHEN block_id % 3 > 0 THEN coalesce(share, 0) END, 6) AS dc, round(CASE WHEN block_id % 3 = 0 THEN coalesce(share, 0) END, 6) AS nc FROM bl LEFT JOIN sh USING (block_id)""", ("reads",))

# --- phasing and blocks ---
register("phase_blocks", lambda t: P.phase_blocks(t("calls").withColumn("phase_begin", col("start_pos") - col("gq")).withColumn("phase_end", col("end_pos") + col("gq"))).groupBy("contig", "block").agg(
    F.count(F.lit(1)).alias("n"), F.min("start_pos").alias("begin"), F.max("end_pos").alias("end_")).drop("block"), """
WITH p AS (SELECT *, start_pos - gq AS pb, end_pos + gq AS pe FROM calls),
l AS (SELECT *, lag(pe) OVER w AS ppe, lag(pb) OVER w AS ppb, lag(end_pos) OVER w AS pend, lag(start_pos) OVER w AS pst FROM p WINDOW w AS (PARTITION BY contig ORDER BY start_pos, call_id)),
f AS (SELECT *, CASE WHEN ppe IS NULL OR NOT (least(pe, ppe) - greatest(pb, ppb) > 0 OR least(end_pos, pend) - greatest(start_pos, pst) > 0) THEN 1 ELSE 0 END AS fresh FROM l),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY start_pos, call_id) AS block FROM f)
SELECT contig, count(*) AS n, min(start_pos) AS begin, max(end_pos) AS end_ FROM k GROUP BY contig, block""", ("calls",))
register("allele_counts", lambda t: t("calls").select("contig", F.explode(F.array("gt1", "gt2")).alias("g")).groupBy("contig").agg(F.count_if(col("g") > 0).alias("ac"), F.count(F.lit(1)).alias("an")),
         "SELECT contig, CAST(sum(gt1 + gt2) AS BIGINT) AS ac, 2 * count(*) AS an FROM calls GROUP BY contig", ("calls",))
register("merged_vcf_lines", lambda t: P.vcf_lines(t("calls").select("contig", "start_pos", "call_id", F.lit("A").alias("ref"), F.array(F.lit("G")).alias("alts"), "qual",
         F.array("gt1", "gt2").alias("gt"), "gq")), """
SELECT concat_ws(chr(9), contig, CAST(start_pos + 1 AS VARCHAR), CAST(call_id AS VARCHAR), 'A', 'G', CAST(qual AS VARCHAR), 'PASS', 'AC=' || CAST(gt1 + gt2 AS VARCHAR) || ';AN=2', 'GT:GQ',
  CAST(gt1 AS VARCHAR) || '|' || CAST(gt2 AS VARCHAR) || ':' || CAST(gq AS VARCHAR)) AS line FROM calls""", ("calls",))
del W
