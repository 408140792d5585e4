"""Queries over haplotype and genotype models, phasing, candidate rules, distributions and collections."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import collections as L
from ..functions import numeric as N
from ..operators import coverage as V
from . import candidates as K
from . import genotypes as G
from . import haplotypes as H
from . import phasing as P
from .call_queries import _LIK, R6, likelihoods, posteriors
from .interval_queries import _DEPTH
from .registry import register

col = F.col


def _name(c):
    return F.concat_ws("/", F.transform(c, lambda h: h.cast("string")))


# --- haplotypes ---
register("haplotype_ranks", lambda t: G.rank_haplotypes(likelihoods(t)).select("block_id", "sample", "haplotype_id", R6(col("ln_total"), "ln_total"), "rank"), f"""
WITH {_LIK}, s AS (SELECT block_id, sample, haplotype_id, sum(ln_p) AS ln FROM lk GROUP BY ALL)
SELECT block_id, sample, haplotype_id, round(ln, 6) AS ln_total, CAST(row_number() OVER (PARTITION BY block_id, sample ORDER BY round(ln, 9) DESC, haplotype_id) AS INT) AS rank FROM s""", ("reads",))
register("haplotype_metrics", lambda t: H.haplotype_metrics(likelihoods(t)).select("block_id", "haplotype_id", R6(col("best"), "best"), "n_perfect", "n_assigned", R6(col("total"), "total")), f"""
WITH {_LIK}, x AS (SELECT *, max(ln_p) OVER (PARTITION BY block_id, sample, read_id) AS top FROM lk),
s AS (SELECT block_id, sample, haplotype_id, sum(ln_p) AS ln, count(*) FILTER (WHERE ln_p > -1e-9) AS z, count(*) FILTER (WHERE top - ln_p < 1e-9) AS a FROM x GROUP BY ALL)
SELECT block_id, haplotype_id, round(max(ln), 6) AS best, CAST(sum(z) AS BIGINT) AS n_perfect, CAST(sum(a) AS BIGINT) AS n_assigned, round(sum(ln), 6) AS total FROM s GROUP BY ALL""", ("reads",))
register("filter_haplotypes", lambda t: H.filter_haplotypes(likelihoods(t).where("haplotype_id < 2 or block_id % 3 > 0"), 2, protected=(col("haplotype_id") == 1) & (col("block_id") % 2 == 0), order=("n_assigned", "n_perfect", "best")), f"""
WITH {_LIK}, l AS (SELECT * FROM lk WHERE haplotype_id < 2 OR block_id % 3 > 0), x AS (SELECT *, max(ln_p) OVER (PARTITION BY block_id, sample, read_id) AS top FROM l),
s AS (SELECT block_id, sample, haplotype_id, sum(ln_p) AS ln, count(*) FILTER (WHERE ln_p > -1e-9) AS z, count(*) FILTER (WHERE top - ln_p < 1e-9) AS a FROM x GROUP BY ALL),
m AS (SELECT block_id, haplotype_id, max(ln) AS best, sum(z) AS z, sum(a) AS a FROM s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY CASE WHEN haplotype_id = 1 AND block_id % 2 = 0 THEN 0 ELSE 1 END, a DESC, z DESC, round(best, 9) DESC, haplotype_id) AS k FROM m)
SELECT block_id, haplotype_id FROM k WHERE k <= 2""", ("reads",))
register("remove_unlikely_haplotypes", lambda t: G.remove_unlikely(posteriors(t), 0.3, protected=col("haplotype_id") == 0).select("block_id", "haplotype_id", R6(col("posterior"), "posterior")), f"""
WITH {_LIK}, m AS (SELECT block_id, sample, h, sum(posterior) AS p FROM ps, (SELECT unnest([0, 1, 2]) AS h) WHERE x = h OR y = h GROUP BY ALL), b AS (SELECT block_id, h, max(p) AS p FROM m GROUP BY ALL)
SELECT block_id, h AS haplotype_id, round(p, 6) AS posterior FROM b WHERE p >= 0.3 OR h = 0""", ("reads",))
register("collapse_haplotypes", lambda t: G.collapse_duplicates(t("sites").select((col("site_id") % 40).alias("block_id"), col("site_id").alias("haplotype_id"), col("ref").alias("hap_seq"), (-(col("site_id") * 7 % 13)).cast("double").alias("ln_prior"))), """
SELECT block_id, haplotype_id, hap_seq, ln_prior FROM (SELECT *, row_number() OVER (PARTITION BY block_id, hap_seq ORDER BY ln_prior DESC, haplotype_id) AS k FROM (
  SELECT site_id % 40 AS block_id, site_id AS haplotype_id, ref AS hap_seq, CAST(-(site_id * 7 % 13) AS DOUBLE) AS ln_prior FROM sites)) WHERE k = 1""", ("sites",))
register("active_blocks", lambda t: H.active_blocks(t("sites")).select("contig", "start_pos", "end_pos", F.size("variants").cast("long").alias("n_variants")), """
WITH m AS (SELECT *, max(end_pos) OVER (PARTITION BY contig ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sites),
k AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_pos > reach + 30 THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT contig, greatest(min(start_pos) - 20, 0) AS start_pos, max(end_pos) + 20 AS end_pos, count(DISTINCT (start_pos, end_pos, ref, alt)) AS n_variants FROM k GROUP BY contig, island""", ("sites",))
register("bad_regions", lambda t: (lambda runs: H.bad_regions(runs, V.depth_stats(runs).select("contig", "mean_depth"), t("calls"), t("reads"), depth_factor=1.8, density=0.028, window=200, min_mq=24.0))(V.depth_runs(t("reads"))), _DEPTH + """,
md AS (SELECT contig, sum(depth * (end_pos - start_pos)) / sum(end_pos - start_pos) AS m FROM runs GROUP BY contig),
k AS (SELECT runs.contig, start_pos, end_pos, 1 AS kind FROM runs JOIN md ON md.contig = runs.contig AND depth > 1.8 * m UNION ALL
  SELECT contig, w * 200, w * 200 + 200, 2 FROM (SELECT contig, start_pos // 200 AS w, count(*) AS n FROM calls GROUP BY ALL) WHERE n > 0.028 * 200 UNION ALL
  SELECT contig, w * 200, w * 200 + 200, 3 FROM (SELECT contig, start_pos // 200 AS w, avg(mq) AS q FROM reads GROUP BY ALL) WHERE q < 24),
m AS (SELECT *, max(end_pos) OVER (PARTITION BY contig ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_pos > reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT contig, min(start_pos) AS start_pos, max(end_pos) AS end_pos, CASE WHEN count(DISTINCT kind) > 1 THEN 'high' ELSE 'low' END AS severity FROM i GROUP BY contig, island""", ("reads", "calls"))

# --- genotype models ---
register("template_likelihoods", lambda t: G.template_likelihoods(likelihoods(t), F.substring_index("read_id", "/", 1)).select("block_id", "sample", "template", "haplotype_id", R6(col("ln_p"), "ln_p"), "n_reads"), f"""
WITH {_LIK} SELECT block_id, sample, split_part(read_id, '/', 1) AS template, haplotype_id, round(sum(ln_p), 6) AS ln_p, count(*) AS n_reads FROM lk GROUP BY ALL""", ("reads",))


def model_posteriors(t):
    lk = likelihoods(t)
    frequencies = F.create_map(F.lit(0), F.lit(0.5), F.lit(1), F.lit(0.3), F.lit(2), F.lit(0.2))
    two, one = G.genotypes(lk, 2), G.genotypes(lk, 1)
    model = G.evidence(G.genotype_likelihoods(two, lk), two.withColumn("ln_prior", G.hardy_weinberg_ln_prior(col("haplotype_ids"), frequencies)))
    dummy = G.evidence(G.genotype_likelihoods(one, lk), one.withColumn("ln_prior", F.lit(0.0)))
    return G.model_posterior(model, dummy).select("block_id", "sample", R6(col("posterior"), "posterior"), F.round("mp", 4).alias("mp"))


register("model_posteriors", model_posteriors, f"""
WITH {_LIK}, e AS (SELECT block_id, sample, max(ln_j) + ln(sum(exp(ln_j - m))) AS e FROM (SELECT *, max(ln_j) OVER (PARTITION BY block_id, sample) AS m FROM jn) GROUP BY ALL),
s AS (SELECT block_id, sample, haplotype_id, sum(ln_p) AS l FROM lk GROUP BY ALL), d AS (SELECT block_id, sample, max(l) + ln(sum(exp(l - m))) AS d FROM (SELECT *, max(l) OVER (PARTITION BY block_id, sample) AS m FROM s) GROUP BY ALL)
SELECT block_id, sample, round(1 / (1 + exp(d - e)), 6) AS posterior, round(10 * log10(1 + exp(e - d)), 4) AS mp FROM e JOIN d USING (block_id, sample)""", ("reads",))
register("population_em", lambda t: (lambda lk: G.population_em(lk, lk, rounds=8))(likelihoods(t)).select("block_id", "sample", _name(col("haplotype_ids")).alias("genotype"), F.round("posterior", 5).alias("posterior")), f"""
WITH RECURSIVE {_LIK.strip()},
n AS (SELECT block_id, count(DISTINCT sample) AS n FROM g2 GROUP BY block_id),
em AS (SELECT 0 AS r, block_id, 1 / 3.0 AS f0, 1 / 3.0 AS f1, 1 / 3.0 AS f2 FROM n UNION ALL
  SELECT r + 1, block_id, sum(p * ((x = 0)::INT + (y = 0)::INT)) / (2 * any_value(n)), sum(p * ((x = 1)::INT + (y = 1)::INT)) / (2 * any_value(n)), sum(p * ((x = 2)::INT + (y = 2)::INT)) / (2 * any_value(n)) FROM (
    SELECT *, e / sum(e) OVER (PARTITION BY r, block_id, sample) AS p FROM (SELECT *, exp(l - max(l) OVER (PARTITION BY r, block_id, sample)) AS e FROM (
      SELECT em.r, em.block_id, sample, x, y, n.n, ln_l + CASE WHEN x = y THEN 0 ELSE ln(2) END + ln(greatest(CASE x WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END, 1e-300)) + ln(greatest(CASE y WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END, 1e-300)) AS l
      FROM em JOIN g2 ON g2.block_id = em.block_id JOIN n ON n.block_id = em.block_id WHERE r < 7))) GROUP BY r, block_id),
z AS (SELECT em.block_id, sample, x, y, ln_l + CASE WHEN x = y THEN 0 ELSE ln(2) END + ln(greatest(CASE x WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END, 1e-300)) + ln(greatest(CASE y WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END, 1e-300)) AS l
  FROM em JOIN g2 ON g2.block_id = em.block_id WHERE r = 7),
q AS (SELECT *, exp(l - max(l) OVER (PARTITION BY block_id, sample)) AS e FROM z)
SELECT block_id, sample, concat_ws('/', x, y) AS genotype, round(e / sum(e) OVER (PARTITION BY block_id, sample), 5) AS posterior FROM q""", ("reads",))
register("trio_posteriors", lambda t: (lambda lk: G.trio_posteriors(G.genotype_likelihoods(G.genotypes(lk, 2), lk), "S0", "S1", "S2", top=4))(likelihoods(t)).select(
    "block_id", _name(col("m")).alias("mother"), _name(col("f")).alias("father"), _name(col("c")).alias("child"), "is_denovo", R6(col("posterior"), "posterior")), f"""
WITH {_LIK}, b AS (SELECT *, row_number() OVER (PARTITION BY block_id, sample ORDER BY round(ln_l, 9) DESC, x, y) AS k FROM g2),
t AS (SELECT m.block_id, m.x AS mx, m.y AS my, f.x AS fx, f.y AS fy, c.x AS cx, c.y AS cy, m.ln_l + f.ln_l + c.ln_l AS l FROM b m JOIN b f ON f.block_id = m.block_id AND f.sample = 'S1' AND f.k <= 4
  JOIN b c ON c.block_id = m.block_id AND c.sample = 'S2' AND c.k <= 4 WHERE m.sample = 'S0' AND m.k <= 4),
w AS (SELECT *, ((mx = cx)::INT + (my = cx)::INT) / 2.0 * ((fx = cy)::INT + (fy = cy)::INT) / 2.0 AS w1, ((mx = cy)::INT + (my = cy)::INT) / 2.0 * ((fx = cx)::INT + (fy = cx)::INT) / 2.0 AS w2 FROM t),
i AS (SELECT *, CASE WHEN cx = cy THEN w1 ELSE w1 + w2 END AS h, cx IN (mx, my, fx, fy) OR cy IN (mx, my, fx, fy) AS kin FROM w),
j AS (SELECT *, l + CASE WHEN h > 0 THEN ln(h) WHEN kin THEN ln(1e-8) ELSE 2 * ln(1e-8) END AS lj FROM i), e AS (SELECT *, exp(lj - max(lj) OVER (PARTITION BY block_id)) AS e FROM j)
SELECT block_id, concat_ws('/', mx, my) AS mother, concat_ws('/', fx, fy) AS father, concat_ws('/', cx, cy) AS child, h = 0 AS is_denovo, round(e / sum(e) OVER (PARTITION BY block_id), 6) AS posterior FROM e""", ("reads",))
register("clone_mixtures", lambda t: G.clone_mixtures(likelihoods(t)))
register("coalescent_priors", lambda t: (lambda x: x.join(F.broadcast(G.coalescent_table(x.sparkSession, 6, [2, 3, 4, 5, 6], 0.4)), ["k", "n"]).select("call_id", F.round("ln_p", 6).alias("ln_p")))(
    t("calls").select("call_id", (col("gq") % 7).cast("int").alias("k"), (2 + col("call_id") % 5).cast("int").alias("n"))), """
WITH c AS (SELECT call_id, gq % 7 AS k, 2 + call_id % 5 AS n FROM calls), t AS (SELECT call_id, k, n, unnest(range(2, n + 1)) AS i FROM c)
SELECT call_id, round(ln(sum(pow(-1, i) * exp(lgamma(n) - lgamma(i) - lgamma(n - i + 1)) * (i - 1) / (0.4 + i - 1) * pow(0.4 / (0.4 + i - 1), k))), 6) AS ln_p FROM t GROUP BY call_id""", ("calls",))

# --- assignment and phasing ---
register("assignment_actions", lambda t: P.assign_by(likelihoods(t), ["drop", "first", "all"]).groupBy("action", "block_id", "sample", "haplotype_id").agg(F.count(F.lit(1)).alias("n")), f"""
WITH {_LIK}, b AS (SELECT *, max(ln_p) OVER (PARTITION BY block_id, sample, read_id) AS m FROM lk),
t AS (SELECT *, count(*) OVER (PARTITION BY block_id, sample, read_id) AS ties, row_number() OVER (PARTITION BY block_id, sample, read_id ORDER BY haplotype_id) AS k FROM b WHERE abs(ln_p - m) < 1e-9)
SELECT 'drop' AS action, block_id, sample, haplotype_id, count(*) AS n FROM t WHERE ties = 1 GROUP BY ALL UNION ALL SELECT 'first', block_id, sample, haplotype_id, count(*) FROM t WHERE k = 1 GROUP BY ALL
UNION ALL SELECT 'all', block_id, sample, haplotype_id, count(*) FROM t GROUP BY ALL""", ("reads",))


def phase_pairs(t):
    x = t("calls").select((col("call_id") % 90).alias("block_id"), "sample", (col("gq") % 12).cast("long").alias("site_a"), (col("gt1") == col("gt2")).alias("in_cis"), col("qual").alias("posterior"))
    return P.pair_phase_quality(x.withColumn("site_b", col("site_a") + 1))


register("pair_phase_quality", lambda t: phase_pairs(t).select("block_id", "sample", "site_a", "in_cis", R6(col("quality"), "quality")), """
WITH p AS (SELECT call_id % 90 AS block_id, sample, CAST(gq % 12 AS BIGINT) AS site_a, sum(CASE WHEN gt1 = gt2 THEN qual ELSE 0 END) AS cis, sum(qual) AS a FROM calls GROUP BY ALL)
SELECT block_id, sample, site_a, cis * 2 >= a AS in_cis, round(least(-10 * log10(greatest(1 - greatest(cis, a - cis) / a, 2.2250738585072014e-308)), 3076.526556), 6) AS quality FROM p""", ("calls",))
register("phase_sets", lambda t: P.phase_sets(phase_pairs(t), min_score=4.0).select("block_id", "sample", "first_site", "last_site", R6(col("quality"), "quality")), """
WITH p AS (SELECT call_id % 90 AS block_id, sample, CAST(gq % 12 AS BIGINT) AS site_a, sum(CASE WHEN gt1 = gt2 THEN qual ELSE 0 END) AS cis, sum(qual) AS a FROM calls GROUP BY ALL),
q AS (SELECT *, least(-10 * log10(greatest(1 - greatest(cis, a - cis) / a, 2.2250738585072014e-308)), 3076.526556) AS q FROM p),
s AS (SELECT *, sum(CASE WHEN q >= 4 THEN 0 ELSE 1 END) OVER (PARTITION BY block_id, sample ORDER BY site_a) AS k FROM q)
SELECT block_id, sample, min(site_a) AS first_site, max(site_a) + 1 AS last_site, round(min(q), 6) AS quality FROM s WHERE q >= 4 GROUP BY block_id, sample, k""", ("calls",))

# --- rules of candidates ---


def observations(t):
    x = t("calls").select("sample", "start_pos", (1 + col("gq") % 23).cast("int").alias("n_obs"), (col("call_id") % 4).alias("kind"), (col("call_id") % 9).alias("size"), "gq")
    ref = F.when(col("kind") == 1, F.repeat(F.lit("ACG"), (1 + col("size")).cast("int"))).otherwise("A")
    alt = F.when(col("kind") == 2, F.repeat(F.lit("TG"), (1 + col("size")).cast("int"))).when(col("kind") == 3, F.repeat(F.lit("C"), (2 + col("size") * 40).cast("int"))).otherwise("T")
    return x.select("start_pos", "sample", "n_obs", ref.alias("ref"), alt.alias("alt"), (col("n_obs") + col("gq") * 3).cast("int").alias("depth"), (col("n_obs") * (5 + col("gq") % 20)).cast("long").alias("sum_quality"),
                    F.when(col("gq") % 5 == 0, col("n_obs")).otherwise(F.floor(col("n_obs") / 2)).cast("int").alias("n_forward"))


register("inclusion_rules", lambda t: observations(t).select(
    "start_pos", "sample", "n_obs", "depth", F.length("alt").cast("long").alias("n_alt"), K.include_simple(3).alias("simple"), K.include_germline(col("depth")).alias("germline"), K.include_somatic(col("depth"), min_frequency=0.05).alias("somatic"),
    K.include_long_reads(col("depth")).alias("long_reads"), K.include_cell(col("depth")).alias("cell"), K.include_cell(col("depth"), pooled=True).alias("cell_pooled"),
    K.include_unknown_copy_number(col("depth"), "S0", min_frequency=0.05).alias("unknown_copies")), """
WITH o AS (SELECT start_pos, sample, 1 + gq % 23 AS n, call_id % 4 AS kind, call_id % 9 AS size, gq FROM calls),
p AS (SELECT *, CASE WHEN kind = 1 THEN 3 * (1 + size) ELSE 1 END AS rl, CASE WHEN kind = 2 THEN 2 * (1 + size) WHEN kind = 3 THEN 2 + size * 40 ELSE 1 END AS al, n + gq * 3 AS d, n * (5 + gq % 20) AS q, CASE WHEN gq % 5 = 0 THEN n ELSE n // 2 END AS f FROM o),
c AS (SELECT DISTINCT n, d FROM p),
g AS (SELECT n, d, list_sum(list_transform(range(4000), lambda i: exp((n - 0.5) * ln((i + 0.5) / 4000 * 0.05) + (d - n - 0.5) * ln(1 - (i + 0.5) / 4000 * 0.05)))) / 4000 * 0.05 AS v5,
  list_sum(list_transform(range(4000), lambda i: exp((n - 0.5) * ln((i + 0.5) / 4000 * 0.2) + (d - n - 0.5) * ln(1 - (i + 0.5) / 4000 * 0.2)))) / 4000 * 0.2 AS v20, exp(lgamma(n + 0.5) + lgamma(d - n + 0.5) - lgamma(d + 1)) AS z FROM c),
x AS (SELECT p.*, 1 - v5 / z AS s5, 1 - v20 / z AS s20, p.n / p.d AS vaf FROM p JOIN g ON g.n = p.n AND g.d = p.d),
y AS (SELECT *, n >= 2 AND n >= d * 0.1 AND q >= 10.0 * n AND NOT (n >= 10 AND (f = 0 OR f = n)) AS germline FROM x)
SELECT start_pos, sample, CAST(n AS INT) AS n_obs, CAST(d AS INT) AS depth, CAST(al AS BIGINT) AS n_alt, n >= 3 AS simple, germline, s5 >= 0.75 AS somatic,
  CASE WHEN rl = 1 AND al = 1 THEN n > 1 AND vaf > 0.1 WHEN al > rl THEN CASE WHEN al <= 2 THEN n >= 2 AND vaf > 0.2 WHEN al <= 3 THEN n >= 2 AND vaf > 0.1 WHEN al <= 20 THEN n >= 2 AND vaf > 0.05 WHEN al <= 200 THEN vaf > 0.05 WHEN al <= 500 THEN vaf > 0.02 ELSE true END
    ELSE CASE WHEN rl <= 2 THEN n >= 2 AND vaf > 0.2 WHEN rl <= 3 THEN n >= 2 AND vaf > 0.1 WHEN rl <= 50 THEN n >= 2 AND vaf > 0.05 ELSE vaf > 0.1 END END AS long_reads,
  n > 1 AND s20 >= 0.5 AS cell, n > 1 AND s20 >= 0.8 AS cell_pooled, CASE WHEN sample = 'S0' THEN germline ELSE n > 1 AND s5 >= 0.75 END AS unknown_copies FROM y""", ("calls",))
register("tolerant_candidates", lambda t: observations(t).groupBy(K.match_key().alias("key")).agg(F.sum("n_obs").alias("n_obs"), F.count(F.lit(1)).alias("n")), """
WITH o AS (SELECT start_pos, 1 + gq % 23 AS n, call_id % 4 AS kind, call_id % 9 AS size FROM calls),
p AS (SELECT *, CASE WHEN kind = 1 THEN repeat('ACG', CAST(1 + size AS INT)) ELSE 'A' END AS ref, CASE WHEN kind = 2 THEN repeat('TG', CAST(1 + size AS INT)) WHEN kind = 3 THEN repeat('C', CAST(2 + size * 40 AS INT)) ELSE 'T' END AS alt FROM o)
SELECT CASE WHEN length(alt) > length(ref) THEN 'I/' || start_pos || '/' || CASE WHEN replace(alt, alt[1:1], '') = '' THEN alt[1:1] ELSE length(alt) || '.' || (length(alt) - length(replace(alt, 'N', ''))) END
  WHEN length(alt) < length(ref) THEN 'D/' || start_pos ELSE 'S/' || start_pos || '/' || ref || '/' || alt END AS key, CAST(sum(n) AS BIGINT) AS n_obs, count(*) AS n FROM p GROUP BY ALL""", ("calls",))

# --- distributions of every row, and collections ---


def distributions(t):
    x = t("orders").select("o_orderkey", (col("o_custkey") % 97 + 1).cast("double").alias("a"), (col("o_orderkey") % 83 + 1).cast("double").alias("b"), (F.round("o_totalprice", 2) / 1000).alias("p"))
    alphas = F.array(col("a") / 10, col("b") / 10, F.lit(1.5))
    ks = F.array("a", "b", F.lit(3.0))
    return x.select("o_orderkey", F.round(N.normal_cdf(col("p"), 250.0, 90.0), 9).alias("normal"), R6(N.digamma(col("a") / 3), "digamma"), R6(N.beta_binomial_ln(col("a"), col("a") + col("b"), col("b") / 7, F.lit(2.5)), "beta_binomial"),
                    R6(N.dirichlet_multinomial_ln(ks, alphas), "dirichlet_multinomial"), R6(N.multinomial_ln(ks, F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))), "multinomial"),
                    R6(F.get(N.dirichlet_expectation(alphas), F.lit(1)), "expectation"), R6(N.dirichlet_entropy(alphas), "entropy"), R6(N.log_dirichlet(alphas, F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5))), "dirichlet"),
                    F.round(N.poisson_sf(F.lit(7), col("b") / 5), 9).alias("poisson_sf"), R6(N.log_multinomial(ks), "multinomial_coefficient"))


_PSI = "(ln({x} + 6) - 0.5 / ({x} + 6) - 1 / 12.0 / pow({x} + 6, 2) + 1 / 120.0 / pow({x} + 6, 4) - 1 / 252.0 / pow({x} + 6, 6) + 1 / 240.0 / pow({x} + 6, 8) - 1 / 132.0 / pow({x} + 6, 10) - 1 / {x} - 1 / ({x} + 1) - 1 / ({x} + 2) - 1 / ({x} + 3) - 1 / ({x} + 4) - 1 / ({x} + 5))"
register("more_distributions", distributions, f"""
WITH x AS (SELECT o_orderkey, CAST(o_custkey % 97 + 1 AS DOUBLE) AS a, CAST(o_orderkey % 83 + 1 AS DOUBLE) AS b, round(o_totalprice, 2) / 1000 AS p FROM orders),
y AS (SELECT *, greatest(least((p - 250) / 90, 9), -9) AS z, a / 10 + b / 10 + 1.5 AS s FROM x),
n AS (SELECT *, 0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 141), lambda n: CASE WHEN z = 0 THEN 0 ELSE sign(z) * exp((2 * n + 1) * ln(abs(z)) + n * ln(2) + lgamma(n + 1) - lgamma(2 * n + 2)) END)) AS normal FROM y)
SELECT o_orderkey, round(normal, 9) AS normal, round({_PSI.format(x='(a / 3)')}, 6) AS digamma,
  round(lgamma(a + b + 1) - lgamma(a + 1) - lgamma(b + 1) + lgamma(a + b / 7) + lgamma(b + 2.5) - lgamma(a + b / 7 + b + 2.5) - lgamma(b / 7) - lgamma(2.5) + lgamma(b / 7 + 2.5), 6) AS beta_binomial,
  round(lgamma(a + b + 4) + lgamma(s) - lgamma(a + b + 3 + s) + lgamma(a + a / 10) - lgamma(a / 10) - lgamma(a + 1) + lgamma(b + b / 10) - lgamma(b / 10) - lgamma(b + 1) + lgamma(4.5) - lgamma(1.5) - lgamma(4), 6) AS dirichlet_multinomial,
  round(lgamma(a + b + 4) - lgamma(a + 1) - lgamma(b + 1) - lgamma(4) + a * ln(0.5) + b * ln(0.3) + 3 * ln(0.2), 6) AS multinomial, round(b / 10 / s, 6) AS expectation,
  round(lgamma(a / 10) + lgamma(b / 10) + lgamma(1.5) - lgamma(s) + (s - 3) * {_PSI.format(x='s')} - (a / 10 - 1) * {_PSI.format(x='(a / 10)')} - (b / 10 - 1) * {_PSI.format(x='(b / 10)')} - 0.5 * {_PSI.format(x='1.5')}, 6) AS entropy,
  round(lgamma(s) - lgamma(a / 10) - lgamma(b / 10) - lgamma(1.5) + (a / 10 - 1) * ln(0.2) + (b / 10 - 1) * ln(0.3) + 0.5 * ln(0.5), 6) AS dirichlet,
  round(1 - list_sum(list_transform(range(0, 8), lambda k: exp(k * ln(b / 5) - b / 5 - lgamma(k + 1)))), 9) AS poisson_sf, round(lgamma(a + b + 4) - lgamma(a + 1) - lgamma(b + 1) - lgamma(4), 6) AS multinomial_coefficient FROM n""")
register("collection_functions", lambda t: t("orders").select("o_orderkey", L.split(col("o_orderpriority"), "-").alias("w"), F.split("o_orderpriority", "").alias("xs"), "o_orderpriority", F.round("o_totalprice", 2).alias("p")).withColumn(
    "m", F.map_from_arrays(F.array(F.lit(2), F.lit(1), F.lit(5)), F.array(col("p"), F.lit(1.5), (col("o_orderkey") % 7).cast("double")))).select(
        "o_orderkey", L.join(col("w"), "+").alias("joined"), F.size("w").cast("long").alias("n_words"), L.is_prefix(F.lit("1-"), col("o_orderpriority")).alias("prefix"), L.is_suffix(F.lit("ED"), col("o_orderpriority")).alias("suffix"),
        L.to_fixed(col("o_orderkey") / 8.0, 3).alias("fixed"), L.capitalise_front(F.lower("o_orderpriority")).alias("front"), L.join(L.reorder(col("xs"), F.array(F.lit(2), F.lit(0), F.lit(4))), "").alias("reordered"),
        L.join(L.erase_if(col("xs"), lambda x: x == "E"), "").alias("erased"), L.join(L.erase_indices(L.append(col("xs"), F.lit("!")), F.array(F.lit(0), F.lit(1))), "").alias("cut"),
        L.join(F.transform(L.merge_sorted(F.array(F.lit(1), F.lit(40)), F.array((col("o_orderkey") % 50).cast("int"), F.lit(7)), lambda x: x + 1), lambda x: x.cast("string")), ",").alias("merged"),
        F.round(L.sum_values(col("m")), 2).alias("sum_values"), L.sum_keys(col("m")).alias("sum_keys"), L.join(F.transform(L.sorted_keys(col("m")), lambda k: k.cast("string")), ",").alias("keys"),
        F.round(F.get(L.values_by_key(col("m")), F.lit(2)), 2).alias("last_value"), F.round(L.sum_values(L.merge_sums(col("m"), F.create_map(F.lit(1), F.lit(0.25), F.lit(9), F.lit(1.0)))), 2).alias("merged_sum")), """
WITH o AS (SELECT *, round(o_totalprice, 2) AS p, o_orderkey % 50 AS k FROM orders), x AS (SELECT *, string_split(o_orderpriority, '-') AS w, o_orderpriority AS s FROM o)
SELECT o_orderkey, array_to_string(w, '+') AS joined, len(w) AS n_words, starts_with(s, '1-') AS prefix, ends_with(s, 'ED') AS suffix, printf('%.3f', o_orderkey / 8.0) AS fixed, upper(lower(s)[1:1]) || lower(s)[2:] AS front,
  s[3:3] || s[1:1] || s[5:5] AS reordered, replace(s, 'E', '') AS erased, substring(s, 3) || '!' AS cut, array_to_string(list_sort([1, 40, k + 1, 8]), ',') AS merged, round(p + 1.5 + o_orderkey % 7, 2) AS sum_values, CAST(8 AS DOUBLE) AS sum_keys,
  '1,2,5' AS keys, CAST(o_orderkey % 7 AS DOUBLE) AS last_value, round(p + 1.5 + o_orderkey % 7 + 1.25, 2) AS merged_sum FROM x""")
del W
