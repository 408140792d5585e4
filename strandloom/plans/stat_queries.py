"""Queries over read statistics, filters, ranking, sampling, set operations and events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import sequences as S
from ..operators import ranking as K
from .registry import register

col = F.col


def R6(c, name):
    return F.round(c, 6).alias(name)


register("read_directions", lambda t: t("reads").groupBy("sample", "contig").agg(
    F.count(F.lit(1)).alias("n"), F.count_if("is_forward").alias("n_forward"), F.count_if(~col("is_forward")).alias("n_reverse"),
    R6(F.count_if("is_forward") / F.count(F.lit(1)), "strand_bias")), """
SELECT sample, contig, count(*) AS n, count(*) FILTER (WHERE is_forward) AS n_forward, count(*) FILTER (WHERE NOT is_forward) AS n_reverse,
  round(count(*) FILTER (WHERE is_forward) / count(*), 6) AS strand_bias FROM reads GROUP BY sample, contig""", ("reads",))
register("read_flags", lambda t: t("reads").groupBy("sample").agg(
    F.count_if("is_supplementary").alias("n_supplementary"), F.count_if("is_secondary").alias("n_secondary"), F.count_if(col("mq") == 0).alias("n_mq_zero")), """
SELECT sample, count(*) FILTER (WHERE is_supplementary) AS n_supplementary, count(*) FILTER (WHERE is_secondary) AS n_secondary,
  count(*) FILTER (WHERE mq = 0) AS n_mq_zero FROM reads GROUP BY sample""", ("reads",))
register("read_lengths", lambda t: t("reads").groupBy("sample").agg(
    F.min(F.length("seq")).cast("long").alias("min_length"), F.max(F.length("seq")).cast("long").alias("max_length"), R6(F.avg(F.length("seq")), "mean_length"),
    F.median(F.length("seq")).alias("median_length"), F.sum(F.length("seq")).alias("base_pairs"),
    F.coalesce(F.sum(F.when(col("is_forward"), F.length("seq"))), F.lit(0)).alias("forward_base_pairs")), """
SELECT sample, min(length(seq)) AS min_length, max(length(seq)) AS max_length, round(avg(length(seq)), 6) AS mean_length, median(length(seq)) AS median_length,
  CAST(sum(length(seq)) AS BIGINT) AS base_pairs, CAST(coalesce(sum(length(seq)) FILTER (WHERE is_forward), 0) AS BIGINT) AS forward_base_pairs FROM reads GROUP BY sample""", ("reads",))
register("mapping_qualities", lambda t: t("reads").groupBy("sample", "contig").agg(
    F.min("mq").alias("min_mq"), F.max("mq").alias("max_mq"), F.median("mq").alias("median_mq"), R6(N.rms(col("mq")), "rms_mq"),
    R6(F.avg("mq"), "mean_mq"), R6(F.stddev_pop("mq"), "stdev_mq")), """
SELECT sample, contig, min(mq) AS min_mq, max(mq) AS max_mq, median(mq) AS median_mq, round(sqrt(avg(mq * mq)), 6) AS rms_mq, round(avg(mq), 6) AS mean_mq,
  round(stddev_pop(mq), 6) AS stdev_mq FROM reads GROUP BY sample, contig""", ("reads",))
register("max_sample_read_count", lambda t: t("reads").groupBy("contig", "sample").agg(F.count(F.lit(1)).alias("n")).groupBy("contig").agg(
    F.max("n").alias("max_reads"), F.min("n").alias("min_reads"), F.count(F.lit(1)).alias("n_samples")), """
SELECT contig, max(n) AS max_reads, min(n) AS min_reads, count(*) AS n_samples FROM (SELECT contig, sample, count(*) AS n FROM reads GROUP BY ALL) GROUP BY contig""", ("reads",))
register("filter_mapping_quality", lambda t: t("reads").where("mq >= 5 and not is_duplicate and not is_secondary and not is_supplementary").select("read_id", "name", "mq"),
         "SELECT read_id, name, mq FROM reads WHERE mq >= 5 AND NOT is_duplicate AND NOT is_secondary AND NOT is_supplementary", ("reads",))
register("filter_failures", lambda t: t("reads").select(F.coalesce(
    F.when(col("is_secondary"), "secondary"), F.when(col("mq") < 5, "mapping_quality"), F.when(col("is_duplicate"), "duplicate"),
    F.when(F.length("seq") < 10, "short"), F.lit("pass")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")), """
SELECT CASE WHEN is_secondary THEN 'secondary' WHEN mq < 5 THEN 'mapping_quality' WHEN is_duplicate THEN 'duplicate' WHEN length(seq) < 10 THEN 'short' ELSE 'pass' END AS reason,
  count(*) AS n FROM reads GROUP BY reason""", ("reads",))
register("mark_duplicates", lambda t: K.top_k(t("reads").groupBy("sample", "contig", "is_forward", "start_pos", "end_pos", "read_id", "name").agg(F.max("mq").alias("mq")),
         ["sample", "contig", "is_forward", "start_pos", "end_pos"], [F.desc("mq"), col("read_id"), col("name")], 1).select("sample", "contig", "start_pos", "end_pos", "read_id"), """
SELECT sample, contig, start_pos, end_pos, read_id FROM (SELECT *, row_number() OVER (PARTITION BY sample, contig, is_forward, start_pos, end_pos ORDER BY mq DESC, read_id, name) AS k
  FROM (SELECT sample, contig, is_forward, start_pos, end_pos, read_id, name, max(mq) AS mq FROM reads GROUP BY ALL)) WHERE k = 1""", ("reads",))
register("duplicate_five_prime", lambda t: t("reads").withColumn("p5", F.when(col("is_forward"), col("start_pos")).otherwise(col("end_pos"))).groupBy(
    "sample", "contig", "is_forward", "p5").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("sample").agg(
    F.count(F.lit(1)).alias("n_groups"), F.sum(col("n") - 1).alias("n_duplicates")), """
SELECT sample, count(*) AS n_groups, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT sample, contig, is_forward, CASE WHEN is_forward THEN start_pos ELSE end_pos END AS p5, count(*) AS n
  FROM reads GROUP BY ALL HAVING count(*) > 1) GROUP BY sample""", ("reads",))
register("fragment_reads", lambda t: t("reads").select("read_id", "name", "start_pos", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(20))).alias("at")).select(
    "read_id", "name", (col("start_pos") + col("at")).alias("frag_begin"), F.substr("seq", col("at") + 1, F.lit(20)).alias("frag_seq")), """
SELECT read_id, name, start_pos + i AS frag_begin, substring(seq, CAST(i AS INT) + 1, 20) AS frag_seq FROM (SELECT *, unnest(range(0, length(seq), 20)) AS i FROM reads)""", ("reads",))
register("link_templates", lambda t: t("reads").groupBy("sample", "name").agg(F.count(F.lit(1)).alias("n_reads"), F.min("start_pos").alias("begin"), F.max("end_pos").alias("end_")),
         "SELECT sample, name, count(*) AS n_reads, min(start_pos) AS begin, max(end_pos) AS end_ FROM reads GROUP BY sample, name", ("reads",))
register("adapter_overhang", lambda t: (lambda w: t("reads").groupBy("read_id", "name", "start_pos", "end_pos").agg(F.max("is_forward").alias("fw"))
         .withColumn("mate_begin", F.lead("start_pos").over(w)).where("fw and mate_begin is not null")
         .select("read_id", "name", F.greatest(col("end_pos") - col("mate_begin"), F.lit(0)).alias("masked")))(W.partitionBy("name").orderBy("start_pos", "end_pos", "read_id")), """
SELECT read_id, name, greatest(end_pos - mate_begin, 0) AS masked FROM (SELECT *, lead(start_pos) OVER (PARTITION BY name ORDER BY start_pos, end_pos, read_id) AS mate_begin
  FROM (SELECT read_id, name, start_pos, end_pos, max(is_forward) AS fw FROM reads GROUP BY ALL)) WHERE fw AND mate_begin IS NOT NULL""", ("reads",))
# --- ranking and sampling ---
register("top_k_reads", lambda t: K.top_k(t("reads").groupBy("contig", "read_id", "name").agg(F.max("mq").alias("mq"), F.max(F.length("seq")).alias("len")), ["contig"],
         [F.desc("len"), F.desc("mq"), col("read_id"), col("name")], 25).select("contig", "read_id", "name", col("len").cast("long").alias("len")), """
SELECT contig, read_id, name, len FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY len DESC, mq DESC, read_id, name) AS k FROM (
  SELECT contig, read_id, name, max(mq) AS mq, max(length(seq)) AS len FROM reads GROUP BY ALL)) WHERE k <= 25""", ("reads",))
register("top_k_tuples", lambda t: K.top_k_tuples(
    [t("part").where(f"p_size % 3 = {i}").select(col("p_partkey").alias(f"id{i}"), F.round("p_retailprice", 2).alias(f"score{i}")) for i in range(3)],
    [("id0", "score0"), ("id1", "score1"), ("id2", "score2")], 20).select("id0", "id1", "id2", F.round("total", 2).alias("total")), """
WITH a AS (SELECT p_partkey AS id0, round(p_retailprice, 2) AS s0 FROM part WHERE p_size % 3 = 0 ORDER BY s0 DESC, id0 LIMIT 20),
b AS (SELECT p_partkey AS id1, round(p_retailprice, 2) AS s1 FROM part WHERE p_size % 3 = 1 ORDER BY s1 DESC, id1 LIMIT 20),
c AS (SELECT p_partkey AS id2, round(p_retailprice, 2) AS s2 FROM part WHERE p_size % 3 = 2 ORDER BY s2 DESC, id2 LIMIT 20)
SELECT id0, id1, id2, round(s0 + s1 + s2, 2) AS total FROM a, b, c ORDER BY round(s0 + s1 + s2, 6) DESC, id0, id1, id2 LIMIT 20""")
register("hash_sample", lambda t: t("reads").where(F.conv(F.substring(F.md5(F.concat("name", F.lit("/"), col("read_id").cast("string"))), 1, 4), 16, 10).cast("int") < 6554).select("read_id", "name"), """
SELECT read_id, name FROM reads WHERE CAST('0x' || substring(md5(name || '/' || CAST(read_id AS VARCHAR)), 1, 4) AS INT) < 6554""", ("reads",))
register("read_profile", lambda t: t("reads").groupBy("sample").agg(
    F.count(F.lit(1)).alias("n"), F.expr("percentile(end_pos - start_pos, 0.25)").alias("q1"), F.expr("percentile(end_pos - start_pos, 0.75)").alias("q3"),
    R6(F.avg("mq"), "mean_mq"), F.sum(F.length("seq") + F.length("name") + 40).alias("footprint")), """
SELECT sample, count(*) AS n, quantile_cont(end_pos - start_pos, 0.25) AS q1, quantile_cont(end_pos - start_pos, 0.75) AS q3, round(avg(mq), 6) AS mean_mq,
  CAST(sum(length(seq) + length(name) + 40) AS BIGINT) AS footprint FROM reads GROUP BY sample""", ("reads",))
register("head_region_by_reads", lambda t: K.head_by_budget(t("reads"), ["sample", "contig"], "start_pos", 2000), """
SELECT sample, contig, max(start_pos) FILTER (WHERE n <= 2000) AS head_end, max(n) FILTER (WHERE n <= 2000) AS n_reads FROM (
  SELECT sample, contig, start_pos, sum(c) OVER (PARTITION BY sample, contig ORDER BY start_pos)::BIGINT AS n FROM (SELECT sample, contig, start_pos, count(*) AS c FROM reads GROUP BY ALL))
GROUP BY sample, contig""", ("reads",))
register("mass_cut", lambda t: K.mass_cut(t("calls").withColumn("p", col("qual") / F.sum("qual").over(W.partitionBy("contig", "sample"))), "p", ["contig", "sample"], 0.25,
         [col("call_id")]).groupBy("contig", "sample").agg(F.count(F.lit(1)).alias("n"), F.min("qual").alias("least")), """
WITH p AS (SELECT *, qual / sum(qual) OVER (PARTITION BY contig, sample) AS p FROM calls),
m AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY contig, sample ORDER BY p DESC, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mass FROM p)
SELECT contig, sample, count(*) AS n, min(qual) AS least FROM m WHERE mass < 0.75 GROUP BY contig, sample""", ("calls",))
# --- set operations ---
register("set_union_calls", lambda t: t("calls").where("qual > 300").select("call_id", "contig", "start_pos").union(t("calls").where("is_somatic").select("call_id", "contig", "start_pos")).distinct(),
         "SELECT call_id, contig, start_pos FROM calls WHERE qual > 300 UNION SELECT call_id, contig, start_pos FROM calls WHERE is_somatic", ("calls",))
register("set_difference_positions", lambda t: t("calls").select("contig", "start_pos").subtract(t("sites").select("contig", "start_pos")),
         "SELECT contig, start_pos FROM calls EXCEPT SELECT contig, start_pos FROM sites", ("calls", "sites"))
register("set_intersection_positions", lambda t: t("reads").select("contig", "start_pos").intersect(t("calls").select("contig", "start_pos")),
         "SELECT contig, start_pos FROM reads INTERSECT SELECT contig, start_pos FROM calls", ("reads", "calls"))
register("contig_order", lambda t: t("calls").groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.max("end_pos").alias("size")).select(
    "contig", "n", F.row_number().over(W.orderBy(F.desc("size"), "contig")).cast("long").alias("by_size"), F.row_number().over(W.orderBy("contig")).cast("long").alias("by_name")),
    "SELECT contig, count(*) AS n, row_number() OVER (ORDER BY max(end_pos) DESC, contig) AS by_size, row_number() OVER (ORDER BY contig) AS by_name FROM calls GROUP BY contig", ("calls",))
# --- sequences ---
register("sequence_functions", lambda t: t("reads").where("length(seq) > 0").groupBy("seq").agg(F.count(F.lit(1)).alias("n")).select(
    "seq", "n", S.reverse_complement(col("seq")).alias("rc"), R6(S.gc_content(col("seq")), "gc"), S.is_homopolymer(col("seq")).alias("homopolymer"),
    S.transcribe(col("seq")).alias("rna"), S.is_palindromic(col("seq")).alias("palindromic"), S.count_base(col("seq"), "A").cast("long").alias("n_a"), S.is_tandem_repeat(col("seq"), 2).alias("dinucleotide")), """
SELECT seq, count(*) AS n, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc, round(length(translate(seq, 'AT', '')) / length(seq), 6) AS gc,
  length(replace(seq, seq[1:1], '')) = 0 AS homopolymer, replace(seq, 'T', 'U') AS rna, seq = reverse(translate(seq, 'ACGT', 'TGCA')) AS palindromic,
  length(seq) - length(replace(seq, 'A', '')) AS n_a, length(seq) >= 4 AND substring(seq, 1, length(seq) - 2) = substring(seq, 3) AS dinucleotide
FROM reads WHERE length(seq) > 0 GROUP BY seq""", ("reads",))
register("kmer_counts", lambda t: t("reads").select(F.explode(S.kmers(col("seq"), 4)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n")), """
SELECT substring(seq, CAST(i AS INT), 4) AS kmer, count(*) AS n FROM (SELECT seq, unnest(range(1, length(seq) - 2)) AS i FROM reads) GROUP BY kmer""", ("reads",))
register("canonical_motifs", lambda t: t("reads").select(F.substring("seq", 1, 3).alias("m")).where("length(m) = 3").groupBy(S.canonical_motif(col("m")).alias("motif")).agg(F.count(F.lit(1)).alias("n")), """
WITH m AS (SELECT substring(seq, 1, 3) AS m FROM reads WHERE length(seq) >= 3), r AS (SELECT m, reverse(translate(m, 'ACGT', 'TGCA')) AS c FROM m)
SELECT least(m, m[2:3] || m[1:1], m[3:3] || m[1:2], c, c[2:3] || c[1:1], c[3:3] || c[1:2]) AS motif, count(*) AS n FROM r GROUP BY motif""", ("reads",))
register("indel_profile", lambda t: t("reads").where("length(seq) >= 8").groupBy(F.substring("seq", 1, 1).alias("motif"), F.length(F.regexp_extract("seq", "^(A+|C+|G+|T+)", 1)).cast("long").alias("periods")).agg(
    F.count(F.lit(1)).alias("n"), F.count_if(col("mq") < 20).alias("n_errors")), """
SELECT seq[1:1] AS motif, length(regexp_extract(seq, '^(A+|C+|G+|T+)', 1)) AS periods, count(*) AS n, count(*) FILTER (WHERE mq < 20) AS n_errors FROM reads WHERE length(seq) >= 8 GROUP BY ALL""", ("reads",))
# --- numeric functions ---
_INT = "SELECT DISTINCT CAST(o_custkey % 40 AS DOUBLE) AS a, CAST(o_orderkey % 30 AS DOUBLE) AS b FROM orders"
register("phred_functions", lambda t: t("orders").select((col("o_orderkey") % 60).cast("double").alias("q")).distinct().select(
    "q", F.round(N.phred_to_probability(col("q")), 9).alias("p"), R6(N.probability_to_phred(N.phred_to_probability(col("q"))), "back"), F.round(N.phred_to_probability_true(col("q")), 9).alias("p_true")), """
SELECT DISTINCT q, round(pow(10, -q / 10), 9) AS p, round(q, 6) AS back, round(1 - pow(10, -q / 10), 9) AS p_true FROM (SELECT CAST(o_orderkey % 60 AS DOUBLE) AS q FROM orders)""")
register("distribution_functions", lambda t: t("orders").select((col("o_custkey") % 40).cast("double").alias("a"), (col("o_orderkey") % 30).cast("double").alias("b")).distinct().select(
    "a", "b", R6(N.log_gamma(col("a") + 1), "ln_fact"), R6(N.log_beta(col("a") + 1, col("b") + 1), "ln_beta"),
    R6(N.log_binomial(col("a") + col("b"), col("a")), "ln_choose"), R6(N.poisson_pmf(col("a"), col("b") + 1), "poisson"),
    R6(N.log_sum_exp(F.array(-col("a"), -col("b"))), "lse"), R6(N.entropy2(F.array((col("a") + 1) / (col("a") + col("b") + 2), (col("b") + 1) / (col("a") + col("b") + 2))), "entropy")), f"""
SELECT a, b, round(lgamma(a + 1), 6) AS ln_fact, round(lgamma(a + 1) + lgamma(b + 1) - lgamma(a + b + 2), 6) AS ln_beta, round(lgamma(a + b + 1) - lgamma(a + 1) - lgamma(b + 1), 6) AS ln_choose,
  round(exp(a * ln(b + 1) - (b + 1) - lgamma(a + 1)), 6) AS poisson, round(greatest(-a, -b) + ln(exp(-a - greatest(-a, -b)) + exp(-b - greatest(-a, -b))), 6) AS lse,
  round(-((a + 1) / (a + b + 2) * log2((a + 1) / (a + b + 2)) + (b + 1) / (a + b + 2) * log2((b + 1) / (a + b + 2))), 6) AS entropy FROM ({_INT})""")
# --- events: windows beyond the interval operators ---
register("event_sessions", lambda t: t("events").withColumn("ts", col("ts").cast("timestamp")).withColumn("gap", (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(W.partitionBy("user_id").orderBy("ts", "event_id"))) > 1800 * 1000000).withColumn(
    "session", F.sum(F.when(F.coalesce("gap", F.lit(True)), 1).otherwise(0)).over(W.partitionBy("user_id").orderBy("ts", "event_id"))).groupBy("user_id").agg(
    F.max("session").alias("n_sessions"), F.count(F.lit(1)).alias("n_events")), """
WITH g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800 * 1000000 AS gap FROM events),
s AS (SELECT *, sum(CASE WHEN coalesce(gap, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(max(session) AS BIGINT) AS n_sessions, count(*) AS n_events FROM s GROUP BY user_id""")
