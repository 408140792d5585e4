"""Queries from call lines to filtered call lines, and merged tables of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.text_formats import merge_records, parse_vcf, vcf_line
from . import csr
from .registry import register

col = F.col
SAMPLES = ["S0", "S1", "S2"]


def call_lines(t):
    """Text lines of calls with three samples; a quarter of them have no phase set."""
    ps = F.when(col("call_id") % 4 > 0, F.floor(col("call_id") / 16).cast("string")).otherwise(".")
    cells = [F.concat_ws(":", F.concat(((col("gt1") + i) % 2).cast("string"), F.lit("|"), col("gt2").cast("string")), ((col("gq") + 7 * i) % 60).cast("string"), ps) for i in range(3)]
    return t("calls").select(F.concat_ws("\t", "contig", (col("start_pos") + 1).cast("string"), col("call_id").cast("string"), F.lit("A"), F.lit("G"), col("qual").cast("string"), F.lit("q3"),
                                         F.concat(F.lit("PP="), col("pp").cast("string"), F.when(col("is_somatic"), ";SOMATIC").otherwise("")), F.lit("GT:GQ:PS"), *cells).alias("value"))


def refiltered(t):
    records = csr.passing(parse_vcf(call_lines(t), SAMPLES))
    done = csr.single_pass(records, "QUAL < 150 | GQ < 25 | PLN > 900", "PP < 1", ["PLN", "PP", "AC"])
    return done.select(vcf_line(done, SAMPLES).alias("line"))


register("refilter_vcf_lines", refiltered, """
WITH s AS (SELECT c.*, i, (gt1 + i) % 2 AS a, (gq + 7 * i) % 60 AS q, CASE WHEN call_id % 4 > 0 THEN call_id // 16 END AS ps FROM calls c, (SELECT unnest([0, 1, 2]) AS i)),
p AS (SELECT *, CASE WHEN ps IS NULL THEN 1 ELSE max(end_pos) OVER w - min(start_pos) OVER w END AS pln FROM s WINDOW w AS (PARTITION BY i, contig, ps)),
f AS (SELECT *, qual < 150 OR q < 25 OR pln > 900 AS bad, CAST(a AS VARCHAR) || '|' || CAST(gt2 AS VARCHAR) || ':' || '.,' || CAST(a + gt2 AS VARCHAR) || ':' || CAST(q AS VARCHAR) || ':' || CAST(pln AS VARCHAR) || ':' || coalesce(CAST(ps AS VARCHAR), '.') AS cell FROM p),
g AS (SELECT call_id, any_value(contig) AS contig, any_value(start_pos) AS start_pos, any_value(qual) AS qual, any_value(pp) AS pp, any_value(is_somatic) AS som, bool_and(bad) AS bad,
  concat_ws(';', CASE WHEN bool_or(q < 25) THEN 'GQ' END, CASE WHEN any_value(qual) < 150 THEN 'LQ' END, CASE WHEN bool_or(pln > 900) THEN 'PLN' END) AS why, string_agg(cell, chr(9) ORDER BY i) AS cells FROM f GROUP BY call_id)
SELECT concat_ws(chr(9), contig, CAST(start_pos + 1 AS VARCHAR), CAST(call_id AS VARCHAR), 'A', 'G', CAST(qual AS VARCHAR), CASE WHEN bad THEN why ELSE 'PASS' END,
  'PP=' || CAST(CAST(pp AS BIGINT) AS VARCHAR) || CASE WHEN som THEN ';SOMATIC' ELSE '' END, 'GT:AC:GQ:PLN:PS', cells) AS line FROM g WHERE NOT pp < 1""", ("calls",))


def merged(t):
    records = parse_vcf(call_lines(t), [], sites_only=True)
    number = col("id").cast("bigint")
    tables = [records.where(number % 2 == 0), records.where(number % 3 == 0).withColumn("qual", col("qual") + 1), records]
    return merge_records(tables, {str(i): 4 - i for i in range(5)}).select("contig", "start_pos", F.array_join("alt", ",").alias("alt"), F.round("qual", 5).alias("qual"))


register("merge_records", merged, """
WITH c AS (SELECT contig, start_pos, call_id, CASE WHEN call_id % 2 = 0 THEN 0 WHEN call_id % 3 = 0 THEN 1 ELSE 2 END AS t, CASE WHEN call_id % 2 > 0 AND call_id % 3 = 0 THEN qual + 1 ELSE qual END AS q FROM calls),
d AS (SELECT *, row_number() OVER (PARTITION BY contig, start_pos ORDER BY t) AS k, count(*) OVER (PARTITION BY contig, start_pos, t) AS same FROM c)
SELECT contig, start_pos, 'G' AS alt, round(q, 5) AS qual FROM d WHERE k = 1""", ("calls",))
