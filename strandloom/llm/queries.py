"""The registered ``opN_<name>`` queries and their DuckDB SQL.  Each covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, exact_dedup, html_extract, line_dedup, mixing, pii, simhash, token_codes, toxicity, warc)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_groups(_read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).withColumn(
        "contaminated", F.lit(True))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_read(spark, sf_dir, "documents"), mixing.WEIGHTS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "removed", "text")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the secret is a setting of the session; without one the query shows the operator with a public key
    key = spark.conf.get("spark.strandloom.pii.key", "public demonstration key")
    return pii.pseudonymize(_read(spark, sf_dir, "documents"), key=key).select("doc_id", "n_found", "text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.token_table(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_html_main_text, op2_simhash, op3_decontamination, op4_exact_dedup, op5_mixing, op6_warc, op7_line_dedup,
           op8_pii, op9_toxicity, op10_token_codes)
    return {f.__name__: f for f in own}


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)"""

WARC_SQL = """
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to
FROM (SELECT *, payload_bytes >= 100 AND n > 1 AND page_id IS DISTINCT FROM first_id AS again FROM (
  SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
    min(page_id) OVER (PARTITION BY h) AS first_id, count(*) OVER (PARTITION BY h) AS n
  FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)))"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": EXACT_SQL, "op5_mixing": mixing.oracle_sql(), "op6_warc": WARC_SQL}
