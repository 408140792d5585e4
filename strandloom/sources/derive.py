"""Deterministic genomic tables from the test data; the same expressions run in Spark and DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TABLES = {
    "reads": ("lineitem", """
  l_orderkey*10+l_linenumber AS read_id; concat('t', cast(l_orderkey AS {S})) AS name;
  concat('S', cast(l_orderkey % 3 AS {S})) AS sample; cast(l_suppkey % 5 AS {S}) AS contig;
  (l_orderkey*7+l_linenumber*13) % 100000 AS start_pos;
  (l_orderkey*7+l_linenumber*13) % 100000 + cast(l_quantity AS BIGINT) AS end_pos;
  cast(round(l_tax*100) AS INT)*7 AS mq; l_linestatus='F' AS is_forward; l_returnflag='R' AS is_duplicate;
  substring(translate(concat(md5(cast(l_orderkey*10+l_linenumber AS {S})), md5(cast(l_orderkey*10+l_linenumber+1 AS {S}))),
    '0123456789abcdef','ACGTACGTACGTACGT'), 1, cast(l_quantity AS INT)) AS seq;
  l_partkey % 4 = 0 AS is_supplementary; l_partkey % 7 = 0 AS is_secondary; cast(l_discount*100 AS INT) AS clip"""),
    "sites": ("part", """
  p_partkey AS site_id; cast(p_partkey % 5 AS {S}) AS contig; (p_partkey*37) % 100000 AS start_pos;
  (p_partkey*37) % 100000 + p_size % 4 AS end_pos;
  substring(translate(md5(cast(p_partkey AS {S})),'0123456789abcdef','ACGTACGTACGTACGT'), 1, p_size % 4) AS ref;
  substring(translate(md5(cast(p_partkey+7 AS {S})),'0123456789abcdef','ACGTACGTACGTACGT'), 1, cast(p_partkey % 3 AS INT)) AS alt"""),
    "calls": ("orders", """
  o_orderkey AS call_id; cast(o_orderkey % 5 AS {S}) AS contig; (o_orderkey*31) % 100000 AS start_pos;
  (o_orderkey*31) % 100000 + 1 AS end_pos; concat('S', cast(o_custkey % 3 AS {S})) AS sample;
  o_totalprice/1000 AS qual; cast(o_orderkey % 2 AS INT) AS gt1; cast((o_orderkey % 4) / 2 >= 1 AS INT) AS gt2;
  o_orderpriority='1-URGENT' AS is_somatic; cast(o_custkey % 60 AS INT) AS gq; cast(o_custkey % 45 AS DOUBLE) AS pp;
  cast(o_custkey % 35 AS DOUBLE) AS mp"""),
    # alignments in pieces; later columns use earlier ones
    "aligned": ("lineitem", """
  l_orderkey*10+l_linenumber AS read_id; concat('t', cast(l_orderkey AS {S})) AS name; concat('S', cast(l_orderkey % 3 AS {S})) AS sample;
  cast(l_suppkey % 5 AS {S}) AS contig; (l_orderkey*7+l_linenumber*13) % 100000 AS start_pos; cast(l_quantity AS INT) AS len;
  CASE WHEN l_orderkey % 31 = 0 THEN cast(l_quantity AS INT) WHEN l_linenumber % 3 = 0 THEN least(cast(l_discount*100 AS INT), cast(l_quantity AS INT) - 1) ELSE 0 END AS front;
  CASE WHEN l_orderkey % 31 <> 0 AND l_linenumber % 4 = 1 AND cast(l_quantity AS INT) > 25 THEN cast(l_partkey % 14 AS INT) ELSE 0 END AS back;
  CASE WHEN l_orderkey % 31 <> 0 AND cast(l_quantity AS INT) > 40 THEN cast(l_suppkey % 4 AS INT) ELSE 9 END AS kind;
  CASE WHEN kind = 0 THEN 2 ELSE 0 END AS ins; CASE WHEN kind = 1 THEN 3 ELSE 0 END AS del;
  CASE WHEN kind < 3 THEN 10 ELSE len - front - back END AS m1; CASE WHEN kind < 3 THEN len - front - back - ins - 10 ELSE 0 END AS m2;
  start_pos + len - ins + del AS end_pos; CASE WHEN l_orderkey % 13 = 0 THEN len - 1 ELSE len END AS n_quals;
  cast(round(l_tax*100) AS INT)*7 AS mq; l_linestatus <> 'F' AS reverse; l_returnflag='R' AS duplicate;
  translate(substring(translate(concat(md5(cast(l_orderkey*10+l_linenumber AS {S})), md5(cast(l_orderkey*10+l_linenumber+1 AS {S}))),
    '0123456789abcdef','ACGTACGTACGTACGT'), 1, cast(l_quantity AS INT)), CASE WHEN l_linenumber = 2 THEN 'AC' ELSE '' END, CASE WHEN l_linenumber = 2 THEN 'ac' ELSE '' END) AS seq;
  l_partkey % 29 = 0 AS unmapped; l_partkey % 7 = 0 AS secondary; l_partkey % 4 = 0 AS supplementary; l_suppkey % 19 = 0 AS qc_fail;
  l_partkey % 3 > 0 AS has_mate; CASE WHEN l_partkey % 3 = 1 THEN contig ELSE 'other' END AS mate_contig; start_pos + len - 8 + start_pos % 20 AS mate_begin;
  len - 12 + start_pos % 40 AS tlen; start_pos % 11 = 0 AS mate_unmapped; start_pos % 2 = 0 AS mate_reverse; l_suppkey % 2 = 0 AS proper;
  CASE WHEN l_suppkey % 6 = 0 THEN 'chr1_random' WHEN l_suppkey % 6 = 1 THEN 'chrU_7' WHEN l_suppkey % 6 = 2 THEN 'x_decoy' WHEN l_suppkey % 6 = 3 THEN '1' END AS supp_contig;
  cast(l_partkey % 9 AS INT) AS supp_mq; CASE WHEN l_partkey % 5 < 2 THEN concat('v', cast(l_partkey % 5 AS {S})) END AS tag"""),
}


def _columns(name: str, string: str) -> list[str]:
    return [" ".join(x.split()) for x in _TABLES[name][1].format(S=string).split(";")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``reads``, ``sites``, ``calls``, ``aligned`` derived from their base table, or a base table itself."""
    if name in _TABLES:
        return spark.read.parquet(f"{sf_dir}/{_TABLES[name][0]}.parquet").selectExpr(*_columns(name, "STRING"))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_with(*names: str) -> str:
    """DuckDB common table expressions of derived tables, as the start of a query."""
    return "WITH " + ",\n".join(f"{n} AS (SELECT {', '.join(_columns(n, 'VARCHAR'))} FROM {_TABLES[n][0]})" for n in names) + "\n"


def aligned(t: Callable[[str], DataFrame]) -> DataFrame:
    """The table ``aligned`` in the schema of reads, with ``read_id``."""
    c = F.col
    op = lambda size, flag: F.struct(c(size).cast("int").alias("size"), F.lit(flag).alias("flag"))
    ops = F.filter(F.array(op("front", "S"), op("m1", "M"), op("ins", "I"), op("del", "D"), op("m2", "M"), op("back", "S")), lambda o: o["size"] > 0)
    quals = F.transform(F.when(c("n_quals") > 0, F.sequence(F.lit(0), c("n_quals") - 1)).otherwise(F.array().cast("array<int>")),
                        lambda i: ((i * 7 + c("read_id")) % 43).cast("smallint"))
    mate = F.when(c("has_mate"), F.struct(c("mate_contig").alias("contig"), c("mate_begin").alias("begin"), c("tlen").cast("bigint").alias("tlen"),
                                          c("mate_unmapped").alias("unmapped"), c("mate_reverse").alias("reverse")))
    tags = F.when(c("tag").isNotNull(), F.create_map(F.lit("XA"), c("tag"))).otherwise(F.create_map().cast("map<string,string>"))
    supp = F.when(c("supp_contig").isNotNull(), F.array(F.struct(
        c("supp_contig").alias("contig"), F.lit(0).cast("bigint").alias("start_pos"), F.lit(10).cast("bigint").alias("end_pos"), F.lit("10M").alias("cigar"),
        F.lit(True).alias("forward"), c("supp_mq").cast("smallint").alias("mq"))))
    return t("aligned").select(
        "read_id", "name", "sample", F.lit(None).cast("string").alias("read_group"), "contig", "start_pos", "end_pos", "seq", quals.alias("quals"), ops.alias("cigar"),
        c("mq").cast("smallint").alias("mq"), F.lit(None).cast("string").alias("barcode"), c("has_mate").alias("multiple_segment_template"),
        c("proper").alias("all_segments_aligned"), "unmapped", "reverse", "secondary", "qc_fail", "duplicate", "supplementary", F.lit(True).alias("first_segment"),
        F.lit(False).alias("last_segment"), mate.alias("mate"), tags.alias("tags"), supp.alias("supp"))


#: The same for DuckDB: a common table expression ``al`` over ``aligned``.
ALIGNED_SQL = """al AS (SELECT *, list_filter([{'size': front, 'flag': 'S'}, {'size': m1, 'flag': 'M'}, {'size': ins, 'flag': 'I'}, {'size': del, 'flag': 'D'}, {'size': m2, 'flag': 'M'},
  {'size': back, 'flag': 'S'}], lambda o: o.size > 0) AS cigar, list_transform(range(n_quals), lambda i: (i * 7 + read_id) % 43) AS quals FROM aligned)"""
