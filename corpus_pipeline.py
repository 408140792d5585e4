"""A training corpus from raw documents: five stages, each one of the operators in strandloom.llm.

Every stage works on all that its predecessor kept; all but the last return the columns of the
documents.  Stages are written as Parquet and read again in between.

Null texts count as empty.  Decisions fall by id: rows that repeat an id stay or go together, and rows
without one are never dropped by the first three stages.  An empty table passes through all stages.
Columns beside those that a stage reads are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import decontaminate, mixing, simhash, token_codes, toxicity
from strandloom.llm.common import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; texts without words have the score of no evidence and stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at a similarity of 0.8 or more on five-word shingles the smallest doc_id stays.

    Texts with the same words, and those without any, are copies of each other; ids that are null stay.
    """
    return simhash.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover half of a benchmark item go; empty texts and empty or null items match nothing."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A seeded mixture of 60 % of the tokens; one epoch, for repeats would undo the deduplication.

    A null language or source is the empty name; rows with the same id of one source have the same place in its order.
    """
    return mixing.mix(docs, mixing.WEIGHTS, max_epochs=1)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in directly addressable codes, and the table of their documents; an empty text is its end id alone."""
    return token_codes.token_table(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token codes", encode_tokens),
]

#: The stages are not expressible in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
