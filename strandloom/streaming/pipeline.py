"""Structured Streaming forms of the read pipeline, for reads and events that arrive as files.  Beyond the batch engine."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reads as P

col = F.col


def read_stream(spark: SparkSession, path: str, schema: str = P.READ_SCHEMA, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def filtered_reads(stream: DataFrame, names: Iterable[str] = P.DEFAULT, params: dict | None = None) -> DataFrame:
    """Stateless: the same filters as in batch."""
    return P.apply_filters(stream, names, params)


def binned_counts(stream: DataFrame, width: int = 1000) -> DataFrame:
    """Reads, bases and mean mapping quality per sample, contig and bin of begins; updates as files arrive."""
    return stream.groupBy("sample", "contig", F.floor(col("start_pos") / width).alias("bin")).agg(
        F.count(F.lit(1)).alias("n_reads"), F.sum(F.length("seq")).alias("n_bases"), F.avg("mq").alias("mean_mq"))


def event_windows(stream: DataFrame, *, time: str = "ts", key: str = "event_type", size: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Sliding windows with a watermark: late rows within ``late`` count, older ones are dropped."""
    x = stream.withColumn(time, col(time).cast("timestamp")).withWatermark(time, late)
    return x.groupBy(F.window(time, size, slide), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def deduplicate(stream: DataFrame, keys: list[str], *, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first row of each key; its state is dropped behind the watermark."""
    return stream.withColumn(time, col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
