"""Durable stages, and reads in a layout that regions and samples prune."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

col = F.col


def cut(df: DataFrame) -> DataFrame:
    """End a stage: its rows are written to the shared checkpoint folder if there is one, else kept by Spark.

    Later stages read a stage's rows several times; without the cut each reading would plan and run all stages before it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            return df.persist()
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def write_reads(reads: DataFrame, path: str, *, tile: int = 1 << 22, mode: str = "error") -> None:
    """Reads by contig and sample (folders), each cut into tiles of positions and sorted within its files.

    Rows are dealt by contig, sample and tile, so that neither a deep contig nor one sample is a single task, and the
    least and largest positions in the files' footers tell regions apart.
    """
    x = reads.withColumn("_contig", col("contig")).withColumn("_sample", col("sample")).withColumn("_tile", F.floor(col("start_pos") / tile))
    x = x.repartition("_contig", "_sample", "_tile").sortWithinPartitions("_contig", "_sample", "start_pos", "end_pos").drop("_tile")
    x.write.mode(mode).partitionBy("_contig", "_sample").parquet(path)


def scan_reads(spark: SparkSession, path: str, *, contig: str | None = None, begin: int | None = None, end: int | None = None,
               samples: Sequence[str] | None = None, longest: int | None = None) -> DataFrame:
    """Reads that overlap a region (all of a contig, or all contigs, if it is left out) of the given samples.

    Contig and sample choose folders; the begin of the region is compared with the reads' ends and, where the ``longest``
    read's size is known, with their begins too: all of these are pushed to the scan.
    """
    x = spark.read.parquet(path)
    if contig is not None:
        x = x.where(col("_contig") == contig)
    if samples is not None:
        x = x.where(col("_sample").isin(list(samples)))
    if end is not None:
        x = x.where(col("start_pos") < max(end, (begin or 0) + 1))
    if begin is not None:
        x = x.where(col("end_pos") > begin)
        if longest is not None:
            x = x.where(col("start_pos") > begin - longest)
    return x.drop("_contig", "_sample")


def positions(reads: DataFrame, most: int | None = None) -> DataFrame:
    """Contig and region of reads only; ``most`` is a limit on their number."""
    x = reads.select("contig", "start_pos", "end_pos")
    return x if most is None else x.limit(most)


def first_reads(reads: DataFrame, visit, *, batch: int = 1000) -> int:
    """Call ``visit`` with one read after the other until it returns False; the number of reads seen.

    One partition at a time reaches the driver, and no more of them than the visitor asks for.
    """
    n = 0
    for row in reads.toLocalIterator(prefetchPartitions=False):
        n += 1
        if visit(row) is False:
            break
    return n


def samples_in_both(reads: DataFrame, genotypes: DataFrame) -> DataFrame:
    """Names of the samples that have reads and genotypes."""
    return reads.select("sample").distinct().intersect(genotypes.select("sample").distinct())


def random_variants(spark: SparkSession, contig_sizes: DataFrame, n: int, *, seed: int = 1) -> DataFrame:
    """``n`` single-base candidates at seeded positions of the contigs, in proportion to their sizes: ``contig, start_pos, alt``.

    Contigs are few, so that their running sizes are one small window.
    """
    from pyspark.sql import Window as W

    upto = F.sum("size").over(W.orderBy("contig").rowsBetween(W.unboundedPreceding, W.currentRow))
    spans = contig_sizes.select("contig", "size", upto.alias("upto"), (upto - col("size")).alias("from"), F.sum("size").over(W.partitionBy()).alias("all"))
    x = spark.range(n).select("id", (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 53)) / float(1 << 53)).alias("u"), F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(4)).alias("b"))
    x = x.join(F.broadcast(spans), (col("u") * col("all") >= col("from")) & (col("u") * col("all") < col("upto")))
    at = F.floor(col("u") * col("all") - col("from")).cast("bigint")
    return x.select("contig", at.alias("start_pos"), (at + 1).alias("end_pos"), F.substr(F.lit("ACGT"), (col("b") + 1).cast("int"), F.lit(1)).alias("alt"))
