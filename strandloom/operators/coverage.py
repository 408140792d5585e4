"""Positional depth by sweep line, and statistics of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .interval import covered_regions
from .scan import following, running


def depth_runs(df: DataFrame, keys: list[str] = ("contig",)) -> DataFrame:
    """Maximal stretches between interval ends with their depth (gaps between islands have depth 0)."""
    keys = list(keys)
    ends = df.where("end_pos > start_pos").select(*keys, F.explode(F.array(
        F.struct(F.col("start_pos").alias("pos"), F.lit(1).cast("long").alias("d")),
        F.struct(F.col("end_pos").alias("pos"), F.lit(-1).cast("long").alias("d")))).alias("e"))
    steps = ends.groupBy(*keys, F.col("e.pos").alias("start_pos")).agg(F.sum("e.d").alias("d"))
    x = running(steps, keys, "start_pos", F.col("d"), "depth").drop("d")
    return following(x, keys, "start_pos", "end_pos").where("end_pos is not null").select(*keys, "start_pos", "end_pos", "depth")


def depth_stats(runs: DataFrame, keys: list[str] = ("contig",)) -> DataFrame:
    """Sum, maximum, minimum, mean and population deviation of the depth over all positions that the runs span."""
    n = F.col("end_pos") - F.col("start_pos")
    x = runs.withColumn("n", n).groupBy(*keys).agg(
        F.sum("n").alias("n_positions"), F.sum(F.col("depth") * F.col("n")).alias("sum_depth"), F.max("depth").alias("max_depth"),
        F.min("depth").alias("min_depth"), F.sum(F.col("depth") * F.col("depth") * F.col("n")).alias("_sq"))
    mean = F.col("sum_depth") / F.col("n_positions")
    return x.withColumn("mean_depth", mean).withColumn(
        "stdev_depth", F.sqrt(F.greatest(F.col("_sq") / F.col("n_positions") - mean * mean, F.lit(0.0)))).drop("_sq")


def select_regions(runs: DataFrame, test: Column, keys: list[str] = ("contig",)) -> DataFrame:
    """Maximal regions in which ``test`` holds for every run."""
    return covered_regions(runs.where(test), keys)


def high_coverage_regions(runs: DataFrame, threshold: int, keys: list[str] = ("contig",)) -> DataFrame:
    """Maximal regions with a depth of more than ``threshold``."""
    return select_regions(runs, F.col("depth") > threshold, keys)


def depth_at(sites: DataFrame, reads: DataFrame, aggs: dict[str, Column] | None = None, *, on: list[str] = ("contig",), name: str = "max_depth", **options) -> DataFrame:
    """Each site with the largest positional depth inside it (an empty site: at its position), and ``aggs`` over its reads.

    Sites meet runs of equal depth from the sweep, not reads: a site of few positions has few partners at any depth.
    """
    from .interval import per_left

    x = per_left(sites, reads, aggs, on=on, **options) if aggs else sites
    wide = x.withColumn("_end", F.col("end_pos")).withColumn("end_pos", F.greatest(F.col("end_pos"), F.col("start_pos") + 1))
    out = per_left(wide, depth_runs(reads, list(on)), {name: F.coalesce(F.max("r.depth"), F.lit(0)).cast("long")}, on=on, **options)
    return out.withColumn("end_pos", F.col("_end")).drop("_end")


def uniform_coverage_regions(runs: DataFrame, tolerance: int, keys: list[str] = ("contig",)) -> DataFrame:
    """Neighbouring runs whose depths differ by at most ``tolerance`` from one to the next, with the least and largest depth.

    ``runs`` come from :func:`depth_runs`; both steps along a contig are tiled.
    """
    keys = list(keys)
    prior = following(runs.select(*keys, (-F.col("start_pos")).alias("_neg")), keys, "_neg", "_before").select(
        *keys, (-F.col("_neg")).alias("start_pos"), (-F.col("_before")).alias("_before"))
    x = runs.join(prior, [*keys, "start_pos"]).join(runs.select(*keys, F.col("start_pos").alias("_before"), F.col("depth").alias("_depth")), [*keys, "_before"], "left")
    x = x.withColumn("_new", F.when(F.abs(F.col("depth") - F.col("_depth")) <= tolerance, 0).otherwise(1))
    x = running(x, keys, "start_pos", F.col("_new"), "_run")
    return x.groupBy(*keys, "_run").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.min("depth").alias("min_depth"),
                                        F.max("depth").alias("max_depth")).drop("_run")
