"""Top-k selection, top-k tuples, mass cuts and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group.  Spark keeps only ``k`` rows per group and task before the shuffle (group limit)."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def top_k_tuples(tables: Sequence[DataFrame], columns: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """The ``k`` tuples, one row from each table, of largest total score; ties by the ids in order.

    A tuple among the best k has members among the best k of their tables, and the same holds for partial sums.
    So at most k rows meet k rows at each step, whatever the tables' sizes.
    """
    best = None
    for df, (key, score) in zip(tables, columns):
        own = df.orderBy(F.desc(score), key).limit(k).select(key, score)
        if best is None:
            best, ids = own.withColumn("total", F.col(score)).drop(score), [key]
            continue
        ids.append(key)
        best = best.crossJoin(F.broadcast(own)).withColumn("total", F.col("total") + F.col(score)).drop(score)
        best = best.orderBy(F.desc(F.round("total", 6)), *ids).limit(k)
    return best


def mass_cut(df: DataFrame, p: str, keys: Sequence[str], epsilon: float, order: Sequence[Column]) -> DataFrame:
    """The likeliest rows of each group until their mass reaches 1 - epsilon."""
    w = W.partitionBy(*keys).orderBy(F.desc(p), *order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("_mass", F.coalesce(F.sum(p).over(w), F.lit(0.0))).where(F.col("_mass") < 1 - epsilon).drop("_mass")


def head_by_budget(df: DataFrame, keys: Sequence[str], pos: str, budget: int) -> DataFrame:
    """Per group: the last position up to which at most ``budget`` rows begin, and their number (null if the first has more)."""
    from .scan import running

    counts = df.groupBy(*keys, pos).agg(F.count(F.lit(1)).alias("_c"))
    x = running(counts, list(keys), pos, F.col("_c"), "n")
    fits = F.col("n") <= budget
    return x.groupBy(*keys).agg(F.max(F.when(fits, F.col(pos))).alias("head_end"), F.max(F.when(fits, F.col("n"))).alias("n_reads"))


def random_select(df: DataFrame, keys: Sequence[str], seed: int, *id_cols: str) -> DataFrame:
    """One row per group, chosen by a seeded hash of the id columns."""
    return top_k(df, keys, [F.xxhash64(F.lit(seed), *id_cols), *[F.col(c) for c in id_cols]], 1)
