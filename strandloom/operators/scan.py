"""Running sums, maxima and neighbours along a coordinate, without one task per contig.

A plain window over a contig puts the contig's rows into one task.  Here rows are cut into tiles of the
coordinate; a small table has one aggregate per tile and its running value over the tiles; the window then
only orders the rows of one tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

TILE = 1 << 16


def tile_of(pos: Column, tile: int = TILE) -> Column:
    return F.floor(pos / tile).cast("long")


def running(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, *, how: str = "sum", order: list | None = None,
            inclusive: bool = True, tile: int = TILE) -> DataFrame:
    """Add ``out``: the sum or maximum of ``value`` over the rows of ``keys`` up to this row in the order (``pos``, ``order``)."""
    agg, zero = (F.sum, F.lit(0)) if how == "sum" else (F.max, F.lit(None))
    x = df.withColumn("_tile", tile_of(F.col(pos), tile)).withColumn("_value", value)
    before = W.partitionBy(*keys).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    tiles = x.groupBy(*keys, "_tile").agg(agg("_value").alias("_own")).withColumn("_off", agg("_own").over(before)).drop("_own")
    inside = W.partitionBy(*keys, "_tile").orderBy(pos, *(order or [])).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    own = agg("_value").over(inside)
    total = F.coalesce(F.col("_off"), zero) + F.coalesce(own, zero) if how == "sum" else F.greatest(F.col("_off"), own)
    return x.join(tiles, [*keys, "_tile"]).withColumn(out, total).drop("_tile", "_value", "_off")


def running_sums(df: DataFrame, keys: list[str], pos: str, columns: list[str], *, tile: int = TILE) -> DataFrame:
    """``columns`` replaced by their sums over the rows of ``keys`` up to this row's ``pos`` (rows have distinct positions)."""
    x = df.withColumn("_tile", tile_of(F.col(pos), tile))
    before = W.partitionBy(*keys).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    tiles = x.groupBy(*keys, "_tile").agg(*[F.sum(c).alias(c) for c in columns]).select(*keys, "_tile", *[F.sum(c).over(before).alias(f"_off_{c}") for c in columns])
    inside = W.partitionBy(*keys, "_tile").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    sums = {c: F.coalesce(F.col(f"_off_{c}"), F.lit(0)) + F.sum(c).over(inside) for c in columns}
    return x.join(tiles, [*keys, "_tile"]).select(*[sums.get(c, F.col(c)).alias(c) for c in df.columns])


def following(df: DataFrame, keys: list[str], pos: str, out: str, *, tile: int = TILE) -> DataFrame:
    """Add ``out``: the next larger ``pos`` of ``keys`` (rows have distinct positions); null after the last."""
    x = df.withColumn("_tile", tile_of(F.col(pos), tile))
    tiles = x.groupBy(*keys, "_tile").agg(F.min(pos).alias("_first"))
    tiles = tiles.withColumn("_next", F.lead("_first").over(W.partitionBy(*keys).orderBy("_tile"))).drop("_first")
    own = F.lead(pos).over(W.partitionBy(*keys, "_tile").orderBy(pos))
    return x.join(tiles, [*keys, "_tile"]).withColumn(out, F.coalesce(own, F.col("_next"))).drop("_tile", "_next")
