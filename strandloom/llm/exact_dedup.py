"""Exact deduplication with two Bloom passes; native DataFrame operations only.

Pass 1 sends each text's hash to ``probes`` slots of a fixed-size filter and
keeps the slots that were hit twice or more.  Pass 2 probes all rows: a row all
of whose slots were hit repeatedly *may* be a copy.  Only such rows are shuffled
by their digest; all others are groups of one and pass straight through.

The filter is broadcast as 4 kB bitmaps.  Its bits grow with the rows up to
``max_bits`` (32 MB), which bounds the broadcast.  Beyond that it fills up: more
rows shuffle, the result stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import heavy_lookup, materialize, without_ids

#: Bits in one bitmap built by Spark's bitmap functions.
BITMAP_BITS = 32768


def _slots(probes: int, bits: int, digest: Column | None = None) -> list[Column]:
    digest = F.col("digest") if digest is None else digest
    return [F.pmod(F.xxhash64(F.lit(i), digest), F.lit(bits)) for i in range(probes)]


def filter_bits(rows: int, bits_per_row: int, max_bits: int) -> int:
    """Bits of a filter for so many rows: whole bitmaps, doubled up to ``max_bits``."""
    bits = BITMAP_BITS
    while bits < min(max_bits, bits_per_row * rows):
        bits *= 2
    return bits


def probed(rows: DataFrame, filt: DataFrame, digest: Column, probes: int, bits: int) -> DataFrame:
    """``rows`` with ``again``: whether all slots of ``digest`` are set in the bitmaps ``filt``, which are broadcast."""
    cols, x, hit = rows.columns, rows, F.lit(True)
    for i, slot in enumerate(_slots(probes, bits, digest)):
        own = filt.select(F.col("bucket").alias(f"_bucket{i}"), F.col("bitmap").alias(f"_bitmap{i}"))
        x = x.withColumn(f"_slot{i}", slot).withColumn(f"_bucket{i}", F.floor(F.col(f"_slot{i}") / BITMAP_BITS))
        x = x.join(F.broadcast(own), f"_bucket{i}", "left")
        hit = hit & _bit(F.col(f"_bitmap{i}"), F.col(f"_slot{i}"))
    return x.select(*cols, hit.alias("again"))


def with_filter(rows: DataFrame, digest: Column, members: DataFrame, n_members: int, *, bits_per_row: int = 16, probes: int = 2,
                max_bits: int = 1 << 28) -> DataFrame:
    """``rows`` with ``again``: false only if ``digest`` is none of ``members`` (column ``digest``).  The filter has at most ``max_bits``."""
    bits = filter_bits(n_members, bits_per_row, max_bits)
    slots = members.select(F.explode(F.array(*_slots(probes, bits))).alias("slot"))
    filt = slots.groupBy(F.floor(F.col("slot") / BITMAP_BITS).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(BITMAP_BITS))).alias("bitmap"))
    return probed(rows, filt, digest, probes, bits)


def _bit(bitmap: Column, slot: Column) -> Column:
    """Whether bit ``slot % BITMAP_BITS`` of a bitmap is set; false without a bitmap."""
    at = F.pmod(slot, F.lit(BITMAP_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, F.pmod(at, F.lit(8))).bitwiseAND(1) == 1, F.lit(False))


def repeated_slots(digests: DataFrame, probes: int, bits: int) -> DataFrame:
    """Pass 1: bitmaps (``bucket``, ``bitmap``) of the slots that two or more rows hit."""
    slots = digests.select(F.explode(F.array(*_slots(probes, bits))).alias("slot"))
    twice = slots.groupBy("slot").count().where("count > 1")
    return twice.groupBy(F.floor(F.col("slot") / BITMAP_BITS).alias("bucket")).agg(
        F.bitmap_construct_agg(F.pmod("slot", F.lit(BITMAP_BITS))).alias("bitmap"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                     bits_per_row: int = 16, probes: int = 2, max_bits: int = 1 << 28) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Equal texts form a group, of which the largest ``doc_id`` stays.  A null text
    counts as empty; empty texts equal each other.  Repeated rows with the same id
    count in ``group_size``, and each of them that carries ``keep_id`` is kept.  A
    null id never beats another; in a group of null ids only, ``keep_id`` is null
    and its rows are kept.  An empty table gives an empty result.  Other columns
    are ignored.
    """
    rows = materialize(docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias("digest")), "digests")
    total = rows.count()
    bits = filter_bits(total, bits_per_row, max_bits)
    found = probed(rows, repeated_slots(rows, probes, bits), F.col("digest"), probes, bits)

    again = found.where("again").select("doc_id", "digest")
    groups = again.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups, "groups")
    copies = heavy_lookup(again, groups, "digest", "group_size", total)
    single = found.where(~F.col("again")).select(
        "doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return single.unionByName(copies).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return without_ids(docs, exact_duplicates(docs, id_col, text_col).where(~F.col("kept")), id_col)
