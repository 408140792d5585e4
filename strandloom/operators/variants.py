"""Normal forms of variants against a reference, and sets of variants.

Variants are rows ``contig, start_pos, end_pos, ref, alt`` with other columns beside; a reference is cut into chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alleles as A
from ..sources.store import cut
from ..sources.text_formats import CHUNK, fetch_sequences

col = F.col
VARIANT = ["contig", "start_pos", "end_pos", "ref", "alt"]


def _moved(df: DataFrame, form, fields: list[str]) -> DataFrame:
    x = df.withColumn("_v", form)
    for c in fields:
        x = x.withColumn(c, col(f"_v.{c}"))
    return x.drop("_v")


def _with_reference(variants: DataFrame, reference: DataFrame, left: int, right: int, chunk: int) -> DataFrame:
    """Add ``_seq``: the reference from ``left`` positions before a variant (or the contig's start) to ``right`` behind it."""
    around = variants.select("contig", col("start_pos").alias("_at"), col("end_pos").alias("_to")).distinct().select(
        "contig", "_at", "_to", F.greatest(col("_at") - left, F.lit(0)).alias("start_pos"), (col("_to") + right).alias("end_pos"))
    found = fetch_sequences(around, reference, chunk=chunk, id_cols=["contig", "_at", "_to"])
    return variants.join(found.select("contig", col("_at").alias("start_pos"), col("_to").alias("end_pos"), col("ref_seq").alias("_seq")), ["contig", "start_pos", "end_pos"], "left")


def left_align(variants: DataFrame, reference: DataFrame, *, window: int = 64, chunk: int = CHUNK, rounds: int = 12) -> DataFrame:
    """Indels as far left as they go with alleles of their sizes; other variants stay.

    Each round shifts by up to ``window`` positions; only variants that used the whole window go on, with four times the
    window, so that the last of ``rounds`` covers a contig.
    """
    done: DataFrame | None = None
    rest = variants
    for i in range(rounds):
        width = window * 4 ** min(i, 8)
        x = _with_reference(rest, reference, width, 0, chunk)
        before = F.substr("_seq", F.lit(1), F.length("_seq") - F.length("ref"))
        x = x.withColumn("_before", F.coalesce(before, F.lit(""))).withColumn("_n", A.left_shift(col("ref"), col("alt"), col("_before")))
        x = _moved(x, A.shifted_left(col("start_pos"), col("ref"), col("alt"), col("_before"), col("_n")), VARIANT[1:]).drop("_seq", "_before")
        more = (col("_n") == width) & (col("start_pos") > 0)
        if i + 1 == rounds:
            more = F.lit(False)
        fixed = x.where(~more).select(*variants.columns)
        done = fixed if done is None else done.unionByName(fixed)
        if i + 1 < rounds:
            rest = cut(x.where(more).select(*variants.columns))
            if rest.isEmpty():
                break
    return done


def parsimonise(variants: DataFrame, reference: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """Each variant in its shortest form with a base in both alleles."""
    x = _with_reference(variants, reference, 1, 1, chunk)
    one = A.make_parsimonious(col("start_pos"), col("ref"), col("alt"), F.substring("_seq", 1, 1), F.substring("_seq", -1, 1))
    return _moved(x, one, VARIANT[1:]).select(*variants.columns)


def parsimonise_together(variants: DataFrame, reference: DataFrame, group: list[str], *, chunk: int = CHUNK) -> DataFrame:
    """Variants of a group of one region: if any of them needs a padding base, all get it, so that they keep one region."""
    key = F.struct(*group)
    empty = variants.groupBy(key.alias("_g")).agg(F.bool_or((F.length("ref") == 0) | (F.length("alt") == 0)).alias("_pad"))
    x = _with_reference(variants.withColumn("_g", key).join(empty, "_g"), reference, 1, 1, chunk)
    base = F.when(col("start_pos") > 0, F.substring("_seq", 1, 1)).otherwise(F.substring("_seq", -1, 1))
    left, right = A.pad_left(base, col("ref"), col("alt"), col("start_pos")), A.pad_right(base, col("ref"), col("alt"), col("start_pos"))
    form = F.when(~col("_pad"), F.struct("start_pos", "ref", "alt")).when(col("start_pos") > 0, left).otherwise(right)
    return _moved(x, form, ["start_pos", "ref", "alt"]).withColumn("end_pos", col("start_pos") + F.length("ref")).select(*variants.columns)


def normalise(variants: DataFrame, reference: DataFrame, **options) -> DataFrame:
    """Left-aligned and parsimonious."""
    return parsimonise(left_align(variants, reference, **options), reference, chunk=options.get("chunk", CHUNK))


def unique_left_align(variants: DataFrame, reference: DataFrame, **options) -> DataFrame:
    """Distinct variants after left alignment (their own columns only)."""
    return left_align(variants.select(*VARIANT), reference, **options).distinct()


def intervening_reference_alleles(variants: DataFrame, reference: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """``contig, start_pos, end_pos, seq``: the reference between the regions that variants cover."""
    from .interval import intervening_regions

    gaps = intervening_regions(variants.select("contig", "start_pos", "end_pos"))
    return fetch_sequences(gaps, reference, chunk=chunk).select("contig", "start_pos", "end_pos", col("ref_seq").alias("seq"))


def novel_variants(found: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct variants of ``found`` that are not in ``known``."""
    return found.select(*VARIANT).distinct().join(known.select(*VARIANT).distinct(), VARIANT, "left_anti")


def haplotype_difference(haplotypes: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: ``allele_ids`` of ``haplotypes`` that the haplotype of ``other`` with the same key lacks."""
    theirs = other.select(*keys, col("allele_ids").alias("_theirs"))
    return haplotypes.join(theirs, keys, "left").withColumn("allele_ids", F.array_except("allele_ids", F.coalesce("_theirs", F.array().cast("array<int>")))).drop("_theirs")


def resolve_connecting(calls: DataFrame, window: str = "window", keys: list[str] = ("contig",)) -> DataFrame:
    """Calls of neighbouring windows without conflicts: where calls of two windows overlap, the later window's variants stay.

    ``calls`` have the number of their window and ``is_refcall``.  A reference call goes if a variant of either window
    overlaps it; a variant of the earlier window goes if a variant of the next window overlaps it.  Both are anti-joins
    on regions; no window is held as a whole.
    """
    from .interval import copy_nonoverlapped

    keys = list(keys)
    variants = calls.where(~col("is_refcall"))
    later = variants.select(*keys, "start_pos", "end_pos", (col(window) - 1).alias(window))
    kept = copy_nonoverlapped(variants, later, on=[*keys, window])
    refcalls = calls.where("is_refcall")
    return kept.unionByName(copy_nonoverlapped(refcalls, kept.select(*keys, "start_pos", "end_pos"), on=keys))
