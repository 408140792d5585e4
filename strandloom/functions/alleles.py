"""Alleles and variants: (start_pos, end_pos, ref, alt) on the half-open reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequences import common_prefix_length, hamming


def is_snv(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1)


def is_mnv(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == F.length(alt)) & (F.length(ref) > 1)


def is_insertion(ref: Column, alt: Column) -> Column:
    return F.length(alt) > F.length(ref)


def is_deletion(ref: Column, alt: Column) -> Column:
    return F.length(alt) < F.length(ref)


def is_indel(ref: Column, alt: Column) -> Column:
    return F.length(alt) != F.length(ref)


def is_simple_insertion(ref: Column, alt: Column) -> Column:
    return is_insertion(ref, alt) & (F.length(ref) == 0)


def is_simple_deletion(ref: Column, alt: Column) -> Column:
    return is_deletion(ref, alt) & (F.length(alt) == 0)


def is_transition(ref: Column, alt: Column) -> Column:
    pair = F.concat(F.upper(ref), F.upper(alt))
    return is_snv(ref, alt) & pair.isin("AG", "GA", "CT", "TC")


def is_transversion(ref: Column, alt: Column) -> Column:
    return is_snv(ref, alt) & (ref != alt) & ~is_transition(ref, alt)


def indel_size(ref: Column, alt: Column) -> Column:
    return F.abs(F.length(ref) - F.length(alt))


def variant_class(ref: Column, alt: Column) -> Column:
    return (F.when(is_snv(ref, alt), F.when(is_transition(ref, alt), "transition").when(ref != alt, "transversion").otherwise("reference"))
            .when(is_mnv(ref, alt), "mnv").when(is_insertion(ref, alt), "insertion").when(is_deletion(ref, alt), "deletion").otherwise("empty"))


def trim(start: Column, ref: Column, alt: Column) -> Column:
    """``struct(start_pos, end_pos, ref, alt)`` without common bases: first at the front, then at the back."""
    front = common_prefix_length(ref, alt)
    r, a = F.substr(ref, front + 1, F.length(ref)), F.substr(alt, front + 1, F.length(alt))
    back = common_prefix_length(F.reverse(r), F.reverse(a))
    r2, a2 = F.substr(r, F.lit(1), F.length(r) - back), F.substr(a, F.lit(1), F.length(a) - back)
    begin = start + front
    return F.struct(begin.alias("start_pos"), (begin + F.length(r2)).alias("end_pos"), r2.alias("ref"), a2.alias("alt"))


def can_trim(ref: Column, alt: Column) -> Column:
    """Whether first or last bases agree."""
    both = (F.length(ref) > 0) & (F.length(alt) > 0)
    return both & ((F.substring(ref, 1, 1) == F.substring(alt, 1, 1)) | (F.substr(ref, F.length(ref), F.lit(1)) == F.substr(alt, F.length(alt), F.lit(1))))


def is_parsimonious(ref: Column, alt: Column) -> Column:
    """No empty side, at most one common base in front, and none behind unless a side has one base only."""
    shortest = F.least(F.length(ref), F.length(alt))
    two_in_front = (shortest > 1) & (F.substring(ref, 1, 2) == F.substring(alt, 1, 2))
    same_back = F.substr(ref, F.length(ref), F.lit(1)) == F.substr(alt, F.length(alt), F.lit(1))
    return (shortest > 0) & ~two_in_front & ((shortest == 1) | ~same_back)


def split_mnv(start: Column, ref: Column, alt: Column) -> Column:
    """Array of the single-base differences of two sequences of one length: ``struct(start_pos, end_pos, ref, alt)``."""
    n = F.length(ref)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(at, lambda i: F.substr(ref, i + 1, F.lit(1)) != F.substr(alt, i + 1, F.lit(1)))
    return F.transform(hits, lambda i: F.struct((start + i).alias("start_pos"), (start + i + 1).alias("end_pos"),
                                                F.substr(ref, i + 1, F.lit(1)).alias("ref"), F.substr(alt, i + 1, F.lit(1)).alias("alt")))


def positional_alleles(start: Column, seq: Column) -> Column:
    """One reference allele per base."""
    n = F.length(seq)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct((start + i).alias("start_pos"), (start + i + 1).alias("end_pos"), F.substr(seq, i + 1, F.lit(1)).alias("seq")))


def sub_allele(start: Column, seq: Column, begin: Column, end: Column) -> Column:
    """The bases of a same-size allele on [begin, end)."""
    return F.substr(seq, (begin - start + 1).cast("int"), (end - begin).cast("int"))


def pad_left(ref_base: Column, ref: Column, alt: Column, start: Column) -> Column:
    return F.struct((start - F.length(ref_base)).alias("start_pos"), F.concat(ref_base, ref).alias("ref"), F.concat(ref_base, alt).alias("alt"))


def mismatches(a: Column, b: Column) -> Column:
    return hamming(a, b)


def pad_right(ref_base: Column, ref: Column, alt: Column, start: Column) -> Column:
    return F.struct(start.alias("start_pos"), F.concat(ref, ref_base).alias("ref"), F.concat(alt, ref_base).alias("alt"))


def common_suffix_length(a: Column, b: Column) -> Column:
    """In one pass over both strings."""
    ends = lambda x: F.split(F.reverse(x), "")
    first = F.array_position(F.zip_with(ends(a), ends(b), lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(first == 0, F.length(a)).otherwise(first - 1).cast("int")


def left_shift(ref: Column, alt: Column, before: Column) -> Column:
    """How far an indel can move left within ``before``, the reference up to its begin: the common suffix of both
    alleles behind it.  As many as ``before`` has means that it may go on.  Other variants do not move."""
    n = common_suffix_length(F.concat(before, ref), F.concat(before, alt))
    return F.when(is_indel(ref, alt), F.least(n, F.length(before))).otherwise(0)


def shifted_left(start: Column, ref: Column, alt: Column, before: Column, n: Column) -> Column:
    """The variant ``n`` positions to the left; the alleles keep their sizes."""
    cut = lambda x: F.substr(F.concat(before, x), F.length(before) - n + 1, F.length(x))
    begin = start - n
    return F.struct(begin.alias("start_pos"), (begin + F.length(ref)).alias("end_pos"), cut(ref).alias("ref"), cut(alt).alias("alt"))


def make_parsimonious(start: Column, ref: Column, alt: Column, base_before: Column, base_behind: Column) -> Column:
    """The shortest form in which both alleles have a base: common bases go at the front, then at the back, but for one.

    An allele without bases gets the reference base before it, or the one behind it at the start of a contig.
    """
    least = F.least(F.length(ref), F.length(alt))
    front = common_prefix_length(ref, alt)
    rest = lambda x, k: F.substr(x, k + 1, F.length(x))
    back = F.least(common_suffix_length(rest(ref, front), rest(alt, front)), least - front, F.greatest(least - 1, F.lit(0)))
    f = F.when(front == least, least - 1).otherwise(front)
    b = F.when(front == least, 0).otherwise(back)
    cut = lambda x: F.substr(x, f + 1, F.length(x) - f - b)
    cell = lambda s, r, a: F.struct(s.cast("bigint").alias("start_pos"), (s + F.length(r)).cast("bigint").alias("end_pos"), r.alias("ref"), a.alias("alt"))
    return F.when((least == 0) & (start > 0), cell(start - 1, F.concat(base_before, ref), F.concat(base_before, alt))).when(
        least == 0, cell(start, F.concat(ref, base_behind), F.concat(alt, base_behind))).otherwise(cell(start + f, cut(ref), cut(alt)))
