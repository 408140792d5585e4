"""Nucleotide sequences as string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complements of the IUPAC codes, and what each code stands for.
IUPAC, COMPLEMENT = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv", "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"
AMBIGUITY = {"R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def capitalise(s: Column) -> Column:
    return F.upper(s)


def is_canonical_dna(s: Column) -> Column:
    return s.rlike("^[ACGTacgt]*$")


def is_canonical_rna(s: Column) -> Column:
    return s.rlike("^[ACGUacgu]*$")


def is_dna(s: Column) -> Column:
    """Canonical bases and N."""
    return s.rlike("^[ACGTNacgtn]*$")


def has_ns(s: Column) -> Column:
    return s.rlike("[Nn]")


def complement(s: Column) -> Column:
    return F.translate(s, IUPAC, COMPLEMENT)


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def is_reverse_complement(a: Column, b: Column) -> Column:
    return a == reverse_complement(b)


def is_palindromic(s: Column) -> Column:
    """Equal to its own reverse complement."""
    return is_reverse_complement(s, s)


def transcribe(s: Column) -> Column:
    return F.translate(s, "Tt", "Uu")


def reverse_transcribe(s: Column) -> Column:
    return F.translate(s, "Uu", "Tt")


def disambiguate(s: Column) -> Column:
    """Each ambiguity code replaced by the first base it stands for; N stays."""
    codes = [c for c in AMBIGUITY if c != "N"]
    return F.translate(s, "".join(codes) + "".join(codes).lower(), "".join(AMBIGUITY[c][0] for c in codes) + "".join(AMBIGUITY[c][0].lower() for c in codes))


def count_base(s: Column, base: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(base), F.lit("")))


def gc_content(s: Column) -> Column:
    """Share of G and C; 0 for an empty sequence."""
    n = F.length(F.translate(F.upper(s), "ATNU", ""))
    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(n / F.length(s))


def is_homopolymer(s: Column) -> Column:
    return (F.length(s) > 0) & (F.length(F.replace(s, F.substring(s, 1, 1), F.lit(""))) == 0)


def is_tandem_repeat(s: Column, period: int) -> Column:
    """Whether the sequence repeats its first ``period`` bases, at least twice."""
    n = F.length(s)
    return (n >= 2 * period) & (F.substr(s, F.lit(1), n - period) == F.substr(s, F.lit(period + 1), n))


def kmers(s: Column, k: int) -> Column:
    """All windows of ``k`` bases."""
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substr(s, i, F.lit(k)))).otherwise(
        F.array().cast("array<string>"))


def canonical_motif(s: Column) -> Column:
    """The least of all rotations of a motif and of its reverse complement."""
    both = F.array(s, reverse_complement(s))
    spins = F.flatten(F.transform(both, lambda x: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(
        F.substr(x, i, F.length(s)), F.substr(x, F.lit(1), i - 1)))))
    return F.when(F.length(s) > 0, F.array_min(spins)).otherwise(s)


def common_prefix_length(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    hits = F.filter(F.sequence(F.lit(0), n), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))
    return F.array_max(hits)


def hamming(a: Column, b: Column) -> Column:
    """Mismatches over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(at, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))
