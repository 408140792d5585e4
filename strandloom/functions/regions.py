"""Half-open, zero-based region algebra as column functions.

A region is a pair of long columns (begin, end); empty regions (begin = end) are legal and stand for
insertion points.  Regions on different contigs never overlap, contain or touch each other: callers
equate contigs in the join or filter condition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Region:
    """Two columns of one region; ``Region.of("r")`` names the columns ``r.start_pos`` and ``r.end_pos``."""

    begin: Column
    end: Column

    @classmethod
    def of(cls, alias: str | None = None, begin: str = "start_pos", end: str = "end_pos") -> Region:
        p = f"{alias}." if alias else ""
        return cls(F.col(p + begin), F.col(p + end))

    @property
    def size(self) -> Column:
        return self.end - self.begin

    @property
    def is_empty(self) -> Column:
        return self.begin == self.end


def checked(r: Region) -> Column:
    """``begin``, or an error if the region runs backwards."""
    return F.when(r.begin <= r.end, r.begin).otherwise(F.raise_error(F.lit("bad region: begin is after end")))


def is_same(a: Region, b: Region) -> Column:
    return (a.begin == b.begin) & (a.end == b.end)


def is_before(a: Region, b: Region) -> Column:
    return (a.end <= b.begin) & ~is_same(a, b)


def is_after(a: Region, b: Region) -> Column:
    return (b.end <= a.begin) & ~is_same(a, b)


def are_adjacent(a: Region, b: Region) -> Column:
    return (a.begin == b.end) | (a.end == b.begin)


def overlap_size(a: Region, b: Region) -> Column:
    """Signed: negative values are gaps."""
    return F.least(a.end, b.end) - F.greatest(a.begin, b.begin)


def overlaps(a: Region, b: Region) -> Column:
    """Positive overlap, or contact if one of the regions is empty."""
    n = overlap_size(a, b)
    return (n > 0) | ((n == 0) & (a.is_empty | b.is_empty))


def contains(a: Region, b: Region) -> Column:
    return (a.begin <= b.begin) & (b.end <= a.end)


def inner_distance(a: Region, b: Region) -> Column:
    """0 if they overlap, else the gap; negative if ``a`` is on the right."""
    return F.when(overlaps(a, b), F.lit(0)).when(is_before(a, b), b.begin - a.end).otherwise(b.end - a.begin)


def outer_distance(a: Region, b: Region) -> Column:
    """0 if one contains the other, else from the begin of ``a`` to the end of ``b``."""
    return F.when(contains(a, b) | contains(b, a), F.lit(0)).otherwise(b.end - a.begin)


def begin_distance(a: Region, b: Region) -> Column:
    return b.begin - a.begin


def end_distance(a: Region, b: Region) -> Column:
    return b.end - a.end


def _not_below_zero(x: Column) -> Column:
    return F.when(x >= 0, x).otherwise(F.raise_error(F.lit("region moved past the contig's start")))


def shift(a: Region, n) -> Region:
    return Region(_not_below_zero(a.begin + n), a.end + n)


def expand_lhs(a: Region, n) -> Region:
    return Region(_not_below_zero(a.begin - n), a.end)


def expand_rhs(a: Region, n) -> Region:
    return Region(a.begin, a.end + n)


def expand(a: Region, n) -> Region:
    """Both sides; the left side stops at 0, the right side is not bounded."""
    return Region(F.greatest(a.begin - n, F.lit(0)), a.end + n)


def _or_null(test: Column, r: Region) -> Region:
    return Region(F.when(test, r.begin), F.when(test, r.end))


def overlapped_region(a: Region, b: Region) -> Region:
    return _or_null(overlaps(a, b), Region(F.greatest(a.begin, b.begin), F.least(a.end, b.end)))


def encompassing_region(a: Region, b: Region) -> Region:
    return Region(F.least(a.begin, b.begin), F.greatest(a.end, b.end))


def intervening_region(a: Region, b: Region) -> Region:
    return _or_null((a.begin <= b.begin) & ~overlaps(a, b), Region(a.end, b.begin))


def left_overhang_region(a: Region, b: Region) -> Region:
    """The part of ``a`` left of ``b``; empty at the begin of ``a`` if there is none."""
    return Region(a.begin, F.when(a.begin >= b.begin, a.begin).otherwise(F.least(a.end, b.begin)))


def right_overhang_region(a: Region, b: Region) -> Region:
    return Region(F.when(a.end <= b.end, a.end).otherwise(F.greatest(a.begin, b.end)), a.end)


def left_overhang_size(a: Region, b: Region) -> Column:
    return F.greatest(b.begin - a.begin, F.lit(0))


def right_overhang_size(a: Region, b: Region) -> Column:
    return F.greatest(a.end - b.end, F.lit(0))


def closed_region(a: Region, b: Region) -> Region:
    return Region(a.begin, b.end)


def head_region(a: Region, n=0) -> Region:
    return Region(a.begin, F.least(a.begin + n, a.end))


def tail_region(a: Region, n=0) -> Region:
    """The last ``n`` positions; the begin is bounded by 0, not by the region's own begin."""
    return Region(F.greatest(a.end - n, F.lit(0)), a.end)


def to_string(contig: Column, a: Region) -> Column:
    return F.concat(contig, F.lit(":"), a.begin.cast("string"), F.lit("-"), a.end.cast("string"))
