"""Strings, arrays and maps as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


# --- strings ---

def split(s: Column, sep: str) -> Column:
    """Pieces between single separators; a text that ends with one has no empty last piece."""
    pieces = F.split(s, rf"\Q{sep}\E", -1)
    return F.when(s.endswith(sep) | (F.length(s) == 0), F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))).otherwise(pieces)


def join(xs: Column, sep: str) -> Column:
    return F.array_join(xs, sep)


def is_prefix(a: Column, b: Column) -> Column:
    """Whether ``b`` begins with ``a``."""
    return b.startswith(a)


def is_suffix(a: Column, b: Column) -> Column:
    return b.endswith(a)


def to_fixed(x: Column, places: int) -> Column:
    """With so many decimal places, without grouping."""
    return F.format_string(f"%.{places}f", x)


def capitalise_front(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2), F.length(s)))


# --- arrays ---

def append(xs: Column, x: Column) -> Column:
    return F.concat(xs, F.array(x))


def reorder(xs: Column, places: Column) -> Column:
    """Elements at ``places`` (from 0), in that order."""
    return F.transform(places, lambda i: F.get(xs, i))


def erase_if(xs: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(xs, lambda x: ~test(x))


def erase_indices(xs: Column, places: Column) -> Column:
    return F.filter(xs, lambda x, i: ~F.array_contains(places, i))


def merge_sorted(a: Column, b: Column, form: Callable[[Column], Column]) -> Column:
    """Ascending elements of ``a`` and of ``b`` after ``form``."""
    return F.array_sort(F.concat(a, F.transform(b, form)))


# --- maps ---

def sum_values(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v)


def sum_keys(m: Column) -> Column:
    return F.aggregate(F.map_keys(m), F.lit(0.0), lambda s, v: s + v)


def sorted_keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def values_by_key(m: Column) -> Column:
    return F.transform(sorted_keys(m), lambda k: F.element_at(m, k))


def merge_sums(a: Column, b: Column) -> Column:
    """One map with the sums of the values of equal keys."""
    zero = F.lit(0.0)
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))
