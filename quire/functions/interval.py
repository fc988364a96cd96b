"""Closed integer intervals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Number of integers in both intervals."""
    return F.greatest(F.least(e1, e2) + 1 - F.greatest(s1, s2), F.lit(0))


def within(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """[s1, e1] lies in [s2, e2]."""
    return (s1 >= s2) & (e1 <= e2)


def all_within(inner: Column, outer: Column, start: str = "s", end: str = "e") -> Column:
    """Every interval of one array of structs fits in a single one of the other."""
    return F.forall(inner, lambda a: F.exists(outer, lambda b: within(a[start], a[end], b[start], b[end])))


def starts_in_range(s: Column, e: Column, range_start: Column, range_end: Column) -> Column:
    """Starts in the range and ends at most one past it."""
    return (s >= range_start) & (s <= range_end) & (e <= range_end + 1)
