"""Positions and extremes of arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_set(v: Column) -> Column:
    """The distinct elements in order; two arrays hold the same set if these are equal."""
    return F.array_sort(F.array_distinct(v))


def argsort(v: Column) -> Column:
    """0-based positions of the elements in ascending order; equal ones keep their order."""
    return F.transform(F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])


def argsort_floats(v: Column, ascending: bool) -> Column:
    """Positions of doubles in order. ``ascending=True`` gives DESCENDING order, as callers of the original interface expect.

    The descending order is the exact reverse of the ascending one, also among ties. NaN is an error.
    """
    up = F.when(F.exists(v, lambda x: F.isnan(x)), F.raise_error(F.lit("NaN cannot be ordered")).cast("array<int>")).otherwise(argsort(v))
    return F.reverse(up) if ascending else up


def argmax(v: Column) -> Column:
    """(index, value) of the largest element, among ties the last; null for an empty array."""
    pairs = F.transform(v, lambda x, i: F.struct(x.alias("value"), i.alias("index")))
    best = F.array_max(pairs)
    return F.when(F.size(v) > 0, F.struct(best["index"].alias("index"), best["value"].alias("value")))


def argmin(v: Column) -> Column:
    """(index, value) of the smallest element, among ties the first; null for an empty array."""
    pairs = F.transform(v, lambda x, i: F.struct(x.alias("value"), i.alias("index")))
    best = F.array_min(pairs)
    return F.when(F.size(v) > 0, F.struct(best["index"].alias("index"), best["value"].alias("value")))


def min_argmin(v: Column) -> Column:
    """(value, indices) of the smallest element: every position that holds it; null for an empty array."""
    least = F.array_min(v)
    at = F.filter(F.transform(v, lambda x, i: F.when(x == least, i)), lambda i: i.isNotNull())
    return F.when(F.size(v) > 0, F.struct(least.alias("value"), at.alias("indices")))
