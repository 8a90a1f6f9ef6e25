"""Half-open integer intervals (start, end) as pairs of columns (GR30)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Interval = tuple[Column, Column]


def size(a: Interval) -> Column:
    return a[1] - a[0]


def merge(a: Interval, b: Interval) -> Interval:
    """The least interval that holds both."""
    return F.least(a[0], b[0]), F.greatest(a[1], b[1])


def shift(a: Interval, by: Column | int) -> Interval:
    return a[0] + by, a[1] + by


def overlaps(a: Interval, b: Interval) -> Column:
    """Whether the one that starts later starts before the other ends; ones that only touch don't overlap."""
    return F.when(a[0] > b[0], b[1] > a[0]).otherwise(a[1] > b[0])


def contains(a: Interval, b: Interval) -> Column:
    return (a[0] <= b[0]) & (a[1] >= b[1])


def crosses(a: Interval, b: Interval) -> Column:
    """Whether they overlap and the first doesn't hold the second."""
    return overlaps(a, b) & ~contains(a, b)
