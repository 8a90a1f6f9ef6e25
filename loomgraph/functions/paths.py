"""Scopes of attribute paths: steps joined by bars, the empty path being the whole row (SCH11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent(path: Column) -> Column:
    """The path without its last step."""
    return F.regexp_replace(path, r"\|?[^|]*$", "")


def inner(path: Column) -> Column:
    """The path without its first step."""
    return F.regexp_replace(path, r"^[^|]*\|?", "")


def depth(path: Column) -> Column:
    """How many steps the path has."""
    return F.when(path == "", 0).otherwise(F.size(F.split(path, r"\|", -1)))


def same(scope: Column, other: Column) -> Column:
    return scope == other


def outer_of(scope: Column, other: Column) -> Column:
    """Whether the scope holds the other and isn't the other. Steps are compared whole."""
    return (scope != other) & contains(scope, other)


def contains(scope: Column, path: Column) -> Column:
    """Whether the path lies in the scope or is it."""
    return (scope == "") | (scope == path) | path.startswith(F.concat(scope, F.lit("|")))


def relative(scope: Column, path: Column) -> Column:
    """What of the path follows the scope; null where it doesn't lie in it."""
    rest = F.when(scope == "", path).when(scope == path, "").otherwise(F.substr(path, F.length(scope) + 2))
    return F.when(contains(scope, path), rest)
