"""Rows of one small object (a graph, a factor graph) brought together and handed to a Python function.

Objects are gathered by one shuffle and go through mapInPandas, so a task holds an Arrow batch of objects and not
a pandas group for each. An object is a model graph, tens of rows; a table keyed by something unbounded doesn't belong here."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_object(rows: DataFrame, key: str, fn: Callable[[list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """`fn` of each key's rows, as rows of (key, *schema). Rows come in no order; rows with a null key are left out."""
    others = [c for c in rows.columns if c != key]
    lists = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct(*others)).alias("rows"))
    names = [c.strip().split(" ", 1)[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out = [(k, *found) for k, rs in zip(batch["key"], batch["rows"]) for found in fn([r if isinstance(r, dict) else r.asDict() for r in rs])]
            yield pd.DataFrame(out, columns=[key, *names], dtype=object)

    kind = lists.schema["key"].dataType.simpleString()
    return lists.mapInPandas(run, f"`{key}` {kind}, {schema}")
