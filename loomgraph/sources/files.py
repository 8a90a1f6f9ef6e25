"""Nested sources: dispatch by extension, and the schema lattice that merges rows of different shapes.

A schema here is a Python value: "single", "null", "empty", "list", or {"list": bool, "fields": {...}}.
Spark's own inference turns a scalar beside a list into text; this lattice turns it into a list."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Kind = Any


def load(spark: SparkSession, path: str, row_tag: str = "row", distinct: bool = True) -> DataFrame:
    """CSV, tab-separated text, JSON (whole or lines), XML or parquet by extension, split among tasks; duplicate rows removed
    (SRC1-SRC4). sources.documents reads documents that wrap their rows."""
    end = path.rsplit(".", 1)[-1].lower()
    if end in ("csv", "tsv"):
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", "," if end == "csv" else "\t").csv(path)
        df = df.toDF(*[c.strip() for c in df.columns])
    elif end in ("jsonl", "ndjson"):
        df = spark.read.json(path)
    elif end == "json":
        df = spark.read.option("multiLine", True).json(path)
    elif end == "xml":
        df = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "@").option("valueTag", "#text").load(path)
    elif end == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"no reader for {path}")
    return df.distinct() if distinct else df


def kind_of(value: Any) -> Kind:
    """The kind of one JSON value (SCH1)."""
    if value is None:
        return "null"
    if isinstance(value, dict):
        return {"list": False, "fields": {k: kind_of(v) for k, v in value.items()}}
    if isinstance(value, list):
        if not value:
            return "empty"
        kinds = [kind_of(v) for v in value]
        if any(isinstance(k, dict) for k in kinds):
            if not all(isinstance(k, dict) for k in kinds):
                raise TypeError("a list holds objects and values")
            out = kinds[0]
            for k in kinds[1:]:
                out = merge(out, k)
            return {"list": True, "fields": out["fields"]}
        if any(k in ("list", "empty") for k in kinds):
            raise TypeError("a list of lists")
        return "list"
    return "single"


#: What two different plain kinds merge into, in either order.
_JOINS = {frozenset(("single", "list")): "list", frozenset(("single", "null")): "single", frozenset(("empty", "single")): "single", frozenset(("empty", "list")): "list"}


def merge(a: Kind, b: Kind) -> Kind:
    """The least kind above two (SCH2); kinds without one raise."""
    if isinstance(a, dict) and isinstance(b, dict):
        names = dict.fromkeys([*a["fields"], *b["fields"]])
        fields = {n: merge(a["fields"][n], b["fields"][n]) if n in a["fields"] and n in b["fields"] else a["fields"].get(n, b["fields"].get(n)) for n in names}
        return {"list": a["list"] or b["list"], "fields": fields}
    if isinstance(a, dict) or isinstance(b, dict):
        if a == "null" or b == "null":
            return a if isinstance(a, dict) else b
        if b == "empty":
            return {"list": True, "fields": a["fields"]}
        raise TypeError(f"{a} and {b} have no common kind")
    if a == b:
        return a
    if frozenset((a, b)) in _JOINS:
        return _JOINS[frozenset((a, b))]
    raise TypeError(f"{a} and {b} have no common kind")


def infer(rows: DataFrame, column: str = "value") -> Kind:
    """The kind of all rows of JSON text: each partition folds its own, then the driver folds those."""

    def fold(batches):
        import pyarrow as pa

        out = None
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text is not None:
                    out = kind_of(json.loads(text)) if out is None else merge(out, kind_of(json.loads(text)))
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(out)])], ["kind"])

    parts = [json.loads(r["kind"]) for r in rows.select(column).mapInArrow(fold, "kind string").collect()]
    if not parts:
        raise ValueError("no rows to infer a schema from")
    out = parts[0]
    for p in parts[1:]:
        out = merge(out, p)
    return out


def spark_type(kind: Kind) -> T.DataType:
    """The Spark type rows of a kind are normalised to: leaves are text."""
    if isinstance(kind, dict):
        struct = T.StructType([T.StructField(n, spark_type(k)) for n, k in kind["fields"].items()])
        return T.ArrayType(struct) if kind["list"] else struct
    return T.ArrayType(T.StringType()) if kind in ("list", "empty") else T.StringType()


def normalize(value: Any, kind: Kind) -> Any:
    """A JSON value in the shape of a kind (SCH3): missing object lists are empty, scalars become lists."""
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    if isinstance(kind, dict):
        if kind["list"]:
            rows = value if isinstance(value, list) else [] if value is None else [value]
            return [{n: normalize(r.get(n), k) for n, k in kind["fields"].items()} for r in rows]
        return {n: normalize((value or {}).get(n), k) for n, k in kind["fields"].items()}
    if kind in ("list", "empty"):
        return None if value is None else [text(v) for v in value] if isinstance(value, list) else [text(value)]
    if isinstance(value, list):
        return text(value[0]) if value else None
    return text(value)


def paths(kind: Kind, prefix: str = "") -> list[str]:
    """Leaf paths joined by bars (SCH4)."""
    if not isinstance(kind, dict):
        return [prefix]
    return [p for n, k in kind["fields"].items() for p in paths(k, f"{prefix}|{n}" if prefix else n)]


def steps_to(kind: Kind, path: str) -> Kind | None:
    """The kind at a path, null text where there is none; objects and lists of objects are gone through (SCH5)."""
    at = kind
    for step in path.split("|") if path else ():
        if not isinstance(at, dict) or step not in at["fields"]:
            return None
        at = at["fields"][step]
    return at


def has_path(kind: Kind, path: str) -> bool:
    return steps_to(kind, path) is not None


def add_path(kind: Kind, path: str, leaf: Kind, after: str | None = None) -> Kind:
    """A kind with one field more, last among its siblings or right behind one of them (SCH6)."""
    first, _, rest = path.partition("|")
    fields = dict(kind["fields"])
    if rest:
        return kind | {"fields": fields | {first: add_path(fields[first], rest, leaf, after.partition("|")[2] if after else None)}}
    fields.pop(first, None)
    names = list(fields)
    at = names.index(after) + 1 if after in fields else len(names)
    return kind | {"fields": {n: leaf if n == first else fields[n] for n in [*names[:at], first, *names[at:]]}}


def remove_path(kind: Kind, path: str) -> Kind:
    """A kind without a field, and without parents that this leaves empty (SCH7, SCH9)."""
    first, _, rest = path.partition("|")
    fields = dict(kind["fields"])
    if not rest:
        del fields[first]
        return kind | {"fields": fields}
    inner = remove_path(fields[first], rest)
    return kind | {"fields": fields | {first: inner} if inner["fields"] else {n: k for n, k in fields.items() if n != first}}


def to_text(kind: Kind) -> str:
    """A kind as JSON, and from_text() back (SCH9)."""
    return json.dumps(kind)


def from_text(text: str) -> Kind:
    return json.loads(text)


def kind_of_schema(kind: T.DataType) -> Kind:
    """The kind of a table that Spark has read (SCH9)."""
    if isinstance(kind, T.StructType):
        return {"list": False, "fields": {f.name: kind_of_schema(f.dataType) for f in kind.fields}}
    if isinstance(kind, T.ArrayType):
        return kind_of_schema(kind.elementType) | {"list": True} if isinstance(kind.elementType, T.StructType) else "list"
    return "single"
