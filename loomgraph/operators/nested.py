"""Commands on nested columns: zip, unpack, constants, joins, computed columns, regular-expression filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _apply(df: DataFrame, path: str, make: Callable[[Column], Column]) -> DataFrame:
    """Sets the field a bar-joined path names from its parent struct; lists of objects are gone through."""
    steps = path.split("|")

    def inside(parent: Column, kind, rest: list[str]) -> Column:
        if kind.typeName() == "array":
            return F.transform(parent, lambda e: inside(e, kind.elementType, rest))
        if len(rest) == 1:
            return parent.withField(rest[0], make(parent))
        return parent.withField(rest[0], inside(parent[rest[0]], kind[rest[0]].dataType, rest[1:]))

    if len(steps) == 1:
        return df.withColumn(steps[0], make(F.struct(*[F.col(c) for c in df.columns])))
    return df.withColumn(steps[0], inside(F.col(steps[0]), df.schema[steps[0]].dataType, steps[1:]))


def zip_lists(df: DataFrame, lists: list[str], out: str) -> DataFrame:
    """Parallel lists of one parent become a list of objects; unequal lengths are an error (NEST1)."""
    names = [p.rsplit("|", 1)[-1] for p in lists]

    def make(parent: Column) -> Column:
        sizes = [F.size(parent[n]) for n in names]
        equal = F.lit(True)
        for s in sizes[1:]:
            equal = equal & (s == sizes[0])
        return F.when(equal, F.arrays_zip(*[parent[n].alias(n) for n in names])).otherwise(F.raise_error(F.lit("lists of unequal length")))

    return _apply(df, out, make)


def unpack_one(df: DataFrame, path: str) -> DataFrame:
    """A list of at most one element becomes that element or null; more are an error (NEST2)."""
    name = path.rsplit("|", 1)[-1]
    return _apply(df, path, lambda p: F.when(F.size(p[name]) <= 1, F.get(p[name], F.lit(0))).otherwise(F.raise_error(F.lit("more than one element"))))


def unroll(df: DataFrame, path: str, key: str, value: str, names: list[str]) -> DataFrame:
    """Named keys of a list of key/value objects become columns (NEST3)."""
    at = lambda n: F.get(F.filter(F.col(path), lambda e: e[key] == n), F.lit(0))[value].alias(n)
    return df.select("*", *[at(n) for n in names])


def add_literal(df: DataFrame, path: str, value: str) -> DataFrame:
    """A constant at a path, within lists too (NEST4)."""
    return _apply(df, path, lambda p: F.lit(value))


def join_list(df: DataFrame, path: str, delimiter: str = "\n") -> DataFrame:
    """A list of strings becomes one string (NEST5)."""
    name = path.rsplit("|", 1)[-1]
    return _apply(df, path, lambda p: F.array_join(p[name], delimiter))


def computed(df: DataFrame, inputs: list[str], out: str, make: Callable[..., Column]) -> DataFrame:
    """A column from its siblings; null, 0 and false reach the expression as empty text (NEST6)."""
    names = [p.rsplit("|", 1)[-1] for p in inputs]
    text = lambda c: F.when(c.isNull() | c.cast("string").isin("0", "0.0", "false"), "").otherwise(c.cast("string"))
    return _apply(df, out, lambda p: make(*[text(p[n]) for n in names]))


def regex_filter(df: DataFrame, column: str, accept: str | None = None, reject: str | None = None) -> DataFrame:
    """Rows whose value matches one pattern and doesn't match another (NEST8)."""
    if accept:
        df = df.where(F.col(column).rlike(accept))
    return df.where(~F.col(column).rlike(reject)) if reject else df


def explode_paths(df: DataFrame, path: str) -> DataFrame:
    """All values at a path as rows; an empty list gives none, a null one null (REL7, NEST14)."""
    col = None
    kind = df.schema
    out = df
    for step in path.split("|"):
        col = F.col(step) if col is None else col[step]
        kind = kind[step].dataType
        if kind.typeName() == "array":
            out = out.select(F.explode(col).alias("value"))
            col, kind = F.col("value"), kind.elementType
    return out.select(col.alias("value"))


def delete_path(df: DataFrame, path: str) -> DataFrame:
    """Without the field at a path; parents left without fields go too (SCH7)."""
    steps = path.split("|")

    def inside(parent: Column, kind, rest: list[str]) -> Column | None:
        if kind.typeName() == "array":
            if inside(parent, kind.elementType, rest) is None:
                return None
            return F.transform(parent, lambda e: inside(e, kind.elementType, rest))
        own = kind[rest[0]]  # an unknown field is an error
        if len(rest) == 1:
            return None if len(kind) == 1 else parent.dropFields(rest[0])
        made = inside(parent[rest[0]], own.dataType, rest[1:])
        if made is None:
            return None if len(kind) == 1 else parent.dropFields(rest[0])
        return parent.withField(rest[0], made)

    if len(steps) == 1:
        return df.drop(steps[0])
    made = inside(F.col(steps[0]), df.schema[steps[0]].dataType, steps[1:])
    return df.drop(steps[0]) if made is None else df.withColumn(steps[0], made)


def cast_path(df: DataFrame, path: str, kind: str) -> DataFrame:
    """The field at a path as another type, null where it isn't one (SCH8)."""
    name = path.rsplit("|", 1)[-1]
    return _apply(df, path, lambda p: p[name].try_cast(kind))


def cross_rows(df: DataFrame) -> DataFrame:
    """A row for each combination of its lists' elements, objects as bar-joined columns; a row with an empty or null list
    gives none (SNK11). Objects within list elements are left as they are."""
    out = df
    while True:
        structs = [f.name for f in out.schema if f.dataType.typeName() == "struct"]
        if not structs:
            break
        columns = []
        for f in out.schema:
            own = F.col(f"`{f.name}`")
            columns += [own[g].alias(f"{f.name}|{g}") for g in f.dataType.names] if f.name in structs else [own]
        out = out.select(*columns)
    for f in out.schema:
        if f.dataType.typeName() == "array":
            out = out.select(*[F.col(f"`{c}`") for c in out.columns if c != f.name], F.explode(F.col(f"`{f.name}`")).alias(f.name))
    return out.select(*[F.col(f"`{c}`") for c in out.columns])


def same_scope(paths: DataFrame) -> DataFrame:
    """(a, b, same): of every two attribute paths (path), whether they have the same parent (SCH12). Paths are few."""
    parent = F.regexp_replace("path", r"\|?[^|]*$", "")
    own = paths.select("path", parent.alias("parent"))
    a, b = own.select(F.col("path").alias("a"), F.col("parent").alias("pa")), own.select(F.col("path").alias("b"), F.col("parent").alias("pb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (F.col("pa") == F.col("pb")).alias("same"))


def scope_rows(df: DataFrame, scope: str) -> DataFrame:
    """The objects at a path as rows, lists of objects on the way gone through; the empty path is the table itself
    (REL2). An empty list gives no row."""
    out, kind = df, df.schema
    if not scope:
        return df
    col = None
    for step in scope.split("|"):
        col = F.col(step) if col is None else col[step]
        kind = kind[step].dataType
        if kind.typeName() == "array":
            out = out.select(F.explode(col).alias("value"))
            col, kind = F.col("value"), kind.elementType
    return out.select(col.alias("value")).select("value.*")


def project(df: DataFrame, paths: list[str]) -> DataFrame:
    """Only these leaf paths, the objects and lists around them kept in shape (REL1). Fields are picked from their parents,
    so a columnar scan reads the named leaves alone."""
    tree: dict = {}
    for path in paths:
        at = tree
        for step in path.split("|"):
            at = at.setdefault(step, {})

    def pick(value: Column, kind, own: dict) -> Column:
        if not own:
            return value
        if kind.typeName() == "array":
            return F.transform(value, lambda e: pick(e, kind.elementType, own))
        made = F.struct(*[pick(value[n], kind[n].dataType, sub).alias(n) for n, sub in own.items()])
        return F.when(value.isNotNull(), made)

    return df.select(*[pick(F.col(n), df.schema[n].dataType, sub).alias(n) for n, sub in tree.items()])


def instances(df: DataFrame, scope: str, keys: list[str], delimiter: str = ",") -> DataFrame:
    """All objects of a class node at a path, with `view_key`, their key values joined by commas, each once (NEST15, NEST16)."""
    rows = scope_rows(df, scope)
    return rows.withColumn("view_key", F.concat_ws(delimiter, *[F.col(k).cast("string") for k in keys])).dropDuplicates(["view_key"])
