"""Row and list operators: distinct first, groups to lists, chunks, top-k, runs of numbers, ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.rounds import cut


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key (REL9, REL24)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_k(df: DataFrame, k: int, key: list[str], order: list[Column]) -> DataFrame:
    """The k best rows of each key with their rank (REL25)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded hash of their key; the whole table if it has fewer (REL4)."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def chunks(df: DataFrame, size: int, key: list[str], order: list[Column]) -> DataFrame:
    """Rows of each key numbered into chunks of a size (REL11)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def islands(df: DataFrame, key: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers of each key: low, high, n (REL28)."""
    w = Window.partitionBy(*key).orderBy(number)
    runs = df.select(*key, number).distinct().withColumn("_g", F.col(number) - F.row_number().over(w))
    return runs.groupBy(*key, "_g").agg(F.min(number).alias("low"), F.max(number).alias("high"), F.count("*").alias("n")).drop("_g")


def merge_ranges(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Overlapping ranges of each key merged; ranges that only touch stay apart (GR32)."""
    before = Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col(start) < F.max(end).over(before), 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("_g", F.sum("_new").over(upto))
    return runs.groupBy(*key, "_g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_g")


def flatten_struct(df: DataFrame, sep: str = "|") -> DataFrame:
    """Nested objects as columns with joined names (REL6)."""
    from pyspark.sql.types import StructType

    def walk(kind: StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in kind.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, StructType):
                out += walk(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here)))
        return out

    return df.select(*walk(df.schema, ()))


def in_range(df: DataFrame, column: str, low: str, high: str) -> DataFrame:
    """Rows whose id lies between two ids, both included (REL26)."""
    return df.where(F.col(column).between(low, high))


def map_list(df: DataFrame, column: str, make: Callable[[Column], Column], deep: int = 1) -> DataFrame:
    """A list with every element replaced; `deep` 2 goes into the lists of a list of lists (REL12)."""
    inside = lambda c, n: F.transform(c, (lambda x: inside(x, n - 1)) if n > 1 else make)
    return df.withColumn(column, inside(F.col(column), deep))


def keep_in_list(df: DataFrame, column: str, keep: Callable[[Column], Column]) -> DataFrame:
    """A list without the elements that don't satisfy a condition; rows are kept with DataFrame.where (REL13)."""
    return df.withColumn(column, F.filter(column, keep))


def first_match(df: DataFrame, key: list[str], value: str, order: str, condition: Column, default: object = None) -> DataFrame:
    """Of each key the value of the first row, in order, that satisfies a condition (REL14); the default where none does,
    and an error without one. One aggregate, so no group is held or sorted."""
    found = F.min_by(F.struct(F.col(value).alias("v")), F.when(condition, F.col(order)))
    none = F.raise_error(F.lit("no row satisfies the condition")) if default is None else F.lit(default)
    return df.groupBy(*key).agg(found.alias("_found")).select(*key, F.when(F.col("_found").isNull(), none).otherwise(F.col("_found.v")).alias(value))


def flatten_once(df: DataFrame, column: str) -> DataFrame:
    """A list of lists as one list (REL17)."""
    return df.withColumn(column, F.flatten(column))


def join_text(df: DataFrame, column: str, delimiter: str) -> DataFrame:
    """A list as one string, its elements as text; nulls are left out (REL18)."""
    return df.withColumn(column, F.array_join(F.transform(column, lambda x: x.cast("string")), delimiter))


def sort_list(df: DataFrame, column: str, key: Callable[[Column], Column] = lambda x: x, reverse: bool = False) -> DataFrame:
    """A list sorted by a key, equal keys in the order they come in (REL20)."""
    step = F.lit(-1 if reverse else 1)
    place = lambda x, i: F.struct(key(x).alias("k"), (i * step).alias("i"), x.alias("x"))
    return df.withColumn(column, F.transform(F.sort_array(F.transform(column, place), asc=not reverse), lambda e: e["x"]))


def pop_smallest(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The n first rows of a priority queue, and how many rows before each were popped (SE15). The n rows alone come
    together; a task sends on no more than its own n first."""
    w = Window.orderBy(*order)
    return df.orderBy(*order).limit(n).withColumn("popped", (F.row_number().over(w) - 1).cast("long"))


def index_product(df: DataFrame, sizes: list[str], names: list[str]) -> DataFrame:
    """Of each row every combination of indices below its sizes, the last one running fastest (SE16). Combinations are
    numbered and taken apart, so a row's are made by one explode and none where a size is 0."""
    total = F.lit(1).cast("long")
    for s in sizes:
        total = total * F.col(s)
    out = df.where(total > 0).withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), total - 1)))
    step = F.lit(1).cast("long")
    for s, name in reversed(list(zip(sizes, names, strict=True))):
        out = out.withColumn(name, F.floor(F.col("_at") / step) % F.col(s))
        step = step * F.col(s)
    return out.drop("_at")


def first_seen_codes(df: DataFrame, label: str, order: str) -> DataFrame:
    """(label, code): labels numbered from 0 in the order in which they are first seen (AGG19). The window is over the
    distinct labels; it has as many rows as the vocabulary, and ranks are added up over parts of it."""
    first = df.groupBy(label).agg(F.min(order).alias("_first"))
    return ranked(first, ["_first", label], "code").select(label, "code")


def ranked(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Rows numbered from 0 in an order, without one task that holds them all: rows are dealt into ranges of the order,
    numbered in each, and moved on by the sizes of the ranges before."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row a range.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(starts, "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def batches(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Rows in n contiguous batches of an order, equally large but for the last, which takes the rest (UT1)."""
    size = F.greatest(F.floor(F.lit(df.count()) / n), F.lit(1))
    return ranked(df, order, "_i").withColumn("batch", F.least(F.floor(F.col("_i") / size), F.lit(n - 1)).cast("long")).drop("_i")


def lookup(df: DataFrame, table: DataFrame, keys: list[str], value: str, default: object = None) -> DataFrame:
    """Rows with the value that a table has under all their keys together, the default where it has none (UT4)."""
    found = df.join(table.select(*keys, F.col(value)), keys, "left")
    return found if default is None else found.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def at_positions(df: DataFrame, positions: DataFrame, order: list[str]) -> DataFrame:
    """The rows at listed positions (i, position) of an order, as often as they are listed (UT8)."""
    return positions.join(ranked(df, order, "position"), "position")
