"""Results kept and passed on: caches in a shared folder, writers and readers by extension, tagged JSON, rule exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table under a key of a folder that all executors share, made and written if it isn't there whole (SRC16, SRC17)."""
    path = f"{folder.rstrip('/')}/{key}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write(df: DataFrame, path: str) -> None:
    """Rows as CSV, tab-separated text, lines of JSON or parquet, by extension (SNK4). Each task writes its part; pickles
    aren't written, as nothing but Python could read them."""
    end, out = path.rsplit(".", 1)[-1].lower(), df.write.mode("overwrite")
    if end in ("csv", "tsv"):
        out.option("header", True).option("sep", "," if end == "csv" else "\t").option("escape", '"').csv(path)
    elif end in ("json", "jsonl"):
        out.json(path)
    elif end == "parquet":
        out.parquet(path)
    else:
        raise ValueError(f"no writer for {path}")


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """What write() wrote (SRC14)."""
    end = path.rsplit(".", 1)[-1].lower()
    source = spark.read.schema(schema) if schema else spark.read
    if end in ("csv", "tsv"):
        return source.option("header", True).option("sep", "," if end == "csv" else "\t").option("escape", '"').option("multiLine", True).csv(path)
    if end in ("json", "jsonl"):
        return source.json(path)
    if end == "parquet":
        return source.parquet(path)
    raise ValueError(f"no reader for {path}")


#: Fixed value: how a point in time is written beside its class tag.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def tagged_time(at: Column) -> Column:
    """A UTC time as an object with a class tag (SNK6)."""
    return F.struct(F.lit("DateTime").alias("_type"), F.concat(F.date_format(at, TIME_FORMAT), F.lit("+0000")).alias("value"))


def tagged_json(name: str, fields: dict[str, Column]) -> Column:
    """An object as JSON with its class's name in `_type`, times in it tagged too (SNK6)."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()], F.lit(name).alias("_type")))


def from_tagged(text: Column, name: str, fields: str) -> Column:
    """The object back, null where the tag names another class (SNK6)."""
    got = F.from_json(text, f"{fields}, _type string")
    return F.when(got["_type"] == name, got)


def table_lines(df: DataFrame, key: str) -> DataFrame:
    """(key, line): rows as lines of a text table whose columns are as wide as their longest value (SNK7). Widths are one
    aggregate of one row."""
    text = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    widths = text.agg(*[F.greatest(F.max(F.length(f"`{c}`")), F.lit(len(c))).alias(f"w_{c}") for c in df.columns])
    cells = [F.rpad(F.col(f"`{c}`"), F.col(f"w_{c}"), " ") for c in df.columns]
    return text.join(F.broadcast(widths)).select(F.col(f"`{key}`").alias("key"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


#: The soft rules that a link prediction is exported with, and their weights.
PSL_RULES = (
    "2: !Triple(S, P, D)^2",
    "Triple(+S, +P, D) <= 1 .",
    "1: Triple(S, P, D) && Triple(S2, P2, D2) && Link(S2, P3, S) && S != D2 && S != S2 -> Triple(S2, P3, S)",
    "1: SemanticLabel(S, P, D) -> Triple(S, P, D)",
    "1: Triple(S, P, D) && SemanticLabel(S, P, D2) && D != D2 -> !Triple(S, P, D2)",
    "1: Triple(S, P, D) && Link(S, P, D2) && D != D2 -> !Triple(S, P, D2)",
    "1: Cooccurrence(S, P, P2) & Triple(S, P, D) && SemanticLabel(S, P2, D2) -> Triple(S, P2, D2)",
)


def psl_targets(types: DataFrame, links: DataFrame, gold: DataFrame) -> DataFrame:
    """(s, p, o, truth): the triples that are asked for, from candidate types and links of a graph (s, p, o), and whether
    the gold has them (SNK10)."""
    asked = types.select("s", "p", "o").unionByName(links.select("s", "p", "o")).distinct()
    return asked.join(gold.select("s", "p", "o").distinct().withColumn("truth", F.lit(1)), ["s", "p", "o"], "left").fillna(0, ["truth"])


def psl_closed_world(targets: DataFrame) -> DataFrame:
    """(s, p, o): every other triple over the same subjects, predicates and objects, which are all known to be false
    (SNK10). Its size is the product of the three, which is what the export asks for; a model graph has tens of each."""
    part = lambda c: targets.select(c).distinct()
    return part("s").crossJoin(part("p")).crossJoin(part("o")).join(targets.select("s", "p", "o"), ["s", "p", "o"], "left_anti")


def save_weights(spark: SparkSession, weights: list[float], names: list[str], path: str) -> None:
    """A model's weights by name (SNK12)."""
    spark.createDataFrame(list(zip(range(len(names)), names, map(float, weights), strict=True)), "i int, name string, weight double").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> tuple[list[str], list[float]]:
    """Names and weights in their order (SNK12); as many rows as the model has weights."""
    found = spark.read.parquet(path).orderBy("i").collect()
    return [r["name"] for r in found], [r["weight"] for r in found]
