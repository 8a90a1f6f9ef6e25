"""What the corpus operators share: words, scratch tables, connected components, Arrow batches."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are neither a space nor one of \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() knows exactly the white space of WORD."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_count(text: Column) -> Column:
    """Number of words on the JVM side (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a missing one is null text, so that extra or absent columns never clash."""
    have = {c.lower() for c in df.columns}
    return df.select(*[df[n] if n.lower() in have else F.lit(None).cast("string").alias(n) for n in names])


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts an Arrow batch into slices whose texts hold about `most` bytes; a longer text stands alone."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if len(sizes) > start:
        yield batch.slice(start)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of texts hold so many rows, where the session has no smaller number of its own: two
    Python workers beside a full heap have room for little more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where none is set and all executors are local, as in tests."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/loomgraph-scratch"


def _drop(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _drop(spark, path)
    except Exception:  # the session has ended already; the folder goes with the cluster's own clean-up
        pass


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}"
        self.n = 0
        small_batches(spark)
        atexit.register(_drop_at_exit, spark, self.at)

    def write(self, df: DataFrame) -> DataFrame:
        """Writes the rows and returns a reader of them."""
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loomgraph_path = path  # type: ignore[attr-defined]
        return out

    def free(self, *tables: DataFrame) -> None:
        """Deletes tables that no later job reads, and lets Spark clean the shuffles behind them."""
        for df in tables:
            _drop(self.spark, df._loomgraph_path)  # type: ignore[attr-defined]
        self.collect_shuffles()

    def collect_shuffles(self) -> None:
        """Shuffle files are dropped once Python and the JVM have collected the plans that made them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 50) -> DataFrame:
    """Connected components of edges (a, b): a row (node, root) per node, the root being its smallest node.

    Large-star and small-star steps in turn: logarithmically many rounds, partial minima before each
    shuffle, and joins (which adaptive execution can split) rather than lists of a hub's neighbours. An
    error tells if they don't settle within `rounds`; unsettled components are never returned.
    """
    # Edges are two numbers: an eighth of the partitions that texts need is enough to write them.
    parts = max(8, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    now = scratch.write(
        edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct().coalesce(parts)
    )
    before = None
    for _ in range(rounds):
        both = now.select(F.col("v").alias("n"), F.col("u").alias("x")).unionByName(
            now.select(F.col("u").alias("n"), F.col("v").alias("x"))
        )
        least = both.groupBy("n").agg(F.min("x").alias("x0")).select("n", F.least("n", "x0").alias("m"))
        large = both.join(least, "n").where("x > n").select(F.col("x").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        # Small star: every node's smaller neighbours and the node itself go to the smallest of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
        nxt = scratch.write(small.unionByName(least.select("v", F.col("m").alias("u"))).distinct().coalesce(parts))
        mark = nxt.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0)).alias("x")).first()
        scratch.free(now)
        now = nxt
        if (mark["n"], mark["x"]) == before:
            break
        before = (mark["n"], mark["x"])
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
