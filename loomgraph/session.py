"""Spark session defaults and table access shared by the queries, the bench and the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for one machine; a cluster brings its own through spark-submit."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loomgraph")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the path goes to Spark's reader as it is, whatever file system it names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
