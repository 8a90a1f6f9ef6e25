"""Rounds of a fixpoint: each one's rows are checkpointed, so lineage stays short and lost executors cost one round."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the session's checkpoint folder; a folder of its own only where none is set and all executors are local."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        own = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if own is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(own or tempfile.mkdtemp())
    return df.checkpoint()
