"""Reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, a local session gets a folder of its own; a cluster has to name a shared one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)
