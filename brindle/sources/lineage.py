"""Cutting lineage: a DataFrame that is written to the shared checkpoint folder and read from there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as it is now, from the session's checkpoint folder (a temporary one where none is set and all runs on one machine)."""
    session = df.sparkSession
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        shared = session.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)
