"""What several operators of this package need: lineage cuts, code shipping and small column rules."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that the word and line rules count as white space: space and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
#: A word, for Java's regular expressions: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's, or a temporary one where none is set and all runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from there: its lineage ends, and it is computed once."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def looked_up(rows: DataFrame, table: DataFrame, key: str, count: str, share: int = 4096) -> DataFrame:
    """The inner join of rows with ``table``, which has one row a key and, as ``count``, how many of the rows have the key.

    Keys with more than a 1 / ``share`` part of the rows go by broadcast: there are fewer than ``share`` of them, whatever
    the data. No other key is hot, so the rest is an even shuffle. Both frames are read several times: cut them before.
    """
    limit = (table.agg(F.sum(count)).first()[0] or 0) / share
    heavy = F.broadcast(table.where(F.col(count) > limit).drop(count))
    rest = rows.join(heavy.select(key), key, "left_anti").join(table.where(F.col(count) <= limit).drop(count), key)
    return rows.join(heavy, key).unionByName(rest)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def text_of(column: Column) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(column.cast("string"), F.lit(""))
