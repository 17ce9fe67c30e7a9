"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is only ever broadcast after it has been counted and found no longer than this.
BROADCAST_ROWS = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a scratch one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerlake-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there.

    The columns are renamed to themselves, which makes them new ones: tables cut from a common
    origin can then be joined without ambiguity.
    """
    ensure_checkpoint_dir(df.sparkSession)
    stored = df.checkpoint(eager=True)
    return stored.select(*[F.col(f"`{c}`").alias(c) for c in stored.columns])


def broadcast_if_small(stored: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a stored table known to have that many rows, if they are few."""
    return F.broadcast(stored) if rows <= BROADCAST_ROWS else stored
