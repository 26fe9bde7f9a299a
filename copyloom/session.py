"""Session helpers: checkpoint folder, lineage cuts, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only if it has been counted to hold at most this many rows.
BROADCAST_ROWS = 300_000


def local_session(cpus: int | str = "*", name: str = "copyloom", partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and hand-over tables, as the session names it.

    A folder of our own is set only in local mode, where it is unset and every task runs on this machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="copyloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read to the shared folder, and go on from there.

    Parquet rather than a checkpoint: readers prune columns, and the planner knows the size. The files survive
    lost executors; whoever owns the folder clears it.
    """
    path = handover_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def handover_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for files that one step writes and the next one reads."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Whether the frame holds at most `rows` rows; only a number comes back."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side of counted size; a larger side is left to the shuffled join.

    For sides that are cheap to look at: a scan, or a table written by `cut`.
    """
    return F.broadcast(df) if has_at_most(df, rows) else df


def small_table(df: DataFrame) -> DataFrame:
    """An aggregate that is expected to be small: computed once, counted, broadcast if it is small indeed."""
    return broadcast_if_small(cut(df))
