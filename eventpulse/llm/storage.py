"""Tables and folders that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: later uses neither recompute it nor
    depend on executors that may be lost."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of fewer rows for what runs meanwhile, so that whole documents take less memory beside the heap; the
    session's own setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for the small tables of iterative steps."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def refuse_clashes(keep: list[str], own: list[str]) -> None:
    """Columns to keep must differ from each other and from an operator's own."""
    if clash := [c for i, c in enumerate(keep) if c.lower() in {o.lower() for o in own} or c.lower() in {k.lower() for k in keep[:i]}]:
        raise ValueError(f"columns to keep clash with the operator's own or repeat: {', '.join(clash)}; rename them first")
