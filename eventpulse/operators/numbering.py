"""Row numbers within groups of any size, and over whole tables.

A window numbers each group in one task; here no task sees more than one range of the order. Rows are dealt into ranges of
(group, order), each range is written as one sorted file, and a row's place in its file is known from the file. Only the
counts of each (range, group), at most as many as ranges and groups together, meet in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventpulse.sources.files import saved, scratch_path

RANGE, AT, FIRST, ROWS = "_range", "_at", "_first", "_rows"


def _in_ranges(df: DataFrame, by: list[str], order: list[Column], written: bool = False) -> DataFrame:
    """df as sorted files of ranges, with the range and the place in it."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The last key spreads rows that are equal in all others, so that no range must hold a whole group of copies. It is the row's
    # place in a written file, as a task that runs again after a loss must deal each row where it was dealt before.
    keys = [*[F.col(c).asc_nulls_first() for c in by], *order, F.col("_spread")]
    source = df if written else saved(df)
    spread = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("_spread")
    dealt = source.select("*", spread).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    path = scratch_path(spark)
    dealt.drop("_spread").withColumn(RANGE, F.spark_partition_id()).write.option("maxRecordsPerFile", 0).parquet(path)
    schema = T.StructType([*df.schema.fields, T.StructField(RANGE, T.IntegerType())])
    return spark.read.schema(schema).parquet(path).select("*", F.col("_metadata.row_index").alias(AT))


def numbered(df: DataFrame, by: list[str], order: list[Column | str], out: str, size: str | None = None, written: bool = False) -> DataFrame:
    """df with `out`, the row's number from 1 in its group of equal `by` (null is a group of its own; no columns: the whole
    table) in the order given, and with `size`, if named, the group's rows. Rows that are equal in `order` are numbered in any
    order, once and for all: the result reads a written table. df is written first, unless it is a table just read from Parquet
    (written). An empty table gives an empty result."""
    order = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order]
    placed = _in_ranges(df, by, order, written)
    counts = placed.groupBy(RANGE, *by).agg(F.min(AT).alias(FIRST), F.count("*").alias(ROWS))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum(ROWS).over(group.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(
        F.col(RANGE).alias("_r"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], (before - F.col(FIRST)).alias("_shift"), *([F.sum(ROWS).over(group).alias("_size")] if size else [])
    )
    same = F.col(RANGE) == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    found = placed.join(offsets, same)
    own = [F.col(c) for c in df.columns]
    return found.select(*own, (F.col(AT) + F.col("_shift") + 1).alias(out), *([F.col("_size").alias(size)] if size else []))
