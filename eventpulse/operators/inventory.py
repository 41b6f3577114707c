"""File-archive inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventpulse.functions.text import present


def area_summary(manifest: DataFrame, by: list[str]) -> DataFrame:
    """Per area and folder: rows, local copies, folders, skipped, errors, sensitive and publishable files."""
    status = F.col("status")
    return manifest.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(present("local_path")).alias("local_copies"), F.count_if(F.col("asset_type") == "folder").alias("folders"), F.count_if(status == "skipped").alias("skipped"),
        F.count_if(status == "error").alias("errors"), F.count_if(F.col("sensitive")).alias("sensitive"), F.count_if(~F.col("sensitive") & (status == "archived")).alias("publishable"),
    )


def asset_type_summary(manifest: DataFrame) -> DataFrame:
    return area_summary(manifest, ["area", "asset_type"])


def opportunity_matrix(axes: DataFrame, summary: DataFrame) -> DataFrame:
    """Each axis with the records of all its areas."""
    sums = axes.withColumn("area", F.explode("areas")).join(summary.groupBy("area").agg(F.sum("rows").alias("rows")), "area", "left").groupBy("axis").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("records"))
    return axes.select("axis", F.array_join("areas", ";").alias("areas")).join(sums, "axis", "left")


def sponsor_inventory(manifest: DataFrame, folder: str, types: list[str]) -> DataFrame:
    """Folders with a local copy: their name without its number, and files of each type."""
    rows = manifest.filter(present("local_path") & present(folder)).withColumn("sponsor", F.trim(F.regexp_replace(folder, r"^\d+[._ -]*", "")))
    return rows.groupBy("sponsor").agg(F.count("*").alias("files"), *[F.count_if(F.col("asset_type") == t).alias(f"{t}_files") for t in types])
