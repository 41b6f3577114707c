"""Structured-review checking and incremental merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventpulse.functions.text import first_sentence, present, tag_flags


def rule_confidence(penalties: list[tuple[Column, int]]) -> Column:
    """1 minus fixed penalties in hundredths for each condition, between 0 and 1."""
    lost = reduce(lambda a, b: a + b, [F.when(c, F.lit(p)).otherwise(0) for c, p in penalties])
    return F.greatest(F.lit(0), 100 - lost) / 100


def rule_record(df: DataFrame, text: str, penalties: list[tuple[Column, int]], tags: dict[str, str], least: float = 0.85) -> DataFrame:
    """Fallback record: tags, summary, confidence, needs_review if a condition holds or confidence is low, status and mode."""
    out = tag_flags(df, text, tags).withColumns({"confidence": rule_confidence(penalties), "summary": first_sentence(text)})
    flagged = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c, _ in penalties])
    return out.withColumns({"needs_review": flagged | (F.col("confidence") < least), "status": F.lit("success"), "mode": F.lit("rules")})


def validate_ranges(df: DataFrame, key: str, required: list[str], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(key, failures): rows that miss a required field or lie outside a range."""
    tests = [F.when(~present(F.col(c).cast("string")), F.lit(f"{c}:missing")) for c in required]
    tests += [F.when((F.col(c) < low) | (F.col(c) > high), F.lit(f"{c}:range")) for c, (low, high) in ranges.items()]
    return df.select(key, F.array_join(F.array_compact(F.array(*tests)), ";").alias("failures")).filter("failures <> ''")


def parse_json_payload(df: DataFrame, payload: str, schema: str, fallbacks: dict[str, str]) -> DataFrame:
    """The outermost {...} of a fenced or noisy text as fields; absent, null or empty values fall back to columns."""
    body = F.nullif(F.regexp_extract(F.coalesce(F.col(payload), F.lit("")), r"(?s)\{.*\}", 0), F.lit(""))
    out = df.withColumn("_json", F.from_json(body, schema, {"mode": "PERMISSIVE"}))
    fields = {name: F.when(present(F.col(f"_json.{name}").cast("string")), F.col(f"_json.{name}")).otherwise(F.col(other)) for name, other in fallbacks.items()}
    return out.withColumns({**fields, "payload_ok": F.coalesce(F.greatest(*[F.col(f"_json.{n}").isNotNull() for n in fallbacks]), F.lit(False))}).drop("_json")


def preserve_success(existing: DataFrame, fresh: DataFrame, key: str, refreshed: list[str]) -> DataFrame:
    """fresh, but earlier successful rows stay, with the refreshed columns renewed; earlier rows without a fresh one stay as
    they are. Adds merge_mode: preserved, fresh or existing_only."""
    old = existing.select(*[F.col(c).alias(f"_{c}") for c in fresh.columns])
    joined = fresh.withColumn("_fresh", F.lit(True)).join(old, F.col(key) == F.col(f"_{key}"), "full")
    only = F.col("_fresh").isNull()
    was = ~only & F.coalesce(F.col("_status") == "success", F.lit(False))
    columns = [F.when(only | (was if c != key and c not in refreshed else F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fresh.columns]
    return joined.select(*columns, F.when(only, "existing_only").when(was, "preserved").otherwise("fresh").alias("merge_mode"))


def merge_counts(merged: DataFrame) -> DataFrame:
    """Rows of each merge mode."""
    return merged.groupBy("merge_mode").agg(F.count("*").alias("rows"))

