"""Data-quality gate: every check is rows (check_id, target, passed, observed, expected)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventpulse.functions.text import bare_key


def _check(df: DataFrame, check: str, target: str, observed: Column, expected: str | Column, passed: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check_id"), F.lit(target).alias("target"), passed.alias("passed"), observed.cast("string").alias("observed"), (F.lit(expected) if isinstance(expected, str) else expected.cast("string")).alias("expected"))


def check_row_counts(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    rows = [_check(df.agg(F.count("*").alias("n")), "row_count", name, F.col("n"), str(expected[name]), F.col("n") == expected[name]) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def check_canonical(df: DataFrame, name: str, column: str, banned: list[str]) -> DataFrame:
    """No banned value; a missing column fails."""
    if column not in df.columns:
        return _check(df.agg(F.lit(1).alias("n")), "canonical", f"{name}.{column}", F.lit("column missing"), "0", F.lit(False))
    return _check(df.agg(F.count_if(F.col(column).isin(banned)).alias("n")), "canonical", f"{name}.{column}", F.col("n"), "0", F.col("n") == 0)


def check_unique(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key, null keys equal."""
    repeated = df.groupBy(*keys).agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("n"))
    return _check(repeated, "unique", f"{name}({','.join(keys)})", F.col("n"), "0", F.col("n") == 0)


def check_absent_columns(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    found = ",".join(c for c in columns if c in df.columns)
    return _check(df.agg(F.count("*").alias("n")), "absent_columns", name, F.lit(found), "", F.lit(found == ""))


def check_expectation(df: DataFrame, name: str, predicate: Column, least: int, most: int | None) -> DataFrame:
    """Rows for which the predicate holds, between two bounds."""
    counted = df.agg(F.count_if(predicate).alias("n"))
    return _check(counted, "expectation", name, F.col("n"), f"{least}..{'' if most is None else most}", (F.col("n") >= least) & (F.lit(True) if most is None else F.col("n") <= most))


def suspicious_matches(df: DataFrame, query: str, matched: str, score: str, generic: list[str], least: float = 95.0) -> DataFrame:
    """Long titles matched below `least` to a generic or less than 45 % long one."""
    q, m = bare_key(query), bare_key(matched)
    return df.filter((F.length(q) >= 8) & (F.col(score) < least) & (m.isin(generic) | (F.length(m) < 0.45 * F.length(q))))


def scan_forbidden(texts: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, pattern, hits) for each pattern that a text holds."""
    hits = F.array(*[F.struct(F.lit(n).alias("pattern"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(p)).cast("long").alias("hits")) for n, p in patterns.items()])
    return texts.select(key, F.explode(hits).alias("h")).select(key, "h.pattern", "h.hits").filter("hits > 0")


def gate_report(checks: list[DataFrame]) -> DataFrame:
    """All checks with the numbers of blockers and passes and the overall flag."""
    rows = reduce(DataFrame.unionByName, checks)
    totals = rows.agg(F.count_if(~F.col("passed")).alias("blockers"), F.count_if("passed").alias("passes"), F.bool_and("passed").alias("gate_passed"))
    return rows.join(F.broadcast(totals))
