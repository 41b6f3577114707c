"""External mentions: united, collapsed, confirmed, anonymised, scored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventpulse.functions.numbers import rounded
from eventpulse.functions.text import matched_terms, no_spaces, present
from eventpulse.operators.numbering import numbered

from .deident import ordinal_ids
from .metrics import avgrank_scores


def unify_sources(sources: list[tuple[DataFrame, dict[str, str], dict[str, str]]], schema: list[str]) -> DataFrame:
    """Each source (frame, renames to the schema, constants) in one schema of strings, missing columns "", all united."""
    frames = []
    for df, names, constants in sources:
        columns = {new: F.coalesce(F.col(old).cast("string"), F.lit("")) for old, new in names.items()} | {k: F.lit(v) for k, v in constants.items()}
        frames.append(df.select(*[columns.get(c, F.lit("")).alias(c) for c in schema]))
    return reduce(DataFrame.unionByName, frames)


def collapse_by_url(mentions: DataFrame, keys: list[str], first: list[str], joined: str, rank: str, order: str) -> DataFrame:
    """One row per key: first non-empty values, the distinct values of `joined` in order, their number, smallest rank, rows."""
    values = F.array_sort(F.collect_set(F.when(present(joined), F.struct(F.col(order).alias("o"), F.col(joined).alias("v")))))
    return mentions.groupBy(*keys).agg(
        *[F.coalesce(F.min_by(c, F.when(present(c), F.col(order))), F.lit("")).alias(c) for c in first],
        F.array_join(F.array_distinct(F.transform(values, lambda s: s["v"])), ";").alias(joined), F.count_distinct(F.when(present(joined), F.col(joined))).alias("query_count"),
        F.min(F.col(rank).try_cast("long")).alias("best_rank"), F.count("*").alias("raw_rows"),
    )


def review_queue(df: DataFrame, keyword: str, terms: list[str], text: list[str]) -> DataFrame:
    """Keyword flag, matched terms, manual-review flag, an id in key order, and the place in its platform's queue, newest
    first, without a date last."""
    body = F.concat_ws(" ", *text)
    out = df.withColumns({"keyword_present": F.contains(no_spaces(body), F.lit(keyword.lower().replace(" ", ""))), "matched_terms": F.array_join(matched_terms(body, terms), ";")})
    out = out.withColumn("needs_manual_review", ~F.col("keyword_present") | (F.col("matched_terms") == ""))
    out = ordinal_ids(out, ["platform", "url"], "M_", "mention_id", 5)
    return numbered(out, ["platform"], [F.desc_nulls_last(F.nullif("published", F.lit(""))), "url"], "queue_no")


def confirm_mentions(df: DataFrame, keyword: str, since: str) -> DataFrame:
    """Keyword in title or description by date status: class, confidence 100, 95, 90 or 0, evidence and review flag."""
    key = keyword.lower().replace(" ", "")
    title, body = F.contains(no_spaces("title"), F.lit(key)), F.contains(no_spaces("description"), F.lit(key))
    day = F.col("published").try_cast("date")
    late = F.coalesce(day >= F.lit(since).cast("date"), F.lit(False))
    found = title | body
    return df.withColumns({
        "date_status": F.when(day.isNull(), "missing_date").when(late, "in_period").otherwise("before_period"),
        "mention_class": F.when(found & late, "confirmed").when(found & day.isNull(), "confirmed_without_date").when(found, "keyword_before_period").otherwise("not_confirmed"),
        "confidence": F.when(title & late, 100).when(body & late, 95).when(found & day.isNull(), 90).otherwise(0).cast("long"),
        "evidence": F.concat_ws(";", F.when(title, F.lit("title")), F.when(body, F.lit("description"))),
        "needs_review": found & ~late,
    })


def publish_mentions(confirmed: DataFrame, source: str) -> DataFrame:
    """Confirmed mentions with an anonymous source id and an ordinal public id."""
    kept = confirmed.filter("mention_class = 'confirmed'")
    kept = ordinal_ids(kept, ["platform", source], "SRC_", "source_id")
    kept = ordinal_ids(kept, ["platform", "published", "url"], "PUB_", "mention_public_id")
    return kept.select("mention_public_id", "platform", "published", "title", "source_id", "confidence", "evidence")


def number(column: str) -> Column:
    return F.coalesce(F.col(column).try_cast("long"), F.lit(0))


def platform_summary(df: DataFrame, numbers: list[str], source: str = "source_id") -> DataFrame:
    return df.groupBy("platform").agg(F.count("*").alias("mentions"), F.count_distinct(source).alias("sources"), *[F.sum(number(c)).alias(c) for c in numbers])


def _exploded(df: DataFrame, terms: str, aliases: DataFrame, once: bool) -> DataFrame:
    """A row for each term of a mention's list, under its name in the table (alias, name), of several the least; once: a row for
    each mention and name. A mention without terms has one row, UNMATCHED."""
    parts = F.transform(F.filter(F.split(F.coalesce(F.col(terms), F.lit("")), ";"), lambda t: F.trim(t) != ""), lambda t: F.trim(t))
    rows = df.withColumn("term", F.explode(F.when(F.size(parts) == 0, F.array(F.lit(None).cast("string"))).otherwise(parts)))
    names = aliases.filter("alias is not null").groupBy(F.col("alias").alias("_alias")).agg(F.min("name").alias("_name"))
    named = rows.join(names, F.col("term") == F.col("_alias"), "left").withColumn("term", F.coalesce("_name", "term", F.lit("UNMATCHED"))).drop("_alias", "_name")
    return named.dropDuplicates(["mention_id", "term"]) if once else named


def term_summary(df: DataFrame, terms: str, aliases: DataFrame, numbers: list[str], source: str) -> DataFrame:
    """Per term distinct mentions, platforms and sources, and sums; a mention under two aliases of a term adds twice."""
    return _exploded(df, terms, aliases, once=False).groupBy("term").agg(
        F.count_distinct("mention_id").alias("mentions"), F.count_distinct("platform").alias("platforms"), F.count_distinct(source).alias("sources"), *[F.sum(number(c)).alias(c) for c in numbers]
    )


def viral_overall(df: DataFrame, platforms: list[str], numbers: list[str]) -> DataFrame:
    return df.agg(
        F.count("*").alias("mentions"), *[F.count_if(F.col("platform") == p).alias(f"{p}_mentions") for p in platforms], *[F.coalesce(F.sum(number(c)), F.lit(0)).alias(c) for c in numbers],
        F.min(F.nullif("published", F.lit(""))).alias("first_date"), F.max("published").alias("last_date"),
    )


def platform_metrics(df: DataFrame, numbers: list[str], source: str) -> DataFrame:
    total = df.agg(F.count("*").alias("_total"))
    dates = df.groupBy("platform").agg(F.min(F.nullif("published", F.lit(""))).alias("first_date"), F.max("published").alias("last_date"))
    out = platform_summary(df, numbers, source).join(dates, "platform").join(F.broadcast(total))
    return out.withColumn("share", rounded(F.col("mentions") / F.col("_total"), 4)).drop("_total")


def term_metrics(df: DataFrame, terms: str, aliases: DataFrame, platforms: list[str], numbers: list[str], source: str) -> DataFrame:
    """Per term, each mention once: counts by platform, sources, sums, first and last date."""
    rows = _exploded(df, terms, aliases, once=True).filter("term <> 'UNMATCHED'")
    return rows.groupBy("term").agg(
        F.count("*").alias("mentions"), *[F.count_if(F.col("platform") == p).alias(f"{p}_mentions") for p in platforms], F.count_distinct(source).alias("sources"), F.count_distinct("platform").alias("platforms"),
        *[F.sum(number(c)).alias(c) for c in numbers], F.min(F.nullif("published", F.lit(""))).alias("first_date"), F.max("published").alias("last_date"),
    )


def viral_score(df: DataFrame, reach: str, platforms: int, weights: tuple[float, float, float, float] = (0.45, 0.25, 0.20, 0.10)) -> DataFrame:
    """Weighted sum of the average-rank scores of mentions, sources and log reach, and of platform diversity."""
    df = df.withColumn("_reach", F.log1p(F.col(reach).cast("double")))
    df = avgrank_scores(df, {"mentions": "mention_score", "sources": "source_score", "_reach": "reach_score"})
    diversity = F.least(F.lit(100.0), F.col("platforms") * 100.0 / platforms)
    parts = [F.col("mention_score"), F.col("source_score"), F.col("reach_score"), diversity]
    return df.withColumn("viral_score", rounded(reduce(lambda a, b: a + b, [p * w for p, w in zip(parts, weights, strict=True)]), 2)).drop("_reach")


def unmatched_mentions(df: DataFrame, terms: str) -> DataFrame:
    return df.filter(~present(terms))
