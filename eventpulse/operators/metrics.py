"""Aggregations and reaction scores. Global ranks are made on distinct values, then joined back, so that no task
holds all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventpulse.functions.numbers import rounded
from eventpulse.sources.files import saved

COUNTS = ("reservation_count", "reservation_records", "pass_count", "one_time_count", "unknown_count", "cancellation_count", "cancellation_records", "review_count")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, 0 for a zero or missing divisor."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def pick_display_title(sources: list[tuple[DataFrame, str, str, int]]) -> DataFrame:
    """(key, title): of each key the title of lowest source priority, then most frequent, then first by name."""
    parts = [df.select(F.col(key).alias("key"), F.col(title).alias("title"), F.lit(priority).alias("priority")) for df, key, title, priority in sources]
    counts = reduce(DataFrame.unionByName, parts).groupBy("key", "title").agg(F.min("priority").alias("priority"), F.count("*").alias("n"))
    return counts.groupBy("key").agg(F.min_by("title", F.struct("priority", -F.col("n"), "title")).alias("title"))


def conditional_counts(facts: DataFrame, keys: list[str], people: str, method: str, methods: list[str], prefix: str) -> DataFrame:
    """Sum of people, records, and people of each method group."""
    return facts.groupBy(*keys).agg(
        F.coalesce(F.sum(people), F.lit(0)).alias(f"{prefix}_count"),
        F.count("*").alias(f"{prefix}_records"),
        *[F.coalesce(F.sum(F.when(F.col(method) == m, F.col(people))), F.lit(0)).alias(f"{m}_count") for m in methods],
    )


def review_profile(reviews: DataFrame, keys: list[str], ratings: list[str], visits: str, tags: list[str]) -> DataFrame:
    """Reviews, mean ratings (what is no number is ignored), mean visit, open reviews and tag counts."""
    return reviews.groupBy(*keys).agg(
        F.count("*").alias("review_count"),
        *[F.avg(F.col(r).try_cast("double")).alias(f"avg_{r}") for r in ratings],
        F.avg(F.col(visits).try_cast("double")).alias(f"avg_{visits}"),
        F.count_if("needs_review").alias("review_needs_review_count"),
        *[F.count_if(F.col(t)).alias(f"{t}_count") for t in tags],
    )


def outer_combine(frames: list[DataFrame], keys: list[str], zero: list[str]) -> DataFrame:
    """Full outer join of per-key aggregates, null keys matching, missing counts 0."""

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({k: f"_{k}" for k in keys}).withColumn("_right", F.lit(True))
        left = left.withColumn("_left", F.lit(True))
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        both = left.join(right, on, "full")
        merged = [F.when(F.col("_left").isNotNull(), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys]
        rest = [c for c in both.columns if c not in keys and not c.startswith("_")]
        return both.select(*merged, *rest)

    return reduce(join, frames).na.fill(0, zero)


def rates(df: DataFrame, prices: dict[str, float]) -> DataFrame:
    """Net count, cancellation, review and method rates, and a price proxy from unit prices; zero divisors give 0."""
    total = F.col("reservation_count") + F.col("cancellation_count")
    proxy = reduce(lambda a, b: a + b, [F.col(f"{m}_count") * F.lit(p) for m, p in prices.items()])
    return df.withColumns({
        "net_count": F.col("reservation_count") - F.col("cancellation_count"),
        "cancellation_rate": ratio("cancellation_count", total),
        "review_rate": ratio("review_count", "reservation_count"),
        **{f"{m}_share": ratio(f"{m}_count", "reservation_count") for m in prices},
        "price_proxy": ratio(proxy, "reservation_count"),
    })


def _value_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, equal, below, all): for each distinct non-null value of the columns how many rows share it, lie below
    it, and have any.

    The running sum is made within 256 ranges between approximate quantiles, whose sums are added before; the ranges
    only share out the work, so their inexactness doesn't matter. But they differ from one computation to the next, so each value's
    range is written once, for its sum and for its place."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = long.filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("equal"))
    bounds = counts.groupBy("column").agg(F.percentile_approx("value", [i / 256 for i in range(1, 256)], 2000).alias("bounds"))
    counts = saved(counts.join(F.broadcast(bounds), "column").withColumn("range", F.size(F.filter("bounds", lambda b: b < F.col("value")))).drop("bounds"))
    by_range = W.partitionBy("column").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = counts.groupBy("column", "range").agg(F.sum("equal").alias("n"))
    ranges = ranges.select("column", "range", F.coalesce(F.sum("n").over(by_range), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy("column")).alias("all"))
    within = W.partitionBy("column", "range").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    below = F.col("before") + F.coalesce(F.sum("equal").over(within), F.lit(0))
    return counts.join(F.broadcast(ranges), ["column", "range"]).select("column", "value", "equal", below.alias("below"), "all")


def _with_scores(df: DataFrame, outs: dict[str, str], score: Column) -> DataFrame:
    """Scores joined back by the distinct values of each column. The frame and its few scores are written once, so that what
    they come from is computed once."""
    df = saved(df) if len(outs) > 1 else df
    scored = _value_ranks(df, list(outs)).select("column", F.col("value").alias("_v"), score.alias("_score"))
    scored = saved(scored) if len(outs) > 1 else scored
    for column, out in outs.items():
        own = scored.filter(F.col("column") == column).select("_v", F.col("_score").alias(out))
        df = df.join(own, F.col(column).cast("double") == F.col("_v"), "left").drop("_v")
    return df


def midrank_scores(df: DataFrame, outs: dict[str, str]) -> DataFrame:
    """(below + half of equal) / n x 100, 2 decimals, for each column under its new name; nulls stay null; a single value
    scores 100."""
    score = F.when(F.col("all") == 1, F.lit(100.0)).otherwise(rounded((F.col("below") + 0.5 * F.col("equal")) / F.col("all") * 100, 2))
    return _with_scores(df, outs, score)


def midrank_score(df: DataFrame, column: str, out: str) -> DataFrame:
    return midrank_scores(df, {column: out})


def avgrank_scores(df: DataFrame, outs: dict[str, str]) -> DataFrame:
    """Average rank / n x 100, 2 decimals; nulls 0."""
    return _with_scores(df, outs, rounded((F.col("below") + (F.col("equal") + 1) / 2) / F.col("all") * 100, 2)).na.fill(0.0, list(outs.values()))


def minmax_score(df: DataFrame, column: str, out: str) -> DataFrame:
    """(x - min) / (max - min) x 100, 2 decimals; a constant column scores 100."""
    ends = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    spread = F.col("_high") - F.col("_low")
    score = F.when(F.col(column).isNull(), None).when(spread == 0, 100.0).otherwise(rounded((F.col(column) - F.col("_low")) / spread * 100, 2))
    return df.join(F.broadcast(ends)).withColumn(out, score).drop("_low", "_high")


def reaction_scores(df: DataFrame, satisfaction: str, visits: str) -> DataFrame:
    """Reservation, review (mean of two mid-ranks), satisfaction, revisit, payment and stability scores."""
    df = midrank_scores(df, {"net_count": "reservation_score", "review_count": "_count_rank", "review_rate": "_rate_rank", visits: "revisit_score", "price_proxy": "payment_score"})
    stability = rounded(F.least(F.greatest(1 - F.col("cancellation_rate"), F.lit(0.0)), F.lit(1.0)) * 100, 2)
    return df.withColumns({
        "review_score": F.floor((rounded(F.col("_count_rank") * 100) + rounded(F.col("_rate_rank") * 100) + 1) / 2) / 100,
        "satisfaction_score": rounded(F.col(satisfaction) / 5 * 100, 2),
        "stability_score": stability,
    }).drop("_count_rank", "_rate_rank")


def weighted_average(value: Column | str, weight: Column | str) -> Column:
    """Aggregate that ignores null values and weights that aren't positive; null if nothing is left."""
    value, weight = (F.col(x) if isinstance(x, str) else x for x in (value, weight))
    valid = value.isNotNull() & (weight > 0)
    return F.try_divide(F.sum(F.when(valid, value * weight)), F.sum(F.when(valid, weight)).cast("double"))


def entity_rollup(metrics: DataFrame, entity: str, counts: list[str], weighted: dict[str, str], prices: dict[str, float], members: str) -> DataFrame:
    """Per entity: distinct members, sums of counts, weighted means, and rates anew."""
    out = metrics.groupBy(entity).agg(
        F.count_distinct(members).alias("member_count"), *[F.sum(c).alias(c) for c in counts], *[weighted_average(v, w).alias(v) for v, w in weighted.items()]
    )
    return rates(out, prices)


def alias_rollup(metrics: DataFrame, key: str, aliases: DataFrame, counts: list[str], weighted: dict[str, str]) -> DataFrame:
    """Entities merged by a table (alias, name), of several names the least: sorted source keys joined by ", ", sums and weighted
    means."""
    names = aliases.filter("alias is not null").groupBy(F.col("alias").alias("_alias")).agg(F.min("name").alias("_name"))
    named = metrics.join(names, F.col(key) == F.col("_alias"), "left").withColumn("entity", F.coalesce("_name", key))
    return named.groupBy("entity").agg(
        F.array_join(F.sort_array(F.collect_set(key)), ", ").alias("source_keys"), *[F.sum(c).alias(c) for c in counts], *[weighted_average(v, w).alias(v) for v, w in weighted.items()]
    )


def overall_profile(metrics: DataFrame, sums: dict[str, str], without: str, mean: str, statuses: dict[str, Column]) -> DataFrame:
    """One row over all entities: their number, sums under new names, entities without a count, mean of a measure, and how
    many meet each status."""
    return metrics.agg(
        F.count("*").alias("entities"), *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in sums.items()], F.count_if(F.coalesce(F.col(without), F.lit(0)) == 0).alias(f"without_{without}"),
        rounded(F.avg(mean), 6).alias(f"mean_{mean}"), *[F.count_if(condition).alias(f"{name}_entities") for name, condition in statuses.items()],
    )


def value_counts(df: DataFrame, column: str, blank: str) -> DataFrame:
    """Rows per value, most frequent first, blanks under a label."""
    text = F.coalesce(F.trim(F.col(column).cast("string")), F.lit(""))
    return df.groupBy(F.when(text == "", F.lit(blank)).otherwise(text).alias("value")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "value")


def top_n(df: DataFrame, sort: list[str], columns: list[str], n: int) -> DataFrame:
    """First n rows, largest first, nulls last, ties by the columns."""
    return df.orderBy(*[F.desc_nulls_last(c) for c in sort], *[F.asc_nulls_last(c) for c in columns]).limit(n).select(*columns, *[c for c in sort if c not in columns])
