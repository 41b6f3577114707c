"""Settlement basis: who is owed for how many people, at which rate."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventpulse.functions.numbers import rounded

#: The most bands of a rule table.
MOST_BANDS = 1000


@dataclass(frozen=True)
class Bands:
    """Bands of a rule table in order of their bounds: least and largest number (null: open), label, rate."""

    rows: tuple[tuple[int, int | None, str, float | None], ...]

    def index(self, count: Column) -> Column:
        """Number of the band that holds a count, from 0; null below the first, in a gap, or beyond a closed last one."""
        lows, highs = (F.array(*[F.lit(row[i]).cast("long") for row in self.rows]) for i in (0, 1))
        last = F.size(F.filter(lows, lambda low: low <= count)) - 1
        return F.when((last >= 0) & (F.get(highs, last).isNull() | (count <= F.get(highs, last))), last)

    def label(self, count: Column, outside: str = "0") -> Column:
        return F.coalesce(F.get(F.array(*[F.lit(row[2]) for row in self.rows]), self.index(count)), F.lit(outside))

    def rate(self, count: Column) -> Column:
        return F.get(F.array(*[F.lit(row[3]).cast("double") for row in self.rows]), self.index(count))

    @property
    def labels(self) -> list[str]:
        return list(dict.fromkeys(row[2] for row in self.rows))


def bands_of(table: DataFrame) -> Bands:
    """The bands of a rule table (low, high or null, label, rate or null). Bands may leave gaps; overlapping ones, one whose high is
    below its low, a null low, and tables of more than MOST_BANDS rows are refused."""
    rows = [tuple(r) for r in table.select("low", "high", "label", "rate").limit(MOST_BANDS + 1).collect()]
    if len(rows) > MOST_BANDS or any(r[0] is None or r[2] is None for r in rows):
        raise ValueError(f"a rule table has at most {MOST_BANDS} bands, all with a low and a label")
    rows.sort(key=lambda r: r[0])
    for one, after in zip(rows, [*rows[1:], None], strict=True):
        if one[1] is not None and one[1] < one[0] or after is not None and (one[1] is None or one[1] >= after[0]):
            raise ValueError(f"bands overlap or are empty: {one}, {after}")
    return Bands(tuple(rows))


def class_metadata(classes: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """One metadata text per key: that of the first row by order."""
    return classes.groupBy(key).agg(F.min_by(text, F.struct(order, text)).alias("metadata"))


def attribute_owner(df: DataFrame, metadata: DataFrame, key: str, title: str, venue: str, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Adds owner and owner_basis: the first rule with a keyword in title and metadata, else the venue."""
    joined = df.join(metadata, key, "left")
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce("metadata", F.lit(""))))
    owner, basis = F.col(venue), F.lit("venue")
    for name, keywords in reversed(rules):
        hit = reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in keywords])
        owner, basis = F.when(hit, F.lit(name)).otherwise(owner), F.when(hit, F.lit("keyword")).otherwise(basis)
    return joined.withColumns({"owner": owner, "owner_basis": basis}).drop("metadata")


def participation(df: DataFrame, keys: list[str], people: str = "people") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(people).alias("participants"))


def cancellation_history(df: DataFrame, keys: list[str], people: str = "people") -> DataFrame:
    """People in cancellations, kept as history and never subtracted."""
    return df.groupBy(*keys).agg(F.sum(people).alias("cancelled_history"))


def band_lookup(df: DataFrame, count: str, bands: Bands) -> DataFrame:
    """Adds band and band_rate; a count that no band holds has band "0" and no rate."""
    return df.withColumns({"band": bands.label(F.col(count)), "band_rate": bands.rate(F.col(count))})


def person_usage(df: DataFrame, method: str = "pass") -> DataFrame:
    """Uses of a method by person, month and class, with the person's uses in that month."""
    own = df.filter(F.col("method") == method).groupBy("month", "owner", "venue", "class_key", "person").agg(F.sum("people").alias("used"))
    monthly = own.groupBy("month", "person").agg(F.sum("used").alias("month_used"))
    return own.join(monthly, ["month", "person"])


def weighted_rate(usage: DataFrame, keys: list[str], bands: Bands) -> DataFrame:
    """Sum of uses x rate over uses, 4 decimals, 0 if none; smallest and largest monthly use."""
    banded = band_lookup(usage, "month_used", bands)
    cents = F.sum(F.col("used") * rounded(F.coalesce("band_rate", F.lit(0.0)) * 100).cast("long"))
    return banded.groupBy(*keys).agg(
        F.sum("used").alias("pass_used"), F.coalesce(rounded(F.try_divide(cents, F.sum("used") * 100), 4), F.lit(0.0)).alias("pass_rate"), F.min("month_used").alias("least_use"), F.max("month_used").alias("most_use")
    )


def band_breakdown(usage: DataFrame, keys: list[str], bands: Bands) -> DataFrame:
    """`label:count; ...` per group, zero bands dropped, sorted by label."""
    banded = band_lookup(usage, "month_used", bands).groupBy(*keys, "band").agg(F.sum("used").alias("n")).filter("n > 0")
    return banded.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "band", F.col("n").cast("string")))), "; ").alias("breakdown"))


def merge_breakdowns(df: DataFrame, keys: list[str], bands: Bands, column: str = "breakdown") -> DataFrame:
    """Breakdown texts added up, bands in their fixed order."""
    parts = df.select(*keys, F.explode(F.split(column, "; ")).alias("part")).select(*keys, F.split_part("part", F.lit(":"), F.lit(1)).alias("band"), F.split_part("part", F.lit(":"), F.lit(2)).cast("long").alias("n"))
    order = F.create_map(*[F.lit(x) for i, label in enumerate(bands.labels) for x in (label, i)])
    sums = parts.groupBy(*keys, "band").agg(F.sum("n").alias("n")).withColumn("item", F.struct(F.coalesce(F.try_element_at(order, F.col("band")), F.lit(-1)).alias("at"), F.concat_ws(":", "band", F.col("n").cast("string")).alias("text")))
    return sums.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["text"]), "; ").alias("breakdown"))


def pivot_methods(df: DataFrame, keys: list[str], methods: list[str]) -> DataFrame:
    """Participants by method as columns, all there, 0 when absent."""
    wide = df.groupBy(*keys).pivot("method", methods).agg(F.sum("participants"))
    return wide.na.fill(0, methods).withColumnsRenamed({m: f"{m}_people" for m in methods})


def _people_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("people"))), F.lit(0))


def settlement_basis(df: DataFrame, keys: list[str], methods: list[str], fallback_rate: float, bands: Bands) -> DataFrame:
    """Per class-month: people by method, pass rate (the fallback where passes exist but no rate), history, total; uses of
    passes, the sum of uses times rate (in hundredths) and of uses by band. In one pass: sums by person, the person's uses of the month
    beside them, sums by key; nothing is read twice."""
    reserved = F.col("kind") == "reservation"
    own = df.groupBy(*dict.fromkeys([*keys, "month", "owner", "venue", "class_key", "person"])).agg(
        F.count_if(reserved).alias("_rows"), *[_people_where(reserved & (F.col("method") == m)).alias(f"{m}_people") for m in methods],
        F.sum(F.when(reserved & (F.col("method") == "pass"), F.col("people"))).alias("_used"), _people_where(F.col("kind") == "cancellation").alias("cancelled_history"),
    )
    own = own.withColumn("_month", F.sum("_used").over(W.partitionBy("month", "person"))).withColumn("_band", bands.index(F.col("_month")))
    cents = F.array(*[rounded(F.lit(float(row[3] or 0)) * 100).cast("long") for row in bands.rows])
    sums = own.groupBy(*keys).agg(
        F.sum("_rows").alias("_rows"), *[F.sum(f"{m}_people").alias(f"{m}_people") for m in methods], F.coalesce(F.sum("_used"), F.lit(0)).alias("pass_used"),
        F.coalesce(F.sum(F.col("_used") * F.coalesce(F.get(cents, F.col("_band")), F.lit(0))), F.lit(0)).alias("rate_cents"), F.sum("cancelled_history").alias("cancelled_history"),
        *[F.coalesce(F.sum(F.when(F.col("_band") == i, F.col("_used"))), F.lit(0)).alias(f"band_{i}") for i in range(len(bands.rows))],
    ).filter("_rows > 0").drop("_rows")
    out = sums.withColumn("pass_rate", F.coalesce(rounded(F.try_divide("rate_cents", F.col("pass_used") * 100), 4), F.lit(0.0)))
    total = reduce(lambda a, b: a + b, [F.col(f"{m}_people") for m in methods])
    rate = F.when((F.col("pass_people") > 0) & (F.col("pass_rate") == 0), F.lit(fallback_rate)).otherwise(F.col("pass_rate"))
    return out.withColumns({"total_people": total, "applied_rate": rate, "note": F.when(F.col("cancelled_history") > 0, F.lit("cancellations kept as history")).otherwise(F.lit(""))})


def owner_month_rollup(basis: DataFrame, bands: Bands) -> DataFrame:
    """Per owner and month: distinct classes and venues, the venue list, sums, the uses by band as `label:count; ...`, and the rate
    weighted by observed uses, without the fallback; 0 if there are none."""
    sums = basis.groupBy("month", "owner").agg(
        F.count_distinct("class_key").alias("classes"), F.count_distinct("venue").alias("venues"), F.array_join(F.array_sort(F.collect_set("venue")), ", ").alias("venue_list"),
        F.sum("total_people").alias("total_people"), F.sum("pass_people").alias("pass_people"), F.sum("cancelled_history").alias("cancelled_history"),
        F.coalesce(rounded(F.try_divide(F.sum("rate_cents"), F.sum("pass_used") * 100), 4), F.lit(0.0)).alias("pass_rate"),
        *[F.sum(f"band_{i}").alias(f"_n{i}") for i in range(len(bands.rows))],
    )
    parts = [F.when(F.col(f"_n{i}") > 0, F.concat(F.lit(f"{row[2]}:"), F.col(f"_n{i}").cast("string"))) for i, row in enumerate(bands.rows)]
    return sums.withColumn("breakdown", F.concat_ws("; ", *parts)).drop(*[f"_n{i}" for i in range(len(bands.rows))])


def package_inference(df: DataFrame, buckets: Bands) -> DataFrame:
    """Uses summed per person, put in buckets; per bucket persons, sum, smallest and largest."""
    people = df.groupBy("person").agg(F.sum("people").alias("used"))
    return people.groupBy(buckets.label(F.col("used")).alias("package")).agg(F.count("*").alias("persons"), F.sum("used").alias("used"), F.min("used").alias("least"), F.max("used").alias("most"))
