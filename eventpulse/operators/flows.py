"""Sessions, itineraries and movement between places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventpulse.functions.numbers import rounded
from eventpulse.functions.text import compact_spaces, join_key
from eventpulse.operators.numbering import numbered
from eventpulse.sources.files import to_geojson_features


STATUSES = ("unknown", "overlap", "comfortable", "tight", "difficult")


def enrich_bookings(df: DataFrame, title: str, people: str, kind: str) -> DataFrame:
    """Adds kind, key, people (1 if missing) and session_key, `key_yyyymmddThhmm` or `key_unparsed`."""
    key = join_key(compact_spaces(title))
    stamp = F.when(F.col("start_at").isNull(), "unparsed").otherwise(F.date_format("start_at", "yyyyMMdd'T'HHmm"))
    return df.withColumns({"kind": F.lit(kind), "class_key": key, "people": F.coalesce(F.col(people).cast("long"), F.lit(1).cast("long")), "session_key": F.concat_ws("_", key, stamp)})


def session_schedule(bookings: DataFrame, attributes: list[str], order: str) -> DataFrame:
    """Per session: first non-null attributes, reservation rows, people and distinct participants, cancellations, review flag."""
    reserved, cancelled = F.col("kind") == "reservation", F.col("kind") == "cancellation"
    return bookings.groupBy("session_key").agg(
        *[F.min_by(a, F.when(F.col(a).isNotNull(), F.col(order))).alias(a) for a in attributes],
        F.max("needs_review").alias("needs_review"),
        F.count_if(reserved).alias("reservation_rows"), F.coalesce(F.sum(F.when(reserved, F.col("people"))), F.lit(0)).alias("reserved_people"), F.count_distinct(F.when(reserved, F.col("person"))).alias("participants"),
        F.count_if(cancelled).alias("cancellation_rows"), F.coalesce(F.sum(F.when(cancelled, F.col("people"))), F.lit(0)).alias("cancelled_people"),
    )


def itinerary(bookings: DataFrame, who: str, order: list[str]) -> DataFrame:
    """Each participant's bookings numbered in order, nulls last."""
    return bookings.withColumn("itinerary_order", F.row_number().over(W.partitionBy(who).orderBy(*[F.asc_nulls_last(c) for c in order])))


def feasibility(gap: Column, travel: Column, buffer: float = 10.0) -> Column:
    return (
        F.when(gap.isNull() | travel.isNull(), "unknown").when(gap < 0, "overlap").when(gap >= travel + buffer, "comfortable").when(gap >= travel, "tight").otherwise("difficult")
    )


def transitions(itinerary: DataFrame, matrix: DataFrame, who: str) -> DataFrame:
    """Consecutive bookings of a participant: gap in minutes, walk by the matrix, same place, scope and feasibility."""
    ahead = W.partitionBy(who).orderBy("itinerary_order")
    pairs = itinerary.select(
        who, "itinerary_order", F.col("place").alias("origin"), F.col("session_key").alias("origin_session"), F.lead("place").over(ahead).alias("destination"), F.lead("session_key").over(ahead).alias("destination_session"),
        F.col("start_at").alias("from_start"), F.col("end_at").alias("from_end"), F.lead("start_at").over(ahead).alias("to_start"),
    ).filter("destination_session is not null")
    walks = matrix.select("origin", "destination", "walk_m", "walk_minutes", "walk_method")
    joined = pairs.join(walks, ["origin", "destination"], "left")
    gap = rounded((F.unix_micros("to_start") - F.unix_micros("from_end")) / 60_000_000, 2)
    scope = F.when(F.col("from_start").isNull() | F.col("to_start").isNull(), "unknown_date").when(F.to_date("from_start") == F.to_date("to_start"), "same_day").otherwise("cross_day")
    joined = joined.withColumns({"gap_minutes": gap, "scope": scope, "same_location": F.col("origin") == F.col("destination")})
    return joined.withColumn("status", feasibility(F.col("gap_minutes"), F.col("walk_minutes"))).drop("from_start", "from_end", "to_start")


def aggregate_transitions(moves: DataFrame, grain: list[str]) -> DataFrame:
    """Same-day moves counted by grain, with mean, smallest and largest gap and mean walk."""
    same = moves.filter("scope = 'same_day'")
    cents = F.sum(rounded(F.col("gap_minutes") * 100).cast("long"))
    walk = F.sum(rounded(F.col("walk_minutes") * 100).cast("long"))
    return same.groupBy(*grain).agg(
        F.count("*").alias("transition_count"), rounded(cents / F.count("gap_minutes") / 100, 2).alias("avg_gap"), F.min("gap_minutes").alias("min_gap"), F.max("gap_minutes").alias("max_gap"),
        rounded(walk / F.count("walk_minutes") / 100, 2).alias("avg_walk"),
    )


def node_mobility(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node moves out, in, within, across, by status, comfortable share, weighted gap and hub score. Each edge goes to its
    ends once; nodes without edges stay."""
    same = F.col("origin") == F.col("destination")
    ends = F.when(same, F.array(F.struct(F.col("origin").alias("node"), F.lit("self").alias("role")))).otherwise(
        F.array(F.struct(F.col("origin").alias("node"), F.lit("out").alias("role")), F.struct(F.col("destination").alias("node"), F.lit("in").alias("role")))
    )
    spread = edges.withColumn("end", F.explode(ends)).withColumns({"node": F.col("end.node"), "role": F.col("end.role")})
    n = F.col("transition_count")

    def total(role: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("role") == role, n)), F.lit(0))

    sums = spread.groupBy("node").agg(
        total("out").alias("cross_out"), total("in").alias("cross_in"), total("self").alias("self_moves"), F.sum(n).alias("moves"),
        *[F.coalesce(F.sum(F.when(F.col("status") == s, n)), F.lit(0)).alias(f"{s}_moves") for s in STATUSES],
        rounded(F.sum(rounded(F.col("avg_gap") * 100).cast("long") * n) / F.sum(F.when(F.col("avg_gap").isNotNull(), n)) / 100, 2).alias("mean_gap"),
    )
    joined = nodes.select(F.col("key").alias("node")).join(sums, "node", "left").na.fill(0)
    return joined.withColumns({
        "outgoing": F.col("cross_out") + F.col("self_moves"), "incoming": F.col("cross_in") + F.col("self_moves"),
        "hub_score": F.col("cross_out") + F.col("cross_in") + 0.5 * F.col("self_moves"), "comfortable_share": rounded(F.coalesce(F.try_divide(F.col("comfortable_moves").cast("double"), F.col("moves").cast("double")), F.lit(0.0)), 4),
    })


def review_lists(reviews: DataFrame, key: str, order: str, text: Column, shown: int) -> DataFrame:
    """Per key its reviews in order as one text list, blanks dropped, missing order last; at most `shown` are listed (the
    feature's size), all are counted."""
    rows = reviews.withColumn("_text", text).filter(F.trim("_text") != "")
    rows = numbered(rows, [key], [F.asc_nulls_last(order), "_text"], "_n")
    return rows.groupBy(key).agg(F.count("*").alias("reviews"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= shown, F.struct("_n", "_text")))), lambda x: x["_text"]), " | ").alias("texts"))


def status_totals(edges: DataFrame) -> DataFrame:
    return edges.groupBy("status").agg(F.sum("transition_count").alias("transitions"), F.count("*").alias("pairs"))


def top_pairs(edges: DataFrame, n: int) -> DataFrame:
    """The n pairs of places with most transitions over all statuses, ties by name."""
    pairs = edges.groupBy("origin", "destination").agg(F.sum("transition_count").alias("transitions"))
    return pairs.orderBy(F.desc("transitions"), "origin", "destination").limit(n)


def top_hubs(mobility: DataFrame, n: int) -> DataFrame:
    """The n places of largest hub score, ties by name."""
    return mobility.select("node", "hub_score", "moves").orderBy(F.desc("hub_score"), "node").limit(n)


def timestamped_features(schedule: DataFrame) -> DataFrame:
    """Points in order of time (a global sort by range, sessions without a time last), with a clamped size and a band of people."""
    people = F.col("reserved_people")
    return schedule.withColumns({
        "radius": F.greatest(F.lit(4.0), F.least(F.lit(24.0), 4 + people * 0.5)), "band": F.when(people >= 200, "high").when(people >= 50, "middle").when(people > 0, "low").otherwise("none"),
    }).orderBy(F.asc_nulls_last("start_at"), "session_key")


def timestamped_points(schedule: DataFrame, nodes: DataFrame) -> DataFrame:
    """timestamped_features at their places' coordinates, as one Feature text a session; sessions without a place on the map go."""
    stamped = timestamped_features(schedule).withColumn("start_at", F.date_format("start_at", "yyyy-MM-dd'T'HH:mm:ss"))
    placed = stamped.join(nodes.select(F.col("key").alias("place"), "lat", "lon"), "place")
    return to_geojson_features(placed.select("session_key", "place", "start_at", "radius", "band", "reserved_people", "lat", "lon"), "lat", "lon")


def session_positions(schedule: DataFrame) -> DataFrame:
    """Each session with its number at its place in order of time, its place's sessions, and its start as a fraction of the
    whole time range."""
    ends = schedule.agg(F.min(F.unix_micros("start_at")).alias("_low"), F.max(F.unix_micros("start_at")).alias("_high"))
    at = F.coalesce(F.try_divide((F.unix_micros("start_at") - F.col("_low")).cast("double"), (F.col("_high") - F.col("_low")).cast("double")), F.lit(0.0))
    placed = schedule.join(F.broadcast(ends)).withColumn("fraction", rounded(at, 6)).drop("_low", "_high")
    return numbered(placed, ["place"], [F.asc_nulls_last("start_at"), "session_key"], "position", "place_sessions")


def space_time_profile(schedule: DataFrame, top: int = 6) -> DataFrame:
    """Per place: sessions, people, first and last start as fractions of the whole time range, and the largest sessions."""
    ends = schedule.agg(F.min(F.unix_micros("start_at")).alias("_low"), F.max(F.unix_micros("start_at")).alias("_high"))
    at = F.coalesce(F.try_divide((F.unix_micros("start_at") - F.col("_low")).cast("double"), (F.col("_high") - F.col("_low")).cast("double")), F.lit(0.0))
    placed = schedule.join(F.broadcast(ends)).withColumn("fraction", at)
    placed = numbered(placed, ["place"], [F.desc("reserved_people"), "session_key"], "_n")
    return placed.groupBy("place").agg(
        F.count("*").alias("sessions"), F.sum("reserved_people").alias("people"), rounded(F.min("fraction"), 6).alias("first_fraction"), rounded(F.max("fraction"), 6).alias("last_fraction"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= top, F.struct("_n", "session_key")))), lambda x: x["session_key"]), ",").alias("top_sessions"),
    )


def top_flows(edges: DataFrame, nodes: DataFrame, n: int = 80) -> DataFrame:
    """Largest positive flows between different known places."""
    known = nodes.select(F.col("key").alias("_key"))
    good = edges.filter((F.col("transition_count") > 0) & (F.col("origin") != F.col("destination")))
    good = good.join(known, F.col("origin") == F.col("_key"), "left_semi").join(known, F.col("destination") == F.col("_key"), "left_semi")
    return good.orderBy(F.desc("transition_count"), "origin", "destination", "status").limit(n)
