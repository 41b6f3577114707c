"""Queries of metrics, capacity and settlement."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventpulse.functions.numbers import rounded

from eventpulse.operators import capacity as C
from eventpulse.operators import metrics as M
from eventpulse.operators import settlement as P

from . import fixed_values as fixed
from .tables import BOOKINGS, REVIEWS, bookings, reviews, table, with_views

METHODS = ["pass", "one_time", "unknown"]
PRICES = {"pass": 9000.0, "one_time": 15000.0, "unknown": 0.0}
KEYS = ["venue", "class_title"]
OWNERS = [("Bolt Works", ["bolt"]), ("Ring House", ["ring", "widget"])]
BASIS_KEYS = ["month", "owner", "venue", "class_key"]


def _reserved(spark, sf_dir):
    return bookings(spark, sf_dir).filter("kind = 'reservation'")


def _profile(spark, sf_dir):
    rated = reviews(spark, sf_dir).withColumn("calm", F.col("lang") == "en").withColumn("space", F.col("lang") == "de")
    return M.review_profile(rated, ["venue"], ["rating", "class_rating"], "visits", ["calm", "space"])


def _venue_metrics(spark, sf_dir):
    b = bookings(spark, sf_dir)
    counts = M.conditional_counts(b.filter("kind = 'reservation'"), ["venue"], "people", "method", METHODS, "reservation")
    cancelled = b.filter("kind = 'cancellation'").groupBy("venue").agg(F.sum("people").alias("cancellation_count"), F.count("*").alias("cancellation_records"))
    combined = M.outer_combine([counts, cancelled, _profile(spark, sf_dir)], ["venue"], [*M.COUNTS, "calm_count", "space_count", "review_needs_review_count"])
    return M.rates(combined, PRICES)


def _class_metrics(spark, sf_dir):
    b = bookings(spark, sf_dir)
    counts = M.conditional_counts(b.filter("kind = 'reservation'"), KEYS, "people", "method", METHODS, "reservation")
    cancelled = b.filter("kind = 'cancellation'").groupBy(*KEYS).agg(F.sum("people").alias("cancellation_count"), F.count("*").alias("cancellation_records"))
    both = M.outer_combine([counts, cancelled], KEYS, list(M.COUNTS[:-1]))
    return both.withColumn("review_count", F.col("cancellation_records") % 5).withColumn("rating", F.when(F.col("reservation_count") % 7 == 0, None).otherwise(F.col("reservation_count") % 5 + 1).cast("double"))


def m1_display_title(spark, sf_dir):
    parts, orders = table(spark, sf_dir, "part"), bookings(spark, sf_dir)
    return M.pick_display_title([(parts, "p_brand", "p_name", 2), (orders, "venue", "class_title", 1)])


def m2_conditional_counts(spark, sf_dir):
    return M.conditional_counts(_reserved(spark, sf_dir), KEYS, "people", "method", METHODS, "reservation")


def m3_review_profile(spark, sf_dir):
    return _profile(spark, sf_dir)


def m4_outer_combine(spark, sf_dir):
    return _venue_metrics(spark, sf_dir).select("venue", "reservation_count", "cancellation_count", "review_count", "avg_rating")


def m5_rates(spark, sf_dir):
    columns = ["cancellation_rate", "review_rate", "pass_share", "one_time_share", "price_proxy"]
    return _venue_metrics(spark, sf_dir).select("venue", "net_count", *[rounded(c, 6).alias(c) for c in columns])


def m6_midrank(spark, sf_dir):
    return M.midrank_score(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "midrank").select("doc_id", "midrank")


def m7_minmax(spark, sf_dir):
    return M.minmax_score(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "score").select("o_orderkey", "score")


def m8_reaction_scores(spark, sf_dir):
    scored = M.reaction_scores(_venue_metrics(spark, sf_dir), "avg_rating", "avg_visits")
    return scored.select("venue", "reservation_score", "review_score", "satisfaction_score", "revisit_score", "payment_score", "stability_score")


def m9_weighted_average(spark, sf_dir):
    return _class_metrics(spark, sf_dir).groupBy("venue").agg(rounded(M.weighted_average("rating", "reservation_records"), 6).alias("rating"))


def m10_entity_rollup(spark, sf_dir):
    out = M.entity_rollup(_class_metrics(spark, sf_dir), "venue", list(M.COUNTS), {"rating": "review_count"}, PRICES, "class_title")
    return out.select("venue", "member_count", "reservation_count", "cancellation_count", "net_count", rounded("rating", 6).alias("rating"), rounded("cancellation_rate", 6).alias("cancellation_rate"))


def m11_alias_rollup(spark, sf_dir):
    aliases = spark.createDataFrame([("Brand#1", "First"), ("Brand#2", "First"), ("Brand#11", "Eleven")], "alias string, name string")
    out = M.alias_rollup(_class_metrics(spark, sf_dir), "venue", aliases, ["reservation_count", "review_count"], {"rating": "reservation_count"})
    return out.withColumn("rating", rounded("rating", 6))


def m12_value_counts(spark, sf_dir):
    return M.value_counts(table(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "click", " ").otherwise(F.col("event_type"))), "status", "missing")


def m13_top_n(spark, sf_dir):
    scored = M.reaction_scores(_venue_metrics(spark, sf_dir), "avg_rating", "avg_visits")
    return M.top_n(scored, ["reservation_score", "payment_score"], ["venue"], 10)


def m14_overall_profile(spark, sf_dir):
    statuses = {"cancelled_at": F.col("cancellation_count") > 0, "rated_well": F.col("avg_rating") >= 4, "unrated": F.col("avg_rating").isNull()}
    return M.overall_profile(_venue_metrics(spark, sf_dir), {"reservation_count": "reserved", "cancellation_count": "cancelled", "review_count": "reviews"}, "review_count", "avg_rating", statuses)


def _sessions(spark, sf_dir):
    b = _reserved(spark, sf_dir).groupBy("part_id", "venue", "month").agg(F.sum("people").alias("reserved"), F.max("size").alias("size"))
    return b.select("part_id", "venue", F.col("month").alias("day"), "reserved", (F.col("size") * 3).cast("long").alias("capacity"))


def _capacity(spark, sf_dir):
    return C.capacity_by_key(_sessions(spark, sf_dir), "venue", reviews(spark, sf_dir).select("venue"))


def c1_capacity_by_key(spark, sf_dir):
    return _capacity(spark, sf_dir)


def _segments(spark, sf_dir):
    by_part = C.capacity_by_key(_sessions(spark, sf_dir), "part_id").select("part_id", "fill_weighted", "reserved_total", "capacity_total", "sessions")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_partkey") % 100).cast("double").alias("score"))
    joined = parts.join(by_part, parts["p_partkey"] == by_part["part_id"], "left")
    filled = joined.withColumn("fill", F.when(F.col("p_partkey") % 11 == 0, None).otherwise(F.col("fill_weighted")))
    return C.segment_capacity(filled, "fill", ["score"], fixed.SEGMENTS, fixed.NO_SEGMENT, fixed.NO_FILL)


def c2_segment_capacity(spark, sf_dir):
    return _segments(spark, sf_dir).select("p_partkey", "segment")


def c3_capacity_rollup(spark, sf_dir):
    status = F.when(F.col("p_partkey") % 5 == 0, "needs_review").when(F.col("p_partkey") % 5 == 1, "fuzzy_same_studio").otherwise("exact_normalized")
    matched = _segments(spark, sf_dir).filter("part_id is not null").withColumn("match_status", status).withColumnRenamed("p_brand", "venue")
    return C.capacity_rollup(matched, "venue", "part_id", table(spark, sf_dir, "part").select(F.col("p_brand").alias("venue")).distinct(), ("exact_normalized", "fuzzy_same_studio"))


def c4_daily_fill(spark, sf_dir):
    return C.daily_fill(_sessions(spark, sf_dir))


def _owned(spark, sf_dir):
    b = bookings(spark, sf_dir).withColumnRenamed("class_title", "class_key")
    return P.attribute_owner(b, _metadata(spark, sf_dir), "class_key", "class_key", "venue", OWNERS)


def _metadata(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_name").alias("class_key"), F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("text"), "p_partkey")
    return P.class_metadata(parts, "class_key", "text", "p_partkey")


def p1_class_metadata(spark, sf_dir):
    return _metadata(spark, sf_dir)


def p2_attribute_owner(spark, sf_dir):
    return _owned(spark, sf_dir).groupBy("owner", "owner_basis").agg(F.count("*").alias("rows"), F.sum("people").alias("people"))


def p3_participation(spark, sf_dir):
    return P.participation(_owned(spark, sf_dir).filter("kind = 'reservation'"), [*BASIS_KEYS, "method"])


def p4_cancellation_history(spark, sf_dir):
    return P.cancellation_history(_owned(spark, sf_dir).filter("kind = 'cancellation'"), ["month", "class_key"])


def _bands(spark, rows):
    return P.bands_of(spark.createDataFrame(rows, "low long, high long, label string, rate double"))


def p5_band_lookup(spark, sf_dir):
    usage = _reserved(spark, sf_dir).filter("method = 'pass'").groupBy("person", "month").agg(F.sum("people").alias("used"))
    return P.band_lookup(usage, "used", _bands(spark, fixed.RATE_BANDS))


def _usage(spark, sf_dir):
    return P.person_usage(_owned(spark, sf_dir).filter("kind = 'reservation'"))


def p6_weighted_rate(spark, sf_dir):
    return P.weighted_rate(_usage(spark, sf_dir), BASIS_KEYS, _bands(spark, fixed.RATE_BANDS))


def p7_band_breakdown(spark, sf_dir):
    return P.band_breakdown(_usage(spark, sf_dir), BASIS_KEYS, _bands(spark, fixed.RATE_BANDS))


def p8_merge_breakdowns(spark, sf_dir):
    return P.merge_breakdowns(p7_band_breakdown(spark, sf_dir), ["month", "owner"], _bands(spark, fixed.RATE_BANDS))


def p9_pivot_methods(spark, sf_dir):
    return P.pivot_methods(P.participation(_owned(spark, sf_dir).filter("kind = 'reservation'"), ["month", "owner", "method"]), ["month", "owner"], METHODS)


def _basis(spark, sf_dir):
    return P.settlement_basis(_owned(spark, sf_dir), BASIS_KEYS, METHODS, 0.55, _bands(spark, fixed.RATE_BANDS))


def p10_settlement_basis(spark, sf_dir):
    return _basis(spark, sf_dir).select(*BASIS_KEYS, "pass_people", "one_time_people", "unknown_people", "total_people", "pass_rate", "applied_rate", "cancelled_history", "note")


def p11_owner_month_rollup(spark, sf_dir):
    return P.owner_month_rollup(_basis(spark, sf_dir), _bands(spark, fixed.RATE_BANDS))


def p12_package_inference(spark, sf_dir):
    return P.package_inference(_reserved(spark, sf_dir).filter("method = 'pass'"), _bands(spark, fixed.PACKAGES))


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] in "mcp" and n[1:2].isdigit()}

_COUNTS = """counts AS (SELECT venue, CAST(sum(people) AS BIGINT) AS reservation_count, count(*) AS reservation_records,
  CAST(coalesce(sum(people) FILTER (WHERE method = 'pass'), 0) AS BIGINT) AS pass_count, CAST(coalesce(sum(people) FILTER (WHERE method = 'one_time'), 0) AS BIGINT) AS one_time_count,
  CAST(coalesce(sum(people) FILTER (WHERE method = 'unknown'), 0) AS BIGINT) AS unknown_count FROM bookings WHERE kind = 'reservation' GROUP BY venue),
cancelled AS (SELECT venue, CAST(sum(people) AS BIGINT) AS cancellation_count, count(*) AS cancellation_records FROM bookings WHERE kind = 'cancellation' GROUP BY venue)"""
_PROFILE = """profile AS (SELECT venue, count(*) AS review_count, avg(rating) AS avg_rating, avg(class_rating) AS avg_class_rating, avg(CAST(visits AS DOUBLE)) AS avg_visits,
  count(*) FILTER (WHERE needs_review) AS review_needs_review_count, count(*) FILTER (WHERE lang = 'en') AS calm_count, count(*) FILTER (WHERE lang = 'de') AS space_count FROM reviews GROUP BY venue)"""
_VENUES = """venues AS (SELECT coalesce(c.venue, x.venue, p.venue) AS venue, coalesce(reservation_count, 0) AS reservation_count, coalesce(pass_count, 0) AS pass_count, coalesce(one_time_count, 0) AS one_time_count,
  coalesce(cancellation_count, 0) AS cancellation_count, coalesce(review_count, 0) AS review_count, avg_rating, avg_visits
  FROM counts c FULL JOIN cancelled x ON c.venue = x.venue FULL JOIN profile p ON coalesce(c.venue, x.venue) = p.venue)"""
_RATES = """rated AS (SELECT *, reservation_count - cancellation_count AS net_count, coalesce(cancellation_count::DOUBLE / nullif(reservation_count + cancellation_count, 0), 0) AS cancellation_rate,
  coalesce(review_count::DOUBLE / nullif(reservation_count, 0), 0) AS review_rate, coalesce(pass_count::DOUBLE / nullif(reservation_count, 0), 0) AS pass_share, coalesce(one_time_count::DOUBLE / nullif(reservation_count, 0), 0) AS one_time_share,
  coalesce((pass_count * 9000.0::DOUBLE + one_time_count * 15000.0::DOUBLE) / nullif(reservation_count, 0), 0) AS price_proxy FROM venues)"""


def _mid(x: str, n: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN count({x}) OVER () = 1 THEN 100 ELSE round((count({x}) OVER (ORDER BY {x} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY {x}) + 0.5::DOUBLE * count(*) OVER (PARTITION BY {x})) / count({x}) OVER () * 100, 2) END AS {n}"


_SCORES = f"""ranked AS (SELECT *, {_mid('net_count', 'reservation_score')}, {_mid('review_count', 'r1')}, {_mid('review_rate', 'r2')}, {_mid('avg_visits', 'revisit_score')}, {_mid('price_proxy', 'payment_score')} FROM rated)"""
_VENUE_VIEWS = (BOOKINGS, REVIEWS, _COUNTS, _PROFILE, _VENUES, _RATES)
_CLASS = """cl AS (SELECT *, cancellation_records % 5 AS review_count, CASE WHEN reservation_count % 7 = 0 THEN NULL ELSE CAST(reservation_count % 5 + 1 AS DOUBLE) END AS rating FROM (
  SELECT venue, class_title, CAST(coalesce(sum(people) FILTER (WHERE kind = 'reservation'), 0) AS BIGINT) AS reservation_count, count(*) FILTER (WHERE kind = 'reservation') AS reservation_records,
  CAST(coalesce(sum(people) FILTER (WHERE kind = 'cancellation'), 0) AS BIGINT) AS cancellation_count, count(*) FILTER (WHERE kind = 'cancellation') AS cancellation_records FROM bookings GROUP BY ALL))"""
_SESSIONS = """sessions AS (SELECT part_id, venue, month AS day, CAST(sum(people) AS BIGINT) AS reserved, CAST(max(size) * 3 AS BIGINT) AS capacity FROM bookings WHERE kind = 'reservation' GROUP BY part_id, venue, month)"""
_SEG = """seg AS (SELECT p_partkey, p_brand AS venue, sessions, reserved_total, capacity_total, CASE WHEN f IS NULL THEN 'capacity_missing' WHEN s >= 70 AND f >= 0.85 THEN 'expand_or_repeat_candidate' WHEN s >= 70 AND f < 0.5 THEN 'message_or_schedule_review'
  WHEN f >= 0.85 THEN 'small_capacity_or_niche_strength' WHEN f < 0.5 THEN 'demand_development_candidate' ELSE 'steady_middle' END AS segment FROM (SELECT p_partkey, p_brand, p_partkey % 100 AS s, sessions, reserved_total, capacity_total, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE fw END AS f
  FROM part LEFT JOIN (SELECT part_id, count(*) AS sessions, sum(reserved) AS reserved_total, sum(capacity) AS capacity_total, round(sum(reserved)::DOUBLE / nullif(sum(capacity), 0), 6) AS fw FROM sessions GROUP BY part_id) ON p_partkey = part_id))"""
_META = """meta AS (SELECT class_key, arg_min(t, p_partkey) AS metadata FROM (SELECT p_type || ' ' || p_name AS class_key, p_brand || ' ' || CAST(p_size AS VARCHAR) AS t, p_partkey FROM part) GROUP BY class_key)"""
_OWNED = """owned AS (SELECT b.*, b.class_title AS class_key, CASE WHEN contains(t, 'bolt') THEN 'Bolt Works' WHEN contains(t, 'ring') OR contains(t, 'widget') THEN 'Ring House' ELSE venue END AS owner,
  CASE WHEN contains(t, 'bolt') OR contains(t, 'ring') OR contains(t, 'widget') THEN 'keyword' ELSE 'venue' END AS owner_basis FROM (SELECT x.*, lower(class_title || ' ' || coalesce(metadata, '')) AS t FROM bookings x LEFT JOIN meta ON class_title = class_key) b)"""
_BAND = "CASE WHEN {x} >= 100 THEN '100+' WHEN {x} >= 10 THEN '10-99' WHEN {x} >= 1 THEN '1-9' ELSE '0' END"
_RATE = "CASE WHEN {x} >= 100 THEN {a} WHEN {x} >= 10 THEN {b} WHEN {x} >= 1 THEN {c} END"
_USAGE = """own AS (SELECT month, owner, venue, class_key, person, sum(people) AS used FROM owned WHERE kind = 'reservation' AND method = 'pass' GROUP BY ALL),
usage AS (SELECT own.*, m.month_used FROM own JOIN (SELECT month AS mm, person AS pp, sum(used) AS month_used FROM own GROUP BY ALL) m ON month = mm AND person = pp)"""
_WRATE = f"""wrate AS (SELECT month, owner, venue, class_key, CAST(sum(used) AS BIGINT) AS pass_used, round(sum(used * {_RATE.format(x='month_used', a=55, b=65, c=75)})::DOUBLE / (sum(used) * 100), 4) AS pass_rate, CAST(min(month_used) AS BIGINT) AS least_use, CAST(max(month_used) AS BIGINT) AS most_use FROM usage GROUP BY month, owner, venue, class_key)"""
_BASIS = """basis AS (SELECT w.*, coalesce(pass_rate, 0) AS pass_rate, CASE WHEN pass_people > 0 AND coalesce(pass_rate, 0) = 0 THEN 0.55 ELSE coalesce(pass_rate, 0) END AS applied_rate, CAST(coalesce(h, 0) AS BIGINT) AS cancelled_history,
  CASE WHEN coalesce(h, 0) > 0 THEN 'cancellations kept as history' ELSE '' END AS note FROM (SELECT month, owner, venue, class_key, CAST(coalesce(sum(people) FILTER (WHERE method = 'pass'), 0) AS BIGINT) AS pass_people, CAST(coalesce(sum(people) FILTER (WHERE method = 'one_time'), 0) AS BIGINT) AS one_time_people,
  CAST(coalesce(sum(people) FILTER (WHERE method = 'unknown'), 0) AS BIGINT) AS unknown_people, CAST(sum(people) AS BIGINT) AS total_people FROM owned WHERE kind = 'reservation' GROUP BY month, owner, venue, class_key) w
  LEFT JOIN wrate USING (month, owner, venue, class_key) LEFT JOIN (SELECT month, owner, venue, class_key, sum(people) AS h FROM owned WHERE kind = 'cancellation' GROUP BY ALL) USING (month, owner, venue, class_key))"""
_OWN = (BOOKINGS, _META, _OWNED)
SQL = {
    "m1_display_title": with_views(BOOKINGS) + "SELECT key, arg_min(title, (priority, -n, title)) AS title FROM (SELECT key, title, min(p) AS priority, count(*) AS n FROM (SELECT p_brand AS key, p_name AS title, 2 AS p FROM part UNION ALL SELECT venue, class_title, 1 FROM bookings) GROUP BY key, title) GROUP BY key",
    "m2_conditional_counts": with_views(BOOKINGS, _COUNTS.replace("SELECT venue, CAST(sum(people) AS BIGINT) AS reservation_count", "SELECT venue, class_title, CAST(sum(people) AS BIGINT) AS reservation_count").replace("'reservation' GROUP BY venue)", "'reservation' GROUP BY venue, class_title)")) + "SELECT * FROM counts",
    "m3_review_profile": with_views(REVIEWS, _PROFILE) + "SELECT * FROM profile",
    "m4_outer_combine": with_views(*_VENUE_VIEWS[:-1]) + "SELECT venue, reservation_count, cancellation_count, review_count, avg_rating FROM venues",
    "m5_rates": with_views(*_VENUE_VIEWS) + "SELECT venue, net_count, round(cancellation_rate, 6) AS cancellation_rate, round(review_rate, 6) AS review_rate, round(pass_share, 6) AS pass_share, round(one_time_share, 6) AS one_time_share, round(price_proxy, 6) AS price_proxy FROM rated",
    "m6_midrank": f"SELECT doc_id, {_mid('n_chars', 'midrank')} FROM documents",
    "m7_minmax": "SELECT o_orderkey, round((o_custkey - min(o_custkey) OVER ())::DOUBLE / (max(o_custkey) OVER () - min(o_custkey) OVER ()) * 100, 2) AS score FROM orders",
    "m8_reaction_scores": with_views(*_VENUE_VIEWS, _SCORES) + "SELECT venue, reservation_score, floor((round(r1 * 100) + round(r2 * 100) + 1) / 2) / 100 AS review_score, round(avg_rating / 5 * 100, 2) AS satisfaction_score, revisit_score, payment_score, round(least(greatest(1 - cancellation_rate, 0), 1) * 100, 2) AS stability_score FROM ranked",
    "m9_weighted_average": with_views(BOOKINGS, _CLASS) + "SELECT venue, round(sum(rating * reservation_records) FILTER (WHERE rating IS NOT NULL AND reservation_records > 0) / sum(reservation_records) FILTER (WHERE rating IS NOT NULL AND reservation_records > 0), 6) AS rating FROM cl GROUP BY venue",
    "m10_entity_rollup": with_views(BOOKINGS, _CLASS) + "SELECT venue, count(DISTINCT class_title) AS member_count, CAST(sum(reservation_count) AS BIGINT) AS reservation_count, CAST(sum(cancellation_count) AS BIGINT) AS cancellation_count, CAST(sum(reservation_count) - sum(cancellation_count) AS BIGINT) AS net_count, round(sum(rating * review_count) FILTER (WHERE rating IS NOT NULL AND review_count > 0) / sum(review_count) FILTER (WHERE rating IS NOT NULL AND review_count > 0), 6) AS rating, round(sum(cancellation_count)::DOUBLE / sum(reservation_count + cancellation_count), 6) AS cancellation_rate FROM cl GROUP BY venue",
    "m11_alias_rollup": with_views(BOOKINGS, _CLASS) + "SELECT CASE WHEN venue IN ('Brand#1', 'Brand#2') THEN 'First' WHEN venue = 'Brand#11' THEN 'Eleven' ELSE venue END AS entity, string_agg(DISTINCT venue, ', ' ORDER BY venue) AS source_keys, CAST(sum(reservation_count) AS BIGINT) AS reservation_count, CAST(sum(review_count) AS BIGINT) AS review_count, round(sum(rating * reservation_count) FILTER (WHERE rating IS NOT NULL AND reservation_count > 0) / sum(reservation_count) FILTER (WHERE rating IS NOT NULL AND reservation_count > 0), 6) AS rating FROM cl GROUP BY 1",
    "m12_value_counts": "SELECT CASE WHEN event_type = 'click' THEN 'missing' ELSE event_type END AS value, count(*) AS rows FROM events GROUP BY 1",
    "m13_top_n": with_views(*_VENUE_VIEWS, _SCORES) + "SELECT venue, reservation_score, payment_score FROM ranked ORDER BY reservation_score DESC NULLS LAST, payment_score DESC NULLS LAST, venue LIMIT 10",
    "m14_overall_profile": with_views(*_VENUE_VIEWS) + "SELECT count(*) AS entities, CAST(sum(reservation_count) AS BIGINT) AS reserved, CAST(sum(cancellation_count) AS BIGINT) AS cancelled, CAST(sum(review_count) AS BIGINT) AS reviews, count(*) FILTER (WHERE review_count = 0) AS without_review_count, round(avg(avg_rating), 6) AS mean_avg_rating, count(*) FILTER (WHERE cancellation_count > 0) AS cancelled_at_entities, count(*) FILTER (WHERE avg_rating >= 4) AS rated_well_entities, count(*) FILTER (WHERE avg_rating IS NULL) AS unrated_entities FROM rated",
    "c1_capacity_by_key": with_views(BOOKINGS, _SESSIONS, REVIEWS) + "SELECT venue, coalesce((SELECT count(*) FROM reviews r WHERE r.venue = x.venue), 0) AS review_count, count(*) AS sessions, CAST(sum(reserved) AS BIGINT) AS reserved_total, CAST(sum(capacity) AS BIGINT) AS capacity_total, avg(capacity) AS capacity_mean, min(capacity) AS capacity_min, max(capacity) AS capacity_max, round(avg(f), 6) AS fill_mean, round(median(f), 6) AS fill_median, count(*) FILTER (WHERE f >= 1) AS sold_out, count(*) FILTER (WHERE f >= 0.8) AS high, count(*) FILTER (WHERE f < 0.5) AS low, count(*) FILTER (WHERE reserved = 0) AS empty, min(day) AS first_day, max(day) AS last_day, round(sum(reserved)::DOUBLE / sum(capacity), 6) AS fill_weighted, round(count(*) FILTER (WHERE f >= 1)::DOUBLE / count(*), 6) AS sold_out_share, round(count(*) FILTER (WHERE f >= 0.8)::DOUBLE / count(*), 6) AS high_share, round(count(*) FILTER (WHERE f < 0.5)::DOUBLE / count(*), 6) AS low_share FROM (SELECT *, reserved::DOUBLE / nullif(capacity, 0) AS f FROM sessions) x GROUP BY venue",
    "c2_segment_capacity": with_views(BOOKINGS, _SESSIONS, _SEG) + "SELECT p_partkey, segment FROM seg",
    "c3_capacity_rollup": with_views(BOOKINGS, _SESSIONS, _SEG) + "SELECT * FROM (SELECT DISTINCT p_brand AS venue FROM part) LEFT JOIN (SELECT venue, count(*) AS capacity_keys, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(reserved_total) AS BIGINT) AS reserved_total, CAST(sum(capacity_total) AS BIGINT) AS capacity_total, count(*) FILTER (WHERE segment = 'expand_or_repeat_candidate') AS expand_count, count(*) FILTER (WHERE segment = 'message_or_schedule_review') AS review_count, count(*) FILTER (WHERE segment = 'demand_development_candidate') AS develop_count, round(sum(reserved_total)::DOUBLE / sum(capacity_total), 6) AS fill_weighted FROM seg WHERE sessions IS NOT NULL AND p_partkey % 5 <> 0 GROUP BY venue) USING (venue)",
    "c4_daily_fill": with_views(BOOKINGS, _SESSIONS) + "SELECT day, count(*) AS sessions, CAST(sum(reserved) AS BIGINT) AS reserved, CAST(sum(capacity) AS BIGINT) AS capacity, round(sum(reserved)::DOUBLE / sum(capacity), 6) AS fill_rate FROM sessions GROUP BY day",
    "p1_class_metadata": with_views(_META) + "SELECT * FROM meta",
    "p2_attribute_owner": with_views(*_OWN) + "SELECT owner, owner_basis, count(*) AS rows, CAST(sum(people) AS BIGINT) AS people FROM owned GROUP BY ALL",
    "p3_participation": with_views(*_OWN) + "SELECT month, owner, venue, class_key, method, CAST(sum(people) AS BIGINT) AS participants FROM owned WHERE kind = 'reservation' GROUP BY ALL",
    "p4_cancellation_history": with_views(*_OWN) + "SELECT month, class_key, CAST(sum(people) AS BIGINT) AS cancelled_history FROM owned WHERE kind = 'cancellation' GROUP BY ALL",
    "p5_band_lookup": with_views(BOOKINGS) + f"SELECT *, {_BAND.format(x='used')} AS band, {_RATE.format(x='used', a=0.55, b=0.65, c=0.75)}::DOUBLE AS band_rate FROM (SELECT person, month, CAST(sum(people) AS BIGINT) AS used FROM bookings WHERE kind = 'reservation' AND method = 'pass' GROUP BY ALL)",
    "p6_weighted_rate": with_views(*_OWN, _USAGE, _WRATE) + "SELECT * FROM wrate",
    "p7_band_breakdown": with_views(*_OWN, _USAGE) + f"SELECT month, owner, venue, class_key, string_agg(b || ':' || CAST(n AS VARCHAR), '; ' ORDER BY b || ':' || CAST(n AS VARCHAR)) AS breakdown FROM (SELECT month, owner, venue, class_key, {_BAND.format(x='month_used')} AS b, CAST(sum(used) AS BIGINT) AS n FROM usage GROUP BY ALL) GROUP BY month, owner, venue, class_key",
    "p8_merge_breakdowns": with_views(*_OWN, _USAGE) + f"SELECT month, owner, string_agg(b || ':' || CAST(n AS VARCHAR), '; ' ORDER BY CASE b WHEN '1-9' THEN 0 WHEN '10-99' THEN 1 ELSE 2 END) AS breakdown FROM (SELECT month, owner, {_BAND.format(x='month_used')} AS b, CAST(sum(used) AS BIGINT) AS n FROM usage GROUP BY ALL) GROUP BY month, owner",
    "p9_pivot_methods": with_views(*_OWN) + "SELECT month, owner, CAST(coalesce(sum(people) FILTER (WHERE method = 'pass'), 0) AS BIGINT) AS pass_people, CAST(coalesce(sum(people) FILTER (WHERE method = 'one_time'), 0) AS BIGINT) AS one_time_people, CAST(coalesce(sum(people) FILTER (WHERE method = 'unknown'), 0) AS BIGINT) AS unknown_people FROM owned WHERE kind = 'reservation' GROUP BY ALL",
    "p10_settlement_basis": with_views(*_OWN, _USAGE, _WRATE, _BASIS) + "SELECT * FROM basis",
    "p11_owner_month_rollup": with_views(*_OWN, _USAGE, _WRATE, _BASIS) + "SELECT month, owner, count(DISTINCT class_key) AS classes, count(DISTINCT venue) AS venues, string_agg(DISTINCT venue, ', ' ORDER BY venue) AS venue_list, CAST(sum(total_people) AS BIGINT) AS total_people, CAST(sum(pass_people) AS BIGINT) AS pass_people, CAST(sum(cancelled_history) AS BIGINT) AS cancelled_history, any_value(coalesce(rate, 0)) AS pass_rate, any_value(coalesce(breakdown, '')) AS breakdown FROM basis LEFT JOIN (SELECT month, owner, round(sum(n * c)::DOUBLE / (sum(n) * 100), 4) AS rate, string_agg(b || ':' || CAST(n AS VARCHAR), '; ' ORDER BY c DESC) AS breakdown FROM (" + f"SELECT month, owner, {_BAND.format(x='month_used')} AS b, {_RATE.format(x='month_used', a=55, b=65, c=75)} AS c, CAST(sum(used) AS BIGINT) AS n FROM usage GROUP BY ALL" + ") GROUP BY month, owner) USING (month, owner) GROUP BY month, owner",
    "p12_package_inference": with_views(BOOKINGS) + "SELECT CASE WHEN used >= 201 THEN 'large' WHEN used >= 51 THEN 'medium' WHEN used >= 1 THEN 'small' ELSE '0' END AS package, count(*) AS persons, CAST(sum(used) AS BIGINT) AS used, CAST(min(used) AS BIGINT) AS least, CAST(max(used) AS BIGINT) AS most FROM (SELECT person, sum(people) AS used FROM bookings WHERE kind = 'reservation' AND method = 'pass' GROUP BY person) GROUP BY 1",
}
