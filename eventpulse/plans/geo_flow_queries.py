"""Queries of places, schedules, movement and de-identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventpulse.functions.numbers import padded, rounded

from eventpulse.functions.geo import haversine, walk_minutes
from eventpulse.functions.text import mask_contacts
from eventpulse.operators import deident as D
from eventpulse.operators import flows as L
from eventpulse.operators import geo as G

from .tables import table, with_views


def _nodes(spark, sf_dir):
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), (30.0 + (key * 7) % 25).alias("lat"), (100.0 + (key * 3) % 50).alias("lon"), key.alias("weight"))


def _places(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("key"), (30.0 + (k * 7 % 251) / 10).alias("lat"), (100.0 + (k * 3 % 499) / 10).alias("lon"), (k % 40).alias("weight"))


def _network(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_name").alias("origin"), F.concat(F.lit("NATION_"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("destination"), (F.col("n_nationkey") * 1000.0 + 500).alias("length_m"))


def _points(spark, sf_dir, name="supplier", key="s_suppkey"):
    k = F.col(key)
    lat = F.when(k % 17 == 0, None).otherwise(30.0 + (k * 13 % 250) / 10)
    return table(spark, sf_dir, name).select(k.alias("point"), lat.alias("lat"), (100.0 + (k * 17 % 480) / 10).alias("lon"), (k % 5 == 0).alias("needs_review"))


def _matrix(spark, sf_dir):
    return G.distance_matrix(_nodes(spark, sf_dir), _network(spark, sf_dir))


def g1_haversine(spark, sf_dir):
    p = _points(spark, sf_dir)
    return p.select("point", rounded(haversine(F.col("lat"), F.col("lon"), F.lit(37.5), F.lit(127.0)), 4).alias("km"))


def g2_activity_center(spark, sf_dir):
    out = G.activity_center(_places(spark, sf_dir), "weight")
    return out.select("key", rounded("center_lat", 6).alias("center_lat"), rounded("center_lon", 6).alias("center_lon"), "center_km")


def g3_location_nodes(spark, sf_dir):
    return G.location_nodes(_places(spark, sf_dir), "key").select("node_id", "key", "lat", "lon")


def _place_matrix(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    ahead = s.select((F.col("s_suppkey") - 1).alias("k"), F.col("s_name").alias("destination"))
    network = s.join(ahead, F.col("s_suppkey") == F.col("k")).select(F.col("s_name").alias("origin"), "destination", (F.col("s_suppkey") * 10.0 + 500).alias("length_m"))
    return G.distance_matrix(_places(spark, sf_dir), network)


def g4_distance_matrix(spark, sf_dir):
    return _place_matrix(spark, sf_dir)


def g5_walk_minutes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", walk_minutes(F.floor("o_totalprice").cast("double")).alias("minutes"))


def g6_nearest_node(spark, sf_dir):
    return G.nearest_node(_points(spark, sf_dir, "customer", "c_custkey"), _places(spark, sf_dir))


def g7_geo_coverage(spark, sf_dir):
    return G.geo_coverage(G.nearest_node(_points(spark, sf_dir, "customer", "c_custkey"), _places(spark, sf_dir)), 300.0)


def g8_distance_extremes(spark, sf_dir):
    return G.distance_extremes(_place_matrix(spark, sf_dir), 5)


def g9_bounding_box(spark, sf_dir):
    return G.bounding_box(_points(spark, sf_dir))


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    start = F.when(F.col("event_id") % 97 == 0, None).otherwise(F.col("ts"))
    end = F.timestamp_micros(F.unix_micros("ts") + rounded(F.col("value") * 60_000_000).cast("long"))
    return e.select(
        "event_id", F.col("user_id").alias("person"), F.concat(F.lit("Class "), "event_type").alias("title"), F.when(F.col("event_type") == "error", "cancellation").otherwise("reservation").alias("what"),
        start.alias("start_at"), F.when(F.col("event_id") % 97 == 0, None).otherwise(end).alias("end_at"), F.concat(F.lit("NATION_"), (F.col("event_id") % 25).cast("string")).alias("place"),
        F.when(F.col("event_id") % 10 == 0, None).otherwise((F.col("event_id") % 4 + 1).cast("string")).alias("people_text"), (F.col("event_id") % 97 == 0).alias("needs_review"),
    )


def _enriched(spark, sf_dir):
    return L.enrich_bookings(_events(spark, sf_dir), "title", "people_text", "x").withColumn("kind", F.col("what"))


def f1_enrich_bookings(spark, sf_dir):
    return _enriched(spark, sf_dir).select("event_id", "kind", "class_key", "people", "session_key")


def _schedule(spark, sf_dir):
    hourly = _enriched(spark, sf_dir).withColumn("session_key", F.concat_ws("_", "class_key", F.coalesce(F.date_format("start_at", "yyyyMMdd'T'HH"), F.lit("unparsed"))))
    return L.session_schedule(hourly, ["title", "place", "start_at"], "event_id")


def f2_session_schedule(spark, sf_dir):
    return _schedule(spark, sf_dir).drop("start_at")


def _itinerary(spark, sf_dir):
    return L.itinerary(_enriched(spark, sf_dir).filter("kind = 'reservation'"), "person", ["start_at", "end_at", "title", "event_id"])


def f3_itinerary(spark, sf_dir):
    return _itinerary(spark, sf_dir).select("person", "itinerary_order", "event_id", "place")


def _moves(spark, sf_dir):
    return L.transitions(_itinerary(spark, sf_dir), _matrix(spark, sf_dir), "person")


def f4_transitions(spark, sf_dir):
    return _moves(spark, sf_dir).select("person", "itinerary_order", "origin", "destination", "gap_minutes", "walk_minutes", "scope", "same_location")


def f5_feasibility(spark, sf_dir):
    return _moves(spark, sf_dir).groupBy("scope", "status").agg(F.count("*").alias("moves"))


def _edges(spark, sf_dir):
    return L.aggregate_transitions(_moves(spark, sf_dir), ["origin", "destination", "status"])


def f6_aggregate_transitions(spark, sf_dir):
    return _edges(spark, sf_dir)


def f7_node_mobility(spark, sf_dir):
    return L.node_mobility(_nodes(spark, sf_dir), _edges(spark, sf_dir))


def f8_review_lists(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("place_in_list", F.when(F.col("doc_id") % 6 == 0, None).otherwise(F.col("n_chars")))
    return L.review_lists(docs, "source", "place_in_list", mask_contacts("text"), 5)


def f9_status_totals(spark, sf_dir):
    return L.status_totals(_edges(spark, sf_dir))


def f9_top_pairs(spark, sf_dir):
    return L.top_pairs(_edges(spark, sf_dir), 20)


def f9_top_hubs(spark, sf_dir):
    return L.top_hubs(L.node_mobility(_nodes(spark, sf_dir), _edges(spark, sf_dir)), 10)


def f10_timestamped_points(spark, sf_dir):
    return L.timestamped_points(_schedule(spark, sf_dir), _nodes(spark, sf_dir))


def f10_timestamped_features(spark, sf_dir):
    return L.timestamped_features(_schedule(spark, sf_dir)).select("session_key", "radius", "band")


def f11_session_positions(spark, sf_dir):
    return L.session_positions(_schedule(spark, sf_dir)).select("session_key", "place", "position", "place_sessions", "fraction")


def f11_space_time_profile(spark, sf_dir):
    return L.space_time_profile(_schedule(spark, sf_dir))


def f12_top_flows(spark, sf_dir):
    return L.top_flows(_edges(spark, sf_dir), _nodes(spark, sf_dir), 80).select("origin", "destination", "status", "transition_count")


def _people(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    phone = F.format_string("010-%04d-%04d", (F.col("c_custkey") * 37 % 10000).cast("int"), (F.col("c_custkey") % 10000).cast("int"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("record"), F.col("c_name").alias("name"), phone.alias("phone"), "c_mktsegment")


def _ids(spark, sf_dir):
    people = _people(spark, sf_dir)
    old = people.filter("record % 1000 = 7").groupBy("name").agg(F.min("record").alias("record")).select("record", F.concat(F.lit("P"), padded(F.col("record"), 6)).alias("person_id"))
    return D.assign_stable_ids(people, old, ["name", "phone"], "record", "record")


def d1_stable_ids(spark, sf_dir):
    return _ids(spark, sf_dir).select("record", "name", "person_id")


def _masked(spark, sf_dir):
    short = F.concat_ws(" ", "name", F.lit("called from"), "phone")
    lines = F.concat_ws("\n", F.lit("reservation"), "c_mktsegment", F.col("record").cast("string"), "name", "phone", F.lit("2 people"))
    raw = _ids(spark, sf_dir).withColumn("raw", F.when(F.col("record") % 3 == 0, short).otherwise(lines))
    return D.mask_record(raw, "raw", "name", "phone", "person_id")


def d2_mask_record(spark, sf_dir):
    return _masked(spark, sf_dir).select("record", "name", "phone", "raw")


def d3_deident_audit(spark, sf_dir):
    mixed = _masked(spark, sf_dir).unionByName(_ids(spark, sf_dir).filter("record % 100 = 0").withColumn("raw", F.concat_ws(" ", "phone", F.lit("a.b@example.org"))))
    return D.deident_audit(mixed, "person_id", r"^P\d{6}$", "phone", "raw")


def d4_ordinal_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("group_name", F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.concat_ws("-", "lang", "source")))
    return D.ordinal_ids(docs, ["group_name"], "G_", "group_id").select("doc_id", "group_id")


def d5_public_projection(spark, sf_dir):
    return D.public_projection(table(spark, sf_dir, "customer"), {"c_custkey": "customer_id", "c_mktsegment": "segment"}, {"identity_handling": "name removed", "balance_handling": "not published"})


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] in "gfd" and n[1:2].isdigit()}


def _hav(a, b, c, d):
    n, e = f"(radians({c} - {a}) / 2)", f"(radians({d} - {b}) / 2)"
    h = f"(pow(sin({n}), 2.0) + cos(radians({a})) * cos(radians({c})) * pow(sin({e}), 2.0))"
    return f"(atan2(sqrt({h}), sqrt(1.0::DOUBLE - {h})) * 12742.0176::DOUBLE)"


_N = "nodes AS (SELECT n_name AS key, CAST(30 + (n_nationkey * 7) % 25 AS DOUBLE) AS lat, CAST(100 + (n_nationkey * 3) % 50 AS DOUBLE) AS lon, n_nationkey AS weight FROM nation)"


_PL = "nodes AS (SELECT s_name AS key, 30.0::DOUBLE + (s_suppkey * 7 % 251)::DOUBLE / 10 AS lat, 100.0::DOUBLE + (s_suppkey * 3 % 499)::DOUBLE / 10 AS lon, s_suppkey % 40 AS weight FROM supplier)"


def _pts(name, key):
    return f"points AS (SELECT {key} AS point, CASE WHEN {key} % 17 = 0 THEN NULL ELSE 30.0::DOUBLE + ({key} * 13 % 250)::DOUBLE / 10 END AS lat, 100.0::DOUBLE + ({key} * 17 % 480)::DOUBLE / 10 AS lon, {key} % 5 = 0 AS needs_review FROM {name})"


_LINKS = {
    "_N": "SELECT n_name AS origin, 'NATION_' || CAST((n_nationkey + 1) % 25 AS VARCHAR) AS destination, CAST(n_nationkey * 1000 + 500 AS DOUBLE) AS length_m FROM nation",
    "_PL": "SELECT s.s_name AS origin, d.s_name AS destination, CAST(s.s_suppkey * 10 + 500 AS DOUBLE) AS length_m FROM supplier s JOIN supplier d ON d.s_suppkey = s.s_suppkey + 1",
}
_M = f"""mat AS (SELECT *, round(walk_m / 80, 2) AS walk_minutes FROM (SELECT a.origin, a.destination, same_location, straight_m, coalesce(length_m, round(straight_m * 1.3::DOUBLE, 2)) AS walk_m,
  CASE WHEN length_m IS NULL THEN 'straight_detour' ELSE 'network' END AS walk_method, round(straight_m * 1.3::DOUBLE / 80, 2) AS fallback_minutes FROM (SELECT x.key AS origin, y.key AS destination, x.key = y.key AS same_location,
  round(CASE WHEN x.key = y.key THEN 0.0::DOUBLE ELSE {_hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} * 1000 END, 2) AS straight_m FROM nodes x CROSS JOIN nodes y) a
  LEFT JOIN ({_LINKS['_N']}) USING (origin, destination)))"""
_PM = _M.replace(_LINKS["_N"], _LINKS["_PL"])
_NEAR = f"""near AS (SELECT p.*, n.nearest, round(n.km, 3) AS nearest_km FROM points p LEFT JOIN (SELECT point, arg_min(key, (km, key)) AS nearest, min(km) AS km FROM (SELECT point, key, round({_hav('p.lat', 'p.lon', 'n.lat', 'n.lon')}, 6) AS km FROM points p CROSS JOIN nodes n WHERE p.lat IS NOT NULL) GROUP BY point) n USING (point))"""
_E = """ev AS (SELECT *, k || '_' || CASE WHEN s IS NULL THEN 'unparsed' ELSE strftime(s, '%Y%m%dT%H%M') END AS session_key, k || '_' || CASE WHEN s IS NULL THEN 'unparsed' ELSE strftime(s, '%Y%m%dT%H') END AS hour_key FROM (
  SELECT event_id, user_id AS person, 'Class ' || event_type AS title, 'class' || event_type AS k, CASE WHEN event_type = 'error' THEN 'cancellation' ELSE 'reservation' END AS kind, CASE WHEN event_id % 97 <> 0 THEN ts END AS s,
  CASE WHEN event_id % 97 <> 0 THEN make_timestamp(epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT)) END AS e, 'NATION_' || CAST(event_id % 25 AS VARCHAR) AS place, CASE WHEN event_id % 10 = 0 THEN 1 ELSE event_id % 4 + 1 END AS people, event_id % 97 = 0 AS needs_review FROM events))"""
_S = """sched AS (SELECT hour_key AS session_key, arg_min(title, event_id) AS title, arg_min(place, event_id) AS place, arg_min(s, event_id) AS start_at, bool_or(needs_review) AS needs_review, count(*) FILTER (WHERE kind = 'reservation') AS reservation_rows,
  CAST(coalesce(sum(people) FILTER (WHERE kind = 'reservation'), 0) AS BIGINT) AS reserved_people, count(DISTINCT person) FILTER (WHERE kind = 'reservation') AS participants, count(*) FILTER (WHERE kind = 'cancellation') AS cancellation_rows,
  CAST(coalesce(sum(people) FILTER (WHERE kind = 'cancellation'), 0) AS BIGINT) AS cancelled_people FROM ev GROUP BY hour_key)"""
_I = "itin AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY s NULLS LAST, e NULLS LAST, title, event_id) AS itinerary_order FROM ev WHERE kind = 'reservation')"
_MV = """mv AS (SELECT * REPLACE (CASE WHEN gap_minutes = 0 THEN 0 ELSE gap_minutes END AS gap_minutes), CASE WHEN gap_minutes IS NULL OR walk_minutes IS NULL THEN 'unknown' WHEN gap_minutes < 0 THEN 'overlap' WHEN gap_minutes >= walk_minutes + 10 THEN 'comfortable' WHEN gap_minutes >= walk_minutes THEN 'tight' ELSE 'difficult' END AS status FROM (
  SELECT person, itinerary_order, p.origin, p.destination, round((epoch_us(ns) - epoch_us(e))::DOUBLE / 60000000, 2) AS gap_minutes, walk_minutes, CASE WHEN s IS NULL OR ns IS NULL THEN 'unknown_date' WHEN CAST(s AS DATE) = CAST(ns AS DATE) THEN 'same_day' ELSE 'cross_day' END AS scope, p.origin = p.destination AS same_location
  FROM (SELECT person, itinerary_order, place AS origin, s, e, lead(place) OVER w AS destination, lead(s) OVER w AS ns FROM itin WINDOW w AS (PARTITION BY person ORDER BY itinerary_order)) p LEFT JOIN mat m ON p.origin = m.origin AND p.destination = m.destination WHERE p.destination IS NOT NULL))"""
_ED = """edges AS (SELECT origin, destination, status, count(*) AS transition_count, round(sum(CAST(round(gap_minutes * 100) AS BIGINT))::DOUBLE / count(gap_minutes) / 100, 2) AS avg_gap, min(gap_minutes) AS min_gap, max(gap_minutes) AS max_gap,
  round(sum(CAST(round(walk_minutes * 100) AS BIGINT))::DOUBLE / count(walk_minutes) / 100, 2) AS avg_walk FROM mv WHERE scope = 'same_day' GROUP BY origin, destination, status)"""
_MOVES = (_N, _M, _E, _I, _MV)
_PEOPLE = "people AS (SELECT o_orderkey AS record, c_name AS name, printf('010-%04d-%04d', c_custkey * 37 % 10000, c_custkey % 10000) AS phone, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)"
_IDS = """ids AS (SELECT p.*, coalesce(k.pid, n.pid) AS person_id FROM people p LEFT JOIN (SELECT name, 'P' || lpad(CAST(min(record) AS VARCHAR), 6, '0') AS pid FROM people WHERE record % 1000 = 7 GROUP BY name) k USING (name)
  LEFT JOIN (SELECT name, 'P' || lpad(CAST((SELECT max(r) FROM (SELECT min(record) AS r FROM people WHERE record % 1000 = 7 GROUP BY name)) + row_number() OVER (ORDER BY min(record), name) AS VARCHAR), 6, '0') AS pid FROM people WHERE name NOT IN (SELECT name FROM people WHERE record % 1000 = 7) GROUP BY name) n USING (name))"""
_MASK = r"""masked AS (SELECT record, person_id AS name, person_id, '[phone]' AS phone, CASE WHEN record % 3 = 0 THEN person_id || ' called from [phone]' ELSE 'reservation' || chr(10) || c_mktsegment || chr(10) || CAST(record AS VARCHAR) || chr(10) || person_id || chr(10) || '[phone]' || chr(10) || '2 people' END AS raw FROM ids)"""
SQL = {
    "g1_haversine": with_views(_pts("supplier", "s_suppkey")) + f"SELECT point, round({_hav('lat', 'lon', '37.5', '127.0')}, 4) AS km FROM points",
    "g2_activity_center": with_views(_PL) + f"SELECT key, round(clat, 6) AS center_lat, round(clon, 6) AS center_lon, round({_hav('clat', 'clon', 'lat', 'lon')}, 3) AS center_km FROM nodes CROSS JOIN (SELECT sum(lat * weight) / sum(weight) AS clat, sum(lon * weight) / sum(weight) AS clon FROM nodes)",
    "g3_location_nodes": with_views(_PL) + "SELECT 'LOC_' || lpad(CAST(row_number() OVER (ORDER BY key) AS VARCHAR), 4, '0') AS node_id, key, lat, lon FROM nodes",
    "g4_distance_matrix": with_views(_PL, _PM) + "SELECT * FROM mat",
    "g5_walk_minutes": "SELECT o_orderkey, round(floor(o_totalprice) / 80, 2) AS minutes FROM orders",
    "g6_nearest_node": with_views(_PL, _pts("customer", "c_custkey"), _NEAR) + "SELECT * FROM near",
    "g7_geo_coverage": with_views(_PL, _pts("customer", "c_custkey"), _NEAR) + "SELECT count(*) AS rows, count(lat) AS with_coordinates, count(*) FILTER (WHERE needs_review) AS needs_review, count(*) FILTER (WHERE nearest_km <= 300) AS near_node FROM near",
    "g8_distance_extremes": with_views(_PL, _PM) + ", o AS (SELECT * FROM mat WHERE NOT same_location), s AS (SELECT round(sum(CAST(round(walk_minutes * 100) AS BIGINT))::DOUBLE / count(walk_minutes) / 100, 4) AS mean_walk, max(walk_minutes) AS longest_walk FROM o) SELECT side, origin, destination, straight_m, mean_walk, longest_walk FROM ((SELECT 'nearest' AS side, * FROM o ORDER BY straight_m, origin, destination LIMIT 5) UNION ALL (SELECT 'farthest', * FROM o ORDER BY straight_m DESC, origin, destination LIMIT 5)) CROSS JOIN s",
    "g9_bounding_box": with_views(_pts("supplier", "s_suppkey")) + "SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, round(avg(lat), 6) AS mean_lat, round(avg(lon), 6) AS mean_lon FROM points",
    "f1_enrich_bookings": with_views(_E) + "SELECT event_id, kind, k AS class_key, CAST(people AS BIGINT) AS people, session_key FROM ev",
    "f2_session_schedule": with_views(_E, _S) + "SELECT * EXCLUDE (start_at) FROM sched",
    "f3_itinerary": with_views(_E, _I) + "SELECT person, itinerary_order, event_id, place FROM itin",
    "f4_transitions": with_views(*_MOVES) + "SELECT * EXCLUDE (status) FROM mv",
    "f5_feasibility": with_views(*_MOVES) + "SELECT scope, status, count(*) AS moves FROM mv GROUP BY ALL",
    "f6_aggregate_transitions": with_views(*_MOVES, _ED) + "SELECT * FROM edges",
    "f7_node_mobility": with_views(*_MOVES, _ED) + ", sp AS (SELECT origin AS node, CASE WHEN origin = destination THEN 'self' ELSE 'out' END AS role, * FROM edges UNION ALL SELECT destination, 'in', * FROM edges WHERE origin <> destination), sums AS (SELECT node, coalesce(sum(transition_count) FILTER (WHERE role = 'out'), 0) AS o, coalesce(sum(transition_count) FILTER (WHERE role = 'in'), 0) AS i, coalesce(sum(transition_count) FILTER (WHERE role = 'self'), 0) AS s, sum(transition_count) AS moves, "
    + ", ".join(f"coalesce(sum(transition_count) FILTER (WHERE status = '{x}'), 0) AS {x}_moves" for x in L.STATUSES)
    + ", round(sum(CAST(round(avg_gap * 100) AS BIGINT) * transition_count)::DOUBLE / sum(transition_count) FILTER (WHERE avg_gap IS NOT NULL) / 100, 2) AS mean_gap FROM sp GROUP BY node) SELECT key AS node, CAST(coalesce(o, 0) AS BIGINT) AS cross_out, CAST(coalesce(i, 0) AS BIGINT) AS cross_in, CAST(coalesce(s, 0) AS BIGINT) AS self_moves, CAST(coalesce(moves, 0) AS BIGINT) AS moves, "
    + ", ".join(f"CAST(coalesce({x}_moves, 0) AS BIGINT) AS {x}_moves" for x in L.STATUSES)
    + ", coalesce(mean_gap, 0) AS mean_gap, CAST(coalesce(o + s, 0) AS BIGINT) AS outgoing, CAST(coalesce(i + s, 0) AS BIGINT) AS incoming, CAST(coalesce(o + i + 0.5 * s, 0) AS DOUBLE) AS hub_score, coalesce(round(comfortable_moves::DOUBLE / nullif(moves, 0), 4), 0) AS comfortable_share FROM nodes LEFT JOIN sums ON key = node",
    "f8_review_lists": r"SELECT source, count(*) AS reviews, string_agg(t, ' | ' ORDER BY n) FILTER (WHERE n <= 5) AS texts FROM (SELECT source, t, row_number() OVER (PARTITION BY source ORDER BY p NULLS LAST, t) AS n FROM (SELECT source, CASE WHEN doc_id % 6 <> 0 THEN n_chars END AS p, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '\+?\d{2,3}[-. ]\d{3,4}[-. ]\d{4}', '[phone]', 'g') AS t FROM documents) WHERE trim(t) <> '') GROUP BY source",
    "f9_status_totals": with_views(*_MOVES, _ED) + "SELECT status, CAST(sum(transition_count) AS BIGINT) AS transitions, count(*) AS pairs FROM edges GROUP BY status",
    "f10_timestamped_features": with_views(_E, _S) + "SELECT session_key, CAST(greatest(4, least(24, 4 + reserved_people * 0.5)) AS DOUBLE) AS radius, CASE WHEN reserved_people >= 200 THEN 'high' WHEN reserved_people >= 50 THEN 'middle' WHEN reserved_people > 0 THEN 'low' ELSE 'none' END AS band FROM sched",
    "f11_space_time_profile": with_views(_E, _S) + ", p AS (SELECT *, coalesce((epoch_us(start_at) - min(epoch_us(start_at)) OVER ())::DOUBLE / (max(epoch_us(start_at)) OVER () - min(epoch_us(start_at)) OVER ()), 0) AS f, row_number() OVER (PARTITION BY place ORDER BY reserved_people DESC, session_key) AS n FROM sched) SELECT place, count(*) AS sessions, CAST(sum(reserved_people) AS BIGINT) AS people, round(min(f), 6) AS first_fraction, round(max(f), 6) AS last_fraction, string_agg(session_key, ',' ORDER BY n) FILTER (WHERE n <= 6) AS top_sessions FROM p GROUP BY place",
    "f9_top_pairs": with_views(*_MOVES, _ED) + "SELECT origin, destination, CAST(sum(transition_count) AS BIGINT) AS transitions FROM edges GROUP BY ALL ORDER BY transitions DESC, origin, destination LIMIT 20",
    "f9_top_hubs": with_views(*_MOVES, _ED) + ", ends AS (SELECT origin AS node, transition_count AS n, CASE WHEN origin = destination THEN 0.5 ELSE 1 END AS w FROM edges UNION ALL SELECT destination, transition_count, 1 FROM edges WHERE origin <> destination) SELECT key AS node, CAST(coalesce(sum(n * w), 0) AS DOUBLE) AS hub_score, CAST(coalesce(sum(n), 0) AS BIGINT) AS moves FROM nodes LEFT JOIN ends ON key = node GROUP BY key ORDER BY hub_score DESC, node LIMIT 10",
    "f10_timestamped_points": with_views(_N, _E, _S) + """SELECT session_key, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || CAST(lon AS VARCHAR) || ',' || CAST(lat AS VARCHAR) || ']},"properties":{"session_key":"' || session_key || '","place":"' || place || '","start_at":' || coalesce('"' || strftime(start_at, '%Y-%m-%dT%H:%M:%S') || '"', 'null')
  || ',"radius":' || CAST(CAST(greatest(4, least(24, 4 + reserved_people * 0.5)) AS DOUBLE) AS VARCHAR) || ',"band":"' || CASE WHEN reserved_people >= 200 THEN 'high' WHEN reserved_people >= 50 THEN 'middle' WHEN reserved_people > 0 THEN 'low' ELSE 'none' END || '","reserved_people":' || CAST(reserved_people AS VARCHAR) || '}}' AS feature FROM sched JOIN nodes ON place = key""",
    "f11_session_positions": with_views(_E, _S) + "SELECT session_key, place, row_number() OVER (PARTITION BY place ORDER BY start_at NULLS LAST, session_key) AS position, count(*) OVER (PARTITION BY place) AS place_sessions, round(coalesce((epoch_us(start_at) - min(epoch_us(start_at)) OVER ())::DOUBLE / (max(epoch_us(start_at)) OVER () - min(epoch_us(start_at)) OVER ()), 0), 6) AS fraction FROM sched",
    "f12_top_flows": with_views(*_MOVES, _ED) + "SELECT origin, destination, status, transition_count FROM edges WHERE origin <> destination AND origin IN (SELECT key FROM nodes) AND destination IN (SELECT key FROM nodes) ORDER BY transition_count DESC, origin, destination, status LIMIT 80",
    "d1_stable_ids": with_views(_PEOPLE, _IDS) + "SELECT record, name, person_id FROM ids",
    "d2_mask_record": with_views(_PEOPLE, _IDS, _MASK) + "SELECT record, name, phone, raw FROM masked",
    "d3_deident_audit": with_views(_PEOPLE, _IDS) + "SELECT count(*) + count(*) FILTER (WHERE record % 100 = 0) AS rows, CAST(0 AS BIGINT) AS bad_ids, count(*) FILTER (WHERE record % 100 = 0) AS unmasked_phones, count(*) FILTER (WHERE record % 100 = 0) AS phone_patterns, count(*) FILTER (WHERE record % 100 = 0) AS email_patterns FROM ids",
    "d4_ordinal_ids": "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'G_' || lpad(CAST(dense_rank() OVER (PARTITION BY doc_id % 9 = 0 ORDER BY lang || '-' || source) AS VARCHAR), 4, '0') END AS group_id FROM documents",
    "d5_public_projection": "SELECT c_custkey AS customer_id, c_mktsegment AS segment, 'name removed' AS identity_handling, 'not published' AS balance_handling FROM customer",
}
