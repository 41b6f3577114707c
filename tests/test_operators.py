"""Rules, ties and null handling of single operators on a few rows."""

import gzip
import hashlib
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from eventpulse.functions import text as X
from eventpulse.functions.geo import haversine
from eventpulse.functions.numbers import rounded
from eventpulse.operators import capacity, checking, content, deident, flows, geo, match, mentions, metrics, quality, records, settlement
from eventpulse.plans import fixed_values, geo_flow_queries, match_record_queries
from eventpulse.sources import files


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def cases():
    return [
        (X.compact_spaces(F.lit(" a \t b\n")), "a b"), (X.compact_spaces(F.lit(None)), ""), (X.normalize_text(F.lit("..Ab--C1!")), "ab c1"), (X.nfkc_key(F.lit("ＡＢ (x) 가1")), "ab가1"),
        (X.safe_int(F.lit("n -1,234 x")), -1234), (X.safe_int(F.lit("none"), 7), 7), (X.safe_float(F.lit("v 2.50")), 2.5), (X.ticket_count(F.lit("5 times"), [1, 5]), 5), (X.ticket_count(F.lit("6 times"), [1, 5]), None),
        (X.bracket_label(F.lit("[ a ] b [c]")), "a"), (X.strip_bracket(F.lit("[a] b")), "b"), (X.normalize_time(F.lit("9;05")), "09:05"), (X.normalize_time(F.lit("x")), ""),
        (X.truthy(F.lit(" YES ")), True), (X.truthy(F.lit(None)), False), (X.first_sentence(F.lit("One. Two.")), "One."), (X.ellipsize(F.lit("abcdefgh"), 6), "abc..."),
        (X.mask_contacts(F.lit("a.b@c.org 010-1234-5678")), "[email] [phone]"), (X.path_part(F.lit("/a//b/"), 1), "b"), (X.path_part(F.lit("a"), 3, "none"), "none"),
        (X.keyword_count(F.lit("aAa a"), ["aa"]), 2), (X.section_between(F.lit("x from: ab to cd"), ["from:"], ["to"]), "ab"), (X.section_between(F.lit("none"), ["from:"], ["to"]), ""),
        (X.clean_address(F.lit("Hall,1"), "Seoul", []), "Seoul Hall 1"), (X.clean_address(F.lit(""), "Seoul", []), ""), (F.date_format(X.parse_date_lenient(F.lit("2026. 2. 3")), "yyyy-MM-dd"), "2026-02-03"),
        (X.parse_date_lenient(F.lit("20261345")), None), (F.array_join(X.matched_terms(F.lit("Big Blue"), ["blue", "bigblue"]), ";"), "bigblue;blue"),
    ]


def test_functions(spark):
    columns = cases()
    found = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(columns)]).first()
    assert list(found) == [e for _, e in columns]


def test_time_range_over_midnight_and_unparsed(spark):
    df = spark.createDataFrame([("5.3 (Sun) 23:30-00:30",), ("13.40 (x) 9:00-10:00",), (None,)], "slot string")
    out = X.parse_time_range(df, "slot", 2026).orderBy(F.col("slot").desc_nulls_last())
    assert values(out, "duration_minutes", "needs_review") == [(60.0, False), (None, True), (None, True)]


def test_midrank_and_average_rank(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None), (4, 9.0)], "id int, v double")
    assert dict(values(metrics.midrank_score(df, "v", "s"), "id", "s")) == {1: 33.33, 2: 33.33, 3: None, 4: 83.33}
    assert dict(values(metrics.avgrank_scores(df, {"v": "s"}), "id", "s")) == {1: 50.0, 2: 50.0, 3: 0.0, 4: 100.0}
    assert values(metrics.midrank_score(df.filter("id = 4"), "v", "s"), "s") == [100.0]
    assert values(metrics.midrank_score(df.filter("id = 0"), "v", "s"), "s") == []


def test_minmax_of_a_constant_column(spark):
    assert values(metrics.minmax_score(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", "s"), "s") == [100.0, 100.0]


def test_outer_combine_matches_null_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, n long")
    b = spark.createDataFrame([(None, 5), ("y", 6)], "k string, m long")
    out = metrics.outer_combine([a, b], ["k"], ["n", "m"])
    assert sorted(values(out, "k", "n", "m"), key=str) == [("x", 2, 0), ("y", 0, 6), (None, 1, 5)]


def test_weighted_average_ignores_what_does_not_count(spark):
    df = spark.createDataFrame([(4.0, 1.0), (2.0, 3.0), (None, 9.0), (5.0, -1.0)], "v double, w double")
    assert df.agg(metrics.weighted_average("v", "w").alias("x")).first()["x"] == 2.5
    assert df.filter("v is null").agg(metrics.weighted_average("v", "w").alias("x")).first()["x"] is None


def test_bands_at_their_edges(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 9, 10, 99, 100)], "n long")
    table = lambda *rows: spark.createDataFrame(rows, "low long, high long, label string, rate double")
    bands = settlement.bands_of(table((100, None, "100+", 0.55), (1, 9, "1-9", 0.75), (10, 99, "10-99", 0.65)))
    with_gap = settlement.bands_of(table((1, 1, "one", None), (10, 99, "many", 1.0)))
    assert values(settlement.band_lookup(df, "n", with_gap), "band", "band_rate") == [("0", None), ("one", None), ("0", None), ("many", 1.0), ("many", 1.0), ("0", None)]
    for bad in ([(1, 9, "a", 1.0), (9, None, "b", 1.0)], [(1, None, "a", 1.0), (5, None, "b", 1.0)], [(5, 4, "a", 1.0)], [(None, 4, "a", 1.0)], [(i, i, "a", 1.0) for i in range(1001)]):
        with pytest.raises(ValueError):
            settlement.bands_of(table(*bad))
    assert values(settlement.band_lookup(df, "n", bands), "band", "band_rate") == [("0", None), ("1-9", 0.75), ("1-9", 0.75), ("10-99", 0.65), ("10-99", 0.65), ("100+", 0.55)]


def test_segments(spark):
    df = spark.createDataFrame([(None, 90.0), (0.85, 70.0), (0.49, 70.0), (0.9, None), (0.2, 1.0), (0.6, 1.0)], "fill double, s double")
    expected = ["capacity_missing", "expand_or_repeat_candidate", "message_or_schedule_review", "small_capacity_or_niche_strength", "demand_development_candidate", "steady_middle"]
    out = capacity.segment_capacity(df, "fill", ["s"], fixed_values.SEGMENTS, fixed_values.NO_SEGMENT, fixed_values.NO_FILL)
    assert values(out, "segment") == expected and out.columns == ["fill", "s", "segment"]


def test_feasibility_edges(spark):
    df = spark.createDataFrame([(None, 5.0), (-1.0, 5.0), (15.0, 5.0), (5.0, 5.0), (4.9, 5.0)], "g double, t double")
    assert values(df.select(flows.feasibility(F.col("g"), F.col("t")).alias("x")), "x") == ["unknown", "overlap", "comfortable", "tight", "difficult"]


def test_mobility_keeps_nodes_without_edges_and_counts_self_once(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    edges = spark.createDataFrame([("a", "b", "tight", 3, 10.0), ("a", "a", "comfortable", 4, 5.0)], "origin string, destination string, status string, transition_count long, avg_gap double")
    out = {r["node"]: r for r in flows.node_mobility(nodes, edges).collect()}
    assert (out["a"]["outgoing"], out["a"]["incoming"], out["a"]["hub_score"]) == (7, 4, 5.0)
    assert out["c"]["hub_score"] == 0 and sum(r["outgoing"] for r in out.values()) == sum(r["incoming"] for r in out.values())


def test_nearest_node_far_and_missing(spark):
    nodes = spark.createDataFrame([("n1", 10.0, 10.0), ("n2", -80.0, 170.0)], "key string, lat double, lon double")
    points = spark.createDataFrame([(1, 10.1, 10.1), (2, -79.0, -175.0), (3, None, 1.0)], "p int, lat double, lon double")
    assert dict(values(geo.nearest_node(points, nodes), "p", "nearest")) == {1: "n1", 2: "n2", 3: None}
    many = spark.range(10_002).select(F.col("id").cast("string").alias("key"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon"))
    matrix = geo.distance_matrix(many, spark.createDataFrame([], "origin string, destination string, length_m double"))  # above the size of a broadcast, still whole
    assert matrix.filter("origin = '10001' and destination in ('0', '10001')").count() == 2


def test_stable_ids_stay_when_rows_are_added(spark):
    old = spark.createDataFrame([(5, "P000009")], "record long, person_id string")
    rows = [("ann", 5), ("bob", 2), ("ann", 1), ("cy", 3)]
    first = dict(values(deident.assign_stable_ids(spark.createDataFrame(rows, "name string, record long"), old, ["name"], "record", "record"), "name", "person_id"))
    assert first == {"ann": "P000009", "bob": "P000010", "cy": "P000011"}
    more = dict(values(deident.assign_stable_ids(spark.createDataFrame([*rows, ("dee", 9)], "name string, record long"), old, ["name"], "record", "record"), "name", "person_id"))
    assert more == first | {"dee": "P000012"}


def test_masking_is_idempotent(spark):
    df = spark.createDataFrame([("a\nb\nc\nAnn\n010-1234-5678\nz", "Ann", "010-1234-5678", "P1")], "raw string, name string, phone string, pid string")
    once = deident.mask_record(df, "raw", "name", "phone", "pid")
    assert values(once, "raw") == ["a\nb\nc\nP1\n[phone]\nz"] == values(deident.mask_record(once, "raw", "name", "phone", "pid"), "raw")


def test_records_edges(spark):
    lines = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(["tel 1", "a", "b", "c", "d", "tel 2", "e", "tel 3"])], "file long, line_no long, line string")
    found, warned = records.anchored_records(lines, "^tel", ["l4", "l3", "l2", "l1"], ["n1"])
    assert values(found, "line_no", "l4", "n1") == [(6, "a", "e")] and sorted(values(warned, "line_no")) == [1, 8]
    items = spark.createDataFrame([(1, i, d, 1, 2) for i, d in enumerate([29, 30, 1, 31])], "file long, line_no long, day int, reserved long, capacity long")
    assert values(records.infer_month_rollover(items, 2026, 4).orderBy("line_no"), "class_date", "needs_review") == [("2026-04-29", False), ("2026-04-30", False), ("2026-05-01", False), ("2026-05-31", False)]
    done, left = records.end_marked_records(lines, "^tel (\\d)", "b")
    assert values(done.orderBy("record"), "name", "flagged", "detail") == [("", False, "1"), ("a", True, "2"), ("e", False, "3")] and values(left, "leftover_lines") == []


def test_match_statuses(spark):
    left = spark.createDataFrame([(1, "yoga flow", "v"), (2, "yoga flaw", "v"), (3, "zzz", "v"), (4, "yoga", "w")], "id int, key string, block string")
    right = spark.createDataFrame([("yoga flow", "v"), ("yoga flew", "v")], "key string, block string")
    out = match.exact_then_fuzzy(left, right, "id", "fuzzy_same_studio").orderBy("id")
    assert values(out, "match_status") == ["exact_normalized", "fuzzy_same_studio", "needs_review", "no_candidate_in_block"]


def test_token_similarity_by_plain_tables(spark):
    import random

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            row = [0] + [max(row[j + 1], row[j] + 1) if c == d else row[j + 1] for j, d in enumerate(b)]
            for j in range(1, len(row)):
                row[j] = max(row[j], row[j - 1])
        return row[-1]

    def ratio(a, b):
        return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0

    def tokens(a, b):
        x, y = set(a.split()), set(b.split())
        both = " ".join(sorted(x & y))
        first, second = f"{both} {' '.join(sorted(x - y))}".strip(), f"{both} {' '.join(sorted(y - x))}".strip()
        return max(ratio(both, first) if both else 0.0, ratio(both, second) if both else 0.0, ratio(first, second)) if x and y else 0.0

    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abc漢") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(6)))
    pairs = [(text(), text()) for _ in range(400)] + [("", ""), ("a", ""), ("b a  c", "c b"), ("x" * 64, "x" * 63 + "y"), ("ab " * 60, "ba " * 50), ("a\tb\u3000c", "c b a")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    out = df.select("i", *[match.similarity(F.col("a"), F.col("b"), m).alias(m) for m in ("token_set", "weighted")]).collect()
    for r in out:
        a, b = pairs[r.i]
        weighted = max(ratio(a, b), 0.95 * ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), 0.95 * tokens(a, b))
        assert abs(r.token_set - tokens(a, b)) < 0.0051 and abs(r.weighted - weighted) < 0.0051, (a, b)


def test_mentions_and_checks(spark):
    df = spark.createDataFrame([("blog", "u1", "Yoga Week", "", "2026-03-01"), ("blog", "u2", "", "yogaweek", "2026-01-31"), ("blog", "u3", "x", "yoga week", ""), ("blog", "u4", "x", "y", "2026-03-01")], "platform string, url string, title string, description string, published string")
    out = mentions.confirm_mentions(df, "yoga week", "2026-02-01").orderBy("url")
    assert values(out, "mention_class", "confidence") == [("confirmed", 100), ("keyword_before_period", 0), ("confirmed_without_date", 90), ("not_confirmed", 0)]
    ranged = spark.createDataFrame([(1, "a", 5.1), (2, "", 4.0), (3, "b", 0.0)], "id int, name string, rating double")
    assert values(checking.validate_ranges(ranged, "id", ["name"], {"rating": (0, 5)}), "id", "failures") == [(1, "rating:range"), (2, "name:missing")]
    gate = quality.gate_report([quality.check_unique(ranged, "r", ["id"]), quality.check_canonical(ranged, "r", "name", ["b"])])
    assert set(values(gate, "blockers", "passes", "gate_passed")) == {(1, 1, False)}


def test_theme_tie_and_none(spark):
    df = spark.createDataFrame([(2, 2), (0, 0), (1, 3)], "a_count int, b_count int")
    assert values(content.primary_theme(df, ["a", "b"]), "primary_theme") == ["a", "unclear", "b"]


def test_optional_table(spark, tmp_path):
    empty, state = files.read_optional(spark, str(tmp_path / "none"), spark.createDataFrame([], "a int").schema)
    assert state == "missing" and empty.count() == 0


def brute_nearest(points, nodes):
    import math

    def km(a, b, c, d):
        n, e = math.radians(c - a) / 2, math.radians(d - b) / 2
        h = math.sin(n) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(e) ** 2
        return 12742.0176 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    return {p: min((round(km(a, b, c, d), 6), n) for n, c, d in nodes)[1] for p, a, b in points if a is not None}


def test_nearest_node_across_the_seam_and_at_the_poles(spark):
    import random

    from eventpulse.operators.geo import nearest_node

    rng = random.Random(4)
    nodes = [("west", 0.0, -179.9), ("east", 0.0, 172.0), ("north", 89.5, 10.0), ("south", -89.0, 100.0)] + [(f"city{i:03d}", 37.5 + rng.random() / 5, 127 + rng.random() / 5) for i in range(150)]
    points = [(0, 0.0, 179.9), (1, 89.9, -170.0), (2, -89.9, -80.0), (3, None, 1.0), (4, 0.0, -95.0), (5, 45.0, 8.0)] + [(10 + i, 37.4 + rng.random() / 2, 126.9 + rng.random() / 2) for i in range(60)] + [(100 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)]
    n, p = spark.createDataFrame(nodes, "key string, lat double, lon double"), spark.createDataFrame(points, "point int, lat double, lon double")
    for cells in (None, (0.001, 0.01), (0.5,)):
        found = {r["point"]: r["nearest"] for r in nearest_node(p, n, cells).collect()}
        assert found == {3: None} | brute_nearest(points, nodes)
    assert [r["nearest"] for r in nearest_node(p, n.limit(0)).collect()] == [None] * len(points)


def test_ids_of_many_keys(spark):
    rows = [(f"https://one.example/{i * 7919 % 1000:04d}", i - 500) for i in range(1000)]
    df = spark.createDataFrame(rows, "url string, n long")
    out = deident.ordinal_ids(df, ["url"], "U_", "id")
    assert [r["id"] for r in sorted(out.collect(), key=lambda r: r["url"])] == [f"U_{i:04d}" for i in range(1, 1001)]
    many = deident.ordinal_ids(spark.range(300_000).select(F.md5(F.col("id").cast("string")).alias("k")), ["k"], "", "id", 6)
    assert many.agg(F.count_distinct("id"), F.min("id"), F.max("id")).first() == (300_000, "000001", "300000")
    plans = [len(f._jdf.queryExecution().optimizedPlan().toString()) for f in (out, many)]
    assert max(plans) < 3 * min(plans)


def test_many_nodes_of_containment(spark):
    from eventpulse.operators import match

    nodes = spark.createDataFrame([(i, f"k{i}", f"hall {i:05d}x", f"street {i:05d}") for i in range(20_001)], "node_order int, node_key string, name string, address string")
    texts = spark.createDataFrame([(1, "Meet at Street 20000 now"), (2, "l 00007X"), (3, "xy"), (4, None)], "row int, place string")
    assert {r["row"]: r["node_key"] for r in match.containment_match(texts, nodes, "row", "place").collect()} == {1: "k20000", 2: "k7", 3: None, 4: None}


def test_medians_of_keys(spark):
    from statistics import median

    from eventpulse.operators.capacity import capacity_by_key

    rows = [(k, i * i * 37 % 101, 100 if i % 11 else 0, "d") for k, n in (("a", 1), ("b", 2), ("c", 999), (None, 50)) for i in range(n)]
    found = {r["key"]: r["fill_median"] for r in capacity_by_key(spark.createDataFrame(rows, "key string, reserved int, capacity int, day string"), "key").collect()}
    expected = {k: [r / c for q, r, c, _ in rows if q == k and c] for k in ("a", "b", "c", None)}
    assert found == {k: round(median(v), 6) if v else None for k, v in expected.items()}


def test_earlier_rows_without_a_fresh_one_stay(spark):
    from eventpulse.operators.checking import merge_counts, preserve_success

    schema = "k int, summary string, m string, status string"
    old = spark.createDataFrame([(1, "old", "a", "success"), (2, "old", "a", "error"), (3, "old", "a", "success"), (4, "old", "a", None)], schema)
    new = spark.createDataFrame([(1, "new", "b", "success"), (2, "new", "b", "success"), (4, "new", "b", "success"), (5, "new", "b", "error")], schema)
    out = preserve_success(old, new, "k", ["m"])
    assert sorted(map(tuple, out.collect())) == [(1, "old", "b", "success", "preserved"), (2, "new", "b", "success", "fresh"), (3, "old", "a", "success", "existing_only"), (4, "new", "b", "success", "fresh"), (5, "new", "b", "error", "fresh")]
    assert {tuple(r) for r in merge_counts(out).collect()} == {("preserved", 1), ("existing_only", 1), ("fresh", 3)}


def test_terms_of_a_table(spark):
    from eventpulse.operators.content import match_terms_by

    df = spark.createDataFrame([(1, "The Deep Sea and the sea"), (2, "nothing"), (3, None), (4, "D E")], "row int, text string")
    terms = spark.createDataFrame([("sea", None), ("Deep Sea", "ocean"), ("de", None), ("ocean", None), ("", "x")], "term string, alias string")
    for most in (10, 1):
        assert {r["row"]: r["t"] for r in match_terms_by(df, "row", "text", terms, "t", most).collect()} == {1: "ocean;sea;de", 2: "", 3: "", 4: "de"}


def test_alias_tables(spark):
    aliases = spark.createDataFrame([("a", "A"), ("b", "A"), ("b", "Z"), (None, "n")], "alias string, name string")
    df = spark.createDataFrame([(1, "p", "a;b", "u"), (2, "p", "", "u"), (3, "q", " c ;a", "v"), (4, "q", None, "v")], "mention_id int, platform string, terms string, source string").withColumn("published", F.lit("2026-01-01"))
    assert sorted(values(mentions.term_summary(df, "terms", aliases, [], "source"), "term", "mentions")) == [("A", 2), ("UNMATCHED", 2), ("c", 1)]
    assert sorted(values(mentions.term_metrics(df, "terms", aliases, ["p"], [], "source"), "term", "mentions")) == [("A", 2), ("c", 1)]
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "k string, n long")
    assert sorted(values(metrics.alias_rollup(rows, "k", aliases, ["n"], {}), "entity", "n"), key=str) == [("A", 3), ("c", 3), (None, 4)]


def test_tables_of_the_catalog_and_features(spark, small, tmp_path):
    try:
        assert files.save_tables(spark, small, ["nation"], ["region", "none"], "kept") == ["nation", "region"]
        assert spark.table("kept.nation").count() == 25
    finally:
        spark.sql("DROP DATABASE IF EXISTS kept CASCADE")
    features = spark.createDataFrame([("a", "{1}"), ("a", "{2}"), ("b", "{3}")], "layer string, feature string")
    files.write_features(features, "layer", str(tmp_path / "out"))
    assert sorted(values(spark.read.text(str(tmp_path / "out")), "value", "layer")) == [("{1}", "a"), ("{2}", "a"), ("{3}", "b")]


def test_manifest_of_files_too_large_for_one_value(spark, tmp_path):
    held = {"plain.bin": os.urandom(40_000), "ends.txt": b"ab\n" * 9000 + b"\r\n\n", "marked.txt": b"\xef\xbb\xbfa\n" + b"x" * 20_000, "marked end.txt": b"\xef\xbb\xbf\n" * 5000, "small": b"a\n"}
    held |= {"a+b%20.gz.txt": b"+\n" * 9000, "packed.gz": gzip.compress(os.urandom(15_000)), "in/deep": bytes(20_000)}
    for name, content in held.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    expected = sorted((n.split("/")[-1], len(c), hashlib.sha256(c).hexdigest()) for n, c in held.items())
    for conf, value in (("spark.sql.sources.binaryFile.maxLength", "16000"), ("spark.sql.files.maxPartitionBytes", "5000")):
        spark.conf.set(conf, value)
    try:
        for whole in (20_000, 10_000):
            assert sorted(values(files.file_manifest(spark, str(tmp_path), whole), "name", "bytes", "sha256")) == expected
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _places_and_links(spark):
    nodes = spark.range(600).select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("key"), F.when(F.col("id") != 7, (F.col("id") * 37 % 170 - 85).cast("double")).alias("lat"), (F.col("id") * 91 % 360 - 180).cast("double").alias("lon"))
    links = [("n000", "n599", 12.345), ("n000", "n000", 3.0), ("n300", "n001", 5.0), ("n300", "n001", 6.0), ("n300", "n002", None), ("none", "n001", 1.0)]
    return nodes, spark.createDataFrame(links, "origin string, destination string, length_m double")


def test_matrix_has_every_pair_and_shuffles_none(spark):
    nodes, network = _places_and_links(spark)
    matrix = geo.distance_matrix(nodes, network)
    a, b = (nodes.select(F.col("key").alias(k), F.col("lat").alias(f"lat{n}"), F.col("lon").alias(f"lon{n}")) for n, k in ((1, "origin"), (2, "destination")))
    straight = F.when(F.col("origin") == F.col("destination"), 0.0).otherwise(haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) * 1000)
    plain = a.crossJoin(b).withColumn("straight_m", rounded(straight, 2)).join(network, ["origin", "destination"], "left")
    walk = F.coalesce("length_m", rounded(F.col("straight_m") * 1.3, 2))
    plain = plain.select("origin", "destination", "straight_m", walk.alias("walk_m"), F.when(F.col("length_m").isNotNull(), "network").otherwise("straight_detour").alias("walk_method"), rounded(walk / 80, 2).alias("walk_minutes"))
    assert matrix.count() == 600 * 600 + 1 and matrix.select(plain.columns).exceptAll(plain).isEmpty()
    once = geo.distance_matrix(nodes, network.distinct().filter("length_m is null or length_m <> 6"))
    above = once._jdf.queryExecution().executedPlan().toString().split("Generate posexplode")
    assert len(above) == 2 and "Exchange" not in above[0] and "Join" not in above[0]


def test_extremes_make_rows_of_few_origins_again(spark):
    nodes, network = _places_and_links(spark)
    matrix = geo.distance_matrix(nodes.filter("lat is not null"), network).filter("origin <> 'n300' or walk_m <> 6")
    found = geo.distance_extremes(matrix, 4)
    rows = [r for r in matrix.filter(~F.col("same_location")).collect()]
    near = sorted((r["straight_m"], r["origin"], r["destination"]) for r in rows)[:4]
    far = sorted((-r["straight_m"], r["origin"], r["destination"]) for r in rows)[:4]
    assert sorted(values(found.filter("side = 'nearest'"), "straight_m", "origin", "destination")) == near
    assert sorted(values(found.filter("side = 'farthest'"), "straight_m", "origin", "destination")) == sorted((-d, o, e) for d, o, e in far)
    assert set(values(found, "mean_walk", "longest_walk")) == {(round(sum(round(r["walk_minutes"] * 100) for r in rows) / len(rows) / 100, 4), max(r["walk_minutes"] for r in rows))}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("IN (n") >= 2


def test_ranges_of_ranks_are_made_once(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7 % 1000).alias("v"))
    for scores in (metrics.avgrank_scores, metrics.midrank_scores):
        scored = scores(df, {"v": "s"})
        assert "percentile_approx" not in scored._jdf.queryExecution().optimizedPlan().toString()  # approximate bounds may differ when made again
        assert {r["v"]: r["s"] for r in scored.collect()}[999] == (99.95 if scores is metrics.midrank_scores else 99.96)


def test_paged_lines_of_split_files(spark, tmp_path):
    held = {"p-1.txt": "\ufeffa\r\nb\n\n" * 900, "p-2.txt": "x\ny\r", "p-3.txt": "\ufeff\r\n", "p-4.txt": "\n", "p-5.txt": "é\rz\n" * 700 + "end"}
    for name, content in held.items():
        (tmp_path / name).write_bytes(content.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for returns in (False, True):
            cut = {n: (c if returns else c.replace("\r\n", "\n")).split("\n") for n, c in held.items()}
            expected = sorted((n, int(n[2]), i, line) for n, lines in cut.items() for i, line in enumerate(lines[:-1] if lines[-1] == "" else lines, 1))
            assert sorted(values(files.read_paged_lines(spark, str(tmp_path), r"p-(\d)", returns), "file", "page", "line_no", "line")) == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_paged_lines_keep_returns_of_texts(spark, tmp_path):
    texts = ["a\r\nbc\r", None, "", "\ufeffd\n"]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = match_record_queries.s4_read_paged_lines(spark, str(tmp_path)).first()
    assert tuple(found) == (2 + 1 + 2, 2 + 3 + 2)


def test_ids_beyond_their_digits_stay_whole(spark):
    old = spark.createDataFrame([(1, "P999998")], "record long, person_id string")
    people = spark.range(1, 40).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.col("id").alias("record"))
    found = deident.assign_stable_ids(people, old, ["name"], "record", "record")
    assert sorted(values(found, "record", "person_id")) == [(r, f"P{999997 + r}") for r in range(1, 40)]
    nodes = spark.range(10_005).select(F.format_string("k%06d", "id").alias("key"), F.lit("1.5").alias("lat"), F.lit("2").alias("lon"))
    ends = geo.location_nodes(nodes, "key").filter("key >= 'k009997'")
    assert sorted(values(ends, "key", "node_id")) == [(f"k{i:06d}", f"LOC_{i + 1}") for i in range(9997, 10_005)]


def test_query_of_stable_ids_keeps_seven_digits(spark, tmp_path):
    orders = [(1_000_007, 1), (1_000_010, 2), (1_000_011, 3), (1_000_012, 2)]
    spark.createDataFrame([(k, c, date(1998, 1, 1)) for k, c in orders], "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(c, f"c{c}", "X") for c in (1, 2, 3)], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    ids = geo_flow_queries.d1_stable_ids(spark, str(tmp_path))
    assert sorted(values(ids, "record", "person_id")) == [(1_000_007, "P1000007"), (1_000_010, "P1000008"), (1_000_011, "P1000009"), (1_000_012, "P1000008")]
    raw = geo_flow_queries.d2_mask_record(spark, str(tmp_path)).filter("record = 1000010").first()
    assert raw["name"] == "P1000008" and raw["raw"].split("\n")[3:5] == ["P1000008", "[phone]"]
