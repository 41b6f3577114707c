"""Nearest texts by edit distance against measuring all pairs."""

import random
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventpulse.operators import match, nearest


@cache
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (c != d)))
        row = new
    return row[-1]


def percent(a, b):
    longest = max(len(a), len(b))
    return float(np.floor((longest - distance(a, b)) / longest * 100 * 100 + 0.5) / 100) if longest else 100.0


def titles(n, seed, letters="abcdefg hij"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 16))) for _ in range(max(1, n // 3))]

    def changed(t):
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(t) + 1)
            t = t[:i] + rng.choice(["", rng.choice(letters)]) + t[i + rng.randrange(2) :]
        return t

    return [changed(rng.choice(base)) for _ in range(n)]


def test_every_similar_pair_shares_what_the_index_asks_for():
    for least, q in nearest.PASSES:
        assert all(nearest.stretches_shared(n, least, q) >= max(1, -(-(n * (100 - q * (100 - least))) // 100) - q + 1) for n in range(q, 3000))
        assert all((100 - least) * n // 100 == 0 for n in range(1, q))


def test_distances_at_once():
    texts = titles(60, 1) + ["", "漢字🙂", "a" * 300, "ab" * 32, "ab" * 31 + "c", "b" * 65]
    points, lengths = nearest.code_points(texts)
    for t in texts[::5] + ["", "漢x🙂", "ab" * 32, "a" * 63, "a" * 65]:
        assert nearest.edit_distances(nearest.code_points([t])[0][0], points, lengths).tolist() == [distance(t, o) for o in texts]


@pytest.mark.parametrize("least,q", nearest.PASSES)
def test_similar_pairs(spark, least, q):
    left, right = titles(120, 2) + ["", "a", "ab"], titles(150, 2)[:100] + titles(60, 3) + ["", "a", "ab"]
    l = spark.createDataFrame([(t, i % 2) for i, t in enumerate(left)], "left_text string, b int")
    r = spark.createDataFrame([(t, i % 2) for i, t in enumerate(right)], "right_text string, b int")
    found = {tuple(x) for x in nearest.similar_pairs(l, r, ["b"], least, q).collect()}
    longest = lambda a, b: max(len(a), len(b))
    want = {(i % 2, a, b) for i, a in enumerate(left) for j, b in enumerate(right) if i % 2 == j % 2 and distance(a, b) * 100 <= (100 - least) * longest(a, b)}
    assert found == want


@pytest.mark.parametrize("passes", [nearest.PASSES, ()])
def test_nearest_in_blocks(spark, monkeypatch, passes):
    monkeypatch.setattr(nearest, "LEFT_CELL", 16)
    monkeypatch.setattr(nearest, "RIGHT_CELL", 16)
    rng = random.Random(4)
    block = lambda: rng.choice(["hot", "hot", "hot", "b", "c", None])
    left, right = [(block(), t) for t in titles(150, 5)] + [("only left", "x"), ("hot", ""), ("hot", None), ("hot", "漢字")], [(block(), t, i) for i, t in enumerate(titles(200, 5)[60:] + titles(40, 6) + ["", "%%%"])]
    found = nearest.nearest_by_edit(spark.createDataFrame(left, "b string, text string"), spark.createDataFrame(right, "b string, text string, rank long"), ["b"], passes).collect()
    want = {}
    for b, t in left:
        near = [(percent(t, o), -rank) for c, o, rank in right if b == c and b is not None and t is not None]
        if near:
            want[b, t] = max(near)
    assert {(r.b, r.text): (r.score, -r["rank"]) for r in found} == want and len(found) == len(want)


def plain_best(queries, references, generic):
    """Best reference of each query by measuring all, with the rules written out; references as reference_dictionary's rows."""
    out = {}
    for q in queries:
        key, body, label, venue = q["query_key"], q["query_body"], q["query_label"], q["query_venue"]
        best = None
        for r in references:
            elsewhere = venue and r.venue_key and venue != r.venue_key
            cover = len(r.body_key) / max(len(body), 1)
            s = percent(body, r.body_key)
            if key in (r.class_key, r.class_base_key):
                s = 101.0
            elif body and body == r.body_key and not elsewhere:
                s = 100.5 if label and label == r.label else 100.0
            else:
                if body and body == r.body_key:
                    s = min(s, 89.0)
                if body and r.body_key and body in r.body_key:
                    s = max(s, 94.0)
                elif body and r.body_key and r.body_key in body and len(r.body_key) >= 5:
                    s = max(s, 92.0)
                s -= 8.0 if elsewhere else 0.0
                if len(body) >= 8 and (r.body_key in generic or cover < 0.45 or cover < 0.65 and s < 98):
                    s = min(s, 89.0)
            s += 0.01 if r.title == r.title_base else 0.0
            best = max(best or (), (s, bool(label) and label == r.label, cover, len(r.body_key), -r.priority, r.title))
        out[q["query"]] = (round(min(best[0], 100.0), 2), best[-1])
    return out


def test_best_reference_by_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEFT_CELL", 32)
    monkeypatch.setattr(nearest, "RIGHT_CELL", 32)
    rng = random.Random(7)
    with_label = lambda t: rng.choice(["", "", f"[{rng.choice(['Hall A', 'Hall B', 'C'])}] "]) + t
    known = [with_label(t) for t in titles(300, 8, "abcde fgh 12")]
    references = match.reference_dictionary([(spark.createDataFrame([(t,) for t in known[:150]], "t string"), "t", "first", 1), (spark.createDataFrame([(t,) for t in known[100:]], "t string"), "t", "second", 2)])
    asked = list({with_label(t) for t in titles(300, 8, "abcde fgh 12")[40:] + titles(60, 9, "qwrtz abc") + known[:20] + ["", "漢字", "a", "ab"]})
    found = match.best_reference_match(spark.createDataFrame([(t,) for t in asked], "q string"), references, "q", ["abc"]).collect()
    keyed = spark.createDataFrame([(t,) for t in asked], "query string")
    keyed = keyed.withColumns({"query_key": match.join_key("query"), "query_body": match.join_key(match.strip_bracket("query")), "query_label": match.bracket_label("query"), "query_venue": match.join_key(match.bracket_label("query"))})
    want = plain_best([r.asDict() for r in keyed.filter("query_key <> ''").collect()], references.collect(), ["abc"])
    assert {r.q: (r.match_score, r.title) for r in found if r.title is not None} == want
    assert all(r.match_method == "missing_title" for r in found if r.title is None) and len(found) == len(asked)


def test_no_plan_pairs_everything(spark):
    references = match.reference_dictionary([(spark.createDataFrame([("yoga flow",), ("yin",)], "t string"), "t", "all", 1)])
    out = match.best_reference_match(spark.createDataFrame([("yoga flaw",)], "q string"), references, "q", [])
    left, right = spark.createDataFrame([(1, "ab", "x")], "id int, key string, block string"), spark.createDataFrame([("ac", "x")], "key string, block string")
    for frame in (out, match.exact_then_fuzzy(left, right, "id", "similar")):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan and "Join Inner\n" not in plan


def test_a_hot_block_in_cells(spark):
    """One block of 10,000 texts of which none is like another: bounded groups, best of each."""
    left = spark.range(300).select(F.lit("hot").alias("b"), F.md5(F.col("id").cast("string")).alias("text"))
    right = spark.range(10_000).select(F.lit("hot").alias("b"), F.md5((F.col("id") + 200).cast("string")).alias("text"), F.col("id").alias("rank"))
    found = nearest.nearest_by_edit(left, right, ["b"], ()).collect()
    assert len(found) == 300 and sum(r.score == 100 for r in found) == 100 and min(r.score for r in found) > 20


def test_far_points_descend_without_pairing_all(spark):
    """Points far from all nodes, nodes at one place, against all pairs; the plan has no join of everything."""
    import math

    from eventpulse.operators import geo

    rng = random.Random(11)
    nodes = [(f"c{i:03d}", 37.5 + rng.random() / 5, 127 + rng.random() / 5) for i in range(200)] + [(f"same{i}", 48.0, 2.0) for i in range(50)] + [("far", -33.0, 151.0)]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)] + [(900, 48.0, 2.0), (901, None, 1.0), (902, 90.0, 0.0), (903, -90.0, 45.0)]

    def km(a, b, c, d):
        n, e = math.radians(c - a) / 2, math.radians(d - b) / 2
        h = math.sin(n) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(e) ** 2
        return 12742.0176 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    frame = geo.nearest_node(spark.createDataFrame(points, "point int, lat double, lon double"), spark.createDataFrame(nodes, "key string, lat double, lon double"))
    want = {p: None if a is None else min((round(km(a, b, c, d), 6), n) for n, c, d in nodes)[1] for p, a, b in points}
    assert {r.point: r.nearest for r in frame.collect()} == want
    assert "Cross" not in frame._jdf.queryExecution().optimizedPlan().toString()
