"""Canonical names against one replacement after the other."""

import random
import re
import time

import pytest

from eventpulse.functions import registry as R
from eventpulse.functions import text as X


def plainly(rows, text):
    whole, spaceless = {r.lower(): c for r, c in rows}, {r.lower().replace(" ", ""): c for r, c in rows}
    if text.lower() in whole:
        return whole[text.lower()]
    for raw, canonical in rows:
        if re.search("[A-Za-z]", raw):
            text = re.sub(re.escape(raw), lambda _: canonical, text, flags=re.I | re.A)  # noqa: B023
    head = text.split("|")[0].strip(" ")
    return whole.get(head.lower()) or spaceless.get(head.lower().replace(" ", "")) or head


def test_random_registries():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abAB 가|.") for _ in range(rng.randrange(1, n))).strip() or "a"
    for _ in range(200):
        rows = tuple((word(5), word(6)) for _ in range(rng.randrange(12)))
        made = R.Registry(rows)
        for _ in range(20):
            text = word(14)
            assert made.canonical(text) == plainly(rows, text), (rows, text)


def test_table_order_blanks_and_size(spark, monkeypatch):
    table = spark.createDataFrame([(2, "Flow", "Late"), (1, "flow", "Early"), (3, None, "x"), (4, " ", "y"), (5, "Hall a", "Hall A")], "place int, raw string, canonical string")
    made = R.registry_of(table, "place")
    assert [r for r, _ in made.rows] == ["flow", "Flow", "Hall a"]
    df = spark.createDataFrame([("FLOW",), ("my flow",), ("halla",), (None,), ("x | flow",)], "t string")
    assert [r[0] for r in df.select(X.canonicalize("t", made)).collect()] == ["Late", "my Early", "Hall A", "", "x"]
    monkeypatch.setattr(R, "MOST", 2)
    with pytest.raises(ValueError):
        R.registry_of(table, "place")


def test_fifty_thousand_aliases(spark):
    rows = spark.range(50_000).selectExpr("concat('alias ', id) as raw", "concat('Name', id) as canonical", "id as place")
    made = R.registry_of(rows, "place")
    df = spark.range(20_000).selectExpr("concat('See ALIAS ', id, ' and more') as t")
    began = time.time()
    found = {r[0] for r in df.select(X.canonicalize("t", made)).collect()}
    assert len(found) > 15_000 and time.time() - began < 60
