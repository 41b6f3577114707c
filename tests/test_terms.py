"""Terms by automaton against one search a term."""

import random
import time

from pyspark.sql import functions as F

from eventpulse.functions import text as X
from eventpulse.functions.terms import occurrences_by_word, scan_terms
from eventpulse.operators.content import match_terms_by


def test_counts_do_not_overlap():
    rng = random.Random(1)
    words = tuple(sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(20)}))
    for _ in range(300):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(40)))
        assert occurrences_by_word(words, text) == {i: text.count(w) for i, w in enumerate(words) if w in text}
    assert occurrences_by_word((), "a") == {} == occurrences_by_word(("a",), "")


def test_groups_aliases_order_nulls(spark):
    df = spark.createDataFrame([(1, "The Cat sat; the cAt"), (2, None), (3, ""), (4, "Ｔ t he 漢字")], "id int, text string")
    scanned = scan_terms(X.no_spaces("text"), {"n": ["the", "cat", "the", ""], "m": ["漢"]}, {"f": [("thecat", "TC"), ("cat", "animal"), ("the", "animal"), ("the", "article"), ("", "none")]})
    rows = {r.id: tuple(r.s) for r in df.select("id", scanned.alias("s")).collect()}
    assert rows == {1: (6, 0, ["TC", "animal", "article"]), 2: (0, 0, []), 3: (0, 0, []), 4: (2, 1, ["animal", "article"])}


def test_ten_thousand_terms_as_fast_as_ten(spark):
    texts = spark.range(3000).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(150)), lambda i: F.substring(F.md5((F.col("id") * 1000 + i).cast("string")), 1, 6))).alias("text")).cache()
    texts.count()
    seconds, hits = {}, {}
    for n in (10, 10, 10_000):
        dictionary = spark.range(n).select(F.substring(F.md5((F.col("id") * 29).cast("string")), 1, 6).alias("term"), F.lit(None).cast("string").alias("alias"))
        began = time.time()
        hits[n] = match_terms_by(texts, "id", "text", dictionary, "terms").filter("terms <> ''").count()
        seconds[n] = time.time() - began
    assert hits[10_000] > hits[10] and seconds[10_000] < 4 * seconds[10] + 3


def test_a_dictionary_too_large_for_tasks_gives_the_same(spark):
    df = spark.createDataFrame([(1, "the sea and the ocean, de"), (2, None), (3, "xyz")], "row int, text string")
    terms = spark.createDataFrame([("sea", None), ("ocean", "water"), ("the sea", "water"), ("de", "of"), ("x", None), ("yz", "z")], "term string, alias string")
    found = [{r["row"]: r["t"] for r in match_terms_by(df, "row", "text", terms, "t", most).collect()} for most in (5, 100)]
    assert found[0] == found[1] == {1: "water;sea;of", 2: "", 3: "z;x"}
