"""Row numbers by ranges against plain counting."""

import random

from pyspark.sql import functions as F

from eventpulse.operators.numbering import _in_ranges, numbered


def expected(rows, by, order):
    groups, out = {}, {}
    for row in sorted(rows, key=lambda r: tuple((r[c] is not None, r[c]) for c in order)):
        key = tuple(row[c] for c in by)
        groups[key] = groups.get(key, 0) + 1
        out.setdefault(key, []).append((tuple(row[c] for c in order), groups[key]))
    return {k: sorted(v, key=lambda x: x[1]) for k, v in out.items()}


def check(spark, rows, by, order):
    frame = spark.createDataFrame(rows, "g string, v long, w string")
    found = numbered(frame, by, order, "n", "size").collect()
    groups = {}
    for row in found:
        groups.setdefault(tuple(row[c] for c in by), []).append((tuple(row[c] for c in order), row.n))
        assert row.size == sum(all(r[c] == row[c] for c in by) for r in rows)
    assert {k: sorted(v, key=lambda x: x[1]) for k, v in groups.items()} == expected(rows, by, order)


def test_groups_nulls_ties(spark):
    rng = random.Random(3)
    rows = [{"g": rng.choice(["a", "a", "a", "b", None, ""]), "v": rng.choice([None, 1, 2, 3, rng.randrange(100)]), "w": str(rng.randrange(5))} for _ in range(500)]
    check(spark, rows, ["g"], ["v", "w"])
    check(spark, rows, [], ["w", "v"])
    check(spark, rows, ["g", "w"], ["v"])


def test_descending_and_empty(spark):
    frame = spark.createDataFrame([("a", i) for i in range(50)], "g string, v long")
    assert {(r.v, r.n) for r in numbered(frame, ["g"], [F.desc("v")], "n").collect()} == {(i, 50 - i) for i in range(50)}
    assert numbered(frame.limit(0), ["g"], ["v"], "n", "s").count() == 0


def test_one_large_group_is_numbered_in_many_tasks(spark):
    rows = 200_000
    frame = spark.range(rows).select(F.lit("all").alias("g"), F.lit(1).alias("v"), "id")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        ranges = [r["count"] for r in _in_ranges(frame, ["g"], [F.col("v").asc()]).groupBy("_range").count().collect()]
        found = numbered(frame, ["g"], ["v"], "n")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(ranges) == rows and len(ranges) == 8 and max(ranges) < rows / 4
    assert found.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first() == (rows, 1, rows)
