"""Operators over all documents against brute force, on odd rows and on the smallest tables."""

import hashlib
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from eventpulse.llm.components import connected_components
from eventpulse.llm.jaccard_join import jaccard_components, one_of_each_component
from eventpulse.llm.neighbours import hadamard, nearest_neighbours
from eventpulse.llm import jaccard_join, substring
from eventpulse.llm.quality import quality_rules
from eventpulse.llm.substring import _leftmost_minima, substring_dedup
from eventpulse.llm.wordblocks import chain, word_blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(params=["odd", "small", "none"])
def documents(request, spark, small, odd_documents):
    table = spark.read.parquet(f"{small}/documents.parquet")
    return {"odd": odd_documents, "small": table, "none": table.limit(0)}[request.param]


def expected_components(rows, width, percent):
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    low = {}
    for (doc, _), x in zip(rows, label):
        low[x] = min([v for v in (low.get(x), doc) if v is not None], default=None)
    return [(doc, len(s), low[x] if s else doc) for (doc, _), s, x in zip(rows, sets, label)]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(documents, width, percent):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    found = [tuple(r) for r in jaccard_components(documents, width, percent).collect()]
    assert sorted(found, key=str) == sorted(expected_components(rows, width, percent), key=str)


def test_a_cloud_of_altered_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.integers(0, 90, int(rng.integers(0, 4))):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(base[:40] + [f"z{i}q{k}" for k in range(50)])) for i in range(30)]
    found = [tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found) == sorted(expected_components(rows, 4, 85))


@pytest.mark.parametrize("by_join", [False, True])
def test_hot_shingles_and_a_large_bitmap(spark, monkeypatch, by_join):
    rng = np.random.default_rng(9)
    shared = [f"s{i}" for i in range(12)]
    rows = []
    for i in range(120):
        own = [f"w{x}" for x in rng.integers(0, 10**6, 50)] if i % 3 else [f"w{(i // 30) * 1000 + k}" for k in range(50)]
        own[int(rng.integers(0, 50))] = "changed"
        rows.append((i, " ".join(shared + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if by_join:
        monkeypatch.setattr(jaccard_join, "MOST_BITS", 1)
    found = [tuple(r) for r in jaccard_components(docs, hot_owners=20).collect()]
    assert sorted(found) == sorted(expected_components(rows, 4, 85)) and len({c for _, _, c in found}) < 120
    signed = docs.selectExpr("doc_id", "doc_id as row_hash", "text").mapInArrow(jaccard_join._signatures(4), "doc_id long, row_hash long, n_shingles long, node binary, node8 long, frequent binary, counts binary")
    assert 8 <= len(jaccard_join._hot_tokens(signed, 100)) <= 10


def test_frequent_tokens_are_in_the_summary():
    rng, frequent = np.random.default_rng(1), jaccard_join._Frequent()
    for i in range(40):
        frequent.add(np.concatenate([rng.integers(0, 2**63, 30_000, dtype=np.uint64), np.arange(5, dtype=np.uint64).repeat(20)]))
    assert len(frequent.tokens) <= jaccard_join.SUMMARY and set(range(5)) <= set(frequent.tokens.tolist())


def test_one_row_of_each_component(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "a"), (None, words, "b"), (None, words + " zz", "c"), (2, words, "d"), (2, "other text of five words", "e"), (2, "other text of five words", "f"), (3, None, "g"), (3, "", "h"), (4, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    kept = sorted((r["doc_id"], r["text"]) for r in one_of_each_component(docs).filter("trim(text) <> ''").collect())
    assert kept == [(1, words), (2, "other text of five words")] and one_of_each_component(docs).filter("doc_id > 2").count() == 3
    assert one_of_each_component(docs).columns == docs.columns


def test_words_with_one_polynomial_hash_stay_apart(spark):
    pair = ["".join("ab"[(i.bit_count() + k) % 2] for i in range(1024)) for k in (0, 1)]
    rows = [(k, " ".join(f"{w}{i}" if i % 2 else w for i in range(40))) for k, w in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["component_id"] for r in jaccard_components(docs).orderBy("doc_id").collect()] == [0, 1]
    assert substring_dedup(docs, ["doc_id"], 6).filter("n_removed > 0").count() == 0
    lines = spark.createDataFrame([(1, "\n".join(pair))], "doc_id long, text string").selectExpr("doc_id", "text", "'h' as source")
    assert quality_rules(lines, ["doc_id"]).first()["n_dup_lines"] == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 100), (7, 7), (101, 102)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(21)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("window", [35, 6])
def test_substring_dedup(documents, window):
    rows = [(r["doc_id"], WORD.findall(r["text"] or "")) for r in documents.collect()]
    counts = Counter(tuple(w[i : i + window]) for _, w in rows for i in range(len(w) - window + 1))
    expected = []
    for doc, words in rows:
        gone = set()
        for i in range(len(words) - window + 1):
            if counts[tuple(words[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        expected.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    found = [tuple(r) for r in substring_dedup(documents, ["doc_id"], window).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_a_common_phrase_is_split_by_window(spark):
    rng = np.random.default_rng(6)
    phrases = [[f"p{i}x{k}" for k in range(5)] for i in range(3000)]
    block = next(word_blocks(pa.array([" ".join(p) for p in phrases])))
    phrase = phrases[int(np.argmin(chain(block.word_hashes(), 5)[::5]))]  # a phrase that is the minimiser of nearly all its windows
    rows = []
    for i in range(240):
        around = [f"w{x}" for x in rng.integers(0, 10**6, 80)]
        rows.append((i, " ".join(around[:40] + phrase + around[40:])))
    rows += [(1000, rows[3][1]), (1001, " ".join(rows[5][1].split()[20:70])), (None, rows[7][1] + " " + rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = Counter(tuple(w[i : i + 35]) for _, t in rows for w in [t.split()] for i in range(len(w) - 34))
    expected = []
    for doc, text in rows:
        words = text.split()
        gone = {k for i in range(len(words) - 34) if counts[tuple(words[i : i + 35])] > 1 for k in range(i, i + 35)}
        expected.append((doc, len(gone)))
    found = substring_dedup(docs, ["doc_id"], hot=50).collect()
    assert sorted([(r["doc_id"], r["n_removed"]) for r in found], key=str) == sorted(expected, key=str)
    keys = substring._hot_keys(docs.select("text"), 35, 5, 50)
    assert len(keys) == 1
    batch = pa.record_batch({"doc_id": pa.array(range(240)), "row_hash": pa.array(range(240)), "text": pa.array([t for _, t in rows[:240]])})
    dealt = Counter()
    for out in substring._dealt_windows(35, 5, 64, keys)([batch]):
        for bucket, n in zip(out.column("bucket").to_pylist(), out.column("counts").to_pylist()):
            dealt[bucket] += len(n) // 4
    assert sum(dealt.values()) > 3000 and max(dealt.values()) < 3 * sum(dealt.values()) / 64


def test_leftmost_minima():
    rng = np.random.default_rng(0)
    for width in (1, 2, 3, 5, 31):
        values = rng.integers(0, 5, 200)
        assert _leftmost_minima(values, width).tolist() == [i + int(np.argmin(values[i : i + width])) for i in range(200 - width + 1)]


def test_hadamard_is_orthonormal():
    matrix = hadamard(np.eye(16))
    assert np.allclose(matrix @ matrix.T, np.eye(16)) and np.allclose(np.abs(matrix), 0.25)


def test_neighbours_recall_and_scores(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")
    rows = table.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    odd = spark.createDataFrame([(9001, None), (9020, []), (9040, [0.0] * 64), (9060, [float("nan")] + [1.0] * 63), (9080, [None] + [1.0] * 63), (9100, [1.0] * 3), (None, [1.0] * 64)], table.schema)
    copies = spark.createDataFrame([(10_000 + 20 * i, [float(v) for v in x[0]]) for i in range(30)], table.schema)
    found = {}
    for r in nearest_neighbours(table.unionByName(odd).unionByName(copies)).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, x = np.concatenate([ids, 10_000 + 20 * np.arange(30)]), np.concatenate([x, np.repeat(x[:1], 30, axis=0)])
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        order = [i for i in np.lexsort((ids, -np.round(scores, 12))) if i != q][:20]
        own = sorted(found[ids[q]])
        assert [n for n, _, _ in own] == list(range(1, 21))
        assert all(abs(s - scores[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(ids[order]))
        total += 20
    assert set(found) == set(ids[ids % 20 == 0].tolist()) and hits >= 0.9 * total
    assert nearest_neighbours(table.limit(0)).count() == 0
    assert nearest_neighbours(table.filter("vec_id < 5"), query_modulus=1).count() == 20


def exact_neighbours(ids, x, k):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        out[int(ids[q])] = [(int(ids[i]), float(scores[i])) for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:k]
    return out


@pytest.mark.parametrize("lengths", ["equal", "unequal"])
def test_neighbours_recall_on_ten_thousand(spark, tmp_path, lengths):
    """Vectors without clusters, the hardest case."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(10_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = (x * (rng.uniform(0.5, 1.5, size=(len(x), 1)) if lengths == "unequal" else 1)).astype(np.float32)
    ids = np.arange(len(x))
    pq.write_table(pa.table({"vec_id": ids, "embedding": list(x), "query_id": ids}), str(tmp_path / "vectors.parquet"))
    found = nearest_neighbours(spark.read.parquet(str(tmp_path / "vectors.parquet"))).toPandas()
    expected = exact_neighbours(ids, x.astype(float), 20)
    hits = sum(len({v for v, _ in expected[q]} & set(own["vec_id"])) for q, own in found.groupby("query_id"))
    assert len(found) == 20 * 500 and hits >= 0.9 * len(found)
    scores = (x[found["query_id"]].astype(float) * x[found["vec_id"]].astype(float)).sum(axis=1)
    assert (np.abs(scores - found["score"]) < 1e-12).all()


def test_neighbours_are_completed(spark):
    """Opposite vectors, and queries far from one cluster, still get all or k rows; repeated ids and equal vectors are found."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(600, 64))
    middle = rng.normal(size=64)
    x[1:] = middle + 0.05 * x[1:]
    x[0] = -middle
    x[20], x[40] = -x[21], x[21]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(1, [float(v) for v in x[1]])], "vec_id long, embedding array<double>")
    found = {}
    for r in nearest_neighbours(df).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    expected = exact_neighbours(np.arange(600), x, 20)
    assert all(sorted(n for n, _, _ in own) == list(range(1, 21)) for own in found.values()) and set(found) == set(expected)
    assert [v for _, v, _ in sorted(found[0])] == [v for v, _ in expected[0]] and [v for _, v, _ in sorted(found[20])] == [v for v, _ in expected[20]]
    few = spark.createDataFrame([(i, [1.0 if j == i else -1.0 if i and j == 0 else 0.0 for j in range(64)]) for i in range(15)], "vec_id long, embedding array<double>")
    assert nearest_neighbours(few, query_modulus=1).count() == 15 * 14


def test_neighbours_of_unequal_lengths(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16)) * rng.uniform(0.2, 3, size=(400, 1))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in nearest_neighbours(df, k=5).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    expected = {q: set([i for i in np.argsort(-(x @ x[q])) if i != q][:5]) for q in range(0, 400, 20)}
    assert sum(len(found[q] & expected[q]) for q in expected) >= 0.9 * 5 * len(expected)


def test_one_vec_id_with_several_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 16))
    rows = [(i, x[i].tolist()) for i in range(30)] + [(7, (-x[7]).tolist()), (20, x[3].tolist()), (7, x[7].tolist())]
    found = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=40).collect():
        found.setdefault(r["query_id"], []).append((round(r["score"], 9), r["vec_id"], r["rank"]))
    different = list({(i, tuple(v)) for i, v in rows})
    for query in (0, 20):
        want = []
        for own in [d for d in different if d[0] == query]:
            near = sorted(((round(-float(np.dot(own[1], v)), 9), i) for i, v in different if (i, v) != own))
            want += [(-s, i, rank + 1) for rank, (s, i) in enumerate(near)]
        assert sorted(found[query]) == sorted(want)


def test_many_equal_rows_in_substring_dedup(spark):
    text = " ".join(f"w{i}" for i in range(3000))
    other = " ".join(f"v{i}" for i in range(100))
    rows = [(1, text)] * 2000 + [(None, text)] * 50 + [(2, other), (3, other + " " + " ".join(f"w{i}" for i in range(40, 90)))]
    began = time.time()
    found = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert found == {(1, 3000, 3000), (None, 3000, 3000), (2, 100, 100), (3, 150, 150)} and time.time() - began < 120
