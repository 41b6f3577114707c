"""The pipeline's stages against brute force on the smallest tables."""

import re
from collections import Counter

import corpus_pipeline
from eventpulse.llm.storage import saved

from .test_corpus_operators import WORD, expected_components

BASE = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""")


def without_passages(texts, window=35):
    """Each text without its words in windows that start twice or more; None where nothing is left."""
    words = [WORD.findall(t or "") for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for text, own in zip(texts, words):
        gone = {k for i in range(len(own) - window + 1) if counts[tuple(own[i : i + window])] > 1 for k in range(i, i + window)}
        out.append(text if not gone else " ".join(w for k, w in enumerate(own) if k not in gone) if len(gone) < len(own) else None)
    return out


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    after = []
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, small))
        after.append(docs)
    assert all(d.columns == columns for d in after[:-1]) and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch
    clean = [r for r in after[0].collect()]
    assert all(len(WORD.findall(r["text"])) >= 50 and r == before[r["doc_id"]] for r in clean)
    parts = expected_components([(r["doc_id"], r["text"]) for r in clean], 5, 80)
    first = after[1].collect()
    assert sorted(r["doc_id"] for r in first) == sorted({c for _, _, c in parts}) and all(r == before[r["doc_id"]] for r in first)
    cut = {r["doc_id"]: t for r, t in zip(first, without_passages([r["text"] for r in first])) if t is not None}
    assert {r["doc_id"]: r["text"] for r in after[2].collect()} == cut
    assert all(r["n_chars"] == len(r["text"]) for r in after[2].filter("n_chars <> length(text)").collect())
    masked = {r["doc_id"]: r["text"] for r in after[3].collect()}
    assert masked.keys() == cut.keys() and all(not BASE.search(t) for t in masked.values())
    assert all("[secret]" in masked[d] if BASE.search(t) else masked[d] == t or "[secret]" in masked[d] for d, t in cut.items())
    assert {r["doc_id"] for r in after[4].collect()} == {r["doc_id"] for r in after[3].collect()}


def test_empty_and_odd(spark, odd_documents):
    for docs in (odd_documents.limit(0), odd_documents):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        one = corpus_pipeline.near_duplicate_stage(spark, docs, "")
        assert one.columns == docs.columns
        kept = sorted(((r["doc_id"], r["text"]) for r in one.collect()), key=str)
        groups = {}
        for (doc, text), (_, n, component) in zip(rows, expected_components(rows, 5, 80)):
            groups.setdefault(component if n else ("alone", doc), []).append((doc is None, doc, text))
        expected = [min(own, key=lambda r: (r[0], r[1] or 0))[1:] for key, own in groups.items() if not isinstance(key, tuple)]
        assert sorted(d for d, _ in kept if d is not None) == sorted([d for d, _ in expected if d is not None] + [r[1] for key, own in groups.items() if isinstance(key, tuple) for r in own])
        for _, stage in corpus_pipeline.STAGES:
            docs = saved(stage(spark, docs, ""))
        docs.count()


def test_a_very_long_run_of_white_space(spark):
    words = " ".join(f"word{i}" for i in range(90))
    docs = spark.createDataFrame([(1, words + "\n" * 1_200_000 + "End.", "en", "s", 5), (2, "other " * 5 + words, "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, ""))
    assert docs.filter("doc_id = 1").count() > 0
