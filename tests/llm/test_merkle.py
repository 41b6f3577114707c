"""The manifest's trees and proofs against plain lists."""

import hashlib
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from eventpulse.llm.merkle import field_digest, folded, merkle_manifest, proof_text
from eventpulse.llm.queries import op11_merkle_manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    doc, source, lang, n, text = row
    if lower and text is not None:
        text = "".join(c.lower() if c.isascii() else c for c in text)
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)])


def grown(nodes):
    """(root, siblings left and right of each leaf's path by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            first = i - i % 8
            paths[leaf].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 8])))
        nodes = [digest(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], paths


def expected(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    own = {lang: grown([leaf_of(r) for r in trees[lang]]) for lang in langs}
    root, over = grown([own[lang][0] for lang in langs])
    out = []
    for lang, path in zip(langs, over, strict=True):
        for row, below in zip(trees[lang], own[lang][1], strict=True):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            node = leaf_of(row, tampered)
            for left, right in below + path:
                node = digest(left, node, right)
            out.append((row[0], leaf_of(row), own[lang][0], root, digest(*itertools.chain(*below, *path)), node, node == root))
    return sorted(map(str, out))


COLUMNS = "doc_id", "source", "lang", "n_chars", "text"


def found(spark, rows, folder):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, root string")
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = op11_merkle_manifest(spark, str(folder)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(str(tuple(r)) for r in got.collect())


def test_odd_rows(spark, tmp_path):
    rows = [
        (1, "s", "en", 3, "Abc"), (1, "s", "en", 3, "Abc"), (1, "s", "en", 3, "Abd"), (None, None, None, None, None), (None, "s", "en", 1, "A"), (2, "s", "", 0, ""), (3, "s", None, 0, " \n\t"), (4, "É", "de", 9, "ÄÖ Σ 漢字 🙂"),
        (5, "s", "xx", None, "ABC " * 300_000), (6, "s", "ÿ", 1, "Q"), (7, "s", "𐍈", 1, "Q"), (8, "s", "￮", 1, "Q"), *[(10 + i, "s", f"l{i}", i, f"Text {i}") for i in range(70)], *[(100, "s", "same", 1, "Copy")] * 30,
    ]
    assert found(spark, rows, tmp_path) == expected(rows)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 64, 65])
def test_sizes(spark, tmp_path, n):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
    assert found(spark, rows, tmp_path) == (expected(rows) if rows else [])


def test_a_tree_of_several_tiers(spark, tmp_path):
    rows = [(i * 7 % 5003, "s", "en", i, f"Text {i}") for i in range(5003)] + [(i, "t", "de", i, f"Text {i}") for i in range(4096)]
    assert found(spark, rows, tmp_path) == expected(rows)


def test_any_columns(spark):
    rows = spark.range(100).select(F.col("id").alias("a"), (F.col("id") % 3).alias("b"), F.lit("x").alias("c"))
    got = merkle_manifest(rows, field_digest("a", "c"), "b", ["a"], ["a", "c"])
    assert got.columns == ["a", "c", "leaf", "subroot", "root", "path"]
    assert got.filter(folded("leaf", "path") == F.col("root")).count() == 100
    assert got.filter(folded(field_digest(F.col("a") + 1, "c"), "path") == F.col("root")).count() == 0
    assert got.select(F.length(proof_text("path"))).first()[0] > 0
    with pytest.raises(ValueError, match="clash"):
        merkle_manifest(rows.withColumn("root", F.lit(1)), field_digest("a"), "b", ["a"], ["root"])
