"""Corpus pipeline: quality rules, near-duplicate removal, substring dedup, secret scans, best-fit packing.

Stages whose last step runs Python over whole documents write their result while Arrow batches are small."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventpulse.llm.jaccard_join import one_of_each_component
from eventpulse.llm.packing import pack_documents
from eventpulse.llm.quality import kept_by_quality
from eventpulse.llm.secrets import redacted, secret_spans
from eventpulse.llm.storage import saved, small_batches
from eventpulse.llm.substring import substring_dedup


def _with_text(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The documents' columns from their struct _row and the new text; n_chars follows it."""
    new = {"text": F.col(text)} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in columns else {})
    return rows.select(*[new.get(c, F.col(f"_row.{c}")).alias(c) for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    with small_batches(spark):
        return saved(kept_by_quality(docs, host="source", text="text"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of 0.8-similar texts (sets of five-word shingles): that with the smallest doc_id."""
    with small_batches(spark):
        return one_of_each_component(docs, width=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of repeated 35-word passages; documents of which nothing is left go."""
    others = F.struct(*[c for c in docs.columns if c != "text"]).alias("_row")
    with small_batches(spark):
        cut = substring_dedup(docs.select(others, "doc_id", "text"), ["_row"], window=35, as_text=True)
        return saved(_with_text(cut.filter("n_removed = 0 or n_removed < n_words"), docs.columns, "kept_text"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mask."""
    others = F.struct(*[c for c in docs.columns if c != "text"]).alias("_row")
    with small_batches(spark):
        spans = secret_spans(docs.select(others, F.col("text").alias("_body")), ["_row", "_body"], text="_body", scan_twice=True)
        return saved(_with_text(redacted(spans, ["_row"], text="_body"), docs.columns, "redacted"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 2048."""
    with small_batches(spark):
        return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

#: Tokenisation and packing have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; between stages the rows are written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
