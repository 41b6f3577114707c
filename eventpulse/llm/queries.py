"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .bpe import encode_and_decode
from .conversations import conversation_digests, repair_conversations
from .html_text import extract_main_text
from .jaccard_join import jaccard_components
from .licenses import licence_scan
from .merkle import field_digest, folded, merkle_manifest, proof_text
from .neighbours import nearest_neighbours
from .packing import pack_documents
from .quality import quality_rules
from .secrets import secret_spans
from .sentence_pieces import sentence_pieces
from .substring import substring_dedup
from .token_counts import document_token_counts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SENTENCE_PIECES = public_tokenizers.path("piece_bpe_32k.model")
END_OF_TEXT = 50256


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality_rules(_table(spark, sf_dir, "documents"), ["doc_id"])
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), k=20, query_modulus=20)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), BYTE_BPE, capacity=2048, end_id=0)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.col("spans_text").alias("spans"))


def op6_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(_table(spark, sf_dir, "documents"), ["doc_id"], WORD_BPE)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), ["doc_id"], window=35)


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(_table(spark, sf_dir, "documents"), ["doc_id"])


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(_table(spark, sf_dir, "documents"), BYTE_BPE, END_OF_TEXT)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, field_digest("doc_id", "source", "lang", "n_chars", lowered))
    leaf = field_digest("doc_id", "source", "lang", "n_chars", "text")
    proved = merkle_manifest(docs.withColumn("_tampered", tampered), leaf, "lang", ["doc_id"], ["doc_id", "_tampered"])
    found = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text("path"), 256).alias("proof_sha256"), folded(F.coalesce("_tampered", "leaf"), "path").alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_sentencepiece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentence_pieces(_table(spark, sf_dir, "documents"), ["doc_id"], SENTENCE_PIECES)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the contract's damage, by the checksum of each row's key."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy")
    return rows.filter("h <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    repair = repair_conversations(_damaged(rows))
    audits = repair.audits.withColumnRenamed("conv_id", "_c")
    found = rows.select("conv_id").distinct().join(audits, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    found = found.join(conversation_digests(repair.turns), F.col("conv_id").eqNullSafe(F.col("conversation")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_approximate_nearest_neighbours,
        op3_best_fit_packing,
        op4_quality_rules,
        op5_secret_scans,
        op6_bpe_encoding,
        op7_html_extraction,
        op8_substring_dedup,
        op9_license_scans,
        op10_token_counts,
        op11_merkle_manifest,
        op12_sentencepiece_encoding,
        op13_conversation_repair,
    )
}
#: Left out: what SQL can't express or is too slow for on whole tables; those are tested against brute force.
SQL = {
    "op1_ngram_jaccard_join": oracle.NGRAM_JACCARD_JOIN,
    "op4_quality_rules": oracle.QUALITY_RULES,
    "op8_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op11_merkle_manifest": oracle.MERKLE_MANIFEST,
    "op13_conversation_repair": oracle.CONVERSATION_REPAIR,
}
