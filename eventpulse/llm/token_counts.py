"""Token counts of flat token files by a separator scan.

A token file is a run of blocks of ids with nothing but end-of-document ids to tell documents apart; documents
cross blocks. Each block is searched by itself, as an array. A two-level prefix scan over block summaries (within
runs of blocks, and over the runs) gives every block its first document number, its place in the file and the
place of the last separator before it, from which the first count of the block follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe_encoder
from .storage import saved
from .wordblocks import released

BLOCK_TOKENS = 1 << 18
RUN = 1024
TOKENS, NAMES = 0, 1


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A flat token file for each partition of docs (doc_id, text), saved as (file, kind, number, payload): of kind TOKENS the
    blocks (zstd of little-endian unsigned 32-bit ids), of kind NAMES the doc_ids in order. Texts never give end_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, end, file = byte_bpe_encoder(tokenizer, special_as_text=True), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=1).compress
        held, block, at = b"", 0, 0

        def row(kind: int, number: int, payload: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([kind], pa.int32()), pa.array([number], pa.int64()), pa.array([payload], pa.binary())], names=["file", "kind", "number", "payload"])

        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                held += b"".join([x for text in part.column(1) for x in (encoded(text.as_py() or ""), end)])
                names = pa.record_batch([part.column(0)], names=["doc_id"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, names.schema) as writer:
                    writer.write_batch(names)
                yield row(NAMES, at, pack(sink.getvalue().to_pybytes()))
                at += part.num_rows
                while len(held) >= 4 * block_tokens:
                    yield row(TOKENS, block, pack(held[: 4 * block_tokens]))
                    held, block = held[4 * block_tokens :], block + 1
        if held:
            yield row(TOKENS, block, pack(held))

    return saved(docs.select("doc_id", "text").mapInArrow(released(run), "file int, kind int, number long, payload binary"))


def _scanned(end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for file, block, payload in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                ids = np.frombuffer(unpack(payload), dtype="<u4")
                ends = np.flatnonzero(ids == end_id)
                rows.append((file, block, len(ids), len(ends), int(ends[0]) if len(ends) else None, int(ends[-1]) if len(ends) else None, (np.diff(ends) - 1).astype(np.int32).tobytes()))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "block", "n_ids", "n_ends", "first", "last", "inner"])

    return run


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document that ends in a block."""
    for batch in batches:
        files, numbers, counts = [], [], []
        for file, doc, head, inner in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            own = np.concatenate([[head], np.frombuffer(inner, np.int32)])
            files.append(np.full(len(own), file, np.int32))
            numbers.append(doc + np.arange(len(own)))
            counts.append(own)
        merge = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (files, numbers, counts)]
        yield pa.RecordBatch.from_arrays([pa.array(m.astype(t)) for m, t in zip(merge, (np.int32, np.int64, np.int64), strict=True)], names=["file", "doc_no", "n_tokens"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for file, number, payload in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            ids = pa.ipc.open_stream(unpack(payload)).read_all().column(0).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), file, np.int32)), pa.array(number + np.arange(len(ids), dtype=np.int64)), ids.cast(pa.int64())], names=["file", "doc_no", "doc_id"])


def count_tokens(blocks: DataFrame, end_id: int) -> DataFrame:
    """(file, doc_no, n_tokens) for the documents of token files given as (file, number, payload) blocks; the end id
    itself isn't counted, and ids after a file's last separator are a document if there are any."""
    found = saved(blocks.select("file", "number", "payload").mapInArrow(_scanned(end_id), "file int, block long, n_ids long, n_ends long, first long, last long, inner binary"))
    found = found.withColumn("run", F.floor(F.col("block") / RUN))
    within = W.partitionBy("file", "run").orderBy("block")
    before = within.rowsBetween(W.unboundedPreceding, -1)
    local = found.withColumn("at", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    local = local.withColumn("ends", F.coalesce(F.sum("n_ends").over(before), F.lit(0))).withColumn("latest", F.max(F.col("at") + F.col("last")).over(before))
    runs = local.groupBy("file", "run").agg(F.sum("n_ids").alias("run_ids"), F.sum("n_ends").alias("run_ends"), F.max(F.col("at") + F.col("last")).alias("run_latest"))
    over = W.partitionBy("file").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("run_at", F.coalesce(F.sum("run_ids").over(over), F.lit(0))).withColumn("ends_before", F.coalesce(F.sum("run_ends").over(over), F.lit(0)))
    runs = runs.withColumn("latest_before", F.max(F.col("run_at") + F.col("run_latest")).over(over))
    placed = local.join(runs.select("file", "run", "run_at", "ends_before", "latest_before"), ["file", "run"])
    latest = F.coalesce(F.col("run_at") + F.col("latest"), F.col("latest_before"), F.lit(-1))
    head = F.col("run_at") + F.col("at") + F.col("first") - latest - 1
    ended = placed.filter("n_ends > 0").select("file", (F.col("ends_before") + F.col("ends")).alias("doc"), head.alias("head"), "inner").mapInArrow(_expanded, "file int, doc_no long, n_tokens long")
    totals = runs.groupBy("file").agg(F.sum("run_ids").alias("ids"), F.sum("run_ends").alias("doc_no"), F.max(F.col("run_at") + F.col("run_latest")).alias("latest"))
    open_ended = totals.withColumn("n_tokens", F.col("ids") - F.coalesce("latest", F.lit(-1)) - 1).filter("n_tokens > 0").select("file", "doc_no", "n_tokens")
    return ended.unionByName(open_ended)


def document_token_counts(docs: DataFrame, tokenizer: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, file, doc_no, n_tokens, from token files written for the purpose.

    Null and empty texts have no tokens; repeated rows and null doc_ids count like others; a very long text is encoded
    whole in one task and may fill many blocks; other columns are not read; an empty table gives an empty result."""
    files = write_token_files(docs, tokenizer, end_id, block_tokens)
    counts = count_tokens(files.filter(F.col("kind") == TOKENS), end_id)
    names = files.filter(F.col("kind") == NAMES).select("file", "number", "payload").mapInArrow(_named, "file int, doc_no long, doc_id long")
    return names.join(counts, ["file", "doc_no"]).select("doc_id", "file", "doc_no", "n_tokens")
