"""Substring dedup by super-k-mer partitioning.

A window is `window` consecutive words. Consecutive windows that share the occurrence of their minimiser (the
leftmost smallest hash of `core` consecutive words) travel as one packed string of word hashes to the
minimiser's bucket; equal windows have equal minimisers, so they meet there. In the bucket windows are sorted
by a rolling hash and neighbours compared word by word. Equal strings of one block travel once, with the list
of their places. Windows that start twice or more come back as word ranges of their document.

Strings are some three times as long as the text, and most windows occur once. So minimisers are counted first, by
short hashes in buckets, and only strings whose minimiser occurs at another place too are packed.

A phrase with varying words around can be the minimiser of any number of different strings, which all belong to one
bucket. Such hot minimisers are counted before, in a plain aggregation; their windows travel one by one, as two
64-bit hashes, to the bucket of the window's hash. So no bucket grows with one phrase, and the number of buckets
follows the size of the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import refuse_clashes, shuffle_partitions
from .wordblocks import chain, mix, powers, release, released, word_blocks

COUNT_SCHEMA = "bucket int, hashes binary, docs binary, counts binary, ordinals binary"
KEY_SCHEMA = "key long, strings long"
BUCKET_TEXT = 1 << 26  # bytes of text for a bucket of minimisers
FLAG_SCHEMA = "row_hash long, ordinals binary"
BUCKET_SCHEMA = "bucket int, counts binary, places binary, docs binary, starts binary, words binary, unknown binary"
RANGE_SCHEMA = "doc_id long, row_hash long, ranges binary"


def _leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest of each `width` consecutive values."""
    best, at, have = values, np.arange(len(values), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        n = len(best) - step
        right = best[step:] < best[:n]
        at = np.where(right, at[step:], at[:n])
        best = np.where(right, best[step:], best[:n])
        have += step
    return at


def _super_kmers(block, window: int, core: int) -> tuple[np.ndarray, ...]:
    """Of a block's runs of windows with one minimiser occurrence: minimiser hash, first word, windows; and the word hashes."""
    words = block.word_hashes()
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), words
    doc = block.doc_of_words()
    cores = chain(words, core)
    at = _leftmost_minima(cores, window - core + 1)
    valid = doc[:n] == doc[window - 1 :]
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (at[1:] != at[:-1]) | (doc[1:n] != doc[: n - 1])
    first = np.flatnonzero(opens)
    run = np.cumsum(opens) - 1
    count = np.bincount(run[valid], minlength=len(first)) if len(first) else np.zeros(0, np.int64)
    return cores[at[first]], first, count.astype(np.int64), words


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each start and length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _contents(key: np.ndarray, first: np.ndarray, count: np.ndarray, words: np.ndarray, window: int) -> np.ndarray:
    """Hashes of the strings."""
    up, down = powers(len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(words * up[: len(words)], dtype=np.uint64)])
        return mix((total[first + count + window - 1] - total[first]) * down[first] + mix(key) + count.astype(np.uint64))


def _strings_by_key(window: int, core: int):
    """Texts to minimisers with the number of different strings that they have in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in word_blocks(batch.column(0)):
                key, first, count, words = _super_kmers(block, window, core)
                if len(first):
                    _, unique = np.unique(_contents(key, first, count, words, window), return_index=True)
                    key, strings = np.unique(key[unique], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(strings.astype(np.int64))], names=["key", "strings"])

    return released(run)


def _hot_keys(texts: DataFrame, window: int, core: int, hot: int) -> np.ndarray:
    """Minimisers with more than `hot` strings in their bucket, sorted; at most one for each `hot` strings of the input."""
    found = texts.mapInArrow(_strings_by_key(window, core), KEY_SCHEMA).groupBy("key").agg(F.sum("strings").alias("n")).filter(F.col("n") > hot).select("key")
    return np.sort(np.array([r["key"] for r in found.collect()], dtype=np.int64).view(np.uint64))


def _minimisers(window: int, core: int, n_buckets: int, hot: np.ndarray):
    """(row_hash, text) rows to buckets of short minimiser hashes, with their documents and numbers there; without hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.asarray(batch.column(0), dtype=np.int64)
            for block in word_blocks(batch.column(1)):
                key, first, _, _ = _super_kmers(block, window, core)
                if not len(first):
                    continue
                doc = np.searchsorted(block.word_bounds, first, side="right") - 1
                number = np.arange(len(first)) - np.searchsorted(doc, doc)
                bucket = ((key >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                order = order[~np.isin(key[order], hot)]
                if not len(order):
                    continue
                key, doc, number, bucket = key[order], doc[order], number[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                rows = []
                for a, b in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
                    heads = np.flatnonzero(np.diff(doc[a:b], prepend=-1))
                    there = names[block.first + doc[a:b][heads]]
                    rows.append((int(bucket[a]), key[a:b].astype("<u4").tobytes(), there.tobytes(), np.diff(np.append(heads, b - a)).astype(np.int32).tobytes(), number[a:b].astype(np.int32).tobytes()))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.binary()] * 4], strict=True)], names=["bucket", "hashes", "docs", "counts", "ordinals"])

    return released(run)


def _flagged(table: pa.Table) -> pa.Table:
    """For each document the numbers of its strings whose minimiser occurs twice or more."""
    columns = [table.column(c).to_pylist() for c in ("hashes", "docs", "counts", "ordinals")]
    hashes, docs, counts, ordinals = (np.concatenate([np.frombuffer(x, t) for x in c]) for c, t in zip(columns, ("<u4", np.int64, np.int32, np.int32), strict=True))
    docs = np.repeat(docs, counts)
    code, seen = pd.factorize(hashes)
    hit = np.flatnonzero(np.bincount(code, minlength=len(seen))[code] > 1)
    hit = hit[np.lexsort((ordinals[hit], docs[hit]))]
    docs, ordinals = docs[hit], ordinals[hit]
    # Equal rows come with the same numbers.
    new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (ordinals[1:] != ordinals[:-1])])[: len(docs)]
    docs, ordinals = docs[new], ordinals[new]
    cuts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    parts = [ordinals[a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(docs)), strict=True)] if len(docs) else []
    return pa.table({"row_hash": pa.array(docs[cuts], pa.int64()), "ordinals": pa.array(parts, pa.binary())})


def _dealt(window: int, core: int, n_buckets: int, at: dict[str, int]):
    """Rows with the columns of at to buckets of packed strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(at["doc_id"])
            missing = np.asarray(ids.is_null())
            ids, hashes = np.asarray(ids.fill_null(0), dtype=np.int64), np.asarray(batch.column(at["row_hash"]), dtype=np.int64)
            wanted = batch.column(at["wanted"])
            for block in word_blocks(batch.column(at["text"])):
                key, first, count, words = _super_kmers(block, window, core)
                chosen = np.zeros(len(first), dtype=bool)
                heads = np.searchsorted(first, block.word_bounds)
                for i, parts in enumerate(wanted.slice(block.first, block.n).to_pylist()):
                    if parts:
                        own = heads[i] + np.frombuffer(b"".join(parts), np.int32)
                        chosen[own[own < heads[i + 1]]] = True
                key, first, count = key[chosen], first[chosen], count[chosen]
                if not len(first):
                    continue
                content = _contents(key, first, count, words, window)
                yield _packed(block, content, key, first, first, count, count + window - 1, words, n_buckets, ids, hashes, missing)

    return released(run)


def _dealt_windows(window: int, core: int, n_buckets: int, hot: np.ndarray):
    """(doc_id, row_hash, text) rows to buckets of the windows of hot minimisers, each packed as two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            missing = np.asarray(ids.is_null())
            ids, hashes = np.asarray(ids.fill_null(0), dtype=np.int64), np.asarray(batch.column(1), dtype=np.int64)
            for block in word_blocks(batch.column(2)):
                key, first, count, words = _super_kmers(block, window, core)
                chosen = np.isin(key, hot)
                at = _spread(first[chosen], count[chosen])
                if len(at):
                    both = np.stack([chain(words, window)[at], chain(mix(words + np.uint64(1)), window)[at]], axis=1)
                    ones = np.ones(len(at), np.int64)
                    yield _packed(block, both[:, 0] ^ mix(both[:, 1]), both[:, 0], at, 2 * np.arange(len(at)), ones, 2 * ones, both.reshape(-1), n_buckets, ids, hashes, missing)

    return released(run)


def _packed(block, content, key, first, packed_at, count, length, words, n_buckets, ids, hashes, missing) -> pa.RecordBatch:
    """Bucket rows of strings that start at word first of the block and are words[packed_at : packed_at + length]; key gives the bucket."""
    pack = zstandard.ZstdCompressor(level=1).compress
    code, _ = pd.factorize(content)
    _, unique = np.unique(code, return_index=True)
    bucket = (mix(key[unique]) % np.uint64(n_buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")  # unique strings by bucket
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    unique, bucket = unique[order], bucket[order]
    code = rank[code]
    by_string = np.argsort(code, kind="stable")  # all occurrences by string
    places = np.bincount(code, minlength=len(unique))
    doc = np.searchsorted(block.word_bounds, first, side="right") - 1
    start = (first - block.word_bounds[doc])[by_string].astype(np.int32)
    doc = doc[by_string] + block.first
    string_at = np.concatenate([[0], np.cumsum(places)])
    word_at = np.concatenate([[0], np.cumsum(length[unique])])
    packed = words[_spread(packed_at[unique], length[unique])]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows = []
    for a, b in zip(cuts, np.append(cuts[1:], len(unique)), strict=True):
        own = doc[string_at[a] : string_at[b]]
        rows.append((
            int(bucket[a]), count[unique[a:b]].astype(np.int32).tobytes(), places[a:b].astype(np.int32).tobytes(),
            pack(np.stack([ids[own], hashes[own]]).tobytes()), start[string_at[a] : string_at[b]].tobytes(), pack(packed[word_at[a] : word_at[b]].tobytes()), missing[own].tobytes(),
        ))
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.binary()] * 6], strict=True)], names=["bucket", "counts", "places", "docs", "starts", "words", "unknown"]
    )


def _repeated(words: np.ndarray, at: np.ndarray, weight: np.ndarray, window: int) -> np.ndarray:
    """Which of the windows words[at : at + window] occur with a total weight of two or more."""
    seed = np.uint64(1)
    while True:
        up, down = powers(len(words) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(words + seed) * up[: len(words)], dtype=np.uint64)])
            rolled = (total[at + window] - total[at]) * down[at]
        order = np.argsort(rolled, kind="stable")
        rolled = rolled[order]
        fresh = np.concatenate([[True], rolled[1:] != rolled[:-1]])
        later = np.flatnonzero(~fresh)
        left, right = at[order[later - 1]], at[order[later]]
        if all((words[left + i] == words[right + i]).all() for i in range(window)):
            group = np.cumsum(fresh) - 1
            twice = np.bincount(group, weights=weight[order]) >= 2
            out = np.empty(len(at), dtype=bool)
            out[order] = twice[group]
            return out
        seed += np.uint64(1)


def _running_end(end: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The largest end so far, anew from each fresh place on."""
    run = np.cumsum(fresh) - 1
    lift = run * (int(end.max(initial=0)) + 1)
    return np.maximum.accumulate(end + lift) - lift


def _counted(window: int, span: int):
    """Bucket rows to the ranges of repeated windows of packed words; a window stands for span words of its document."""

    def run(table: pa.Table) -> pa.Table:
        out = counted(table)
        release()
        return out

    def counted(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        counts, places, docs, starts, words, unknown = ([] for _ in range(6))
        for row in zip(*(table.column(c).to_pylist() for c in ("counts", "places", "docs", "starts", "words", "unknown")), strict=True):
            counts.append(np.frombuffer(row[0], np.int32))
            places.append(np.frombuffer(row[1], np.int32))
            docs.append(np.frombuffer(unpack(row[2]), np.int64).reshape(2, -1))
            starts.append(np.frombuffer(row[3], np.int32))
            words.append(np.frombuffer(unpack(row[4]), np.uint64))
            unknown.append(np.frombuffer(row[5], bool))
        counts, places, starts, words, unknown = (np.concatenate(x) for x in (counts, places, starts, words, unknown))
        docs = np.concatenate(docs, axis=1)
        length = counts.astype(np.int64) + window - 1
        head = np.cumsum(length) - length
        at = _spread(head, counts.astype(np.int64))
        string = np.repeat(np.arange(len(counts)), counts)
        hit = _repeated(words, at, places[string].astype(np.int64), window)
        at, string = at[hit], string[hit]
        if not len(at):
            return pa.table({"doc_id": pa.array([], pa.int64()), "row_hash": pa.array([], pa.int64()), "ranges": pa.array([], pa.binary())})
        opens = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (string[1:] != string[:-1])])
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(at)) - 1
        string, begin, end = string[first], at[first] - head[string[first]], at[last] - head[string[first]] + span
        place_at = np.cumsum(places) - places
        take = _spread(place_at[string], places[string].astype(np.int64))
        begin = np.repeat(begin, places[string]) + starts[take]
        end = np.repeat(end, places[string]) + starts[take]
        # one row for each document of this bucket
        order = np.lexsort((end, begin, docs[1][take], docs[0][take], unknown[take]))
        take, begin, end = take[order], begin[order], end[order]
        key = np.stack([docs[0][take], docs[1][take], unknown[take]])
        # Equal rows come with the same ranges, and ranges that meet are one.
        fresh = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])
        reach = _running_end(end, fresh)
        opens = fresh | np.concatenate([[True], begin[1:] > reach[:-1]])
        at = np.flatnonzero(opens)
        take, begin, end, key = take[at], begin[at], reach[np.append(at[1:], len(reach)) - 1], key[:, at]
        cuts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        both = np.stack([begin, end], axis=1).astype(np.int32)
        ranges = [both[a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(both)), strict=True)]
        return pa.table({
            "doc_id": pa.array(docs[0][take[cuts]], pa.int64(), mask=unknown[take[cuts]]), "row_hash": pa.array(docs[1][take[cuts]], pa.int64()), "ranges": pa.array(ranges, pa.binary()),
        })

    return run


def _cut(keep: list[str], at: dict[str, int], as_text: bool):
    out = "kept_text" if as_text else "kept_sha256"

    def shortened(text: str | None, parts: list[bytes] | None) -> tuple[int, int, str | None]:
        if as_text and not parts:
            return len((text or "").encode().split()), 0, text
        words = (text or "").encode().split()
        kept, at, removed = [], 0, 0
        if parts:
            for begin, end in sorted(map(tuple, np.concatenate([np.frombuffer(p, np.int32) for p in parts]).reshape(-1, 2).tolist())):
                if end > at:
                    kept += words[at : max(at, begin)]
                    removed += end - max(at, begin)
                    at = end
        kept += words[at:]
        joined = b" ".join(kept)
        return len(words), removed, joined.decode() if as_text else hashlib.sha256(joined).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, parts in zip(*(batch.column(at[c]) for c in ("doc_id", "text", "parts")), strict=True):
                doc = doc.as_py()
                rows.append(shortened(text.as_py(), [p["ranges"] for p in parts.as_py() or [] if p["doc_id"] == doc]))
            n, removed, last = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(last, pa.string())], names=[*keep, "n_words", "n_removed", out]
            )

    return released(run), f"n_words long, n_removed long, {out} string"


def substring_dedup(docs: DataFrame, keep: list[str], window: int = 35, core: int = 5, as_text: bool = False, hot: int = 1 << 15) -> DataFrame:
    """Per row of docs (doc_id, text): keep's columns, n_words, n_removed, and kept_sha256 of the kept words joined by
    one space, or with as_text kept_text: the joined kept words where something goes, else the text unchanged.

    A word goes when a window of `window` words that covers it also starts anywhere else, the same text included.
    Null texts count as empty (kept_text stays null); repeated rows are documents of their own, so their windows
    repeat. Null doc_ids take part. A very long text is one block of arrays some 50 times its size in one task. An empty
    table gives an empty result. Minimisers of more than `hot` strings are split by window. keep must not hold a
    result's name, or that of a working column.
    """
    refuse_clashes(keep, ["n_words", "n_removed", "kept_text", "kept_sha256", "row_hash", "wanted", "parts", "_hash", "_flagged"])
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, shuffle_partitions(docs.sparkSession), size // BUCKET_TEXT)
    keys = _hot_keys(docs.select("text"), window, core, hot)
    source = docs.select(*dict.fromkeys([*keep, "doc_id", "text"]), F.xxhash64("doc_id", "text").alias("row_hash"))
    columns = source.columns
    counted = source.select("row_hash", "text").mapInArrow(_minimisers(window, core, buckets, keys), COUNT_SCHEMA).groupBy("bucket").applyInArrow(_flagged, FLAG_SCHEMA)
    flags = counted.groupBy("row_hash").agg(F.collect_list("ordinals").alias("wanted")).withColumnRenamed("row_hash", "_flagged")
    flagged = source.join(flags, F.col("row_hash") == F.col("_flagged")).select(*columns, "wanted")
    at = {c: i for i, c in enumerate(flagged.columns)}
    found = flagged.mapInArrow(_dealt(window, core, 4 * buckets, at), BUCKET_SCHEMA).groupBy("bucket").applyInArrow(_counted(window, window), RANGE_SCHEMA)
    if len(keys):
        split = source.select("doc_id", "row_hash", "text").mapInArrow(_dealt_windows(window, core, 4 * buckets, keys), BUCKET_SCHEMA)
        found = found.unionByName(split.groupBy("bucket").applyInArrow(_counted(2, window), RANGE_SCHEMA))
    # both joins are on row_hash alone, so that they share one exchange of the texts; doc_ids are compared afterwards
    ranges = found.groupBy("row_hash").agg(F.collect_list(F.struct("doc_id", "ranges")).alias("parts")).withColumnRenamed("row_hash", "_hash")
    joined = source.join(ranges, F.col("row_hash") == F.col("_hash"), "left").select(*columns, "parts")
    run, added = _cut(keep, {c: i for i, c in enumerate(joined.columns)}, as_text)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)
    return joined.mapInArrow(run, f"{kept}, {added}")
