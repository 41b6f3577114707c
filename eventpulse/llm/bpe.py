"""Byte-pair encoding of word tokenizers, by segment trees over the ranks of adjacent pairs.

A word's pairs are the leaves, keyed by (rank, position); the root is the leftmost pair of lowest rank. A merge
changes three leaves, each updated up its path. Short words run together, one merge each a step, as rows of
arrays; long words run alone. Words are encoded once for as long as their part of the text stays in the cache.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_symbols
from .pieces import BARE_PARTS, PartCache, cache_for
from .storage import refuse_clashes
from .wordblocks import released

NONE = np.int64(1) << 62
TOGETHER = 64
CELLS = 1 << 19


class WordBpe:
    """Encoder and decoder of a tokenizers file with byte-level symbols and an end-of-word suffix."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.merged = keys[self.order], merged
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        rank = self.ranks(left, right)
        return np.where(rank >= 0, rank * width + at, NONE)

    def _together(self, data: np.ndarray, lengths: np.ndarray, width: int) -> list[np.ndarray]:
        """Words of at most `width` bytes (a power of two), their bytes as rows of data."""
        n = len(lengths)
        rows, column = np.arange(n), np.arange(width)
        ids = np.zeros((n, width + 1), dtype=np.int64)
        ids[:, :width] = self.inner[data]
        ids[rows, lengths - 1] = self.last[data[rows, lengths - 1]]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        alive = column[None, :] < lengths[:, None]
        tree = np.full((n, 2 * width), NONE)
        r, c = np.nonzero(column[None, :] < lengths[:, None] - 1)
        tree[r, width + c] = self._leaf(ids[r, c], ids[r, c + 1], c, width)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def update(r: np.ndarray, at: np.ndarray, value) -> None:
            node = width + at
            tree[r, node] = value
            step = width
            while step > 1:
                node = node // 2
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                step //= 2

        active = rows[tree[:, 1] < NONE]
        while len(active):
            rank, at = np.divmod(tree[active, 1], width)
            gone = after[active, at]
            follow = after[active, gone]
            ids[active, at] = self.merged[rank]
            alive[active, gone] = False
            after[active, at] = follow
            inside = follow < lengths[active]
            before[active[inside], follow[inside]] = at[inside]
            update(active, gone, NONE)
            update(active, at, np.where(inside, self._leaf(ids[active, at], ids[active, np.minimum(follow, width)], at, width), NONE))
            left = before[active, at]
            has = left >= 0
            r, at, left = active[has], at[has], left[has]
            update(r, left, self._leaf(ids[r, left], ids[r, at], left, width))
            active = active[tree[active, 1] < NONE]
        flat = ids[:, :width][alive]
        return np.split(flat, np.cumsum(alive.sum(axis=1))[:-1])

    def _alone(self, data: bytes) -> np.ndarray:
        n, width = len(data), 1 << (len(data) - 1).bit_length()
        ids = self.inner[np.frombuffer(data, np.uint8)].tolist()
        ids[-1] = int(self.last[data[-1]])
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        none = int(NONE)

        def leaf(at: int) -> int:
            rank = self.rank_of.get(ids[at] << 20 | ids[after[at]]) if after[at] < n else None
            return none if rank is None else rank * width + at

        tree = [none] * width + [leaf(i) for i in range(n)] + [none] * (width - n)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(at: int, value: int) -> None:
            node = width + at
            tree[node] = value
            while node > 1:
                node //= 2
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            ids[at], alive[gone], after[at] = int(self.merged[rank]), False, after[gone]
            if after[at] < n:
                before[after[at]] = at
            update(gone, none)
            update(at, leaf(at))
            if before[at] >= 0:
                update(before[at], leaf(before[at]))
        return np.array([i for i, kept in zip(ids, alive, strict=True) if kept], dtype=np.int64)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        raw = [w.encode() for w in words]
        out: list = [None] * len(raw)
        widths: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            if len(w) > TOGETHER:
                out[i] = self._alone(w)
            else:
                widths.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, members in widths.items():
            for at in range(0, len(members), CELLS // width):
                part = members[at : at + CELLS // width]
                data = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in part), np.uint8).reshape(-1, width)
                found = self._together(data, np.array([len(raw[i]) for i in part]), width)
                for i, ids in zip(part, found, strict=True):
                    out[i] = ids
        return out

    def words(self, part: str) -> list[str]:
        """Normalised and split as the file's normalizer and split pattern do."""
        if not part.isascii():
            part = unicodedata.normalize("NFC", part)
        part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
        return self.pattern.findall(part)

    def encode_parts(self, parts: list[str]) -> list[tuple[bytes, int, bytes]]:
        """(ids, number, decoded) of each part."""
        pieces: list[list] = []  # of each part its words, or the id of a special token
        for part in parts:
            if self.special_pattern is not None and "<|" in part:
                split = self.special_pattern.split(part)
                pieces.append([x for s in split if s for x in ([self.special[s]] if s in self.special else self.words(s))])
            else:
                pieces.append(self.words(part))
        flat = list({w for own in pieces for w in own if isinstance(w, str)})
        known = dict(zip(flat, self.encode_words(flat), strict=True))
        out = []
        for own in pieces:
            ids = [int(i) for w in own for i in (known[w] if isinstance(w, str) else [w])]
            out.append((np.array(ids, dtype="<u4").tobytes(), len(ids), " ".join(self.names[i] for i in ids).encode()))
        return out


def _cache(path: str) -> PartCache:
    return cache_for(("word_bpe", path), lambda: WordBpe(path).encode_parts)


def encode_and_decode(docs: DataFrame, keep: list[str], tokenizer: str, text: str = "text") -> DataFrame:
    """Per row of docs: keep's columns, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit) and decoded_sha256
    (the decoded text: tokens joined by one space, as without a decoder). Null and empty texts have no ids and decode to
    the empty text; every row is treated by itself, whatever repeats; a very long text is encoded whole in one task; an empty
    table gives an empty result. keep must not hold a result's name."""
    refuse_clashes(keep, ["n_tokens", "ids_sha256", "decoded_sha256", "_text"])
    source = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts, ids, decoded = [], [], []
                for values in cache.values([BARE_PARTS.findall(t or "") for t in part.column("_text").to_pylist()]):
                    counts.append(sum(n for _, n, _ in values))
                    ids.append(hashlib.sha256(b"".join([v for v, _, _ in values])).hexdigest())
                    decoded.append(hashlib.sha256(b" ".join([d for _, n, d in values if n])).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.select(*keep).schema)
    return source.mapInArrow(released(run), f"{kept}n_tokens long, ids_sha256 string, decoded_sha256 string")
