"""SentencePiece encoding and decoding through a table of distinct marked words.

A text is marked as the library does: white-space characters of the model become markers, and one more stands before the
text. Where no piece holds a marker after another character, no piece reaches over the place before a run of markers, so
the words between such places, each with its markers, are segmented by themselves. Each block of texts is one array of words; a dictionary
lists its distinct ones, those not met lately are segmented by the library, and ids and decoded words are taken back to the
words' positions. The tables are made block by block: a table of a whole corpus' words would have to be joined with every
word of every text, which moves more than the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PartCache, cache_for
from .storage import refuse_clashes
from .wordblocks import released, text_blocks

MARKER = "▁"
#: Shows whether a model keeps texts as they are: ligatures, wide and repeated spaces, composed and decomposed letters.
PROBE = "  a  ﬁ 　éé \t b\n  "


class PieceModel:
    """A model file; segments marked words."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [library.id_to_piece(i) for i in range(library.vocab_size())]
        crossing = [p for p in pieces if MARKER in p.lstrip(MARKER)]
        first = library.encode("a", out_type=str)
        if crossing or library.decode(library.encode(PROBE)) != PROBE or not first[0].startswith(MARKER) or library.piece_to_id(MARKER) == library.unk_id():
            raise ValueError(f"{path}: words can't be segmented apart: pieces cross markers, or the model changes texts or sets no marker before them")
        self.end, self.lone = library.eos_id(), library.piece_to_id(MARKER)

    def segmented(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded) of words whose first marker is left out, as it is the library that sets it; the decoded text is
        without it too. The empty word is a lone marker, which the library doesn't set before an empty text."""
        ids = [i if w else [self.lone] for w, i in zip(words, self.library.encode(words, num_threads=1), strict=True)]
        texts = self.library.decode(ids, num_threads=1) if ids else []
        return [(np.array(i, "<i4").tobytes(), t.encode() if w else b"") for w, i, t in zip(words, ids, texts, strict=True)]


_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """One model a Python worker."""
    if path not in _MODELS:
        _MODELS.clear()
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _cache(path: str) -> PartCache:
    return cache_for(("sentence_pieces", path), lambda: piece_model(path).segmented)


def _offsets(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def marked_words(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words, number of words up to each text's end) of texts that lie in data between bounds. A word begins with each text
    and at each first space of a run; that space, its marker, is left out."""
    space = data == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[heads] = True
    marker = begins.copy()
    marker[heads] = False
    starts = np.flatnonzero(begins)
    dropped = _offsets(marker)
    offsets = np.concatenate([starts - dropped[starts], [len(data) - dropped[-1]]]).astype(np.int64)
    kept = np.ascontiguousarray(data[~marker])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept))
    return words, np.searchsorted(starts, bounds[1:])


def _encoded(texts: pa.Array, path: str, end: bool) -> Iterator[tuple[int, int, pa.Array, pa.Array]]:
    """(first text, texts, their ids, their decoded texts) of blocks."""
    model, cache = piece_model(path), _cache(path)
    for data, bounds, first in text_blocks(pc.replace_substring(texts.cast(pa.large_string()), MARKER, " ")):
        words, upto = marked_words(data, bounds)
        table = words.dictionary_encode()
        place = table.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        rows = cache.values([table.dictionary.to_pylist()])[0]
        n, many = len(rows), len(bounds) - 1
        # Row n is the end id. Of decoded words there are three kinds: with the marker's space, a text's first word without, and the end's.
        ids = np.frombuffer(b"".join([r[0] for r in rows]) + np.array([model.end], "<i4").tobytes(), "<i4")
        sizes = np.array([len(r[0]) // 4 for r in rows] + [1], dtype=np.int64)
        decoded = [b" " + r[1] for r in rows] + [r[1] for r in rows] + [b""]
        lengths = np.diff(np.concatenate([[0], upto]))
        heads = (upto - lengths)[lengths > 0]
        shown = place.copy()
        shown[heads] += n
        if end:
            place, shown, lengths = np.insert(place, upto, n), np.insert(shown, upto, 2 * n), lengths + 1
        of_text = _offsets(lengths)
        flat = pa.LargeListArray.from_arrays(pa.array(_offsets(sizes)), pa.array(ids)).take(pa.array(place)).flatten()
        text = pa.array(decoded, pa.large_binary()).take(pa.array(shown))
        id_offsets = _offsets(sizes[place])[of_text]
        text_offsets = _offsets(np.array([len(d) for d in decoded], dtype=np.int64)[shown])[of_text]
        whole = np.frombuffer(text.buffers()[2] or b"", np.uint8)[: text_offsets[-1]]
        yield (
            first, many, pa.ListArray.from_arrays(pa.array(id_offsets.astype(np.int32)), flat),
            pa.LargeStringArray.from_buffers(many, pa.py_buffer(text_offsets), pa.py_buffer(np.ascontiguousarray(whole))).cast(pa.string()),
        )


def sentence_pieces(docs: DataFrame, keep: list[str], model: str, text: str = "text", end: bool = True) -> DataFrame:
    """Per row of docs: the columns to keep, ids (array<int>) and decoded, as the sentencepiece library's encode, with its end
    id if asked for, and decode give them.

    A null text counts as empty: no id but the end id, and the empty text. Texts are encoded whole; a very long one, or a very long
    word, in one task. Repeated rows and any columns to keep pass as they are; an empty table gives an empty result; keep must not hold a
    result's name. The model must keep texts as they are, set a marker before them and have no piece over a word's
    start; others are refused."""
    refuse_clashes(keep, ["ids", "decoded", "_text"])
    source = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, many, ids, decoded in _encoded(batch.column("_text"), model, end):
                part = batch.slice(first, many)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in range(len(keep))] + [ids, decoded], names=[*keep, "ids", "decoded"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.select(*keep).schema)
    return source.mapInArrow(released(run), f"{kept}ids array<int>, decoded string")
