"""Best-fit packing of token pieces by minimum bin slack.

Spark encodes, cuts and counts the pieces of each length. The plan is made on that histogram, whose size is the
capacity whatever the input: per bin the longest piece left opens it, a bitset subset-sum over the lengths left
finds the fullest feasible combination, and the combination is taken out as often as its counts allow. The plan
holds at most about capacity x ln(capacity) combinations. Pieces are then numbered within their length, in salted
groups with offsets, and every number maps to its place by a search in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe_encoder
from .storage import saved, shuffle_partitions
from .wordblocks import released


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each row's ids with end_id after them; only texts longer than
    the capacity are cut, and then the first piece takes what does not fill one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, end = byte_bpe_encoder(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                row, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(part.column(1)):
                    ids = encoded(text.as_py() or "") + end
                    total = len(ids) // 4
                    first = (total - 1) % capacity + 1
                    cuts = [0, *range(first, total + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of lengths, at most counts of each, with the largest sum not over room."""
    reached, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reached))
            reached |= (reached << (length * k)) & mask
            left -= k
            k *= 2
        if reached >> room & 1:
            break
    total = reached.bit_length() - 1
    taken: dict[int, int] = {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + k
            total -= length * k
    return taken


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations and how many bins each fills; all pieces are used up."""
    left, plan = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        seed = max(left)
        rest = left | {seed: left[seed] - 1}
        taken = fullest({n: c for n, c in rest.items() if c and n <= capacity - seed}, capacity - seed)
        taken[seed] = taken.get(seed, 0) + 1
        times = min(left[n] // k for n, k in taken.items())
        plan.append((taken, times))
        for n, k in taken.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return plan


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length and combination: the first number it serves, how many a bin, the first bin and the offset."""
    used: dict[int, int] = {}
    rows, bins = [], 0
    for taken, times in plan:
        offset = 0
        for length, k in sorted(taken.items(), reverse=True):
            rows.append((length, used.get(length, 0), k, bins, offset))
            used[length] = used.get(length, 0) + k * times
            offset += length * k
        bins += times
    rows.sort()
    return dict(zip(("length", "first", "each", "bin", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 5).T, strict=True))


def _placed(slots: dict[str, np.ndarray]):
    key = (slots["length"] << 44) + slots["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (np.asarray(batch.column(c), dtype=np.int64) for c in ("length", "number"))
            at = np.searchsorted(key, (length << 44) + number, side="right") - 1
            copy, k = np.divmod(number - slots["first"][at], slots["each"][at])
            own = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            placed = [pa.array(slots["bin"][at] + copy), pa.array(slots["offset"][at] + k * length)]
            yield pa.RecordBatch.from_arrays(own + placed, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of each row of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id and
    offset; offsets of a sequence are gapless from 0 and its lengths sum to the capacity at most.

    Null and empty texts have one piece, the end id. Repeated rows and null doc_ids are packed like others. A very long
    text is encoded whole in one task. Other columns, whatever their names, are not read. An empty table gives an empty
    result. Pieces of one length are all alike: which of them goes where is decided by salt, doc_id, piece and checksum.
    """
    pieces = saved(token_pieces(docs, tokenizer, capacity, end_id).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shuffle_partitions(docs.sparkSession))).cast("int")))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = _slots(plan_bins(counts, capacity))
    groups = pieces.groupBy("length", "salt").count()
    before = F.sum("count").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    groups = groups.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = pieces.withColumn("own", own).join(groups, ["length", "salt"]).withColumn("number", F.col("before") + F.col("own") - 1)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(_placed(slots), schema)
