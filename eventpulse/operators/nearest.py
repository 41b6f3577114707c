"""Texts nearest by edit distance within blocks, exactly, without pairing all texts of a block.

Pairs of a similarity share several stretches of q characters, so they meet in an index: each text is listed under the rarest of its
stretches, as many as the number that may be missing asks for, and pairs that meet are filtered by length and measured. What
finds nothing that near is rare; it is measured against its block in cells of bounded size, left part by right part, where
counts of characters tell most pairs apart from the best one before any distance is taken.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventpulse.functions.numbers import rounded
from eventpulse.sources.files import saved

#: (least similarity in percent, characters a stretch): every pair as similar shares a stretch (see stretches_shared).
PASSES = ((90, 3), (75, 2))
#: Rarity is counted in so many buckets, the only counts that reach the driver.
BUCKETS = 1 << 16
LEFT_CELL, RIGHT_CELL = 1024, 4096
_HISTOGRAM, _CELLS, _AT_ONCE = 32, 1 << 20, 1024


def edit_similarity(a: Column, b: Column) -> Column:
    """100 x (1 - edit distance / longer length); two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.coalesce(rounded(F.try_divide((longest - F.levenshtein(a, b)).cast("double"), longest.cast("double")) * 100, 2), F.lit(100.0))


def stretches_shared(longest: int, percent: int, q: int) -> int:
    """How many stretches of q characters two texts share at least, counted with repeats, if the longer one has so many
    characters and they are `percent` similar: each edit spoils q of them."""
    return longest - q + 1 - q * ((100 - percent) * longest // 100)


def _stretches(text: str, q: int) -> list[str]:
    """Stretches of a text; the second of a kind is marked 2, and so on, so that common ones count with repeats."""
    seen: Counter = Counter()
    out = []
    for i in range(len(text) - q + 1):
        s = text[i : i + q]
        seen[s] += 1
        out.append(s if seen[s] == 1 else f"{s}{seen[s]}")
    return out


def _bucket(stretch: str) -> int:
    return zlib.crc32(stretch.encode()) % BUCKETS


def _listed(text: str, percent: int, q: int, counts: np.ndarray) -> list[str]:
    """The rarest stretches of a text, one of which every text as similar lists too."""
    own = _stretches(text, q)
    # No text as similar is shorter than this text's share, so it shares as many as this formula's least over longer ones.
    least = max(1, -(-(len(text) * (100 - q * (100 - percent))) // 100) - q + 1)
    own.sort(key=lambda s: (counts[_bucket(s)], s))
    return own[: max(0, len(own) - least + 1)]


def _rarity(texts: DataFrame, q: int) -> np.ndarray:
    """How often stretches of each bucket occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            found = [_bucket(s) for t in batch.column(0).to_pylist() for s in _stretches(t, q)]
            total += np.bincount(np.array(found, np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    for row in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        counts[row.bucket] = row.n
    return counts


def _indexed(texts: DataFrame, text: str, percent: int, q: int, counts: np.ndarray, out: str) -> DataFrame:
    """texts with one row for each listed stretch."""
    at = texts.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [_listed(t, percent, q, counts) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.string()))], names=[*batch.schema.names, "_list"])

    schema = T.StructType([*texts.schema.fields, T.StructField("_list", T.ArrayType(T.StringType()))])
    return texts.mapInArrow(run, schema).select(*texts.columns, F.explode("_list").alias(out))


def similar_pairs(left: DataFrame, right: DataFrame, block: list[str], percent: int, q: int) -> DataFrame:
    """(block, left_text, right_text): all pairs of different rows' texts (block, left_text) and (block, right_text) of one
    block that are at least `percent` similar; equal texts are among them. Null blocks and texts meet nothing."""
    left, right = (side.select(*block, text).dropna().distinct() for side, text in ((left, "left_text"), (right, "right_text")))
    counts = _rarity(right.select("right_text"), q)
    met = _indexed(left, "left_text", percent, q, counts, "_stretch").join(_indexed(right, "right_text", percent, q, counts, "_stretch"), [*block, "_stretch"])
    a, b = F.length("left_text"), F.length("right_text")
    longest = F.greatest(a, b)
    # The length filter, then the distance, given up beyond what the percentage allows.
    near = met.filter(F.least(a, b) * 100 >= percent * longest).select(*block, "left_text", "right_text").distinct()
    distance = F.levenshtein("left_text", "right_text")
    near = near.filter(F.col("left_text") != F.col("right_text")).filter(distance * 100 <= (100 - percent) * longest)
    equal = left.withColumn("right_text", F.col("left_text")).join(right, [*block, "right_text"], "left_semi").select(*block, "left_text", "right_text")
    return near.unionByName(equal)


def edit_distances(text: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Edit distances of one text (code points) to rows of others, of the given lengths, all at once. For texts of up to 64
    characters a column of the table is two words of bits (steps up and down), so a step takes a few word operations for all rows;
    for longer ones a row is built from the one above, where insertions run along it as a running minimum."""
    if 0 < len(text) <= 64 and others.shape[1]:
        kinds, codes = np.unique(others, return_inverse=True)
        return _by_bits(text, kinds, codes.reshape(others.shape), lengths)
    width = others.shape[1]
    along = np.arange(width + 1, dtype=np.int32)
    row = np.broadcast_to(along, (len(others), width + 1))
    for i, c in enumerate(text.tolist()):
        new = np.empty((len(others), width + 1), dtype=np.int32)
        new[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (others != c), out=new[:, 1:])
        new -= along
        np.minimum.accumulate(new, axis=1, out=new)
        row = new + along
    return row[np.arange(len(others)), lengths]


def _by_bits(text: np.ndarray, kinds: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The same for texts of up to 64 characters; others are given as numbers of their kinds of characters, in order."""
    m, one = len(text), np.uint64(1)
    places = np.zeros(len(kinds), dtype=np.uint64)
    at = np.minimum(np.searchsorted(kinds, text), len(kinds) - 1)
    known = kinds[at] == text
    np.bitwise_or.at(places, at[known], (one << np.arange(m, dtype=np.uint64))[known])
    equal = places[codes.T]
    up, down = np.full(len(codes), ~np.uint64(0)), np.zeros(len(codes), dtype=np.uint64)
    last, score = np.uint64(m - 1), np.full(len(codes), m, dtype=np.int64)
    scores = np.empty((codes.shape[1] + 1, len(codes)), dtype=np.int64)
    scores[0] = m
    with np.errstate(over="ignore"):
        for j, eq in enumerate(equal):
            across = (((eq & up) + up) ^ up) | eq
            rises, falls = down | ~(across | up), up & across
            score = score + ((rises >> last) & one).astype(np.int64) - ((falls >> last) & one).astype(np.int64)
            scores[j + 1] = score
            rises, falls = (rises << one) | one, falls << one
            along = eq | down
            up, down = falls | ~(along | rises), rises & along
    return scores[lengths, np.arange(len(codes))]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of code points, -1 beyond their end, and their lengths."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.full((len(texts), int(lengths.max(initial=0))), -1, dtype=np.int32)
    for i, t in enumerate(texts):
        out[i, : lengths[i]] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<i4")
    return out, lengths


def _histograms(points: np.ndarray) -> np.ndarray:
    """Characters of each text by the low bits of their code point; texts share at most what these have in common."""
    out = np.zeros((len(points), _HISTOGRAM), dtype=np.int32)
    rows, columns = np.nonzero(points >= 0)
    np.add.at(out, (rows, points[rows, columns] % _HISTOGRAM), 1)
    return out


def _percent(distance: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """As edit_similarity, of distances."""
    with np.errstate(invalid="ignore", divide="ignore"):
        exact = (longest - distance).astype(np.float64) / longest * 100
    return np.where(longest > 0, np.floor(exact * 100 + 0.5) / 100, 100.0)


class _Side:
    def __init__(self, rows: pa.Table):
        self.texts = rows.column("_text").to_pylist()
        self.labels, self.venues = (np.array(rows.column(c).to_pylist(), dtype=object) for c in ("_label", "_venue"))
        self.bonus, self.rank = (rows.column(c).to_numpy() for c in ("_bonus", "_rank"))
        # Texts of like length together, so that a few long ones don't widen all rows.
        order = np.argsort([len(t) for t in self.texts], kind="stable")
        self.groups = []
        for at in range(0, len(order), 1024):
            own = order[at : at + 1024]
            points, lengths = code_points([self.texts[i] for i in own])
            kinds, codes = np.unique(points, return_inverse=True)
            self.groups.append((own, points, kinds, codes.reshape(points.shape), lengths, _histograms(points)))


def _best_in(side: _Side, text: str, label: str, venue: str, venue_cost: float) -> tuple[float, bool, int, float]:
    """(value, whether the label is the same, -rank, score) of the best right text: value is the score and the bonus."""
    points, _ = code_points([text])
    histogram, best = _histograms(points)[0], (-np.inf, False, 0, 0.0)
    for own, others, kinds, codes, lengths, theirs in side.groups:
        longest = np.maximum(lengths, len(text))
        cost = np.where((venue != "") & (side.venues[own] != "") & (side.venues[own] != venue), venue_cost, 0.0)
        common = np.minimum(theirs, histogram).sum(axis=1)
        ceiling = _percent(longest - common, longest) - cost + side.bonus[own]
        order = np.argsort(-ceiling, kind="stable")
        at_once = max(1, min(_AT_ONCE, _CELLS // (others.shape[1] + 1)))
        for at in range(0, len(order), at_once):
            part = order[at : at + at_once]
            part = part[ceiling[part] >= best[0]]
            if not len(part):
                break
            distance = longest[part].copy()
            some = np.flatnonzero(common[part] > 0)  # the others are as far as can be
            if not len(some):
                pass
            elif len(text) <= 64:
                distance[some] = _by_bits(points[0], kinds, codes[part[some]], lengths[part[some]])
            else:
                distance[some] = edit_distances(points[0], others[part[some]], lengths[part[some]])
            score = _percent(distance, longest[part]) - cost[part]
            value = score + side.bonus[own[part]]
            same = (label != "") & (side.labels[own[part]] == label)
            top = max(zip(value.tolist(), same.tolist(), (-side.rank[own[part]]).tolist(), score.tolist(), strict=True))
            best = max(best, top)
    return best


def _cell(venue_cost: float, block: list[str]):
    def run(rows: pa.Table) -> pa.Table:
        side = rows.column("_side").to_numpy()
        left, right = (rows.filter(pa.array(side == s)) for s in (0, 1))
        if not left.num_rows or not right.num_rows:
            return left.slice(0, 0).select([*block, "_text", "_label", "_venue", "_rank", "_bonus", "_same"])
        held = _Side(right)
        found = [_best_in(held, *row, venue_cost) for row in zip(*(left.column(c).to_pylist() for c in ("_text", "_label", "_venue")), strict=True)]
        value, same, rank, _ = zip(*found, strict=True)
        new = [pa.array([-r for r in rank], pa.int64()), pa.array(value, pa.float64()), pa.array(same, pa.bool_())]
        return pa.Table.from_arrays([left.column(c) for c in [*block, "_text", "_label", "_venue"]] + new, names=[*block, "_text", "_label", "_venue", "_rank", "_bonus", "_same"])

    return run


def best_in_cells(left: DataFrame, right: DataFrame, block: list[str], venue_cost: float = 0.0) -> DataFrame:
    """Best right row of each left row (block, text, label, venue, all but the block not null): the same columns with rank and
    value. right has (block, text, label, venue, bonus, rank); rank is a number of its own for each row. value is the edit
    similarity, less venue_cost where both venues are named and differ, and the bonus; ties by an equal label, then the smaller rank.

    A block becomes cells of about LEFT_CELL by RIGHT_CELL rows, each a task's group, however large it is; each left row
    has one candidate a cell. Left rows of blocks without right rows, and null blocks, have no result."""
    own = [*block, "text", "label", "venue"]
    left, right = left.select(*own).dropna(subset=block).distinct(), right.dropna(subset=block)
    parts = [side.groupBy(*block).agg(F.ceil(F.count("*") / most).cast("int").alias(n)) for side, n, most in ((left, "_ln", LEFT_CELL), (right, "_rn", RIGHT_CELL))]
    sizes = parts[0].join(parts[1], block)

    def dealt(side: DataFrame, number: int, key: Column, mine: str, other: str, rank: Column, bonus: Column) -> DataFrame:
        places = {mine: F.pmod(key, F.col(mine.replace("p", "n"))).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(other.replace("p", "n")) - 1))}
        rows = side.join(sizes, block)
        return rows.select(*block, places["_lp"].alias("_lp"), places["_rp"].alias("_rp"), F.lit(number).alias("_side"), F.col("text").alias("_text"), F.col("label").alias("_label"), F.col("venue").alias("_venue"), rank.alias("_rank"), bonus.alias("_bonus"), F.lit(False).alias("_same"))

    key = F.xxhash64("text", "label", "venue")
    rows = dealt(left, 0, key, "_lp", "_rp", F.lit(0).cast("long"), F.lit(0.0)).unionByName(dealt(right, 1, F.xxhash64("rank"), "_rp", "_lp", F.col("rank").cast("long"), F.col("bonus").cast("double")))
    schema = T.StructType([*[left.schema[c] for c in block], *[T.StructField(c, T.StringType()) for c in ("_text", "_label", "_venue")], T.StructField("_rank", T.LongType()), T.StructField("_bonus", T.DoubleType()), T.StructField("_same", T.BooleanType())])
    found = rows.groupBy(*block, "_lp", "_rp").applyInArrow(_cell(venue_cost, block), schema)
    best = found.groupBy(*block, "_text", "_label", "_venue").agg(F.max_by(F.struct(F.col("_rank").alias("rank"), F.col("_bonus").alias("value")), F.struct("_bonus", "_same", -F.col("_rank"))).alias("_best"))
    return best.select(*block, F.col("_text").alias("text"), F.col("_label").alias("label"), F.col("_venue").alias("venue"), "_best.rank", "_best.value")


def nearest_by_edit(left: DataFrame, right: DataFrame, block: list[str], passes: tuple[tuple[int, int], ...] = PASSES) -> DataFrame:
    """(block, text, rank, score): the most similar right row (block, text, rank) of each distinct left (block, text); ties to the
    smaller rank. Left texts whose block has no right row have no result."""
    todo, done = saved(left.select(*block, "text").dropna().distinct()), []
    right = right.dropna(subset=[*block, "text"])
    smallest = right.groupBy(*block, "text").agg(F.min("rank").alias("rank"))
    for percent, q in passes:
        pairs = similar_pairs(todo.withColumnRenamed("text", "left_text"), right.withColumnRenamed("text", "right_text"), block, percent, q)
        scored = pairs.withColumn("score", edit_similarity(F.col("left_text"), F.col("right_text"))).join(smallest.withColumnRenamed("text", "right_text"), [*block, "right_text"])
        best = scored.groupBy(*block, F.col("left_text").alias("text")).agg(F.max_by(F.struct("rank", "score"), F.struct("score", -F.col("rank"))).alias("_best")).select(*block, "text", "_best.*")
        best = saved(best.filter(F.col("score") > percent))
        done.append(best)
        todo = saved(todo.join(best, [*block, "text"], "left_anti"))
    blank = [F.lit("").alias("label"), F.lit("").alias("venue")]
    rest = best_in_cells(todo.select("*", *blank), smallest.select("*", *blank, F.lit(0.0).alias("bonus")), block)
    return reduce(DataFrame.unionByName, [*done, rest.select(*block, "text", "rank", F.col("value").alias("score"))])
