"""Approximate nearest neighbours by cross-polytope hashing.

Equal vectors are one member. Members are hashed in several tables: a pseudo-rotation (three rounds of random
signs and a fast Hadamard transform) and the signed axis nearest to the rotated unit vector; as the table grows,
further rotations refine the buckets, which hold about four members at every size. Queries probe, in each table, the
buckets that cost least, found by a beam over the rotations. Stretches of buckets meet their probing queries in one
task group, which scores and keeps each query's best; the partial lists are merged per query. Crowded groups
are split, their queries repeated. Queries that found too few rows are finished exactly, against all members in
blocks. The best are reranked by scores computed once for each pair, in double precision, from the original vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventpulse.operators.numbering import numbered

from .storage import saved, shuffle_partitions
from .wordblocks import released

GROUP = 4096
BATCH = 2048
BUCKET = 4
SPARE = 8


def _valid(dtype: type):
    """(vec_id, key, vector): rows that take part, the vector as dtype, the key the same for equal vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, vectors = [], [], []
            for vec_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if vec_id is None or not value.is_valid or value.values.null_count or not len(value.values):
                    continue
                own = np.asarray(pc.cast(value.values, pa.from_numpy_dtype(dtype), safe=False), dtype=dtype) + dtype(0)
                if np.isfinite(own).all() and own.any():
                    ids.append(vec_id)
                    vectors.append(own.tobytes())
                    keys.append(hashlib.blake2b(vectors[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "key", "vector"])

    return released(run)


def _matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    """Rows of doubles."""
    whole = b"".join(vectors)
    return np.frombuffer(whole, np.float32 if len(whole) == 4 * dim * len(vectors) else np.float64).reshape(-1, dim).astype(np.float64)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row, orthonormal; the number of columns is a power of two."""
    n, d = x.shape
    half = 1
    while half < d:
        x = x.reshape(n, d // (2 * half), 2, half)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
        half *= 2
    return x.reshape(n, d) / np.sqrt(d)


class CrossPolytope:
    """Bucket numbers and probed buckets of about `buckets` buckets, in mixed radix over the rotations of a table."""

    def __init__(self, dim: int, tables: int, buckets: int, probes: int, radius: float | None, seed: int = 17):
        self.dim, self.tables, self.radius = dim, tables, radius
        self.width = 1 << (dim + (radius is not None) - 1).bit_length()
        self.sizes: list[int] = []  # signed axes that each rotation takes part with
        while buckets >= 2:
            self.sizes.append(2 * self.width if not self.sizes else min(2 * self.width, 1 << (buckets.bit_length() - 1)))
            buckets = -(-buckets // self.sizes[-1])
        self.buckets = int(np.prod(self.sizes, dtype=np.int64))
        self.probes = min(probes, self.buckets)
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, max(1, len(self.sizes)), 3, self.width))

    def prepared(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors, padded; of unequal lengths, members get one more coordinate, so that nearest means largest product."""
        out = np.zeros((len(x), self.width))
        length = np.linalg.norm(x, axis=1, keepdims=True)
        if query or self.radius is None:
            out[:, : self.dim] = x / length
        else:
            out[:, : self.dim] = x / self.radius
            out[:, self.dim] = np.sqrt(np.maximum(0.0, 1 - (length[:, 0] / self.radius) ** 2))
        return out

    def _signed(self, x: np.ndarray, table: int, which: int) -> np.ndarray:
        for signs in self.signs[table, which]:
            x = hadamard(x * signs)
        x = x[:, : self.sizes[which] // 2]
        return np.stack([-x, x], axis=2).reshape(len(x), -1)

    def members(self, x: np.ndarray, table: int) -> np.ndarray:
        bucket = np.zeros(len(x), dtype=np.int64)
        for which, size in enumerate(self.sizes):
            bucket = bucket * size + self._signed(x, table, which).argmax(axis=1)
        return bucket

    def probed(self, x: np.ndarray, table: int) -> np.ndarray:
        """The cheapest buckets of each row: their cost is the sum of the rotations' squared distances to the nearest axis."""
        bucket, cost = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
        for which, size in enumerate(self.sizes):
            signed = self._signed(x, table, which)
            more = (signed.max(axis=1, keepdims=True) - signed) ** 2
            cost = (cost[:, :, None] + more[:, None, :]).reshape(len(x), -1)
            bucket = (bucket[:, :, None] * size + np.arange(size)[None, None, :]).reshape(len(x), -1)
            if cost.shape[1] > self.probes:
                best = np.argpartition(cost, self.probes - 1, axis=1)[:, : self.probes]
                cost, bucket = np.take_along_axis(cost, best, 1), np.take_along_axis(bucket, best, 1)
        return bucket


DEALT = "tab int, grp long, kind int, id long, vector binary, buckets binary"
NAMES = ["tab", "grp", "kind", "id", "vector", "buckets"]


def _dealt(hashing: CrossPolytope, per_group: int, query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step := 64 if query else 2048):
                batch = whole.slice(at, step)
                x = hashing.prepared(_matrix(batch.column(1).to_pylist(), hashing.dim), query)
                for table in range(hashing.tables):
                    if query:
                        buckets = np.sort(hashing.probed(x, table), axis=1)
                        rows, groups, held = [], [], []
                        for i, own in enumerate(buckets):
                            cuts = np.flatnonzero(np.diff(own // per_group, prepend=-1))
                            for a, b in zip(cuts, np.append(cuts[1:], len(own)), strict=True):
                                rows.append(i)
                                groups.append(int(own[a]) // per_group)
                                held.append(own[a:b].tobytes())
                    else:
                        own = hashing.members(x, table)
                        rows, groups, held = np.arange(len(own)), own // per_group, [b.tobytes() for b in own]
                    part = batch.take(pa.array(rows, pa.int64()))
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, table, np.int32)), pa.array(groups, pa.int64()), pa.array(np.full(n, 0 if query else 1, np.int32)), part.column(0), part.column(1), pa.array(held, pa.binary())], names=NAMES
                    )

    return released(run)


class _Best:
    """Each query's best members so far."""

    def __init__(self, k: int):
        self.k, self.at = k, {}
        self.ids, self.scores = np.zeros((0, k), np.int64), np.zeros((0, k))

    def rows(self, queries: list[int]) -> np.ndarray:
        for q in queries:
            self.at.setdefault(q, len(self.at))
        if len(self.at) > len(self.ids):
            more = max(len(self.at), 2 * len(self.ids)) - len(self.ids)
            self.ids = np.concatenate([self.ids, np.full((more, self.k), np.iinfo(np.int64).max)])
            self.scores = np.concatenate([self.scores, np.full((more, self.k), -np.inf)])
        return np.array([self.at[q] for q in queries])

    def merge(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """ids (one row for all, or a row each) with their scores; ties to the smaller id, each id once."""
        ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        order = np.lexsort((ids, -scores), axis=1)
        ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
        again = np.zeros(ids.shape, dtype=bool)
        again[:, 1:] = (ids[:, 1:] == ids[:, :-1]) & np.isfinite(scores[:, 1:])
        order = np.argsort(again | ~np.isfinite(scores), axis=1, kind="stable")[:, : self.k]
        ids, scores = np.take_along_axis(ids, order, 1), np.where(np.take_along_axis(again, order, 1), -np.inf, np.take_along_axis(scores, order, 1))
        self.ids[rows], self.scores[rows] = ids, scores


def _searched(dim: int, k: int):
    """Partitions sorted by group, queries before members, to each query's best members of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, group, rows, names, probes, matrix = _Best(k), None, [], [], [], None

        def score(part: pa.RecordBatch) -> None:
            for at in range(0, len(names), BATCH):
                score_some(part, slice(at, at + BATCH))

        def score_some(part: pa.RecordBatch, some: slice) -> None:
            member = _matrix(part.column(4).to_pylist(), dim)
            bucket = np.frombuffer(b"".join(part.column(5).to_pylist()), np.int64)
            low = bucket.min()
            hit = np.zeros((len(names[some]), bucket.max() - low + 1), dtype=bool)
            for i, own in enumerate(probes[some]):
                own = own[(own >= low) & (own < low + hit.shape[1])] - low
                hit[i, own] = True
            scores = np.where(hit[:, bucket - low], matrix[some] @ member.T, -np.inf)
            ids = np.asarray(part.column(3), dtype=np.int64)
            if scores.shape[1] > 4 * k:
                top = np.argpartition(-scores, 2 * k, axis=1)[:, : 2 * k]
                edge = np.take_along_axis(scores, top, 1).min(axis=1)
                crowded = (scores >= edge[:, None]).sum(axis=1) > 2 * k  # ties at the edge: all are looked at
                plain = ~crowded | ~np.isfinite(edge)
                if plain.any():
                    best.merge(rows[some][plain], ids[top[plain]], np.take_along_axis(scores, top, 1)[plain])
                if (~plain).any():
                    best.merge(rows[some][~plain], ids[None, :], scores[~plain])
            else:
                best.merge(rows[some], ids[None, :], scores)

        for batch in batches:
            key = np.stack([np.asarray(batch.column(c), dtype=np.int64) for c in (0, 1, 6, 2)])
            cuts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])) if batch.num_rows else []
            for a, b in zip(cuts, np.append(cuts[1:], batch.num_rows), strict=True) if len(cuts) else ():
                here, part = tuple(key[:3, a]), batch.slice(a, b - a)
                if here != group:
                    group, names, probes, vectors, matrix = here, [], [], [], None
                if key[3, a] == 0:
                    names += part.column(3).to_pylist()
                    probes += [np.frombuffer(p, np.int64) for p in part.column(5).to_pylist()]
                    vectors += part.column(4).to_pylist()
                elif names:
                    if matrix is None:
                        rows, matrix = best.rows(names), _matrix(vectors, dim)
                    for at in range(0, part.num_rows, BATCH):
                        score(part.slice(at, BATCH))
        queries = list(best.at)
        for at in range(0, len(queries), 1000):
            own = queries[at : at + 1000]
            ids, scores = best.ids[at : at + len(own)], best.scores[at : at + len(own)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array([i[np.isfinite(s)].tobytes() for i, s in zip(ids, scores, strict=True)], pa.binary()), pa.array([s[np.isfinite(s)].tobytes() for s in scores], pa.binary())],
                names=["query", "ids", "scores"],
            )

    return released(run)


def _merged(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries, heads = [], []
            for query, ids, own in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                ids = np.concatenate([np.frombuffer(i, np.int64) for i in ids])
                own = np.concatenate([np.frombuffer(s, np.float64) for s in own])
                order = np.lexsort((ids, -own))
                _, first = np.unique(ids[order], return_index=True)
                order = order[np.sort(first)[:k]]
                queries += [query] * len(order)
                heads += ids[order].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(heads, pa.int64())], names=["query", "head"])

    return run


def _rescored(dim: int):
    """(query, head, vector, head_vector) to (query, head, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                x, y = (_matrix(part.column(c).to_pylist(), dim) for c in (2, 3))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array((x * y).sum(axis=1))], names=["query", "head", "score"])

    return released(run)


def _met(members: DataFrame, asking: DataFrame, dim: int, k: int) -> DataFrame:
    """(query, ids, scores): partial lists of the groups; crowded groups are split by member, their queries repeated."""
    crowds = members.groupBy("tab", "grp").count().filter(F.col("count") > 4 * GROUP).select("tab", "grp", F.ceil(F.col("count") / (2 * GROUP)).cast("int").alias("parts"))
    crowds = saved(crowds)
    members = members.join(crowds, ["tab", "grp"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int"))
    asking = asking.join(crowds, ["tab", "grp"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    met = members.unionByName(asking).select(*NAMES, "part").repartition(shuffle_partitions(members.sparkSession), "tab", "grp", "part").sortWithinPartitions("tab", "grp", "part", "kind")
    return met.mapInArrow(_searched(dim, k), "query long, ids binary, scores binary")


def _exact(heads: DataFrame, queries: DataFrame, n_heads: int, dim: int, k: int) -> DataFrame:
    """The same for a few queries against all members: blocks of queries and members, dealt by hash."""
    parts, blocks = max(1, n_heads // GROUP), max(1, queries.count() // GROUP)
    zero = F.lit(bytearray(np.int64(0).tobytes()))
    members = heads.withColumn("tab", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("tab", F.pmod(F.xxhash64("head"), F.lit(parts)).alias("grp"), F.lit(1).alias("kind"), F.col("head").alias("id"), "vector", zero.alias("buckets"))
    asking = queries.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    asking = asking.select(F.pmod(F.xxhash64("head"), F.lit(blocks)).cast("int").alias("tab"), "grp", F.lit(0).alias("kind"), F.col("head").alias("id"), "vector", zero.alias("buckets"))
    return _met(members, asking, dim, k)


def nearest_neighbours(vectors: DataFrame, k: int = 20, query_modulus: int = 20, tables: int = 12, probes: int = 96, growth: float = 0.8) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by query_modulus its k nearest found other
    rows by inner product, best first, ties to the smaller vec_id; all other rows, if there are fewer.

    vectors has vec_id and embedding; other columns are not read. Null vec_ids and vectors that are null, empty, zero or
    hold null or non-finite components take no part, nor do vectors of another than the most frequent dimension. Repeated
    vectors are found like others; repeated rows are one row. Rows of one vec_id with different vectors are different rows: each is
    a candidate, and if the vec_id is divisible, a query with a list of its own. An empty table gives an empty result. Buckets hold about BUCKET members at every size. The probes of a table are `probes`, or `growth` times the
    root of the number of different vectors if that is more, and twice as many for unequal lengths: on vectors without
    any clusters nothing less keeps the recall.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    valid = saved(vectors.select("vec_id", "embedding").mapInArrow(_valid(np.float32 if kind == "float" else np.float64), "vec_id long, key binary, vector binary"))
    sizes = valid.groupBy(F.length("vector").alias("bytes")).count().orderBy(F.desc("count"), F.desc("bytes")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid, dim = valid.filter(F.length("vector") == sizes["bytes"]), sizes["bytes"] // (4 if kind == "float" else 8)
    order = W.partitionBy("key").orderBy("vec_id")
    ids = valid.select("key", "vec_id").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).drop("n")
    # Different vectors are numbered in order of their smallest vec_id, as one vec_id may have several.
    different = valid.groupBy("key").agg(F.min("vec_id").alias("_first"), F.first("vector").alias("vector"))
    heads = saved(numbered(different, [], ["_first", "key"], "head").drop("_first"))
    asked = valid.filter(F.pmod("vec_id", F.lit(query_modulus)) == 0).select("key", F.col("vec_id").alias("query_id")).distinct()
    queries = saved(heads.join(asked.select("key").distinct(), "key", "left_semi").select("head", "vector"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.linalg.norm(_matrix(batch.column(0).to_pylist(), dim), axis=1))], names=["length"])

    seen = heads.select("vector").mapInArrow(lengths, "length double").agg(F.count("*").alias("n"), F.min("length").alias("low"), F.max("length").alias("high")).first()
    radius = seen["high"] if seen["low"] < 0.99 * seen["high"] else None
    asked_for = max(probes, int(growth * seen["n"] ** 0.5)) * (1 if radius is None else 2)
    hashing = CrossPolytope(dim, tables, seen["n"] // BUCKET, asked_for, radius)
    per_group = max(1, hashing.buckets * GROUP // seen["n"])
    members = heads.select("head", "vector").mapInArrow(_dealt(hashing, per_group, query=False), DEALT)
    asking = queries.mapInArrow(_dealt(hashing, per_group, query=True), DEALT)
    merged = lambda found: found.groupBy("query").agg(F.collect_list("ids").alias("ids"), F.collect_list("scores").alias("scores")).mapInArrow(_merged(k + SPARE), "query long, head long")
    lists = saved(merged(_met(members, asking, dim, k + SPARE)))
    names = saved(ids.join(heads.select("key", "head"), "key").select("head", "vec_id"))
    # queries with fewer rows than there are get the rest
    need = min(k + 1, names.count())
    enough = lists.join(names.groupBy("head").count(), "head").groupBy("query").agg(F.sum("count").alias("n")).filter(F.col("n") >= need).select(F.col("query").alias("head"))
    short = saved(queries.join(enough, "head", "left_anti"))
    if not short.isEmpty():
        rest = merged(_exact(heads.select("head", "vector"), short, seen["n"], dim, k + SPARE))
        lists = lists.join(short.select(F.col("head").alias("query")), "query", "left_anti").unionByName(rest)
    pairs = lists.join(queries.select(F.col("head").alias("query"), "vector"), "query").join(heads.select("head", F.col("vector").alias("head_vector")), "head")
    scored = pairs.select("query", "head", "vector", "head_vector").mapInArrow(_rescored(dim), "query long, head long, score double")
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "head")
    spread = scored.join(names, "head").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    asked = asked.join(heads.select("key", F.col("head").alias("query")), "key").select("query_id", "query")
    final = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id", "head")
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("head") == F.col("query"))
    answers = asked.join(spread, "query").filter(~own).withColumn("rank", F.row_number().over(final))
    return answers.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
