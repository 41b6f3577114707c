"""N-gram Jaccard join: a grouped prefix join over the shingle sets of documents.

1. Texts with equal shingle sets fall to one node (128-bit fingerprint of the sorted set). The same pass summarises
   each task's most frequent shingles (Misra and Gries), so that hot ones are known before anything is dealt.
2. A longer prefix, in hash order, is a sample in which linked nodes share a known number of shingles; nodes that
   share fewer with others have no link. What stays is marked in a bitmap made for its number, which may mark more;
   beyond the size of a broadcast the texts are semi-joined instead.
3. Among these, shingles are counted exactly in hash buckets, whose number follows the number of shingles; each node
   learns its shared shingles with their counts, and prefixes are taken rarest first. Hot shingles count as the
   least rare without being gathered: they go to buckets of their owners. Unshared shingles fill the prefix at no
   cost, and a node whose whole prefix is unshared has no partner.
4. Nodes with one size and one prefix form a group. Groups that share a prefix shingle are candidate pairs
   under the size and position filters; pairs that stay are expanded to members, which are verified on their sets.
5. Only components are wanted, so no pair inside one component needs a test: a star pass (each list's groups
   against two of them, and each group's members against one of its own) connects the large clusters with at most
   twice as many tests as list entries, and the last, exhaustive pass tests what still lies in different components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import saved, shuffle_partitions
from .wordblocks import chain, release, released, word_blocks

MOST_TOKENS = 1 << 19
BUCKET_TOKENS = 1 << 21
#: Largest bitmap that is broadcast (16 bits a candidate).
MOST_BITS = 1 << 28
SUMMARY = 1 << 12
KEY = "_row_hash_of_doc_id_and_text"
HOT_SEEN = 1 << 40


def block_sets(block, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; texts of fewer words have one for all their words."""
    words = block.word_hashes()
    grams = chain(words, width)
    for first, count in zip(block.word_bounds[:-1], block.n_words, strict=True):
        if count >= width:
            own = np.sort(grams[first : first + count - width + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif count:
            yield chain(words[first : first + count], int(count))
        else:
            yield np.zeros(0, dtype=np.uint64)


def _fingerprint(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _prefix_length(n: int, percent: int, shared: int = 1) -> int:
    """Two linked sets have `shared` common tokens in prefixes of this length, under any common order."""
    return n - (percent * n + 99) // 100 + shared


def _sample_share(n: int, percent: int) -> int:
    """How many common tokens the first, longer prefix is made for."""
    return max(1, (100 - percent) * n // 100)


class _Frequent:
    """Misra and Gries' summary: tokens of more than 1 / (SUMMARY + 1) of all that were added are in it."""

    def __init__(self):
        self.tokens, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, tokens: np.ndarray) -> None:
        new, counts = np.unique(tokens, return_counts=True)
        both, at = np.unique(np.concatenate([self.tokens, new]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([self.counts, counts]), minlength=len(both)).astype(np.int64)
        if len(total) > SUMMARY:
            total -= np.partition(total, len(total) - SUMMARY - 1)[len(total) - SUMMARY - 1]
        self.tokens, self.counts = both[total > 0], total[total > 0]


def _signatures(width: int):
    """(row_hash, text, other columns) rows: those, the set's size and fingerprint; a last row of size -1 has the frequent tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, schema = _Frequent(), None
        for batch in batches:
            others = [c for c in batch.schema.names if c != "text"]
            for block in word_blocks(batch.column("text"), lower=True):
                sets = list(block_sets(block, width))
                if sets:
                    frequent.add(np.concatenate(sets))
                nodes = [_fingerprint(own) if len(own) else None for own in sets]
                own = [batch.column(c).slice(block.first, block.n) for c in others]
                n = len(nodes)
                out = pa.RecordBatch.from_arrays(
                    [*own, pa.array([len(x) for x in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array([x and int.from_bytes(x[:8], "little", signed=True) for x in nodes], pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())],
                    names=[*others, "n_shingles", "node", "node8", "frequent", "counts"],
                )
                schema = out.schema
                yield out
        if schema is not None:
            last = {"n_shingles": pa.array([-1], pa.int64()), "frequent": pa.array([frequent.tokens.tobytes()], pa.binary()), "counts": pa.array([frequent.counts.tobytes()], pa.binary())}
            yield pa.RecordBatch.from_arrays([last.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)

    return released(run)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tokens, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(tokens, np.int64)), pa.array(np.frombuffer(counts, np.int64))], names=["token", "n"])


def _hot_tokens(signed: DataFrame, least: int) -> np.ndarray:
    """The tokens that at least so many rows have for sure, sorted."""
    found = signed.filter("n_shingles < 0").select("frequent", "counts").mapInArrow(_unpacked, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return np.sort(np.array([r["token"] for r in found.select("token").collect()], dtype=np.int64).view(np.uint64))


class _Dealer:
    """Gathers sets and deals their tokens to buckets, each with its owners' keys, sizes and token counts. Hot tokens go to
    buckets of their owners, numbered from n_buckets on."""

    def __init__(self, n_buckets: int, token_type: str, key_bytes: int, hot: np.ndarray):
        self.n_buckets, self.token_type, self.key_bytes, self.hot = n_buckets, token_type, key_bytes, hot
        self.clear()

    def clear(self) -> None:
        self.keys: dict[bytes, int] = {}
        self.tokens: list[np.ndarray] = []
        self.held = 0

    def add(self, node: bytes, size: int, tokens: np.ndarray) -> Iterator[pa.RecordBatch]:
        if node[: self.key_bytes] not in self.keys:  # copies travel once
            self.keys[node[: self.key_bytes]] = size
            self.tokens.append(tokens)
            self.held += len(tokens)
            if self.held >= MOST_TOKENS:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        flat = np.concatenate(self.tokens)
        owner = np.repeat(np.arange(len(self.tokens), dtype=np.int32), [len(t) for t in self.tokens])
        keys = np.frombuffer(b"".join(self.keys), dtype=np.uint8).reshape(-1, self.key_bytes)
        bucket = ((flat >> np.uint64(32)) % np.uint64(self.n_buckets)).astype(np.int32)
        if len(self.hot):
            hot = np.flatnonzero(np.isin(flat, self.hot))
            bucket[hot] = self.n_buckets + (_words(keys, self.key_bytes)[owner[hot], 0] % np.uint64(self.n_buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        flat, owner, bucket = flat[order].astype(self.token_type), owner[order], bucket[order]
        sizes = np.array(list(self.keys.values()), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = []
        for a, b in zip(cuts, np.append(cuts[1:], len(flat)), strict=True):
            first = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
            there = owner[a:b][first]
            rows.append((int(bucket[a]), flat[a:b].tobytes(), np.diff(np.append(first, b - a)).astype(np.uint16 if b - a < 1 << 16 else np.uint32).tobytes(), keys[there].tobytes(), sizes[there].astype(np.uint32).tobytes()))
        self.clear()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], names=["bucket", "tokens", "counts", "nodes", "sizes"]
        )


def _dealt(width: int, percent: int, n_buckets: int, hot: np.ndarray, whole: bool, chosen=None):
    """(row_hash, text) rows to buckets: samples (32-bit tokens of the longer prefix) or whole sets; with a bitmap of
    chosen row_hashes only those rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = _Dealer(n_buckets, "<u8", 16, hot) if whole else _Dealer(n_buckets, "<u4", 8, hot)
        for batch in batches:
            if chosen is not None:
                at = np.asarray(batch.column(0), dtype=np.int64) & (8 * len(chosen.value) - 1)
                batch = batch.filter(pa.array((chosen.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1, pa.uint8()).cast(pa.bool_()))
            for block in word_blocks(batch.column(1), lower=True):
                for own in block_sets(block, width):
                    n = len(own)
                    if n:
                        yield from dealer.add(_fingerprint(own), n, own if whole else own[: _prefix_length(n, percent, _sample_share(n, percent))])
        yield from dealer.flush()

    return released(run)


def _gathered(table: pa.Table, token_type: str, key_bytes: int, n_buckets: int) -> tuple[np.ndarray, ...]:
    """A bucket's distinct (token, node) entries sorted by token, how many nodes have the token, the nodes' keys and sizes."""
    hot = table.column("bucket")[0].as_py() >= n_buckets
    tokens, counts, keys, sizes = [], [], [], []
    for t, c, k, s in zip(*(table.column(x).to_pylist() for x in ("tokens", "counts", "nodes", "sizes")), strict=True):
        tokens.append(np.frombuffer(t, dtype=token_type))
        keys.append(np.frombuffer(k, dtype=f"V{key_bytes}"))
        sizes.append(np.frombuffer(s, dtype=np.uint32))
        counts.append(np.frombuffer(c, dtype=np.uint16 if len(c) == 2 * len(keys[-1]) else np.uint32).astype(np.int64))
    tokens, counts, keys, sizes = (np.concatenate(x) for x in (tokens, counts, keys, sizes))
    names, code = np.unique(_words(keys, key_bytes), axis=0, return_inverse=True)
    owners = np.repeat(code.reshape(-1), counts)
    size = np.zeros(len(names), dtype=np.int64)
    size[code.reshape(-1)] = sizes
    order = np.lexsort((owners, tokens))
    tokens, owners = tokens[order], owners[order]
    fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])])
    tokens, owners = tokens[fresh], owners[fresh]
    cuts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    seen = np.diff(np.append(cuts, len(tokens)))
    return tokens, owners, np.full(len(tokens), HOT_SEEN) if hot else np.repeat(seen, seen), names, size


def _words(keys: np.ndarray, key_bytes: int) -> np.ndarray:
    """Keys as rows of 64-bit words."""
    return np.frombuffer(keys.tobytes(), dtype=np.uint64).reshape(-1, key_bytes // 8)


def _sharing(n_buckets: int):
    """(node8, size, shared): how many of a node's sample tokens in this bucket some other node has."""

    def run(table: pa.Table) -> pa.Table:
        _, owners, seen, names, size = _gathered(table, "<u4", 8, n_buckets)
        shared = np.bincount(owners[seen > 1], minlength=len(names))
        found = np.flatnonzero(shared)
        out = pa.table({"node8": pa.array(names[found, 0].view(np.int64)), "size": pa.array(size[found]), "shared": pa.array(shared[found])})
        release()
        return out

    return run


def _shared_tokens(n_buckets: int):
    """For each owner its shared tokens in this bucket, and how many have each."""

    def run(table: pa.Table) -> pa.Table:
        tokens, owners, seen, names, sizes = _gathered(table, "<u8", 16, n_buckets)
        shared = seen > 1
        tokens, owners, seen = tokens[shared], owners[shared], seen[shared]
        order = np.argsort(owners, kind="stable")
        tokens, owners, seen = tokens[order], owners[order], seen[order]
        cuts = np.flatnonzero(np.diff(owners, prepend=-1))
        rows = [(names[owners[a]].tobytes(), int(sizes[owners[a]]), tokens[a:b].tobytes(), seen[a:b].tobytes()) for a, b in zip(cuts, np.append(cuts[1:], len(tokens)), strict=True)] if len(cuts) else []
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        out = pa.table({n: pa.array(c, t) for (n, t), c in zip({"node": pa.binary(), "size": pa.int64(), "tokens": pa.binary(), "seen": pa.binary()}.items(), columns, strict=True)})
        release()
        return out

    return run


def _rare_prefixes(percent: int):
    """Rows of a node with all its shared tokens to its rarest-first prefix; nodes without a shared prefix token go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, size, tokens, seen in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                tokens = np.concatenate([np.frombuffer(t, dtype=np.uint64) for t in tokens])
                seen = np.concatenate([np.frombuffer(s, dtype=np.int64) for s in seen])
                alone = size - len(tokens)
                room = _prefix_length(size, percent) - alone
                if room > 0:
                    order = np.lexsort((tokens, seen))
                    prefix = tokens[order[:room]]
                    group = hashlib.blake2b(prefix.tobytes() + size.to_bytes(8, "little") + alone.to_bytes(8, "little"), digest_size=16).digest()
                    rows.append((node, size, alone, group, prefix.view(np.int64), np.sort(tokens).view(np.int64)))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["node", "size", "alone", "grp", "prefix", "tokens"])

    return released(run)


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of fixed size with the bits set that the column h names."""
    position = F.col("h").bitwiseAND(F.lit(bits - 1))
    parts = hashes.select(F.shiftright(position, 15).alias("part"), (position % 32768).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts.collect():  # bits / 32768 rows of 4 KB at most
        out[row["part"] * 4096 : (row["part"] + 1) * 4096] = np.frombuffer(row["map"], dtype=np.uint8)
    return out


def _candidate_nodes(docs: DataFrame, signed: DataFrame, width: int, percent: int, hot_owners: int) -> DataFrame:
    """Steps 2 and 3: (node, size, alone, grp, prefix, tokens)."""
    spark = docs.sparkSession
    total = signed.agg(F.sum(F.greatest("n_shingles", F.lit(0)))).first()[0] or 0
    hot = _hot_tokens(signed, max(hot_owners, total >> 20))
    buckets = max(64, shuffle_partitions(spark), total // BUCKET_TOKENS)
    dealt = "bucket int, tokens binary, counts binary, nodes binary, sizes binary"
    source = docs.select("row_hash", "text")
    sharing = source.mapInArrow(_dealt(width, percent, buckets, hot, whole=False), dealt).groupBy("bucket").applyInArrow(_sharing(buckets), "node8 long, size long, shared long")
    least = F.ceil(F.col("size") * percent / 100)
    enough = F.greatest(F.lit(1), F.floor((100 - percent) * least / 100))
    near = sharing.groupBy("node8").agg(F.max("size").alias("size"), F.sum("shared").alias("shared")).filter(F.col("shared") >= enough).select("node8")
    chosen = signed.filter("n_shingles > 0").groupBy("node").agg(F.min("row_hash").alias("h"), F.first("node8").alias("node8"))
    chosen = saved(chosen.join(near, "node8", "left_semi").select("h"))
    bits = 1 << max(16, (16 * chosen.count()).bit_length())
    if bits <= MOST_BITS:
        own = source.mapInArrow(_dealt(width, percent, buckets, hot, True, spark.sparkContext.broadcast(_bitmap(chosen, bits))), dealt)
    else:
        own = source.join(chosen.withColumnRenamed("h", "row_hash"), "row_hash", "left_semi").mapInArrow(_dealt(width, percent, buckets, hot, True), dealt)
    shared = own.groupBy("bucket").applyInArrow(_shared_tokens(buckets), "node binary, size long, tokens binary, seen binary")
    whole = shared.groupBy("node", "size").agg(F.collect_list(F.struct("tokens", "seen")).alias("parts")).select("node", "size", "parts.tokens", "parts.seen")
    return saved(whole.mapInArrow(_rare_prefixes(percent), "node binary, size long, alone long, grp binary, prefix array<long>, tokens array<long>"))


def _fits(percent: int) -> Column:
    """Size, position and unshared-shingle filters on list entries x and y: shingles that one set alone has are never common."""
    small, large = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
    total = F.col("x.size") + F.col("y.size")
    left = F.least(F.col("x.size") - F.col("x.pos"), F.col("y.size") - F.col("y.pos"), F.col("x.size") - F.col("x.alone"), F.col("y.size") - F.col("y.alone"))
    return (100 * small >= percent * large) & ((100 + percent) * left >= percent * total)


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    one = nodes.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("tokens").alias("tokens_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("tokens").alias("tokens_b"))
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    tested = pairs.join(one, "a").join(two, "b")
    return tested.filter(100 * both >= percent * (F.col("size_a") + F.col("size_b") - both)).select("a", "b")


def _star_pairs(lists: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """In each list, every group against two: that with fewest unshared shingles, the likely centre of a cluster of altered
    copies, and one that a hash chooses. Pairs that pass the filters are expanded: members against the other's head; and
    each group's members meet its head."""
    hub = F.struct("head", "grp", "size", "alone", "pos")
    middle, other = F.struct("alone", F.xxhash64("grp")), F.xxhash64("grp")
    centers = lists.groupBy("token").agg(F.min_by(hub, middle).alias("low"), F.max_by(hub, other).alias("high"))
    centers = centers.select("token", F.explode(F.array("low", "high")).alias("hub")).select("token", "hub.*")
    across = lists.alias("y").join(centers.alias("x"), "token").filter((F.col("x.grp") != F.col("y.grp")) & _fits(percent))
    met = across.select(F.col("x.head").alias("a"), F.col("y.grp").alias("grp")).distinct()
    heads = lists.select("grp", F.col("head").alias("a")).distinct()
    return met.unionByName(heads).join(nodes.select("grp", F.col("node").alias("b")), "grp").filter("a <> b").select("a", "b")


def _rest_pairs(lists: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """All pairs of members of different components whose groups share a prefix token and pass the filters. In a list
    with a main component only the others look for partners."""
    units = parts.select("grp", "component").distinct()
    entries = lists.join(units, "grp")
    counts = entries.groupBy("token", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("kinds")).filter("kinds > 1").select("token", "main")
    entries = entries.join(main, "token")
    minor = entries.filter("component <> main").alias("x")
    other = (F.col("y.component") == F.col("y.main")) | (F.col("x.component") < F.col("y.component"))
    across = minor.join(entries.alias("y"), F.col("x.token") == F.col("y.token")).filter((F.col("x.component") != F.col("y.component")) & other & _fits(percent))
    met = across.select(F.col("x.grp").alias("g1"), F.col("x.component").alias("c1"), F.col("y.grp").alias("g2"), F.col("y.component").alias("c2")).distinct()
    members = parts.select("grp", "component", "node")
    one = members.select(F.col("grp").alias("g1"), F.col("component").alias("c1"), F.col("node").alias("a"))
    two = members.select(F.col("grp").alias("g2"), F.col("component").alias("c2"), F.col("node").alias("b"))
    return met.join(one, ["g1", "c1"]).join(two, ["g2", "c2"]).select("a", "b")


def _links(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Steps 4 and 5: (links that connect, (node, component) of the linked nodes)."""
    groups = nodes.groupBy("grp").agg(F.min("node").alias("head"), *[F.first(c).alias(c) for c in ("size", "alone", "prefix")])
    lists = groups.select("grp", "head", "size", "alone", F.posexplode("prefix").alias("i", "token"))
    lists = saved(lists.select("grp", "head", "size", "alone", "token", (F.col("alone") + F.col("i")).alias("pos")))
    tested = lambda pairs: _verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), nodes, percent)
    links = saved(tested(_star_pairs(lists, nodes, percent)))
    found = connected_components(links)
    parts = saved(nodes.select("node", "grp").join(found, "node", "left").select("node", "grp", F.coalesce("component", "node").alias("component")))
    more = saved(tested(_rest_pairs(lists, parts, percent)))
    links = links.unionByName(more)
    if more.isEmpty():
        return links, found
    stars = found.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b")
    return links, connected_components(stars.unionByName(more))


def _placed(docs: DataFrame, width: int, percent: int, hot_owners: int) -> DataFrame:
    """(doc_id, row_hash, n_shingles, node, component, component_id) of each row of docs (doc_id, row_hash, text); node and
    the others are null without shingles."""
    signature = "doc_id long, row_hash long, n_shingles long, node binary, node8 long, frequent binary, counts binary"
    signed = saved(docs.select("doc_id", "row_hash", "text").mapInArrow(_signatures(width), signature))
    _, found = _links(_candidate_nodes(docs, signed, width, percent, hot_owners), percent)
    least = signed.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("low"))
    placed = least.join(found, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component"))
    names = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    of_node = placed.join(names, "component").select(F.col("node").alias("_node"), "component", "component_id")
    rows = signed.filter("n_shingles >= 0").select("doc_id", "row_hash", "n_shingles", "node")
    return rows.join(of_node, F.col("node") == F.col("_node"), "left").drop("_node")


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, hot_owners: int = 1 << 17) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Words are runs of other than white space (0x20, 0x09-0x0D), A-Z lower-cased. Two rows link when the Jaccard
    similarity of their sets of `width`-word shingles is at least `percent` / 100; component_id is the smallest
    doc_id reachable. Texts with fewer words have one shingle, all of them. Null, empty and wordless texts have
    none, link with nothing and keep their own doc_id. Rows with a repeated doc_id count as documents of their
    own; null doc_ids take part and are ignored in the minimum. Very long texts are one block of arrays some 30 times
    their size in one task. Other columns of docs, whatever their names, are not read. An empty table gives an empty
    result. Shingles of at least `hot_owners` rows, and of 1 in 4,096 in some task, are not gathered in one bucket.
    """
    placed = _placed(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), "text"), width, percent, hot_owners)
    return placed.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each_component(docs: DataFrame, width: int = 5, percent: int = 80, hot_owners: int = 1 << 17) -> DataFrame:
    """The rows of docs (doc_id, text and any others) that stay when of each component of jaccard_components one row does:
    that with the smallest doc_id, nulls last. Rows without words stay. Of rows with one doc_id and one text a single
    one stays, with any of their other columns."""
    keyed = docs.withColumn(KEY, F.xxhash64("doc_id", "text"))
    placed = _placed(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), "text"), width, percent, hot_owners)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")
    first = placed.filter("n_shingles > 0").groupBy("component").agg(F.min_by("row_hash", order).alias(KEY)).select(KEY)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed.filter(worded).join(first, KEY, "left_semi").dropDuplicates([KEY])
    return kept.select(*docs.columns).unionByName(docs.filter(~worded))
