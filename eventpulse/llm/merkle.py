"""Merkle manifest of a dataset: a digest of each row, trees of digests by key, one root over all, and a proof for each row.

The rank of a row in its tree, in base eight, says where it stands: its lowest digit is its place among its siblings.
Digits are grouped away one after the other, each group nesting its children as structs, until a block of 4,096 rows is one
nested row. Blocks are dealt by (tree, block), which serves all four groupings, so a large tree is spread like small
ones. Roots of blocks are rows of the next tier and roll up in the same way, as do the roots of the trees. On the way
back each nested row is unfolded by transform and explode, siblings left and right of the path going with it; no row is
joined, only blocks take the path above them from the tier above, one row for 4,096.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventpulse.operators.numbering import numbered

from .storage import refuse_clashes, saved

DIGIT = 3
LEVELS = 4
BLOCK = DIGIT * LEVELS
OWN = ["_tree", "_block", "_n", "_rank", "_load", "_kids", "_path", "_digest", "_key"]


def digest_of(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes of all parts, one after the other."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def field_digest(*columns: Column | str) -> Column:
    """Digest of several values: each is `-` if null, else its UTF-8 bytes' count, a colon and the value as text."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return digest_of(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _is_level(level: int) -> Column:
    """Whether a tree of _n leaves has this level of inner nodes."""
    return F.col("_n") > F.lit(1 << DIGIT * level).cast("long")


def _rolled(items: DataFrame, tier: int) -> DataFrame:
    """(_tree, _n, _block, _digest, _kids) of items (_tree, _n, _rank, _digest, _load)."""
    digits = [F.shiftright("_rank", DIGIT * i).bitwiseAND(F.lit(7)).cast("byte").alias(f"_d{i}") for i in range(LEVELS)]
    rows = items.select("_tree", "_n", F.shiftright("_rank", BLOCK).alias("_block"), *digits, "_digest", "_load").repartition("_tree", "_block")
    child = F.struct(F.col("_d0").alias("digit"), F.col("_digest").alias("digest"), F.col("_load").alias("below"))
    for i in range(LEVELS):
        rows = rows.groupBy("_tree", "_n", "_block", *[f"_d{j}" for j in range(i + 1, LEVELS)]).agg(F.sort_array(F.collect_list(child)).alias("_kids"))
        joined = digest_of(F.array_join(F.transform("_kids", lambda k: k["digest"]), ""))
        rows = rows.withColumn("_digest", F.when(_is_level(tier * LEVELS + i), joined).otherwise(F.col("_kids")[0]["digest"]))
        if i + 1 < LEVELS:
            child = F.struct(F.col(f"_d{i + 1}").alias("digit"), F.col("_digest").alias("digest"), F.col("_kids").alias("below"))
    return rows


def _with_siblings(kids: str) -> Column:
    """Each child with the digests left and right of it."""

    def all_of(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda k: k["digest"]), "")

    def one(kid: Column, i: Column) -> Column:
        return F.struct(kid.alias("kid"), F.struct(all_of(F.slice(kids, F.lit(1), i)).alias("left"), all_of(F.slice(kids, i + 2, F.lit(1 << DIGIT))).alias("right")).alias("step"))

    return F.transform(kids, one)


def _unfolded(blocks: DataFrame, tier: int, carried: list[str]) -> DataFrame:
    """The items of blocks (with _path from their own node up): _tree, _n, _rank, _digest, _load, _path and the carried columns."""
    rows = blocks.withColumn("_rank", F.col("_block"))
    for i in reversed(range(LEVELS)):
        rows = rows.select("_tree", "_n", "_rank", "_path", *carried, F.explode(_with_siblings("_kids")).alias("_x"))
        path = F.when(_is_level(tier * LEVELS + i), F.concat(F.array("_x.step"), "_path")).otherwise(F.col("_path"))
        rows = rows.select("_tree", "_n", (F.shiftleft("_rank", DIGIT) + F.col("_x.kid.digit")).alias("_rank"), path.alias("_path"), *carried, F.col("_x.kid.digest").alias("_digest"), F.col("_x.kid.below").alias("_kids"))
    return rows.withColumnRenamed("_kids", "_load")


def _tiers(items: DataFrame, most: int) -> list[DataFrame]:
    """Blocks of all tiers, until each tree is one block."""
    tiers = []
    while True:
        blocks = saved(_rolled(items, len(tiers)))
        tiers.append(blocks)
        if most <= 1 << BLOCK * len(tiers):
            return tiers
        items = blocks.select("_tree", "_n", F.col("_block").alias("_rank"), "_digest", F.lit(None).cast("byte").alias("_load"))


def _proved(tiers: list[DataFrame], top: DataFrame, carried: list[str]) -> DataFrame:
    """Items of the lowest tier; top has the blocks of the highest one with _path and the carried columns."""
    for tier in reversed(range(len(tiers))):
        items = _unfolded(top, tier, carried)
        if tier:
            above = items.select(F.col("_tree").alias("_t"), F.col("_rank").alias("_r"), "_path", *carried)
            top = tiers[tier - 1].join(above, (F.col("_tree") == F.col("_t")) & (F.col("_block") == F.col("_r"))).drop("_t", "_r")
    return items


def _most(items: DataFrame) -> int:
    return items.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]


def merkle_manifest(rows: DataFrame, leaf: Column, tree: str, order: list[str], keep: list[str]) -> DataFrame:
    """Per row: the columns to keep, leaf, subroot, root, and path: the siblings of each level from the leaf to the root, as
    structs (left, right) of joined digests.

    leaf gives a row's digest (see field_digest). Rows with one value of `tree` (null is a value) make a tree; leaves ascend by
    `order` (nulls first), then by leaf, so repeated rows stand together and each has a path of its own. Every eight
    consecutive nodes, the last run with fewer, become the digest of their joined digests, until one remains; the trees'
    roots, null first and then by the bytes of the tree's text, are the leaves of the last tree. A tree of one row has its
    leaf as subroot. Long texts are digested whole in the scan and travel no further. An empty table gives an empty result.
    keep must not hold a result's name; its types must be orderable."""
    refuse_clashes(keep, ["leaf", "subroot", "root", "path", *OWN])
    key = F.when(F.col(tree).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(tree).cast("string")))
    leaves = saved(rows.select(key.alias("_tree"), F.struct(*order).alias("_key"), leaf.alias("_digest"), F.struct(*keep).alias("_load")))
    placed = numbered(leaves, ["_tree"], [*[F.col(f"_key.{c}").asc_nulls_first() for c in order], F.col("_digest").asc()], "_rank", "_n", written=True)
    items = placed.select("_tree", "_n", (F.col("_rank") - 1).alias("_rank"), "_digest", "_load")
    tiers = _tiers(items, _most(items))
    subroots = tiers[-1].select(F.lit("").alias("_tree"), F.col("_tree").alias("_key"), "_digest", F.struct(F.col("_tree").alias("tree")).alias("_load"))
    trees = numbered(subroots, ["_tree"], ["_key"], "_rank", "_n").select("_tree", "_n", (F.col("_rank") - 1).alias("_rank"), "_digest", "_load")
    over = _tiers(trees, _most(trees))
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    heads = _proved(over, over[-1].withColumns({"_path": no_path, "root": F.col("_digest")}), ["root"])
    heads = heads.select(F.col("_load.tree").alias("_t"), "_path", "root")
    top = tiers[-1].join(heads, F.col("_tree") == F.col("_t")).drop("_t").withColumn("subroot", F.col("_digest"))
    proved = _proved(tiers, top, ["subroot", "root"])
    return proved.select("_load.*", F.col("_digest").alias("leaf"), "subroot", "root", F.col("_path").alias("path"))


def proof_text(path: Column | str) -> Column:
    """The siblings of all levels, from the leaf up and left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column | str, path: Column | str) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, F.col(leaf) if isinstance(leaf, str) else leaf, lambda node, s: digest_of(s["left"], node, s["right"]))
