"""Merkle manifest of a dataset, its trees stored in van Emde Boas order.

Every row is a leaf: a digest of its fields.  The leaves of a language, in the order of their ids, form a binary tree
whose top is the language's subroot; the subroots form the tree of the whole dataset.  A tree is cut into aligned
subtrees of ``2 ** BLOCK_LEVELS`` leaves.  Such a block is one row of a table: its digests in one binary value, laid out by
splitting the subtree at half its height, the upper half first, then the lower ones from left to right, each of them
split the same way (``slot``).  A path from a leaf to the top thus crosses few stretches of the value, whatever the size of
a page.  The tops of the blocks are the leaves of the next tier of blocks, and so on until one block is left, so that no
task holds more than one block, however large a language is.

Slots are arithmetic on (height, depth, index): building writes the levels to their slots, and a proof reads the siblings of a
path from theirs (``prove``).  A proof is verified by folding it onto a leaf (``folded``), which needs no table.

Defined results: a null field is written as ``-``; rows that share an id are ordered by their leaf, rows without an id come
first and are never tampered with in ``op11_``; rows without a language form a language of their own, which comes first;
equal rows are leaves of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks_for, pick, settle

#: A block has ``2 ** BLOCK_LEVELS`` leaves: 8191 digests, 262 kB.
BLOCK_LEVELS = 12
#: Rows of a range of ids that are numbered together.
RANGE_ROWS = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step of a proof: a byte that says where the sibling stands (0: there is none), and its digest.
STEP = 33
LEFT, RIGHT = 1, 2


def slot(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Place of the nodes ``index`` at ``depth`` (0: the top) of a tree of ``height`` levels in van Emde Boas order."""
    at, index = np.zeros(len(index), np.int64), np.asarray(index, np.int64)
    while height > 1:
        upper = height // 2
        if depth < upper:
            height = upper
            continue
        height, depth = height - upper, depth - upper
        at += (1 << upper) - 1 + (index >> depth) * ((1 << height) - 1)
        index = index & ((1 << depth) - 1)
    return at


def levels_of(leaves: int) -> int:
    """Levels of a tree of so many leaves."""
    return (leaves - 1).bit_length() + 1


def build_block(leaves: Iterable[bytes], height: int) -> np.ndarray:
    """The digests of a block of ``height`` levels, 32 bytes a slot; slots without a node are zero."""
    level = [x.hex() for x in leaves]
    nodes = np.zeros(((1 << height) - 1, 32), np.uint8)
    for depth in range(height - 1, -1, -1):
        nodes[slot(height, depth, np.arange(len(level)))] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, 32)
        if depth:
            level = [sha256("".join(level[i : i + 2]).encode()).hexdigest() for i in range(0, len(level), 2)]
    return nodes


def siblings(nodes: np.ndarray, height: int, leaves: int, at: np.ndarray) -> np.ndarray:
    """The proof steps within a block of the leaves at the positions ``at``: a row of ``(height - 1) * STEP`` bytes each."""
    steps = np.zeros((len(at), height - 1, STEP), np.uint8)
    for up in range(height - 1):
        index = at >> up
        beside = index ^ 1
        there = np.flatnonzero(beside < -(-leaves >> up))
        steps[there, up, 0] = np.where(beside[there] < index[there], LEFT, RIGHT)
        steps[there, up, 1:] = nodes[slot(height, height - 1 - up, beside[there])]
    return steps.reshape(len(at), -1)


def leaf_digest(**fields: Column) -> Column:
    """Digest of a row's fields, in ``FIELDS``' order: each ``-`` if null, else its length in bytes, a colon, and it."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in (fields[n] for n in FIELDS)]
    return F.unhex(F.sha2(F.concat(*told).cast("binary"), 256))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their position ``pos`` within ``grp`` by ``order``, and ``n``, the rows of ``grp``.

    Rows are ranged and sorted once; a row's place in its range and the counts of the ranges before give its position.
    """
    ranges = blocks_for(rows.count(), RANGE_ROWS)
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())  # spreads equal rows over ranges
    keys = ["grp", *order, "_tie"]
    placed = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    placed = settle(placed.drop("_tie").withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    by_range = Window.partitionBy("grp").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("grp", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_m"))
    starts = starts.select("grp", "_range", "_first", F.coalesce(F.sum("_m").over(by_range), F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy("grp")).alias("n"))
    return placed.join(starts, ["grp", "_range"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_range", "_at", "_first", "_before")


BLOCK = "grp string, block long, blocks long, leaves int, height int, top binary, nodes binary"


def _build(block_levels: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        grp, block = key
        group = group.sort_values("at")
        blocks = -(-int(group["n"].iloc[0]) >> block_levels)
        height = block_levels + 1 if blocks > 1 else levels_of(len(group))
        nodes = build_block(group["leaf"], height)
        return pd.DataFrame({"grp": [grp], "block": [block], "blocks": [blocks], "leaves": [len(group)], "height": [height], "top": [nodes[0].tobytes()], "nodes": [nodes.tobytes()]})

    return run


def build_tiers(leaves: DataFrame, block_levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """The tiers of blocks over ``leaves`` (grp, pos, n, leaf), lowest first; a group ends at the tier where it has one block."""
    tiers = []
    while True:
        cut = leaves.select("grp", F.shiftright("pos", block_levels).alias("block"), F.col("pos").bitwiseAND((1 << block_levels) - 1).alias("at"), "n", "leaf")
        tiers.append(settle(cut.groupBy("grp", "block").applyInPandas(_build(block_levels), BLOCK)))
        leaves = tiers[-1].where("blocks > 1").select("grp", F.col("block").alias("pos"), F.col("blocks").alias("n"), F.col("top").alias("leaf"))
        if leaves.isEmpty():
            return tiers


def tops(tiers: list[DataFrame]) -> DataFrame:
    """grp, top: the top digest of each group."""
    found = [t.where("blocks = 1").select("grp", "top") for t in tiers]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0]


def _climb(names: list[str]):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[names].copy()
        if len(left) and len(right):
            block = right.iloc[0]
            height = int(block["height"])
            nodes = np.frombuffer(block["nodes"], np.uint8).reshape(-1, 32)
            steps = siblings(nodes, height, int(block["leaves"]), left["at"].to_numpy(np.int64))
            out["path"] = [s.tobytes() + block["upper"] for s in steps]
            out["subroot"], out["root"] = block["subroot"], block["root"]
        else:  # nothing is known of this block
            out["path"] = out["subroot"] = out["root"] = None
        return out

    return run


def climb(items: DataFrame, tier: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``items`` (grp, pos and others) with the path from them to the root, read from the blocks of ``tier`` (with ``upper``)."""
    cut = items.withColumn("block", F.shiftright("pos", block_levels)).withColumn("at", F.col("pos").bitwiseAND((1 << block_levels) - 1))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", path binary, subroot binary, root binary"
    return cut.groupBy("grp", "block").cogroup(tier.groupBy("grp", "block")).applyInPandas(_climb(items.columns), schema)


def with_upper(tiers: list[DataFrame], start: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """The lowest tier, each block with the path from its top to the root; ``start`` (grp, upper, subroot, root) has that of each group."""
    above = None
    for tier in reversed(tiers):
        known = start.join(tier.where("blocks = 1").select("grp"), "grp").select("grp", F.lit(0).cast("long").alias("block"), "upper", "subroot", "root")
        if above is not None:
            more = climb(tier.where("blocks > 1").select("grp", F.col("block").alias("pos")), above, block_levels)
            known = known.unionByName(more.select("grp", F.col("pos").alias("block"), F.col("path").alias("upper"), "subroot", "root"))
        above = settle(tier.join(known, ["grp", "block"]))
    return above


@dataclass
class Manifest:
    """``leaves``: grp, pos, n, leaf and the columns that were asked for; ``blocks``: the lowest tier with the paths above it;
    ``tiers``, ``root_tiers``: all blocks of the languages' trees and of the tree over them."""

    leaves: DataFrame
    blocks: DataFrame
    tiers: list[DataFrame]
    root_tiers: list[DataFrame]

    def root(self) -> DataFrame:
        """One row: the digest of the whole dataset (none for an empty one)."""
        return tops(self.root_tiers).select(F.lower(F.hex("top")).alias("root"))

    def subroots(self) -> DataFrame:
        return tops(self.tiers).select(language_of("grp").alias("lang"), F.lower(F.hex("top")).alias("subroot"))

    def write(self, folder: str) -> None:
        """Tables that ``read_manifest`` reads."""
        self.leaves.write.parquet(f"{folder}/leaves")
        self.blocks.write.parquet(f"{folder}/blocks")
        for name, tiers in (("tiers", self.tiers), ("root_tiers", self.root_tiers)):
            for i, tier in enumerate(tiers):
                tier.withColumn("tier", F.lit(i)).write.mode("append").parquet(f"{folder}/{name}")


def read_manifest(spark: SparkSession, folder: str) -> Manifest:
    tiers = []
    for name in ("tiers", "root_tiers"):
        every = spark.read.parquet(f"{folder}/{name}")
        most = every.agg(F.max("tier")).first()[0] or 0
        tiers.append([every.where(F.col("tier") == i).drop("tier") for i in range(most + 1)])
    return Manifest(spark.read.parquet(f"{folder}/leaves"), spark.read.parquet(f"{folder}/blocks"), *tiers)


def group_of(lang: Column) -> Column:
    """A key that is never null and sorts as the language does, null first."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def language_of(grp: str) -> Column:
    return F.when(F.col(grp) != "", F.substring(grp, 2, 1 << 30))


def build_manifest(rows: DataFrame, block_levels: int = BLOCK_LEVELS) -> Manifest:
    """The manifest of ``rows``: doc_id, lang, leaf and further columns that its leaves carry."""
    keyed = settle(rows.withColumn("grp", group_of(F.col("lang"))).drop("lang"))
    leaves = settle(numbered(keyed, "doc_id", "leaf"))
    tiers = build_tiers(leaves, block_levels)
    subroots = settle(tops(tiers).select(F.lit("").alias("grp"), F.col("grp").alias("member"), F.col("top").alias("leaf")))
    ranked = settle(numbered(subroots, "member"))
    root_tiers = build_tiers(ranked, block_levels)
    whole = tops(root_tiers).select("grp", F.lit(b"").alias("upper"), F.lit(b"").alias("subroot"), F.col("top").alias("root"))
    over = climb(ranked.select("grp", "pos", "member", "leaf"), with_upper(root_tiers, whole, block_levels), block_levels)
    start = settle(over.select(F.col("member").alias("grp"), F.col("path").alias("upper"), F.col("leaf").alias("subroot"), "root"))
    return Manifest(leaves, with_upper(tiers, start, block_levels), tiers, root_tiers)


def prove(manifest: Manifest, leaves: DataFrame | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``leaves`` (some or all of the manifest's) with path, subroot and root as binary values."""
    return climb(manifest.leaves if leaves is None else leaves, manifest.blocks, block_levels)


def steps_of(path: str) -> Column:
    """The steps of a proof as an array of binary values."""
    n = F.octet_length(path)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (n / STEP).cast("int") - 1), lambda i: F.substring(F.col(path), i * STEP + 1, F.lit(STEP)))).otherwise(F.array().cast("array<binary>"))


def _side(step: Column) -> Column:
    return F.substring(F.hex(step), 2, 1)


def _sibling(step: Column) -> Column:
    return F.lower(F.substring(F.hex(step), 3, 64))


def folded(leaf: Column, path: str) -> Column:
    """The root, in hexadecimal, that a proof leads to from ``leaf``."""

    def onto(digest: Column, step: Column) -> Column:
        side = _side(step)
        run = F.when(side == str(LEFT), F.concat(_sibling(step), digest)).when(side == str(RIGHT), F.concat(digest, _sibling(step))).otherwise(digest)
        return F.sha2(run.cast("binary"), 256)

    return F.aggregate(steps_of(path), F.lower(F.hex(leaf)), onto)


def proof_digest(path: str) -> Column:
    """Digest of a proof's siblings, from the leaf to the root."""
    there = F.filter(steps_of(path), lambda s: _side(s) != "0")
    return F.sha2(F.array_join(F.transform(there, _sibling), "").cast("binary"), 256)


def tampered_manifest(docs: DataFrame, every: int = 7, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Every row's proof, held against a row whose n_chars is one more where ``every`` divides the check sum of its id.

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    rows = pick(docs, **{n: n for n in FIELDS})
    fields = {n: F.col(n) for n in FIELDS}
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    rows = rows.select("doc_id", "lang", leaf_digest(**fields).alias("leaf"), F.when(touched & F.col("n_chars").isNotNull(), leaf_digest(**fields | {"n_chars": F.col("n_chars") + 1})).alias("other"))
    found = prove(build_manifest(rows, block_levels), block_levels=block_levels)
    found = found.select("doc_id", *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")], proof_digest("path").alias("proof_sha256"), folded(F.coalesce("other", "leaf"), "path").alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
