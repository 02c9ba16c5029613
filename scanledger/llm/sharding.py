"""Sharding by Karmarkar-Karp differencing.

Rows with equal texts form one indivisible group.  Groups are dealt to blocks by a hash of their text; every block is
differenced on its own (the two partial partitions of largest spread are combined, the larger sums of one with the
smaller sums of the other), which leaves one partial partition of ``shards`` sums; those are differenced again, up to
``FAN_IN`` at a time, until one is left.  A group's shard is its part in the block carried through the permutations
of the levels above.  No task sees more than one block's groups, and rows are numbered in salted pieces of a shard.

Defined results: a null text counts as empty (size 1, crc32 0) and shares the group of empty texts; repeated rows and rows without a doc_id stay
separate rows of one group; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, pick, settle

BLOCK_GROUPS = 4096
FAN_IN = 512


def difference(tuples: list[list[int]], shards: int) -> tuple[list[int], np.ndarray]:
    """Combine partial partitions (each ``shards`` sums, largest first) into one.

    Returns its sums, largest first, and for each input the positions of its parts in the result.
    """
    n = len(tuples)
    heap = [(t[-1] - t[0], i) for i, t in enumerate(tuples)]
    heapq.heapify(heap)
    sums: dict[int, list[int]] = dict(enumerate(tuples))
    made: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums.pop(a), sums.pop(b)
        both = [x[i] + y[shards - 1 - i] for i in range(shards)]
        order = sorted(range(shards), key=both.__getitem__, reverse=True)
        node = n + len(made)
        made.append((a, b, order))
        sums[node] = [both[i] for i in order]
        heapq.heappush(heap, (sums[node][-1] - sums[node][0], node))
    places = np.zeros((n + len(made), shards), dtype=np.int32)
    places[-1] = np.arange(shards)
    for k in range(len(made) - 1, -1, -1):
        a, b, order = made[k]
        at = places[n + k]
        places[a, order] = at
        places[b, [shards - 1 - i for i in order]] = at
    return sums[heap[0][1]], places[:n]


def _difference_block(shards: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["gsize", "gkey"], ascending=[False, True])
        sums, places = difference([[int(s)] + [0] * (shards - 1) for s in group["gsize"]], shards)
        return pd.DataFrame({"gkey": group["gkey"].to_numpy(), "block": key[0], "part": places[:, 0], "sums": [sums] + [None] * (len(group) - 1)})

    return run


def _difference_level(shards: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        sums, places = difference([list(map(int, s)) for s in group["sums"]], shards)
        return pd.DataFrame({"node": group["node"].to_numpy(), "parent": key[0], "places": [p.tolist() for p in places], "sums": [sums] + [None] * (len(group) - 1)})

    return run


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """Put all rows into ``shards`` shards of near equal bytes, rows with equal texts together.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot (gapless from 0 within a shard).
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = settle(rows.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("gkey")))
    n = rows.count()
    nb = F.pmod(F.xxhash64("gkey"), F.lit(blocks_for(n, BLOCK_GROUPS)))
    groups = rows.groupBy("gkey").agg(F.sum("size").alias("gsize")).withColumn("block", nb)
    parts = settle(groups.groupBy("block").applyInPandas(_difference_block(shards), "gkey binary, block long, part int, sums array<long>"))

    level = parts.where("sums is not null").select(F.col("block").alias("node"), "sums")
    moved = level.select(F.col("node").alias("block"), F.col("node").alias("top"), F.sequence(F.lit(0), F.lit(shards - 1)).alias("way"))
    count = blocks_for(n, BLOCK_GROUPS)
    while True:  # logarithmic in the number of blocks
        step = settle(
            level.withColumn("parent", F.floor(F.col("node") / FAN_IN).cast("long"))
            .groupBy("parent")
            .applyInPandas(_difference_level(shards), "node long, parent long, places array<int>, sums array<long>")
        )
        moved = moved.join(step.select(F.col("node").alias("top"), "parent", "places"), "top").select(
            "block", F.col("parent").alias("top"), F.transform("way", lambda i: F.get("places", i)).alias("way")
        )
        if count <= FAN_IN:
            break
        count = blocks_for(count, FAN_IN)
        level = step.where("sums is not null").select(F.col("parent").alias("node"), "sums")
    shard_of = parts.join(moved.select("block", "way"), "block").select("gkey", F.get("way", F.col("part")).alias("shard"))

    pieces = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks_for(n, BLOCK_GROUPS * shards)))
    placed = settle(rows.join(shard_of, "gkey").select("doc_id", "size", "text_crc32", "shard", pieces.alias("piece")))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "piece").agg(F.count("*").alias("m")).select("shard", "piece", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"))
    in_piece = Window.partitionBy("shard", "piece").orderBy("doc_id", "size", "text_crc32")
    return (
        placed.withColumn("slot", F.row_number().over(in_piece) - 1)
        .join(starts, ["shard", "piece"])
        .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("slot") + F.col("first")).cast("long").alias("slot"))
    )
