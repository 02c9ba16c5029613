"""Reproducible draws: rank by a hash of seed and key, so that input order never matters and growth keeps the order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import draw_hash
from ..sources.io import Refused


def hashed_draw(df: DataFrame, size: int, seed: int, keys: list[str]) -> DataFrame:
    """``size`` rows with the smallest hash of seed and first key, ties by all keys (a top-k, no full sort)."""
    return df.withColumn("_h", draw_hash(seed, F.col(keys[0]))).orderBy("_h", *keys).limit(size).drop("_h")


def sample_index(index: DataFrame, size: int, seed: int) -> DataFrame:
    """The drawn servers with corpus, sampled and seed as denominators; an empty index or size is refused."""
    if size <= 0:
        raise Refused("a sample needs a positive size")
    corpus = index.count()
    if not corpus:
        raise Refused("an empty index can't be sampled")
    drawn = hashed_draw(index, size, seed, ["server_id", "repo_url"])
    return drawn.select("*", F.lit(corpus).cast("long").alias("corpus"), F.lit(min(size, corpus)).cast("long").alias("sampled"), F.lit(seed).cast("long").alias("sample_seed"))


def stratified_sample(findings: DataFrame, kept: DataFrame, per_rule: int, seed: int) -> DataFrame:
    """Findings already in ``kept`` (finding_id), and per rule as many fresh ones by hashed draw as ``per_rule`` lacks."""
    marked = findings.join(kept.select("finding_id", F.lit(True).alias("held")), "finding_id", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    held = marked.groupBy("rule_id").agg(F.count_if("held").alias("n_held"))
    order = Window.partitionBy("rule_id").orderBy(draw_hash(seed, F.col("finding_id")), "finding_id")
    fresh = marked.where("not held").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_rule)
    fresh = fresh.join(F.broadcast(held), "rule_id").where(F.col("rn") <= F.greatest(F.lit(per_rule) - F.col("n_held"), F.lit(0)))
    return marked.where("held").select(*findings.columns, "held").unionByName(fresh.select(*findings.columns, "held"))


def one_per_group(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """One row per group, by hashed draw."""
    order = Window.partitionBy(group).orderBy(draw_hash(seed, F.col(key)), key)
    return df.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def numbered_by_hash(rows: DataFrame, digest: str, ties: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: their number, from 1, in the order of a hexadecimal digest (ties by other columns).

    Rows are numbered within blocks of their first three digits; what comes together are the sizes of those 4096 blocks.
    """
    block = F.substring(digest, 1, 3)
    sizes = rows.groupBy(block.alias("_block")).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_block", before.alias("_start"))
    within = F.row_number().over(Window.partitionBy("_block").orderBy(digest, *ties))
    placed = rows.withColumn("_block", block).withColumn("_nth", within).join(starts, "_block")
    return placed.withColumn(name, (F.col("_nth") + F.col("_start")).cast("int")).drop("_block", "_nth", "_start")
