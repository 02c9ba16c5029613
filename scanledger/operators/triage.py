"""Adjudication with a cache and a budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import settled

DECIDED = "key string, probability double, cost_usd double, latency_ms double, failure string"


def valid_decision() -> Column:
    p, c = F.col("probability"), F.col("cost_usd")
    return F.coalesce(~F.isnan(p) & p.between(0, 1) & (c >= 0) & ~F.isnan(c), F.lit(False))


def rules_only(text: str) -> tuple[float, float]:
    """The judge that believes every finding: probability 1 at no cost."""
    return 1.0, 0.0


def _ask(judge: Callable[[str], tuple[float, float]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, text in zip(frame["key"], frame["shown"], strict=True):
                try:
                    out.append((key, *judge(text), 0.0, None))
                except Exception as e:
                    out.append((key, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["key", "probability", "cost_usd", "latency_ms", "failure"])

    return run


def adjudicate(entries: DataFrame, cache: DataFrame, judge: Callable[[str], tuple[float, float]], most_calls: int) -> tuple[DataFrame, DataFrame]:
    """(entry_id, key, probability, source, failure per entry; new cache rows) for entries (entry_id, key, shown).

    Cached answers are free, the same question is asked once, and questions are asked, first come first by entry, until
    ``most_calls`` have succeeded or none are left; the rest stay null.  A failed call, or an answer that is no valid
    decision, does not count against the budget and is not cached.

    Questions go out in rounds, each of as many of the next ones as the budget still lacks: exactly those that asking one
    after the other would have asked, since a round ends the job only if all of it succeeded.  A round is written before
    the next begins, so no question goes out twice but for one whose task is run again.
    """
    spark = entries.sparkSession
    entries = settled(entries.select("entry_id", "key", "shown"))
    known = settled(entries.select("entry_id", "key").join(cache.groupBy("key").agg(F.min("probability").alias("probability")), "key", "left"))
    answered = known.where("probability is not null").select("key").distinct()
    questions = entries.join(answered, "key", "left_anti").groupBy("key").agg(F.min("entry_id").alias("first"), F.min("shown").alias("shown"))
    questions = settled(questions.select("key", F.struct("first", "key").alias("place"), "shown"))  # once for all rounds
    order = questions.select("key", "place")
    rounds: list[DataFrame] = []
    last, lacking, kinds = None, most_calls, order.schema["place"].dataType.fields
    while lacking > 0:
        after = order if last is None else order.where(F.col("place") > F.struct(*[F.lit(x).cast(t.dataType) for x, t in zip(last, kinds, strict=True)]))
        wanted = lacking
        asked = settled(after.orderBy("place").limit(wanted))
        end = asked.agg(F.count("*").alias("n"), F.max("place").alias("place")).first()
        if not end["n"]:
            break
        answers = settled(questions.select("key", "shown").join(asked.select("key"), "key").repartition(spark.sparkContext.defaultParallelism, "key").mapInPandas(_ask(judge), DECIDED))
        rounds.append(answers)
        lacking -= answers.where(valid_decision()).count()
        last = tuple(end["place"])
        if end["n"] < wanted:  # these were the last
            break
    answers = spark.createDataFrame([], DECIDED)
    for each in rounds:
        answers = answers.unionByName(each)
    answers = answers.withColumn("failure", F.when(~valid_decision(), F.coalesce("failure", F.lit("no valid decision"))))
    fresh = answers.where("failure is null")
    new = answers.select("key", F.when(F.col("failure").isNull(), F.col("probability")).alias("new"), "failure")
    joined = known.join(new, "key", "left")
    source = F.when(F.col("probability").isNotNull(), "cache").when(F.col("new").isNotNull(), "judge").when(F.col("failure").isNotNull(), "failed").otherwise("over budget")
    return joined.select("entry_id", "key", F.coalesce("probability", "new").alias("probability"), source.alias("source"), "failure"), fresh


#: Calls of a block of ``spend_cap``.
BLOCK_CALLS = 50_000


def spend_cap(calls: DataFrame, cap: float, order: str, arm: str, block_calls: int = BLOCK_CALLS) -> DataFrame:
    """Calls whose arm had spent less than ``cap`` before them (the last may overshoot), with ``spent_before``; no cost is negative.

    Calls are ranged by arm and order into blocks; what an arm spent before a block is a sum over its blocks' sums, blocks
    that begin beyond the cap go, and only within a block are calls added up one by one.  A call without a cost costs
    nothing; of calls at the same place any may come first.
    """
    blocks = max(1, -(-calls.count() // block_calls))
    ranged = settled(calls.repartitionByRange(blocks, arm, order).withColumn("_block", F.spark_partition_id()))
    spent = ranged.groupBy(F.col(arm).alias("_arm"), "_block").agg(F.coalesce(F.sum("cost_usd"), F.lit(0)).alias("_spent"))
    by_block = Window.partitionBy("_arm").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begun = spent.select("_arm", F.col("_block").alias("_b"), F.coalesce(F.sum("_spent").over(by_block), F.lit(0)).alias("_begun")).where(F.col("_begun") < cap)
    within = Window.partitionBy(arm, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    left = ranged.join(begun, (F.col("_b") == F.col("_block")) & F.col(arm).eqNullSafe(F.col("_arm")))
    left = left.withColumn("spent_before", (F.col("_begun") + F.coalesce(F.sum("cost_usd").over(within), F.lit(0))).cast("double"))
    return left.where(F.col("spent_before") < cap).select(*calls.columns, "spent_before")


def cost_projection(pairs: DataFrame, sampled: DataFrame, cap: float) -> DataFrame:
    """per_call, pool, projected, over_cap: mean cost of the sampled calls times two conditions times the pool."""
    cost = sampled.agg(F.avg("cost_usd").alias("per_call"))
    pool = pairs.agg(F.count("*").alias("pool"))
    return cost.crossJoin(pool).withColumn("projected", F.col("per_call") * 2 * F.col("pool")).withColumn("over_cap", F.col("projected") > cap)


def run_totals(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count("*").alias("calls"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))


def failure_reasons(failures: DataFrame) -> DataFrame:
    """Reasons with entry ids masked, 160 characters at most, and how often each occurs."""
    reason = F.substring(F.regexp_replace("failure", r"g-\d+", "g-#"), 1, 160)
    return failures.where("failure is not null").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Cost of a call in dollars at prices per million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6
