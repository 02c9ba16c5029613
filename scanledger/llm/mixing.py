"""Mixing sources to target weights by Pareto order sampling.

A document's expected number of copies is a level of its source times the document's weight, ``MOST_COPIES`` at most; the
level is such that the source's expected words are its target.  The whole part is taken for certain; the rest is the
document's inclusion probability p.  Documents are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p))
with u from a hash of the id, and taken in that order until the source's remaining words are used up.  Ranks are cut by
counting words in bins of the rank, then in bins within the bin that is split, so that only one small bin per source is
ever sorted; of the documents behind the cut, the largest that still fits what is left is added.

Weights are rounded to ``STEPS`` to the octave, so that a source has a bounded number of them however many documents it
has.  Unless given, a weight grows with the logarithm of the document's words: very short texts teach little.

Tables with one row per source are settled, so that Spark knows their size and broadcasts them only while they are small.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, after all others; repeated
rows are ranked apart by their number among equals; rows without an id are ranked like any other; a source of size 0 has
target 0; a null or negative weight counts as 0; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPACE, pick, settle

BINS = 4096
MOST_COPIES = 3
STEPS = 8


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than the blank and code points 9 to 13; null counts as empty."""
    words = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"^{WORD_SPACE}|{WORD_SPACE}$", ""), WORD_SPACE)
    return F.when(F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.size(words)).otherwise(0).cast("long")


def source_targets(sized: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target: weights 1, 2, 3, repeating over the sources in order share all words.

    No target exceeds ``most`` times its source's size; what is above is shared among the others by weight.  Targets
    are min(most * size, level * weight); the level follows from running sums over the sources by size to weight.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sums = sums.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("most", (F.col("source_size") * most).cast("double"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        sums.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
    )
    # The sources before the first one that stays below its bound are full; that one sets the level of all that follow.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("full", "level"))).over(every)["level"]
    return sums.withColumn("level", level).select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def _cut(rows: DataFrame, room: DataFrame) -> DataFrame:
    """Of ``rows`` (source, size, rank in [0, 1), ...) those that fit, in rank order, into ``room`` (source, room).

    Returns ``rows`` with ``in`` set for what fits before the first row that doesn't.
    """
    first = F.floor(F.col("rank") * BINS).cast("int")
    second = F.floor((F.col("rank") * BINS - first) * BINS).cast("int")
    rows = rows.withColumn("b1", first).withColumn("b2", second)
    up_to = Window.partitionBy("source").orderBy("b1", "b2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins1 = rows.groupBy("source", "b1").agg(F.sum("size").alias("words"))
    ends1 = bins1.withColumn("end", F.sum("words").over(Window.partitionBy("source").orderBy("b1"))).join(room, F.expr("source <=> source_r"))
    split1 = ends1.where("end > room").groupBy("source_r").agg(F.min(F.struct("b1", (F.col("end") - F.col("words")).alias("before"))).alias("s1"))
    cut1 = room.join(split1.withColumnRenamed("source_r", "source_s"), F.expr("source_r <=> source_s"), "left").select("source_r", "room", F.col("s1.b1").alias("c1"), F.col("s1.before").alias("before1"))
    cut1 = settle(cut1)
    bins2 = rows.join(cut1, F.expr("source <=> source_r and b1 = c1")).groupBy("source", "source_r", "b1", "b2", "room", "before1").agg(F.sum("size").alias("words"))
    ends2 = bins2.withColumn("end", F.col("before1") + F.sum("words").over(up_to))
    split2 = ends2.where("end > room").groupBy("source").agg(F.min(F.struct("b2", (F.col("end") - F.col("words")).alias("before"))).alias("s2")).select(F.col("source").alias("source_t"), F.col("s2.b2").alias("c2"), F.col("s2.before").alias("before2"))
    cuts = cut1.join(split2, F.expr("source_r <=> source_t"), "left").drop("source_t", "before1")
    cuts = settle(cuts)
    marked = rows.join(cuts, F.expr("source <=> source_r")).drop("source_r")
    at = (F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2"))
    inside = F.col("c1").isNull() | (F.col("b1") < F.col("c1")) | ((F.col("b1") == F.col("c1")) & (F.col("c2").isNull() | (F.col("b2") < F.col("c2"))))
    edge = marked.where(at).withColumn("end", F.col("before2") + F.sum("size").over(Window.partitionBy("source").orderBy("rank", "doc_id", "copy_no")))
    rest = marked.where(~F.coalesce(at, F.lit(False))).withColumn("in", inside)
    keep = [c for c in rows.columns if c not in ("b1", "b2")]
    return rest.select(*keep, "in").union(edge.withColumn("in", F.col("end") <= F.col("room")).select(*keep, "in"))


def length_weight(size: Column) -> Column:
    """1 for a text without words, one more for each doubling of their number."""
    return 1 + F.floor(F.log2(size.cast("double") + 1)).cast("double")


def source_levels(weighted: DataFrame, targets: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """source, weight, source_size, target, wanted: expected copies of a document of each source and weight.

    Wanted is min(most, level * weight), heavier documents reach the bound first; those before the first weight that stays
    below it set the level of all that follow.
    """
    sums = weighted.groupBy("source", "weight").agg(F.sum("size").alias("words"))
    t = targets.select(F.col("source").alias("source_t"), "source_size", "target")
    sums = sums.join(t, F.expr("source <=> source_t")).drop("source_t")
    heavy = Window.partitionBy("source").orderBy(F.col("weight").desc())
    before, every = heavy.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("source")
    mass = F.col("words") * F.col("weight")
    full = most * F.coalesce(F.sum("words").over(before), F.lit(0))
    left = F.sum(mass).over(heavy.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    sums = sums.withColumn("level", F.try_divide(F.greatest(F.col("target") - full, F.lit(0.0)), F.when(left > 0, left)))
    below = F.col("level") * F.col("weight") <= most
    level = F.max_by(F.when(below, F.col("level")), F.when(below, F.col("weight"))).over(every)
    wanted = F.least(F.lit(float(most)), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return sums.select("source", "weight", "source_size", "target", F.when((F.col("source_size") > 0) & (F.col("weight") > 0), wanted).otherwise(0.0).alias("wanted"))


def ranked_documents(sized: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, copy_no, source, size, source_size, target, whole, p, u, rank of each row of ``sized`` (doc_id, source, size, copy_no, optional weight).

    ``whole`` copies are certain, p is the probability of one more, u a number in (0, 1) from a hash; rank, in [0, 1), grows
    with the odds of u over those of p.
    """
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)) if "weight" in sized.columns else length_weight(F.col("size"))
    rows = sized.select("doc_id", "copy_no", "source", "size", weight.alias("weight"))
    rows = rows.withColumn("weight", F.when(F.col("weight") > 0, F.pow(2.0, F.round(F.log2(F.greatest("weight", F.lit(1e-300))) * STEPS) / STEPS)).otherwise(0.0))
    levels = settle(source_levels(rows, targets))
    levels = levels.select(F.col("source").alias("source_l"), F.col("weight").alias("weight_l"), "source_size", "target", "wanted")
    rows = rows.join(levels, F.expr("source <=> source_l and weight = weight_l")).drop("source_l", "weight_l")
    rows = rows.withColumn("whole", F.floor(F.col("wanted") + 1e-9).cast("int")).withColumn("p", F.greatest(F.col("wanted") - F.col("whole"), F.lit(0.0)))
    # u in (0, 1) from 52 bits of a hash; odds above 0, so that odds / (1 + odds) ranks in [0, 1) as the odds do.
    rows = rows.withColumn("u", (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size", "copy_no"), 12) + 0.5) / float(1 << 52))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.greatest("p", F.lit(1e-12)) / (1 - F.least("p", F.lit(1 - 1e-12))))
    rows = rows.withColumn("rank", F.least(odds / (1 + odds), F.lit(1 - 2.0**-53)))
    return settle(rows.select("doc_id", "copy_no", "source", "size", "source_size", "target", "whole", "p", "u", "rank"))


def pareto_mix(sized: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """Whole copies of each row of ``sized`` (doc_id, source, size, copy_no, optional weight) under ``targets``.

    Returns doc_id, copy_no, source, size, source_size, target, copies.
    """
    rows = ranked_documents(sized, targets, seed).drop("u")
    room = settle(rows.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("whole"))).alias("room")).withColumnRenamed("source", "source_r"))
    closed = (F.col("p") <= 0) | (F.col("size") == 0)
    cut = settle(_cut(rows.where(~closed), room).unionByName(rows.where(closed).withColumn("in", F.lit(False))))
    used = cut.where("in").groupBy("source").agg(F.sum("size").alias("used")).withColumnRenamed("source", "source_u")
    left = settle(room.join(used, F.expr("source_r <=> source_u"), "left").select("source_r", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")))
    last = (
        cut.where("not `in` and p > 0 and size > 0")
        .join(left, F.expr("source <=> source_r and size <= room"))
        .groupBy("source")
        .agg(F.max_by(F.struct("doc_id", "copy_no"), F.struct("size", -F.col("rank"))).alias("last"))
        .select(F.col("source").alias("source_f"), F.col("last.doc_id").alias("last_id"), F.col("last.copy_no").alias("last_no"))
    )
    fills = F.expr("source <=> source_f and doc_id <=> last_id and copy_no = last_no and not `in`")
    done = cut.join(settle(last), fills, "left").withColumn("in", F.col("in") | F.col("last_no").isNotNull())
    return done.select("doc_id", "copy_no", "source", "size", "source_size", "target", (F.col("whole") + F.col("in").cast("int")).alias("copies"))


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size and copy_no (0, 1, ... among rows equal in all three), settled."""
    rows = pick(docs, doc_id=id_col, source=source_col, text=text_col).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    counts = rows.groupBy("doc_id", "source", "size").agg(F.count("*").cast("int").alias("n"))
    return settle(counts.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy_no")))


def mix_documents(docs: DataFrame) -> DataFrame:
    """Words that the mix takes of each document: doc_id, copy_no, source, size, source_size, target, copies, taken."""
    sized = sized_documents(docs)
    return pareto_mix(sized, settle(source_targets(sized))).withColumn("taken", F.col("copies").cast("long") * F.col("size"))
