"""Scores, thresholds, calibration, agreement, and what context changes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .golden import verdicts_differ
from .sampling import numbered_by_hash

FLOOR = 0.80
BINS = 5
REPLICATES = 2000
#: Counts that a sign test sums as whole numbers, and steps of a larger one at a time.
EXACT, STEPS = 1000, 1 << 15


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def unmatched(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """entry_id, side of labels without a prediction and the reverse (a score refuses any)."""
    a = labels.select("entry_id").join(predictions.select("entry_id"), "entry_id", "left_anti").withColumn("side", F.lit("label"))
    return a.union(predictions.select("entry_id").join(labels.select("entry_id"), "entry_id", "left_anti").withColumn("side", F.lit("prediction")))


def _scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]


def score_rules(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per rule: precision, recall, F1 and support; entries labelled unsure don't count."""
    rows = labels.join(predictions.select("entry_id", "verdict"), "entry_id").where("label <> 'unsure'")
    true, said = F.col("label") == "true_positive", F.col("verdict")
    sums = rows.groupBy("rule_id").agg(F.count_if(true & said).alias("tp"), F.count_if(~true & said).alias("fp"), F.count_if(true & ~said).alias("fn"), F.count("*").alias("support"))
    return sums.select("rule_id", *_scores(F.col("tp"), F.col("fp"), F.col("fn")), "support")


def weighted_precision(scores: DataFrame, population: DataFrame) -> DataFrame:
    joined = scores.join(population, "rule_id")
    return joined.agg(ratio(F.sum(F.col("precision") * F.col("population")), F.sum("population")).alias("weighted_precision"))


def sweep_thresholds(labelled: DataFrame, steps: int = 100) -> DataFrame:
    """Scores at every k / steps: rows are first summed by the last threshold that they reach, then met with the thresholds."""
    true, p = F.col("label") == "true_positive", F.col("probability")
    near = F.floor(p * steps)
    reached = F.when(F.isnan(p), steps).when((near + 1) / F.lit(float(steps)) <= p, near + 1).when(near / F.lit(float(steps)) > p, near - 1).otherwise(near)
    bins = labelled.where("label <> 'unsure' and probability is not null").groupBy(F.least(F.greatest(reached, F.lit(-1)), F.lit(steps)).alias("reached"))
    counts = bins.agg(F.count_if(true).alias("t"), F.count_if(~true).alias("f"))  # ``steps`` and two rows at most
    marks = labelled.sparkSession.range(steps + 1).select("id", (F.col("id") / float(steps)).alias("threshold"))
    said = F.col("reached") >= F.col("id")
    sums = counts.crossJoin(F.broadcast(marks)).groupBy("threshold").agg(F.sum(F.when(said, F.col("t")).otherwise(0)).alias("tp"), F.sum(F.when(said, F.col("f")).otherwise(0)).alias("fp"), F.sum(F.when(~said, F.col("t")).otherwise(0)).alias("fn"))
    return sums.select("threshold", *_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def choose_threshold(swept: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Above the precision floor the largest recall, then the largest threshold; none if no threshold reaches it."""
    return swept.where(F.col("precision") >= floor).agg(F.max(F.struct("recall", "threshold", "precision")).alias("b")).where("b is not null").select("b.threshold", "b.precision", "b.recall")


def _outcomes_up_to(n: int, k: int) -> float:
    """Share of the 2^n outcomes of n tosses with at most k heads, k <= n / 2.

    Binomial coefficients are taken as multiples of the middle one, downwards by their ratios, until they vanish beside it:
    some 40 * sqrt(n) steps, whatever k is.  Shares below 1e-290 come out as 0.
    """
    at, term, whole, tail = n // 2, 1.0, 0.0, 0.0
    while at >= 0 and term > 1e-300:
        i = np.arange(at, max(at - STEPS, -1), -1, dtype="float64")
        ratios = i / (n - i + 1)
        terms = term * np.concatenate(([1.0], np.cumprod(ratios[:-1])))
        whole, tail = whole + terms.sum(), tail + terms[i <= k].sum()
        at, term = at - STEPS, terms[-1] * ratios[-1]
    return float(tail / (2 * whole - (n % 2 == 0)))  # the other half is the same, and an even n has one middle


def _sign_test(more: pd.Series, less: pd.Series) -> pd.Series:
    def one(a: int, b: int) -> float:
        n, k = int(a + b), int(min(a, b))
        if n > EXACT:  # whole coefficients have n bits, and there are k of them
            return min(1.0, 2 * _outcomes_up_to(n, k))
        return 1.0 if n == 0 else min(1.0, sum(math.comb(n, i) for i in range(k + 1)) / (1 << (n - 1)))

    return pd.Series([one(a, b) for a, b in zip(more, less, strict=True)], dtype="float64")


def sign_test(more: Column, less: Column) -> Column:
    """Exact two-sided binomial p-value of two counts, ties left out by the caller; beyond ``EXACT`` counts to some 12 digits."""
    return F.pandas_udf(_sign_test, "double")(more.cast("long"), less.cast("long"))


def cluster_bootstrap_ci(rows: DataFrame, cluster: str, numerator: Column, replicates: int = REPLICATES, seed: int = 7) -> DataFrame:
    """low, high: 95% interval of a share when whole clusters are drawn with replacement.

    Rows become one sum and one count per cluster first; clusters are numbered in the order of their names' hashes.  Draw
    ``slot`` of a replicate takes the cluster whose number is a hash modulo the number of clusters.
    """
    sums = rows.groupBy(F.col(cluster).alias("c")).agg(F.sum(numerator.cast("long")).alias("a"), F.count("*").alias("n"))
    sums = numbered_by_hash(sums.withColumn("h", F.sha2(F.col("c").cast("string").cast("binary"), 256)), "h", ["c"], "at").withColumn("at", F.col("at") - 1)
    k = sums.agg(F.count("*").alias("k"))
    slots = rows.sparkSession.range(replicates).withColumnRenamed("id", "rep").crossJoin(F.broadcast(k)).where("k > 0")
    slots = slots.select("rep", "k", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("slot"))
    drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "rep", "slot").cast("binary"), 256), 1, 8), 16, 10).cast("long") % F.col("k")
    values = slots.withColumn("at", drawn).join(sums.select("at", "a", "n"), "at").groupBy("rep").agg((F.sum("a") / F.sum("n")).alias("value"))
    ranked = values.withColumn("rank", F.row_number().over(Window.orderBy("value", "rep")) - 1)
    low, high = math.floor(0.025 * replicates), min(math.ceil(0.975 * replicates) - 1, replicates - 1)
    return ranked.agg(F.max(F.when(F.col("rank") == low, F.col("value"))).alias("low"), F.max(F.when(F.col("rank") == high, F.col("value"))).alias("high"))


def cohens_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement, kappa (null where chance agreement is complete)."""
    counts = pairs.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))
    marked = counts.withColumn("total", F.sum("n").over(every)).withColumn("row", F.sum("n").over(Window.partitionBy("a"))).withColumn("col", F.sum("n").over(Window.partitionBy("b")))
    rows = marked.groupBy("a").agg(F.first("row").alias("row")).withColumnRenamed("a", "x")
    cols = marked.groupBy("b").agg(F.first("col").alias("col")).withColumnRenamed("b", "x")
    total = marked.agg(F.coalesce(F.max("total"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    chance = rows.join(cols, "x").agg(F.coalesce(F.sum(F.col("row").cast("double") * F.col("col")), F.lit(0.0)).alias("chance"))
    both = total.crossJoin(chance)
    observed, expected = F.col("same") / F.col("n"), F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    return both.where("n > 0").select("n", observed.alias("agreement"), F.when(F.abs(expected - 1) > 1e-12, (observed - expected) / (1 - expected)).alias("kappa"))


def brier_score(p: Column, truth: Column) -> Column:
    return F.avg(F.pow(p - truth.cast("double"), 2))


def reliability(rows: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """Per bin of ``p``: n, mean_p, rate of ``truth``; empty bins are absent."""
    bin_ = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("truth").cast("double")).alias("rate"))


def expected_calibration_error(reliable: DataFrame, by: list[str]) -> DataFrame:
    return reliable.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def by_condition(rows: DataFrame) -> DataFrame:
    """One row per entry and condition asked: condition, p."""
    return rows.select("*", F.explode(F.create_map(F.lit("window"), F.col("p_window"), F.lit("function"), F.col("p_function"))).alias("condition", "p")).where("p is not null")


def paired(rows: DataFrame) -> DataFrame:
    return rows.where("p_window is not null and p_function is not null and not isnan(p_window) and not isnan(p_function)")


def decided_by_human(rows: DataFrame) -> DataFrame:
    return rows.where("labelled_by = 'human' and label in ('true_positive', 'false_positive')")


def window_errors(rows: DataFrame) -> DataFrame:
    """Disagreements that people decided against the window; credulous where the window believed the finding."""
    said = F.col("p_window") >= 0.5
    wrong = said != (F.col("label") == "true_positive")
    return decided_by_human(paired(rows)).where(verdicts_differ() & wrong).withColumn("credulous", said)


def credulous_report(errors: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """n, credulous, share, p_value over the window's errors, and the share's interval (low, high) over servers."""
    sums = errors.agg(F.count("*").alias("n"), F.count_if("credulous").alias("credulous")).select("n", "credulous", ratio(F.col("credulous"), F.col("n")).alias("share"), sign_test(F.col("credulous"), F.col("n") - F.col("credulous")).alias("p_value"))
    return sums.crossJoin(cluster_bootstrap_ci(errors, "server_id", F.col("credulous").cast("int"), replicates))


def flip_share(rows: DataFrame) -> DataFrame:
    return paired(rows).agg(F.count("*").alias("n"), F.count_if(verdicts_differ()).alias("flips")).withColumn("share", ratio(F.col("flips"), F.col("n")))


def without_largest(rows: DataFrame) -> DataFrame:
    """Rows without the server of most verdict changes (ties by name)."""
    flips = paired(rows).where(verdicts_differ()).groupBy("server_id").agg(F.count("*").alias("n"))
    return rows.join(flips.orderBy(F.desc("n"), "server_id").limit(1).select("server_id"), "server_id", "left_anti")


def side_counts(rows: DataFrame) -> DataFrame:
    true = F.col("label") == "true_positive"
    return decided_by_human(paired(rows)).where(verdicts_differ()).agg(F.count_if((F.col("p_window") >= 0.5) == true).alias("window_right"), F.count_if((F.col("p_function") >= 0.5) == true).alias("function_right"))


def unsure_counts(rows: DataFrame) -> DataFrame:
    people = paired(rows).where(verdicts_differ() & (F.col("labelled_by") == "human"))
    return people.agg(F.count_if(F.col("label") == "unsure").alias("unsure"), F.count("*").alias("of_human"))


def compare_conditions(observed: DataFrame) -> DataFrame:
    """Per condition over entries judged under both (entry_id, condition, label): n, decided, unsure, true, precision or null."""
    both = observed.groupBy("entry_id").agg(F.count_distinct("condition").alias("k")).where("k = 2").select("entry_id")
    rows = observed.join(both, "entry_id", "left_semi")
    decided, true = F.count_if(F.col("label") != "unsure"), F.count_if(F.col("label") == "true_positive")
    return rows.groupBy("condition").agg(F.count("*").alias("n"), decided.alias("decided"), F.count_if(F.col("label") == "unsure").alias("unsure"), true.alias("true_positives"), F.try_divide(true, decided).alias("precision"))


def resolved_by_context(wide: DataFrame) -> DataFrame:
    """Of (narrow, wide) labels: undecided narrow and decided wide, how many of them true, and their share."""
    rows = wide.where("narrow = 'unsure' and wide <> 'unsure'")
    return rows.agg(F.count("*").alias("resolved"), F.count_if(F.col("wide") == "true_positive").alias("true_positives")).withColumn("share", ratio(F.col("true_positives"), F.col("resolved")))


def decisiveness(rows: DataFrame) -> DataFrame:
    """Per rule and over all (rule_id null): n, medians of |p - 0.5|, how often the function was more, less or as decisive, and the sign test of that."""
    w, f = F.abs(F.col("p_window") - 0.5), F.abs(F.col("p_function") - 0.5)
    out = paired(rows).withColumns({"w": w, "f": f}).rollup("rule_id").agg(
        F.count("*").alias("n"), F.median("w").alias("median_window"), F.median("f").alias("median_function"), F.count_if(F.col("f") > F.col("w")).alias("more"), F.count_if(F.col("f") < F.col("w")).alias("less"), F.count_if(F.col("f") == F.col("w")).alias("tied")
    )
    return out.withColumn("p_value", sign_test(F.col("more"), F.col("less")))


def flip_sensitivity(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold: flips, n, servers with flips, the largest server's count and its share."""
    marks = rows.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    flip = (F.col("p_window") >= F.col("threshold")) != (F.col("p_function") >= F.col("threshold"))
    per = paired(rows).crossJoin(F.broadcast(marks)).groupBy("threshold", "server_id").agg(F.count_if(flip).alias("flips"), F.count("*").alias("n"))
    out = per.groupBy("threshold").agg(F.sum("flips").alias("flips"), F.sum("n").alias("n"), F.count_if(F.col("flips") > 0).alias("servers"), F.max("flips").alias("largest"))
    return out.withColumn("largest_share", ratio(F.col("largest"), F.col("flips")))


def truth_agreement(rows: DataFrame, labelled_by: str) -> DataFrame:
    """On disagreements decided by one kind of labeller: right, credulous and missed per condition, vulnerable, servers, tests."""
    decided = paired(rows).where(verdicts_differ() & (F.col("labelled_by") == labelled_by) & (F.col("label") != "unsure"))
    true, w, f = F.col("label") == "true_positive", F.col("p_window") >= 0.5, F.col("p_function") >= 0.5
    sums = decided.agg(
        F.count("*").alias("n"), F.count_if(w == true).alias("window_right"), F.count_if(f == true).alias("function_right"), F.count_if(w & ~true).alias("window_credulous"), F.count_if(f & ~true).alias("function_credulous"),
        F.count_if(~w & true).alias("window_missed"), F.count_if(~f & true).alias("function_missed"), F.count_if(true).alias("vulnerable"), F.count_distinct("server_id").alias("servers"),
    )
    return sums.withColumn("p_value", sign_test(F.col("function_right"), F.col("window_right")))


def retest_stability(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two runs (entry_id, condition, p) per condition: n, verdict changes, identical, median and largest shift."""
    joined = first.join(second.select("entry_id", "condition", F.col("p").alias("q")), ["entry_id", "condition"])
    shift = F.abs(F.col("p") - F.col("q"))
    return joined.withColumn("shift", shift).groupBy("condition").agg(F.count("*").alias("n"), F.count_if((F.col("p") >= 0.5) != (F.col("q") >= 0.5)).alias("changes"), F.count_if(F.col("shift") == 0).alias("identical"), F.median("shift").alias("median_shift"), F.max("shift").alias("max_shift"))


def flip_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """Sets of entries that flipped in two runs: both, only one, and their Jaccard similarity (1.0 for two empty sets)."""
    a, b = first.select("entry_id", F.lit(1).alias("a")), second.select("entry_id", F.lit(1).alias("b"))
    both, one, two = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()), F.count_if(F.col("b").isNull()), F.count_if(F.col("a").isNull())
    out = a.join(b, "entry_id", "full_outer").agg(both.alias("both"), one.alias("only_first"), two.alias("only_second"))
    union = F.col("both") + F.col("only_first") + F.col("only_second")
    return out.withColumn("jaccard", F.when(union > 0, F.col("both") / union).otherwise(1.0))


def shift_summary(rows: DataFrame) -> DataFrame:
    """Function against window: lower, higher, unchanged, median shift, sign test."""
    d = F.col("p_function") - F.col("p_window")
    out = paired(rows).withColumn("d", d).agg(F.count_if(F.col("d") < 0).alias("lower"), F.count_if(F.col("d") > 0).alias("higher"), F.count_if(F.col("d") == 0).alias("unchanged"), F.median("d").alias("median_shift"))
    return out.withColumn("p_value", sign_test(F.col("higher"), F.col("lower")))
