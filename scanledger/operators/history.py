"""Stable identities, the nightly fold of findings into the history, and the trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finding_id
from ..schemas import COLLAPSE_FACTOR, CONFIDENCES, SEVERITIES
from ..sources.io import Refused, refuse_any

FIELDS = ["finding_id", "server_id", "commit_sha", "rule_id", "severity", "confidence", "file", "line", "evidence"]
STAMPS = ["first_seen", "last_seen", "previous_ids"]
MOVE_KEY = ["server_id", "rule_id", "file", "evidence"]


def with_identity(findings: DataFrame) -> DataFrame:
    return findings.withColumn("finding_id", finding_id())


def rejection(strict_commit: bool = True) -> Column:
    """Why a finding is invalid, or null."""
    return (
        F.when(~F.coalesce(F.col("severity").isin(SEVERITIES), F.lit(False)), "severity")
        .when(~F.coalesce(F.col("confidence").isin(CONFIDENCES), F.lit(False)), "confidence")
        .when(~F.coalesce(F.col("commit_sha").rlike(r"\A[0-9a-fA-F]{40}\z"), F.lit(False)), "commit")
    )


def validate_findings(findings: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason); strict refuses any rejected row."""
    judged = findings.withColumn("rejected_for", rejection())
    bad = judged.where("rejected_for is not null")
    if strict:
        refuse_any(bad, "an invalid finding")
    return judged.where("rejected_for is null").drop("rejected_for"), bad


def last_of_each(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of the largest ``order`` per key, by aggregation, without sorting groups."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*key, "r.*")


def merge_findings(previous: DataFrame, current: DataFrame, now: Column) -> DataFrame:
    """Full outer fold by finding_id; both sides have one row per id (see ``last_of_each``).

    Seen again: tonight's fields, first_seen and earlier ids kept.  New: both stamps now.  Absent: kept, with missing
    stamps repaired to now.
    """
    p = previous.select(F.col("finding_id"), *[F.col(c).alias(f"p_{c}") for c in [*FIELDS[1:], "first_seen", "last_seen", "previous_ids"]], F.lit(True).alias("p_is"))
    c = current.select("finding_id", *[F.col(x).alias(f"c_{x}") for x in FIELDS[1:]], F.lit(True).alias("c_is"))
    seen = F.col("c_is").isNotNull()
    fields = [F.when(seen, F.col(f"c_{x}")).otherwise(F.col(f"p_{x}")).alias(x) for x in FIELDS[1:]]
    return p.join(c, "finding_id", "full_outer").select(
        "finding_id",
        *fields,
        F.coalesce("p_first_seen", now).alias("first_seen"),
        F.when(seen, now).otherwise(F.coalesce("p_last_seen", now)).alias("last_seen"),
        F.coalesce("p_previous_ids", F.array().cast("array<string>")).alias("previous_ids"),
    )


def merge_nights(rows: DataFrame, tonight: Column, now: Column, order: str = "event_id") -> DataFrame:
    """The same fold from raw ``rows`` (findings with night) in one aggregation: ``tonight`` says which rows are new, the others
    make the history, seen from their first to their last night; the row of the largest ``order`` counts on each side."""
    fields = F.struct(*FIELDS[1:])
    before = F.when(~tonight, F.col("night").cast("timestamp"))
    sides = rows.groupBy("finding_id").agg(
        F.max_by(fields, F.when(tonight, F.col(order))).alias("c"), F.max_by(fields, F.when(~tonight, F.col(order))).alias("p"), F.min(before).alias("first_seen"), F.max(before).alias("last_seen")
    )
    seen = F.col("c").isNotNull()
    return sides.select(
        "finding_id",
        *[F.when(seen, F.col(f"c.{x}")).otherwise(F.col(f"p.{x}")).alias(x) for x in FIELDS[1:]],
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(seen, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.array().cast("array<string>").alias("previous_ids"),
    )


def carry_moved(merged: DataFrame, now: Column) -> DataFrame:
    """Pair what vanished with what arrived under the same server, rule, file and evidence, in line order.

    Only where as many vanished as arrived: the old row goes, the new one takes its first_seen and its chain of ids.
    All windows share one shuffle on a hash of the key, and ``merged`` is read once.
    """
    return _carried(merged.withColumn("k", F.xxhash64(*MOVE_KEY)), now).drop("k")


def _carried(rows: DataFrame, now: Column) -> DataFrame:
    """``carry_moved`` of rows with k, the hash of their key, which stays."""
    side = F.when(F.col("last_seen") != now, "gone").when((F.col("last_seen") == now) & (F.col("first_seen") == now), "came").otherwise("kept")
    rows = rows.withColumn("side", side)
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("k", *MOVE_KEY, "side").orderBy("line", "finding_id")))
    same = Window.partitionBy("k", *MOVE_KEY)
    rows = rows.withColumn("even", F.count_if(F.col("side") == "gone").over(same) == F.count_if(F.col("side") == "came").over(same))
    old = F.max(F.when(F.col("side") == "gone", F.struct("finding_id", "first_seen", "previous_ids"))).over(Window.partitionBy("k", *MOVE_KEY, "rn"))
    rows = rows.withColumn("old", F.when(F.col("even") & (F.col("side") == "came"), old))
    return rows.where("not (side = 'gone' and even)").select(
        *FIELDS,
        F.coalesce("old.first_seen", "first_seen").alias("first_seen"),
        "last_seen",
        F.when(F.col("old").isNotNull(), F.concat("old.previous_ids", F.array("old.finding_id"))).otherwise(F.col("previous_ids")).alias("previous_ids"),
        "k",
    )


def nightly_fold(previous: DataFrame, current: DataFrame, now: Column) -> DataFrame:
    return carry_moved(merge_findings(previous, current, now), now)


def dealt(history: DataFrame, buckets: int) -> DataFrame:
    """A history in the form of ``write_bucketed_history``, dealt to buckets by k, the hash of what a move keeps."""
    return history.select(*FIELDS, *STAMPS, F.lit(False).alias("tonight"), F.xxhash64(*MOVE_KEY).alias("k")).repartition(buckets, "k")


def fold_into_buckets(kept: DataFrame, current: DataFrame, now: Column, buckets: int) -> DataFrame:
    """``nightly_fold`` where ``kept`` is a history that ``write_bucketed_history`` left: only tonight's side is shuffled.

    An id is made of the fields of the key and the line, so rows of one id and all that may have moved into one another
    stand in one bucket; the merge is an aggregation and the moves are windows within it.  Both sides have one row per id,
    and server, rule, file and evidence are never null.  The result has the form of ``kept``, and is written to buckets as it
    is.  Both branches of the union stay without a projection, above which Spark would no longer know of the buckets.
    """
    types = {f.name: f.dataType for f in kept.schema}
    new = [F.col(x).cast(types[x]).alias(x) for x in FIELDS] + [F.lit(None).cast(types[x]).alias(x) for x in STAMPS]
    new = current.select(*new, F.lit(True).alias("tonight"), F.xxhash64(*MOVE_KEY).alias("k")).repartition(buckets, "k")
    sides = kept.union(new).groupBy("k", "finding_id").agg(
        F.max_by(F.struct(*FIELDS[1:]), "tonight").alias("r"), F.max("tonight").alias("seen"), *[F.first(x, ignorenulls=True).alias(x) for x in STAMPS]
    )
    merged = sides.select(
        "finding_id",
        "r.*",
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(F.col("seen"), now).otherwise(F.coalesce("last_seen", now)).alias("last_seen"),
        F.coalesce("previous_ids", F.array().cast("array<string>")).alias("previous_ids"),
        "k",
    )
    return _carried(merged, now).select(*FIELDS, *STAMPS, F.lit(False).alias("tonight"), "k")


def seen_in(history: DataFrame, at: Column) -> DataFrame:
    return history.where(F.col("last_seen") == at)


def live_findings(history: DataFrame) -> DataFrame:
    """Rows that carry the newest last_seen."""
    newest = history.agg(F.max("last_seen").alias("newest"))
    return history.crossJoin(F.broadcast(newest)).where("last_seen = newest").drop("newest")


def collapse_guard(previous_scanned: int, scanned: int) -> None:
    """Refuse a night that scanned less than half of what the one before did."""
    if previous_scanned > 0 and scanned < previous_scanned * COLLAPSE_FACTOR:
        raise Refused(f"{scanned} scanned, {previous_scanned} the night before")


def scan_collapses(scanned_by_night: DataFrame, factor: float = COLLAPSE_FACTOR) -> DataFrame:
    """night, scanned, before, refused: the guard over a series of nights."""
    before = F.lag("scanned").over(Window.orderBy("night"))
    return scanned_by_night.select("night", "scanned", before.alias("before")).withColumn("refused", F.coalesce((F.col("before") > 0) & (F.col("scanned") < F.col("before") * factor), F.lit(False)))


def history_matches_trend(history: DataFrame, trend: DataFrame) -> DataFrame:
    """newest_seen, last_point, matches: the history's newest stamp against the last point of the trend."""
    newest = history.agg(F.date_format(F.max("last_seen"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("newest_seen"))
    last = trend.agg(F.max("scanned_at").alias("last_point"))
    return newest.crossJoin(last).withColumn("matches", F.coalesce(F.col("newest_seen") == F.col("last_point"), F.lit(False)))


def trend_points(findings: DataFrame, published: DataFrame) -> DataFrame:
    """One row per night: found, published, servers and the map of found by rule."""
    by_rule = findings.groupBy("night", "rule_id").agg(F.count("*").alias("n"))
    rules = by_rule.groupBy("night").agg(F.sum("n").alias("findings_found"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", "n")))).alias("by_rule"))
    servers = findings.groupBy("night").agg(F.count_distinct("server_id").alias("servers_affected"))
    shown = published.groupBy("night").agg(F.count("*").alias("findings_published"))
    out = rules.join(servers, "night").join(shown, "night", "left").withColumn("findings_published", F.coalesce("findings_published", F.lit(0)))
    return out.withColumn("withheld", F.col("findings_found") - F.col("findings_published"))


def append_point(trend: DataFrame, point: DataFrame) -> DataFrame:
    """Upsert by day: a point replaces that of its day; late nights land in place (readers sort by stamp)."""
    day = F.substring("scanned_at", 1, 10)
    kept = trend.withColumn("_day", day).join(F.broadcast(point.select(day.alias("_day")).distinct()), "_day", "left_anti").drop("_day")
    return kept.unionByName(point, allowMissingColumns=True)


def findings_by_rule_by_night(trend: DataFrame) -> DataFrame:
    """Trend exploded: night, rule_id, n, change against the night before."""
    flat = trend.select("night", F.explode("by_rule").alias("rule_id", "n"))
    return flat.withColumn("change", F.col("n") - F.lag("n").over(Window.partitionBy("rule_id").orderBy("night")))
