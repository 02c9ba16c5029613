"""The ledger of notices and the gate that keeps findings back until their windows close."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import gated, stamp
from ..schemas import PRIVATE_CHANNELS, PUBLISHABLE, SHOWN_UNSEEN, WINDOW_DAYS, state_dimension

PAIR = ["server_id", "finding_id"]
WINDOW = f"interval {WINDOW_DAYS} days"


def disclosure_records(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts per server and finding: notified_at, extended_until, withdrawn; servers that opted out).

    The earliest notice on a private channel counts, the latest extension, any withdrawal.
    """
    private = (F.col("kind") == "notice") & F.col("channel").isin(PRIVATE_CHANNELS)
    told = ledger.where(private | F.col("kind").isin("extension", "withdrawal"))
    named = told.select("server_id", F.explode(F.when(F.col("kind") == "notice", F.col("finding_ids")).otherwise(F.array("finding_id"))).alias("finding_id"), "kind", "notified_at", "until")
    at = lambda kind, stamp_: F.when(F.col("kind") == kind, F.col(stamp_))
    facts = _fold(named.select(*PAIR, at("notice", "notified_at").alias("notified_at"), at("extension", "until").alias("extended_until"), (F.col("kind") == "withdrawal").alias("withdrawn")))
    return facts, ledger.where("kind = 'opt_out'").select("server_id").distinct()


def _fold(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*PAIR).agg(F.min("notified_at").alias("notified_at"), F.max("extended_until").alias("extended_until"), F.bool_or("withdrawn").alias("withdrawn"))


def follow_moves(facts: DataFrame, history: DataFrame) -> DataFrame:
    """Facts on any earlier id of a finding hold for its current id too (within one server); earlier ids keep theirs.

    ``previous_ids`` is the whole chain, so one join on exploded ids does.
    """
    ids = history.select("server_id", F.col("finding_id").alias("current_id"), F.explode("previous_ids").alias("finding_id"))
    carried = facts.join(ids, PAIR).select("server_id", F.col("current_id").alias("finding_id"), "notified_at", "extended_until", "withdrawn")
    return _fold(facts.unionByName(carried))


def _stated(joined: DataFrame, columns: list[str], now: Column) -> DataFrame:
    closes = F.greatest(F.col("notified_at") + F.expr(WINDOW), F.col("extended_until"))
    state = (
        F.when(F.col("opted"), "opted_out")
        .when(F.col("withdrawn"), F.when(gated(F.col("severity")), "withdrawn").otherwise("retracted"))
        .when(~gated(F.col("severity")), "published")
        .when(F.col("notified_at").isNull(), "withheld")
        .when(now > closes, "disclosed")
        .otherwise("withheld")
    )
    return joined.withColumn("disclosure_state", state).select(*columns, "disclosure_state")


def with_state(findings: DataFrame, facts: DataFrame, opted_out: DataFrame, now: Column) -> DataFrame:
    """``findings`` with disclosure_state; the window's end is excluded (strictly later than it)."""
    joined = findings.join(facts, PAIR, "left").join(opted_out.withColumn("opted", F.lit(True)), "server_id", "left")
    return _stated(joined, findings.columns, now)


def state_by_ledger(history: DataFrame, facts: DataFrame, opted_out: DataFrame, now: Column) -> DataFrame:
    """The same as ``with_state`` of ``follow_moves``, with ``history`` read once.

    A finding is looked up under its own id and all its earlier ones, and what is found is folded onto its one row.
    """
    names = history.columns
    rows = history.select(F.struct(*names).alias("row"), "server_id", F.explode(F.concat(F.array("finding_id"), "previous_ids")).alias("finding_id"))
    found = rows.join(facts, PAIR, "left").groupBy(F.col("row.finding_id").alias("id")).agg(
        F.any_value("row").alias("row"), F.min("notified_at").alias("notified_at"), F.max("extended_until").alias("extended_until"), F.bool_or("withdrawn").alias("withdrawn")
    )
    flat = found.select("row.*", "notified_at", "extended_until", "withdrawn")
    return _stated(flat.join(opted_out.withColumn("opted", F.lit(True)), "server_id", "left"), names, now)


def state_counts(stated: DataFrame) -> DataFrame:
    """Findings per state, zeros included."""
    counts = stated.groupBy("disclosure_state").agg(F.count("*").alias("n"))
    return state_dimension(stated.sparkSession).join(counts, "disclosure_state", "left").select("disclosure_state", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def publish_findings(stated: DataFrame, tonight: Column) -> DataFrame:
    """Tonight's publishable rows, and rows no longer seen that stay visible, marked with when they were seen last."""
    seen, state = F.col("last_seen") == tonight, F.col("disclosure_state")
    shown = stated.where((seen & state.isin(PUBLISHABLE)) | (~seen & state.isin(SHOWN_UNSEEN)))
    return shown.withColumn("no_longer_seen_since", F.when(~seen, stamp(F.col("last_seen"))))


def publish_from_history(history: DataFrame, facts: DataFrame, opted_out: DataFrame, generated_at: Column, now: Column) -> DataFrame:
    """Publish again without a scan: what the run of ``generated_at`` saw is tonight, the gate's clock is ``now``."""
    return publish_findings(with_state(history, follow_moves(facts, history), opted_out, now), generated_at)


def check_notices(notices: DataFrame, history: DataFrame, verified: DataFrame, now: Column) -> DataFrame:
    """server_id, finding_id, notified_at, refusal for each finding that a notice names (null: none)."""
    named = notices.select("server_id", "notified_at", F.explode_outer("finding_ids").alias("finding_id"))
    known = history.select("finding_id", F.col("server_id").alias("found_at"), "first_seen")
    checked = named.join(known, "finding_id", "left").join(verified.select("finding_id").distinct().withColumn("verified", F.lit(True)), "finding_id", "left")
    refusal = (
        F.when(F.col("finding_id").isNull(), "names nothing")
        .when(F.col("notified_at") > now, "dated in the future")
        .when(F.col("found_at").isNull(), "unknown finding")
        .when(F.col("found_at") != F.col("server_id"), "another server")
        .when(F.col("verified").isNull(), "not verified")
        .when(F.col("notified_at") < F.col("first_seen"), "dated before it was seen")
    )
    return checked.select("server_id", "finding_id", "notified_at", refusal.alias("refusal"))


def human_true_positives(annotations: DataFrame, entries: DataFrame) -> DataFrame:
    """finding_id, reason where a person's latest label is a true positive (the smallest reason where several agree)."""
    latest = annotations.groupBy("annotator", "entry_id").agg(F.max_by(F.struct("label", "reason"), "seq").alias("a"))
    true = latest.where("a.label = 'true_positive'").groupBy("entry_id").agg(F.min("a.reason").alias("reason"))
    return true.join(entries.select("entry_id", "finding_id"), "entry_id").select("finding_id", "reason")


def select_findings(verified: DataFrame, history: DataFrame, facts: DataFrame, opted_out: DataFrame, tonight: Column) -> DataFrame:
    """Verified findings by class: no longer produced, already notified, opted out, to draft (in that order)."""
    rows = history.select("finding_id", F.col("server_id"), "last_seen")
    joined = verified.select("finding_id").distinct().join(rows, "finding_id", "left").join(facts.select(*PAIR, "notified_at"), PAIR, "left")
    joined = joined.join(opted_out.withColumn("opted", F.lit(True)), "server_id", "left")
    kind = F.when(F.coalesce(F.col("last_seen") != tonight, F.lit(True)), "no longer produced").when(F.col("notified_at").isNotNull(), "already notified").when(F.col("opted"), "opted out").otherwise("to draft")
    return joined.select("finding_id", "server_id", kind.alias("class"))


def notice_table(selected: DataFrame, history: DataFrame, servers: DataFrame, now: Column) -> DataFrame:
    """Per server to be told: items with permalinks, distinct rules, and the day its window closes."""
    items = selected.where("class = 'to draft'").select("finding_id").join(history, "finding_id").join(servers.select("server_id", "repo_url"), "server_id")
    link = F.concat("repo_url", F.lit("/blob/"), "commit_sha", F.lit("/"), "file", F.lit("#L"), F.col("line").cast("string"))
    grouped = items.withColumn("link", link).groupBy("server_id").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("link")).alias("links"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    return grouped.withColumn("closes_on", F.date_format(F.date_add(now.cast("date"), WINDOW_DAYS), "yyyy-MM-dd"))


def ledger_summary(ledger: DataFrame, now: Column) -> DataFrame:
    notice = F.col("kind") == "notice"
    closes = F.when(notice, F.col("notified_at") + F.expr(WINDOW))
    ahead = F.when(closes > now, closes)
    return ledger.agg(
        F.count_if(notice).alias("notices"),
        F.coalesce(F.sum(F.when(notice, F.size("finding_ids"))), F.lit(0)).alias("findings_named"),
        F.count_if(F.col("kind") == "opt_out").alias("opt_outs"),
        F.count_if(notice & F.col("acknowledged_at").isNotNull()).alias("acknowledged"),
        F.count_if(notice & F.col("fixed_at").isNotNull()).alias("fixed"),
        stamp(F.min(ahead)).alias("next_close"),
        stamp(F.max(ahead)).alias("last_close"),
    )


def notice_id() -> Column:
    return F.concat("server_id", F.lit("@"), stamp(F.col("notified_at")))


def mark_notices(ledger: DataFrame, updates: DataFrame) -> DataFrame:
    """Notices with acknowledged_at and fixed_at from ``updates`` (notice_id, acknowledged_at, fixed_at).

    Notices to one server within one second share an id; ``updates`` with a column reference tell them apart by that of the
    notice.  An update that still means several notices stops the query.  Several of one notice are one update of their
    latest stamps, and every notice stays one row.
    """
    key = ["notice_id", "reference"] if "reference" in updates.columns else ["notice_id"]
    named = ledger.where("kind = 'notice'").withColumn("notice_id", notice_id())
    u = updates.groupBy(*[F.col(k).alias(f"u_{k}") for k in key]).agg(F.max("acknowledged_at").alias("u_ack"), F.max("fixed_at").alias("u_fixed"), F.lit(True).alias("u_is"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"u_{k}")) for k in key])
    several = F.col("u_is") & (F.count("*").over(Window.partitionBy(*key)) > 1)
    refused = lambda c: F.when(several, F.raise_error(F.concat(F.lit("several notices are meant by "), "notice_id"))).otherwise(c)
    marked = named.join(u, same, "left")
    return marked.withColumns({"acknowledged_at": refused(F.coalesce("u_ack", "acknowledged_at")), "fixed_at": refused(F.coalesce("u_fixed", "fixed_at"))}).select(*named.columns)


def redact_benchmark(entries: DataFrame, stated: DataFrame, fields: list[str]) -> DataFrame:
    """The allowed fields of the entries whose finding may be published."""
    shown = stated.where(F.col("disclosure_state").isin(PUBLISHABLE)).select("finding_id")
    return entries.join(shown, "finding_id", "left_semi").select(*fields)
