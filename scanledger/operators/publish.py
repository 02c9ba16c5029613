"""Aggregates and tables that are published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import server_slug
from ..schemas import SARIF_LEVELS

DECISION = ["server_id", "rule_id", "evidence", "status"]


def published_servers(published: DataFrame, servers: DataFrame) -> DataFrame:
    return servers.select("server_id", "repo_url").distinct().join(published.select("server_id"), "server_id", "left_semi")


def found_by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count("*").alias("found"))


def run_summary(found: DataFrame, states: DataFrame, scan: DataFrame) -> DataFrame:
    """One row: counters of the scan, maps of found by rule and findings by state, withheld with those opted out."""
    rules = found.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", "found")))).alias("found_by_rule"), F.coalesce(F.sum("found"), F.lit(0)).alias("findings_found"))
    n = lambda *names: F.coalesce(F.sum(F.when(F.col("disclosure_state").isin(*names), F.col("n"))), F.lit(0))
    gate = states.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("disclosure_state", "n")))).alias("disclosure"), n("withheld", "opted_out").alias("withheld"), n("disclosed", "published", "retracted").alias("publishable"))
    return scan.crossJoin(F.broadcast(rules)).crossJoin(F.broadcast(gate))


def row_status() -> Column:
    return (
        F.when(F.col("disclosure_state") == "retracted", "withdrawn: our error")
        .when(F.col("no_longer_seen_since").isNotNull(), F.concat(F.lit("no longer seen since "), F.substring("no_longer_seen_since", 1, 10)))
        .otherwise("current")
    )


def decisions(published: DataFrame) -> DataFrame:
    """One row per server, rule, evidence and status: occurrences, places, first and last stamps, severity of the first member."""
    rows = published.withColumn("status", row_status())
    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    return rows.groupBy(*DECISION).agg(
        F.count("*").alias("occurrences"), F.array_sort(F.collect_list(place)).alias("places"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min_by("severity", "finding_id").alias("severity")
    )


def rule_summary(rules: DataFrame, findings: DataFrame, published: DataFrame) -> DataFrame:
    """Per registered rule, zeros kept: found, current findings, current decisions, distinct servers."""
    current = published.withColumn("status", row_status()).where("status = 'current'")
    shown = current.groupBy("rule_id").agg(F.count("*").alias("current"), F.count_distinct(F.struct("server_id", "evidence")).alias("current_decisions"), F.count_distinct("server_id").alias("servers"))
    out = rules.select("rule_id", "title").join(found_by_rule(findings), "rule_id", "left").join(shown, "rule_id", "left")
    return out.select("rule_id", "title", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("found", "current", "current_decisions", "servers")])


def severity_counts(published: DataFrame) -> DataFrame:
    return published.withColumn("status", row_status()).where("status = 'current'").groupBy("severity").agg(F.count("*").alias("n"))


def site_totals(published: DataFrame, withheld: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row of totals; ``withheld`` (one row: withheld, opted out included) and ``corpus`` (one row: corpus, scanned)."""
    rows = published.withColumn("status", row_status())
    now = F.col("status") == "current"
    totals = rows.agg(
        F.count_if(now).alias("published"),
        F.count_distinct(F.when(now, F.struct("server_id", "rule_id", "evidence"))).alias("decisions"),
        F.count_distinct(F.when(now, F.col("server_id"))).alias("servers"),
        F.count_if(F.col("status").startswith("no longer")).alias("no_longer_seen"),
        F.count_if(F.col("status").startswith("withdrawn")).alias("retracted"),
    )
    return totals.crossJoin(withheld).crossJoin(corpus).withColumn("found", F.col("published") + F.col("withheld"))


def coverage_shares(totals: DataFrame) -> DataFrame:
    """Percentages of the corpus scanned and of the findings published, denominators at least 1."""
    share = lambda a, b: F.round(100.0 * F.col(a) / F.greatest(F.col(b), F.lit(1)), 4)
    return totals.select(share("scanned", "corpus").alias("scanned_share"), share("published", "found").alias("published_share"))


def top_decisions(decided: DataFrame, n: int = 10) -> DataFrame:
    current = decided.where("status = 'current'").select("server_id", "rule_id", "evidence", "occurrences")
    return current.orderBy(F.desc("occurrences"), "server_id", "rule_id", "evidence").limit(n)


def server_index(decided: DataFrame) -> DataFrame:
    """Per server: current decisions and occurrences, distinct evidence, and decisions that are not current."""
    now = F.col("status") == "current"
    return decided.groupBy("server_id").agg(
        F.count_if(now).alias("current_decisions"), F.coalesce(F.sum(F.when(now, F.col("occurrences"))), F.lit(0)).alias("occurrences"), F.array_sort(F.collect_set(F.when(now, F.col("evidence")))).alias("evidence"), F.count_if(~now).alias("others")
    )


def sarif_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule that fired with its index (from 0, by id) and its title, or a stand-in for an unknown one."""
    fired = findings.select("rule_id").distinct().withColumn("rule_index", F.row_number().over(Window.orderBy("rule_id")) - 1)
    return fired.join(F.broadcast(rules.select("rule_id", "title")), "rule_id", "left").select("rule_id", "rule_index", F.coalesce("title", F.concat(F.lit("Rule "), "rule_id")).alias("title"))


def sarif_results(findings: DataFrame, fired: DataFrame) -> DataFrame:
    levels = F.create_map(*[F.lit(x) for pair in SARIF_LEVELS.items() for x in pair])
    message = F.concat(F.col("rule_id"), F.lit(": "), F.col("evidence"))
    return findings.join(F.broadcast(fired.select("rule_id", "rule_index")), "rule_id").select("server_id", "finding_id", "rule_id", "rule_index", F.try_element_at(levels, F.col("severity")).alias("level"), message.alias("message"), "file", "line")


def slug_collisions(servers: DataFrame) -> DataFrame:
    """Slugs that more than one server would get."""
    slugs = servers.select(server_slug(F.col("server_id")).alias("slug"), "server_id").groupBy("slug").agg(F.count_distinct("server_id").alias("n"), F.min("server_id").alias("first_server"))
    return slugs.where("n > 1")
