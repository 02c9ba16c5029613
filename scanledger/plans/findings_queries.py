"""Queries over intake, history, disclosure and publication, each with the SQL it is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import canonical_url, linkable, stamp
from ..operators import disclosure, history, intake, publish, sampling
from ..schemas import rule_dimension
from ..sources import io
from ..streaming import merge_stream as stream
from . import sql_views as sv
from . import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


TS = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
ROW = ["finding_id", "server_id", "rule_id", "severity", "file", "line", "evidence"]


def stamped(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: stamp(F.col(n)) for n in names})


# Intake


@query(f"WITH {sv.ENTRIES} SELECT (SELECT count(*) FROM el) AS records, count(*) AS entries_seen, count(*) - (SELECT count(*) FROM el) AS skipped_without_source FROM en")
def intake_totals(spark, d):
    return intake.crawl_totals(v.entries(spark, d))


@query(f"WITH {sv.ENTRIES} SELECT server_id, repo_url, 'registry' AS discovered_via FROM el")
def eligible_entries(spark, d):
    return intake.eligible_entries(v.entries(spark, d))


@query(f"WITH {sv.ENTRIES} SELECT repo_url, string_agg(DISTINCT server_id, ',' ORDER BY server_id) AS server_ids, count(DISTINCT server_id) AS claim_count FROM el GROUP BY 1")
def corpus_by_repo(spark, d):
    return intake.build_corpus(intake.eligible_entries(v.entries(spark, d))).withColumn("server_ids", F.array_join("server_ids", ","))


@query(f"WITH {sv.DUP}, c AS (SELECT repo_url, count(DISTINCT server_id) AS n FROM du GROUP BY 1) SELECT count(*) AS repository_count, CAST(sum(n) AS BIGINT) AS entries_seen, CAST(sum(n) - count(*) AS BIGINT) AS entries_collapsed, max(n) AS most_claimed FROM c")
def corpus_stats(spark, d):
    return intake.corpus_stats(intake.eligible_entries(v.entries_dup(spark, d)))


@query(f"WITH {sv.DUP} SELECT min(server_id) AS server_id, repo_url, 'registry' AS discovered_via FROM du GROUP BY repo_url")
def index_collapse(spark, d):
    return intake.collapse_to_index(intake.eligible_entries(v.entries_dup(spark, d)))


@query("SELECT DISTINCT full_name AS server_id, 'https://github.com/' || full_name AS repo_url, 'code-search' AS discovered_via FROM (SELECT source || '/' || lang AS full_name FROM documents)")
def discoveries(spark, d):
    names = v.table(spark, d, "documents").groupBy("source").agg(F.collect_set(F.concat("source", F.lit("/"), "lang")).alias("items"))
    return intake.discoveries(names)


@query(
    f"WITH {sv.ENTRIES}, u AS (SELECT DISTINCT lower(regexp_replace(regexp_replace(repo_url, '/+$', ''), '\\.git$', '')) AS url FROM en), k AS (SELECT DISTINCT lower(regexp_replace(regexp_replace(repo_url, '/+$', ''), '\\.git$', '')) AS url FROM el) SELECT count(*) AS sample_size, count(k.url) AS in_census, count(*) - count(k.url) AS beyond_census, round((count(*) - count(k.url)) / greatest(count(*), 1), 6) AS beyond_share FROM u LEFT JOIN k USING (url)"
)
def census_overlap(spark, d):
    entries = v.entries(spark, d)
    return intake.census_overlap(entries, intake.eligible_entries(entries)).withColumn("beyond_share", F.round("beyond_share", 6))


@query(f"WITH {sv.ENTRIES} SELECT (SELECT count(*) FROM en) AS entries_seen, (SELECT count(*) FROM en) - count(*) AS skipped, count(*) - count(DISTINCT repo_url) AS collapsed, count(DISTINCT repo_url) AS repositories, true AS closes FROM el")
def reconcile(spark, d):
    return intake.coverage_reconciliation(v.entries(spark, d))


@query("SELECT page_id, url, lower(regexp_replace(regexp_replace(url, '/+$', ''), '\\.git$', '')) AS canonical, regexp_matches(trim(url), '^[hH][tT][tT][pP][sS]?://[^/?#\\s]+') AS linkable FROM pages")
def url_predicates(spark, d):
    return v.table(spark, d, "pages").select("page_id", "url", canonical_url(F.col("url")).alias("canonical"), linkable(F.col("url")).alias("linkable"))


@query("SELECT doc_id, source, lang FROM documents ORDER BY sha256('20260923:' || doc_id), doc_id LIMIT 100")
def hashed_draw(spark, d):
    return sampling.hashed_draw(v.table(spark, d, "documents").select("doc_id", "source", "lang"), 100, 20260923, ["doc_id"])


@query(f"WITH {sv.ENTRIES} SELECT server_id, repo_url, (SELECT count(*) FROM el) AS corpus, CAST(least(50, (SELECT count(*) FROM el)) AS BIGINT) AS sampled, CAST(20260923 AS BIGINT) AS sample_seed FROM el ORDER BY sha256('20260923:' || server_id), server_id, repo_url LIMIT 50")
def sampled_index(spark, d):
    return sampling.sample_index(intake.eligible_entries(v.entries(spark, d)), 50, 20260923).drop("discovered_via")


# Identity, history, trend


@query(f"WITH {sv.FINDINGS} SELECT event_id, finding_id FROM f")
def finding_ids(spark, d):
    return v.findings(spark, d).select("event_id", "finding_id")


@query(f"WITH {sv.FINDINGS} SELECT event_id, CASE WHEN event_id % 40 = 0 THEN 'severity' WHEN event_id % 41 = 0 THEN 'confidence' ELSE 'commit' END AS rejected_for FROM f WHERE event_id % 40 = 0 OR event_id % 41 = 0 OR event_id % 42 = 0")
def invalid_findings(spark, d):
    e = F.col("event_id")
    rows = v.findings(spark, d)
    rows = rows.withColumns({"severity": F.when(e % 40 == 0, "awful").otherwise(F.col("severity")), "confidence": F.when(e % 41 == 0, F.lit(None)).otherwise(F.col("confidence")), "commit_sha": F.when(e % 42 == 0, "HEAD").otherwise(F.col("commit_sha"))})
    return history.validate_findings(rows)[1].select("event_id", "rejected_for")


@query(f"WITH {sv.HISTORY} SELECT {', '.join(ROW)}, {TS.format('first_seen')} AS first_seen, {TS.format('last_seen')} AS last_seen FROM m")
def nightly_merge(spark, d):
    merged = history.merge_findings(v.previous(spark, d), v.current(spark, d), v.now())
    return stamped(merged.select(*ROW, "first_seen", "last_seen"), "first_seen", "last_seen")


@query(f"WITH {sv.HISTORY} SELECT {', '.join(ROW)}, {TS.format('first_seen')} AS first_seen, {TS.format('last_seen')} AS last_seen, previous_ids FROM h")
def moved_findings(spark, d):
    h = v.folded(spark, d).withColumn("previous_ids", F.array_join("previous_ids", ","))
    return stamped(h.select(*ROW, "first_seen", "last_seen", "previous_ids"), "first_seen", "last_seen")


@query(f"WITH {sv.HISTORY} SELECT {', '.join(ROW)}, {TS.format('first_seen')} AS first_seen, {TS.format('last_seen')} AS last_seen, previous_ids FROM h")
def bucketed_fold(spark, d):
    """The fold of tonight into a history kept in buckets."""
    table, buckets = f"history_{uuid.uuid4().hex}", 64
    kept = io.write_bucketed_history(history.dealt(v.previous(spark, d), buckets), table, buckets, io.scratch(spark))
    h = history.fold_into_buckets(kept, v.current(spark, d), v.now(), buckets).withColumn("previous_ids", F.array_join("previous_ids", ","))
    return stamped(h.select(*ROW, "first_seen", "last_seen", "previous_ids"), "first_seen", "last_seen")


@query(f"WITH {sv.HISTORY} SELECT finding_id FROM h, clock WHERE last_seen = now")
def seen_tonight(spark, d):
    return history.seen_in(v.folded(spark, d), v.now()).select("finding_id")


@query(f"WITH {sv.HISTORY} SELECT finding_id, server_id, rule_id FROM prev WHERE last_seen = (SELECT max(last_seen) FROM prev)")
def live_findings(spark, d):
    return history.live_findings(v.previous(spark, d)).select("finding_id", "server_id", "rule_id")


@query(f"WITH {sv.FINDINGS}, n AS (SELECT strftime(night, '%Y-%m-%d') AS night, count(DISTINCT server_id || file) FILTER (WHERE event_id % 7 < extract(day FROM night) % 5) AS scanned FROM f GROUP BY 1) SELECT night, scanned, lag(scanned) OVER (ORDER BY night) AS before, coalesce(lag(scanned) OVER (ORDER BY night) > 0 AND scanned < lag(scanned) OVER (ORDER BY night) * 0.5, false) AS refused FROM n")
def collapse_guard(spark, d):
    kept = F.when(F.col("event_id") % 7 < F.dayofmonth("night") % 5, F.concat("server_id", "file"))
    nights = v.findings(spark, d).groupBy(F.date_format("night", "yyyy-MM-dd").alias("night")).agg(F.count_distinct(kept).alias("scanned"))
    return history.scan_collapses(nights)


TREND = "t AS (SELECT strftime(night, '%Y-%m-%d') AS night, rule_id, count(*) AS n FROM f GROUP BY 1, 2)"


def _trend(spark, d):
    rows = v.findings(spark, d).withColumn("night", F.date_format("night", "yyyy-MM-dd"))
    return history.trend_points(rows, rows.where("severity not in ('critical', 'high')"))


@query(f"WITH {sv.FINDINGS}, {TREND}, a AS (SELECT strftime(night, '%Y-%m-%d') AS night, count(*) AS findings_found, count(DISTINCT server_id) AS servers_affected, count(*) FILTER (WHERE severity NOT IN ('critical', 'high')) AS findings_published FROM f GROUP BY 1) SELECT night, findings_found, servers_affected, findings_published, findings_found - findings_published AS withheld, (SELECT string_agg(rule_id || '=' || n, ',' ORDER BY rule_id) FROM t WHERE t.night = a.night) AS by_rule FROM a")
def trend_by_night(spark, d):
    rules = F.array_join(F.transform(F.map_entries("by_rule"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return _trend(spark, d).select("night", "findings_found", "servers_affected", "findings_published", "withheld", rules.alias("by_rule"))


@query(f"WITH {sv.FINDINGS}, a AS (SELECT strftime(night, '%Y-%m-%d') || 'T02:00:00Z' AS scanned_at, count(*) AS findings_found FROM f GROUP BY 1), p AS (SELECT strftime(night, '%Y-%m-%d') || 'T05:00:00Z' AS scanned_at, count(DISTINCT finding_id) AS findings_found FROM f WHERE night >= DATE '2024-01-29' GROUP BY 1) SELECT * FROM a WHERE substr(scanned_at, 1, 10) NOT IN (SELECT substr(scanned_at, 1, 10) FROM p) UNION ALL SELECT * FROM p")
def trend_upsert(spark, d):
    rows = v.findings(spark, d)
    at = lambda hour: F.concat(F.date_format("night", "yyyy-MM-dd"), F.lit(f"T{hour}:00:00Z")).alias("scanned_at")
    trend = rows.groupBy(at("02")).agg(F.count("*").alias("findings_found"))
    point = rows.where("night >= '2024-01-29'").groupBy(at("05")).agg(F.count_distinct("finding_id").alias("findings_found"))
    return history.append_point(trend, point)


@query(f"WITH {sv.FINDINGS}, {TREND} SELECT night, rule_id, n, n - lag(n) OVER (PARTITION BY rule_id ORDER BY night) AS change FROM t")
def rule_delta(spark, d):
    return history.findings_by_rule_by_night(_trend(spark, d))


@query(f"WITH {sv.HISTORY}, a AS (SELECT strftime(max(last_seen), '%Y-%m-%dT%H:%M:%SZ') AS newest_seen FROM h), b AS (SELECT strftime(max(night), '%Y-%m-%dT00:00:00Z') AS last_point FROM f) SELECT newest_seen, last_point, newest_seen = last_point AS matches FROM a, b")
def history_matches_trend(spark, d):
    trend = v.findings(spark, d).select(F.date_format("night", "yyyy-MM-dd'T'00:00:00'Z'").alias("scanned_at")).distinct()
    return history.history_matches_trend(v.folded(spark, d), trend)


# Disclosure


@query(f"WITH {sv.LEDGER} SELECT server_id, finding_id, {TS.format('notified_at')} AS notified_at, {TS.format('extended_until')} AS extended_until, withdrawn FROM facts")
def disclosure_windows(spark, d):
    return stamped(disclosure.disclosure_records(v.ledger(spark, d))[0], "notified_at", "extended_until")


@query(f"WITH {sv.LEDGER} SELECT server_id, finding_id, {TS.format('notified_at')} AS notified_at, {TS.format('extended_until')} AS extended_until, withdrawn FROM moved")
def moved_notices(spark, d):
    facts, _ = disclosure.disclosure_records(v.ledger(spark, d))
    return stamped(disclosure.follow_moves(facts, v.folded(spark, d)), "notified_at", "extended_until")


@query(f"WITH {sv.LEDGER} SELECT finding_id, severity, disclosure_state FROM st")
def disclosure_states(spark, d):
    return v.stated(spark, d).select("finding_id", "severity", "disclosure_state")


@query(f"WITH {sv.LEDGER} SELECT disclosure_state, n FROM states")
def state_counts(spark, d):
    return disclosure.state_counts(v.stated(spark, d))


@query(f"WITH {sv.LEDGER} SELECT finding_id, disclosure_state, no_longer_seen_since FROM pub")
def publishable(spark, d):
    return v.published(spark, d).select("finding_id", "disclosure_state", "no_longer_seen_since")


@query(f"WITH {sv.LEDGER} SELECT finding_id, disclosure_state, no_longer_seen_since FROM pub")
def republished(spark, d):
    facts, opted = disclosure.disclosure_records(v.ledger(spark, d))
    return disclosure.publish_from_history(v.folded(spark, d), facts, opted, v.now(), v.gate_clock()).select("finding_id", "disclosure_state", "no_longer_seen_since")


VERIFIED = "vf AS (SELECT DISTINCT finding_id FROM f WHERE event_id % 2 = 0)"


def _verified(spark, d):
    return v.findings(spark, d).where("event_id % 2 = 0").select("finding_id").distinct()


@query(
    f"WITH {sv.LEDGER}, {VERIFIED} SELECT n.server_id, n.finding_id, {TS.format('n.notified_at')} AS notified_at, CASE WHEN n.notified_at > TIMESTAMP '2024-01-28 00:00:00' THEN 'dated in the future' WHEN h.finding_id IS NULL THEN 'unknown finding' WHEN h.server_id <> n.server_id THEN 'another server' WHEN vf.finding_id IS NULL THEN 'not verified' WHEN n.notified_at < h.first_seen THEN 'dated before it was seen' END AS refusal FROM notices n LEFT JOIN h ON h.finding_id = n.finding_id LEFT JOIN vf ON vf.finding_id = n.finding_id"
)
def notice_refusals(spark, d):
    notices = v.ledger(spark, d).where("kind = 'notice'")
    return stamped(disclosure.check_notices(notices, v.folded(spark, d), _verified(spark, d), F.lit("2024-01-28").cast("timestamp")), "notified_at")


@query(
    f"WITH {sv.LEDGER}, {VERIFIED} SELECT vf.finding_id, h.server_id, CASE WHEN h.last_seen IS NULL OR h.last_seen <> (SELECT now FROM clock) THEN 'no longer produced' WHEN fa.notified_at IS NOT NULL THEN 'already notified' WHEN o.server_id IS NOT NULL THEN 'opted out' ELSE 'to draft' END AS class FROM vf LEFT JOIN h USING (finding_id) LEFT JOIN facts fa ON fa.finding_id = vf.finding_id AND fa.server_id = h.server_id LEFT JOIN opted o ON o.server_id = h.server_id"
)
def notice_selection(spark, d):
    facts, opted = disclosure.disclosure_records(v.ledger(spark, d))
    return disclosure.select_findings(_verified(spark, d), v.folded(spark, d), facts, opted, v.now())


@query(
    f"WITH {sv.LEDGER}, {VERIFIED}, dr AS (SELECT h.* FROM vf JOIN h USING (finding_id) LEFT JOIN facts fa ON fa.finding_id = h.finding_id AND fa.server_id = h.server_id LEFT JOIN opted o ON o.server_id = h.server_id WHERE h.last_seen = (SELECT now FROM clock) AND fa.notified_at IS NULL AND o.server_id IS NULL), li AS (SELECT *, 'https://example.org/' || server_id || '/blob/' || commit_sha || '/' || file || '#L' || line AS link FROM dr) SELECT server_id, count(*) AS n_items, string_agg(link, ' ' ORDER BY link) AS links, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules, '2024-04-29' AS closes_on FROM li GROUP BY 1"
)
def notice_table(spark, d):
    h = v.folded(spark, d)
    facts, opted = disclosure.disclosure_records(v.ledger(spark, d))
    chosen = disclosure.select_findings(_verified(spark, d), h, facts, opted, v.now())
    out = disclosure.notice_table(chosen, h, v.servers(spark, d), v.now())
    return out.withColumns({"links": F.array_join("links", " "), "rules": F.array_join("rules", ",")})


@query(
    f"WITH {sv.LEDGER} SELECT count(*) AS notices, count(*) AS findings_named, (SELECT count(*) FROM f WHERE event_id % 100 = 7) AS opt_outs, count(acknowledged_at) AS acknowledged, count(fixed_at) AS fixed, {TS.format('min(notified_at + INTERVAL 90 DAY) FILTER (WHERE notified_at + INTERVAL 90 DAY > gate)')} AS next_close, {TS.format('max(notified_at + INTERVAL 90 DAY) FILTER (WHERE notified_at + INTERVAL 90 DAY > gate)')} AS last_close FROM notices, clock"
)
def ledger_summary(spark, d):
    return disclosure.ledger_summary(v.ledger(spark, d), v.gate_clock())


@query(
    f"WITH {sv.LEDGER} SELECT server_id, {TS.format('notified_at')} AS notified_at, {TS.format("CASE WHEN event_id % 15 = 0 THEN notified_at + INTERVAL 3 DAY ELSE acknowledged_at END")} AS acknowledged_at, {TS.format('fixed_at')} AS fixed_at FROM notices"
)
def marked_notices(spark, d):
    led = v.ledger(spark, d)
    chosen = v.findings(spark, d).where("event_id % 15 = 0").select(F.concat("server_id", F.lit("@"), stamp(F.col("ts"))).alias("notice_id"), F.col("event_id").cast("string").alias("reference"), (F.col("ts") + F.expr("interval 3 days")).alias("acknowledged_at"), F.lit(None).cast("timestamp").alias("fixed_at"))
    return stamped(disclosure.mark_notices(led, chosen).select("server_id", "notified_at", "acknowledged_at", "fixed_at"), "notified_at", "acknowledged_at", "fixed_at")


@query(f"WITH {sv.LEDGER} SELECT finding_id, rule_id, severity FROM st WHERE disclosure_state IN ('disclosed', 'published', 'retracted')")
def benchmark_rows(spark, d):
    s = v.stated(spark, d)
    return disclosure.redact_benchmark(v.folded(spark, d), s, ["finding_id", "rule_id", "severity"])


# Publication


@query(f"WITH {sv.LEDGER} SELECT DISTINCT server_id, 'https://example.org/' || server_id AS repo_url FROM pub")
def published_servers(spark, d):
    return publish.published_servers(v.published(spark, d), v.servers(spark, d))


@query(f"WITH {sv.LEDGER} SELECT rule_id, count(*) AS found FROM cur GROUP BY 1")
def found_by_rule(spark, d):
    return publish.found_by_rule(v.current(spark, d))


@query(
    f"WITH {sv.LEDGER}, c AS (SELECT rule_id, count(*) AS n FROM cur GROUP BY 1) SELECT (SELECT count(DISTINCT server_id || file) FROM f) AS scanned, (SELECT string_agg(rule_id || '=' || n, ',' ORDER BY rule_id) FROM c) AS found_by_rule, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS findings_found, (SELECT string_agg(disclosure_state || '=' || n, ',' ORDER BY disclosure_state) FROM states) AS disclosure, CAST(sum(n) FILTER (WHERE disclosure_state IN ('withheld', 'opted_out')) AS BIGINT) AS withheld, CAST(sum(n) FILTER (WHERE disclosure_state IN ('disclosed', 'published', 'retracted')) AS BIGINT) AS publishable FROM states"
)
def run_summary(spark, d):
    scan = v.findings(spark, d).agg(F.count_distinct(F.concat("server_id", "file")).alias("scanned"))
    out = publish.run_summary(publish.found_by_rule(v.current(spark, d)), disclosure.state_counts(v.stated(spark, d)), scan)
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumns({"found_by_rule": text("found_by_rule"), "disclosure": text("disclosure")})


@query(f"WITH {sv.LEDGER} SELECT finding_id, status FROM ps")
def row_status(spark, d):
    return v.published(spark, d).select("finding_id", publish.row_status().alias("status"))


@query(f"WITH {sv.LEDGER} SELECT server_id, rule_id, evidence, status, occurrences, places, {TS.format('first_seen')} AS first_seen, {TS.format('last_seen')} AS last_seen, severity FROM de")
def decisions(spark, d):
    out = publish.decisions(v.published(spark, d)).withColumn("places", F.array_join("places", ","))
    return stamped(out, "first_seen", "last_seen")


@query(
    f"WITH {sv.LEDGER} SELECT r.rule_id, r.title, (SELECT count(*) FROM cur c WHERE c.rule_id = r.rule_id) AS found, count(p.finding_id) AS current, count(DISTINCT p.server_id || '|' || p.evidence) AS current_decisions, count(DISTINCT p.server_id) AS servers FROM rules r LEFT JOIN (SELECT * FROM ps WHERE status = 'current') p USING (rule_id) GROUP BY r.rule_id, r.title"
)
def rule_summary(spark, d):
    return publish.rule_summary(rule_dimension(spark), v.current(spark, d), v.published(spark, d))


@query(f"WITH {sv.LEDGER} SELECT severity, count(*) AS n FROM ps WHERE status = 'current' GROUP BY 1")
def severity_counts(spark, d):
    return publish.severity_counts(v.published(spark, d))


def _totals(spark, d):
    counts = disclosure.state_counts(v.stated(spark, d))
    withheld = counts.agg(F.sum(F.when(F.col("disclosure_state").isin("withheld", "opted_out"), F.col("n")).otherwise(0)).alias("withheld"))
    corpus = v.findings(spark, d).agg(F.count_distinct("server_id").alias("corpus"), F.count_distinct(F.when(F.col("night") >= "2024-01-25", F.col("server_id"))).alias("scanned"))
    return publish.site_totals(v.published(spark, d), withheld, corpus)


TOTALS = "tt AS (SELECT count(*) FILTER (WHERE status = 'current') AS published, count(DISTINCT server_id || '|' || rule_id || '|' || evidence) FILTER (WHERE status = 'current') AS decisions, count(DISTINCT server_id) FILTER (WHERE status = 'current') AS servers, count(*) FILTER (WHERE status LIKE 'no longer%') AS no_longer_seen, count(*) FILTER (WHERE status LIKE 'withdrawn%') AS retracted, (SELECT CAST(sum(n) AS BIGINT) FROM states WHERE disclosure_state IN ('withheld', 'opted_out')) AS withheld, (SELECT count(DISTINCT server_id) FROM f) AS corpus, (SELECT count(DISTINCT server_id) FROM f WHERE night >= DATE '2024-01-25') AS scanned FROM ps)"


@query(f"WITH {sv.LEDGER}, {TOTALS} SELECT *, published + withheld AS found FROM tt")
def site_totals(spark, d):
    return _totals(spark, d)


@query(f"WITH {sv.LEDGER}, {TOTALS} SELECT round(100.0 * scanned / greatest(corpus, 1), 4) AS scanned_share, round(100.0 * published / greatest(published + withheld, 1), 4) AS published_share FROM tt")
def coverage_shares(spark, d):
    return publish.coverage_shares(_totals(spark, d))


@query(f"WITH {sv.LEDGER} SELECT server_id, rule_id, evidence, occurrences FROM de WHERE status = 'current' ORDER BY occurrences DESC, server_id, rule_id, evidence LIMIT 10")
def top_decisions(spark, d):
    return publish.top_decisions(publish.decisions(v.published(spark, d)))


@query(
    f"WITH {sv.LEDGER} SELECT server_id, count(*) FILTER (WHERE status = 'current') AS current_decisions, CAST(coalesce(sum(occurrences) FILTER (WHERE status = 'current'), 0) AS BIGINT) AS occurrences, coalesce(string_agg(DISTINCT evidence, ',' ORDER BY evidence) FILTER (WHERE status = 'current'), '') AS evidence, count(*) FILTER (WHERE status <> 'current') AS others FROM de GROUP BY 1"
)
def server_index(spark, d):
    return publish.server_index(publish.decisions(v.published(spark, d))).withColumn("evidence", F.array_join("evidence", ","))


@query(
    f"WITH {sv.LEDGER}, fr AS (SELECT rule_id, CAST(row_number() OVER (ORDER BY rule_id) - 1 AS INTEGER) AS rule_index FROM (SELECT DISTINCT rule_id FROM pub)) SELECT server_id, finding_id, rule_id, rule_index, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, rule_id || ': ' || evidence AS message, file, line FROM pub JOIN fr USING (rule_id)"
)
def sarif_results(spark, d):
    shown = v.published(spark, d)
    return publish.sarif_results(shown, publish.sarif_rules(shown, rule_dimension(spark)))


@query(f"WITH {sv.LEDGER} SELECT rule_id, CAST(row_number() OVER (ORDER BY rule_id) - 1 AS INTEGER) AS rule_index, coalesce(title, 'Rule ' || rule_id) AS title FROM (SELECT DISTINCT rule_id FROM pub) LEFT JOIN rules USING (rule_id)")
def sarif_rules(spark, d):
    return publish.sarif_rules(v.published(spark, d), rule_dimension(spark))


@query("SELECT lower(replace(source || '/' || lang, '/', '--')) AS slug, count(DISTINCT s) AS n, min(s) AS first_server FROM (SELECT source, lang, CASE WHEN doc_id % 2 = 0 THEN source || '/' || lang ELSE upper(source || '/' || lang) END AS s FROM documents) GROUP BY 1 HAVING count(DISTINCT s) > 1")
def slug_collisions(spark, d):
    name = F.concat("source", F.lit("/"), "lang")
    return publish.slug_collisions(v.table(spark, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, name).otherwise(F.upper(name)).alias("server_id")))


# The fold and the rollup over the larger table


BIG = """b AS (SELECT 's' || l_suppkey AS server_id, l_returnflag || l_linestatus AS rule_id, 'p' || l_partkey AS file, CAST(l_linenumber AS INTEGER) AS line, 'q' || CAST(l_quantity AS INTEGER) AS evidence, CAST(l_shipdate AS DATE) AS night FROM lineitem),
bi AS (SELECT *, sha256(server_id || '|' || rule_id || '|' || file || ':' || line || '|' || sha256(evidence)) AS finding_id FROM b)"""


@query(f"WITH {BIG} SELECT server_id, rule_id, evidence, count(*) AS occurrences, count(DISTINCT finding_id) AS findings, strftime(min(night), '%Y-%m-%d') AS first_night, strftime(max(night), '%Y-%m-%d') AS last_night FROM bi GROUP BY 1, 2, 3")
def big_decisions(spark, d):
    rows = v.findings_big(spark, d)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.groupBy("server_id", "rule_id", "evidence").agg(F.count("*").alias("occurrences"), F.count_distinct("finding_id").alias("findings"), day(F.min("night")).alias("first_night"), day(F.max("night")).alias("last_night"))


@query(f"WITH {BIG}, o AS (SELECT finding_id, min(night) AS a, max(night) AS z FROM bi WHERE night < DATE '1997-01-01' GROUP BY 1), n AS (SELECT DISTINCT finding_id FROM bi WHERE night >= DATE '1997-01-01') SELECT coalesce(o.finding_id, n.finding_id) AS finding_id, strftime(coalesce(o.a, DATE '1999-01-01'), '%Y-%m-%d') AS first_night, strftime(CASE WHEN n.finding_id IS NOT NULL THEN DATE '1999-01-01' ELSE o.z END, '%Y-%m-%d') AS last_night FROM o FULL OUTER JOIN n ON o.finding_id = n.finding_id")
def big_merge(spark, d):
    rows = v.findings_big(spark, d)
    clock = F.lit("1999-01-01").cast("date")
    old = rows.where("night < '1997-01-01'").groupBy("finding_id").agg(F.min("night").alias("a"), F.max("night").alias("z"))
    new = rows.where("night >= '1997-01-01'").groupBy("finding_id").agg(F.lit(True).alias("seen"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return old.join(new, "finding_id", "full_outer").select("finding_id", day(F.coalesce("a", clock)).alias("first_night"), day(F.when(F.col("seen"), clock).otherwise(F.col("z"))).alias("last_night"))


# SARIF documents, files that are read back, and the incremental fold


SARIF = "fr AS (SELECT rule_id, CAST(row_number() OVER (ORDER BY rule_id) - 1 AS INTEGER) AS rule_index FROM (SELECT DISTINCT rule_id FROM pub)), sr AS (SELECT server_id, finding_id, rule_id, rule_index, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, rule_id || ': ' || evidence AS message, file, line FROM pub JOIN fr USING (rule_id)), sn AS (SELECT server_id, CAST(ceil(count(*) / 5000) AS BIGINT) AS parts FROM sr GROUP BY 1), sd AS (SELECT sr.*, CAST('0x' || substr(finding_id, 1, 8) AS BIGINT) % parts AS part FROM sr JOIN sn USING (server_id))"


@query(
    f"WITH {sv.LEDGER}, {SARIF} SELECT server_id, part, '{{\"version\":\"2.1.0\",\"runs\":[{{\"tool\":{{\"driver\":{{\"name\":\"scanledger\",\"rules\":' || (SELECT to_json(list({{'id': rule_id, 'index': rule_index}} ORDER BY rule_id)) FROM fr) || '}}}},\"results\":' || to_json(list({{'finding_id': finding_id, 'rule_id': rule_id, 'rule_index': rule_index, 'level': level, 'message': message, 'file': file, 'line': line}} ORDER BY finding_id)) || '}}]}}' AS document FROM sd GROUP BY 1, 2"
)
def sarif_documents(spark, d):
    shown = io.settled(v.published(spark, d))
    fired = publish.sarif_rules(shown, rule_dimension(spark))
    return io.sarif_documents(publish.sarif_results(shown, fired), fired)


def _scanned(spark, d):
    """The servers of findings, and suppliers as servers that were scanned without any."""
    quiet = v.table(spark, d, "supplier").select(F.concat(F.lit("io.x/Ü y."), F.col("s_suppkey").cast("string")).alias("server_id"))
    return v.findings(spark, d).select("server_id").union(quiet).distinct()


@query(
    f"WITH {sv.LEDGER}, {SARIF}, sc AS (SELECT server_id FROM f UNION SELECT 'io.x/Ü y.' || s_suppkey FROM supplier), sp AS (SELECT server_id, part, count(*) AS n_results, sha256(string_agg(finding_id, ',' ORDER BY finding_id)) AS digest FROM sd GROUP BY 1, 2) SELECT sc.server_id, coalesce(part, 0) AS part, coalesce(n_results, 0) AS n_results, coalesce(digest, sha256('')) AS digest, (SELECT count(*) FROM fr) AS n_rules FROM sc LEFT JOIN sp USING (server_id)"
)
def sarif_files(spark, d):
    """The documents of all servers that were scanned, written as files and read back: results and rules of each."""
    shown = io.settled(v.published(spark, d))
    fired = publish.sarif_rules(shown, rule_dimension(spark))
    path = io.scratch(spark)
    io.write_sarif(io.sarif_documents(publish.sarif_results(shown, fired), fired, servers=_scanned(spark, d)), path)
    run = F.from_json("document", "runs array<struct<tool: struct<driver: struct<rules: array<struct<id: string>>>>, results: array<struct<finding_id: string>>>>")["runs"][0]
    read = io.read_sarif(spark, path).select("server_id", "part", run.alias("run"))
    ids = F.array_join(F.array_sort(F.transform("run.results", lambda r: r["finding_id"])), ",")
    return read.select("server_id", "part", F.size("run.results").cast("long").alias("n_results"), F.sha2(ids.cast("binary"), 256).alias("digest"), F.size("run.tool.driver.rules").cast("long").alias("n_rules"))


@query("SELECT CAST(page_id AS VARCHAR) AS name, url AS repo_url FROM pages")
def registry_pages(spark, d):
    server = F.struct(F.struct(F.col("page_id").cast("string").alias("name"), F.struct("url").alias("repository")).alias("server"))
    pages = v.table(spark, d, "pages").groupBy(F.floor(F.col("page_id") / 100).alias("p")).agg(F.collect_list(server).alias("servers"))
    return io.parse_registry_pages(pages.select(F.to_json(F.struct("servers")).alias("value")))


def _folded_as_it_lands(spark, d, base, arrival, arrivals):
    """What ``arrival`` numbers from 0 lands in that order, in as many files as it is read in, and is folded as it lands; the last version."""
    names = ["server_id", "commit_sha", "rule_id", "severity", "confidence", "file", "line", "evidence", "finding_id", "night"]
    rows = v.findings(spark, d)
    for i in range(arrivals):
        rows.where(arrival == i).select(*names).write.parquet(f"{base}/landing/{i}")
        version = stream.fold_stream(spark, f"{base}/landing/*", f"{base}/state", f"{base}/checkpoint", files_per_batch=None)
    return version


@query(None)
def merge_stream(spark, d):
    base = io.scratch(spark)
    half = F.when(F.col("night") < "2024-01-16", 0).otherwise(1)
    out = stream.read_version(spark, f"{base}/state", _folded_as_it_lands(spark, d, base, half, 2))
    return stamped(out.select("finding_id", "server_id", "rule_id", "first_seen", "last_seen"), "first_seen", "last_seen")


@query(f"WITH {sv.FINDINGS}, u AS (SELECT DISTINCT strftime(night, '%Y-%m-%d') AS night, finding_id, server_id, rule_id, severity FROM f), {TREND.replace('strftime(night, ' + chr(39) + '%Y-%m-%d' + chr(39) + ')', 'night').replace('FROM f', 'FROM u')}, a AS (SELECT night, count(*) AS findings_found, count(DISTINCT server_id) AS servers_affected, count(*) FILTER (WHERE severity NOT IN ('critical', 'high')) AS findings_published FROM u GROUP BY 1) SELECT night, findings_found, servers_affected, findings_published, findings_found - findings_published AS withheld, (SELECT string_agg(rule_id || '=' || n, ',' ORDER BY rule_id) FROM t WHERE t.night = a.night) AS by_rule FROM a")
def stream_trend(spark, d):
    """The trend that the stream keeps: three arrivals are cut through nights, and they are out of order; each finding once a night."""
    base = io.scratch(spark)
    part = F.pmod(F.xxhash64("finding_id"), F.lit(2))
    piece = F.when(F.col("night") < "2024-01-10", 1).when(F.col("night") < "2024-01-20", 0).when((F.col("night") > "2024-01-20") | (part == 0), 2).otherwise(3)
    version = _folded_as_it_lands(spark, d, base, piece, 4)
    rules = F.array_join(F.transform(F.array_sort(F.map_entries("by_rule")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return stream.read_trend(spark, f"{base}/state", version).select(F.col("scanned_at").alias("night"), "findings_found", "servers_affected", "findings_published", "withheld", rules.alias("by_rule"))


# Files that are written and read back


@query(f"WITH {sv.ENTRIES} SELECT min(server_id) AS server_id, repo_url, 'registry' AS discovered_via FROM el GROUP BY repo_url")
def index_file(spark, d):
    path = io.scratch(spark)
    io.write_index(intake.collapse_to_index(intake.eligible_entries(v.entries(spark, d))), path)
    return io.read_index(spark, path)


@query(f"WITH {sv.HISTORY} SELECT {', '.join(ROW)}, {TS.format('first_seen')} AS first_seen, {TS.format('last_seen')} AS last_seen, previous_ids FROM h")
def history_file(spark, d):
    path = io.scratch(spark)
    place = F.struct("file", "line").alias("location")
    h = v.folded(spark, d)
    io.write_history(h.select(*[c for c in h.columns if c not in ("file", "line")], place), path)
    back = io.read_history(spark, path).select("*", "location.file", "location.line").withColumn("previous_ids", F.array_join("previous_ids", ","))
    return stamped(back.select(*ROW, "first_seen", "last_seen", "previous_ids"), "first_seen", "last_seen")


@query("SELECT source AS server_id, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS line_feeds, count(*) FILTER (WHERE false) AS links FROM documents WHERE text IS NOT NULL GROUP BY 1")
def files_read(spark, d):
    """Texts as files in a folder per server, a line feed behind each, read back as a table of files."""
    path = io.scratch(spark)
    v.table(spark, d, "documents").where("text is not null").select(F.col("source").alias("server"), "text").write.partitionBy("server").text(path)
    found = io.read_files(spark, path).where("path like '%.txt'")
    content = F.decode("content", "UTF-8")
    feeds = F.length(content) - F.length(F.replace(content, F.lit("\n")))
    server = F.regexp_replace("server_id", "^server=", "")
    return found.groupBy(server.alias("server_id")).agg(F.sum("size").alias("bytes"), F.sum(feeds).cast("long").alias("line_feeds"), F.count_if("is_symlink").alias("links"))


@query(
    f"WITH {sv.LEDGER}, al AS (SELECT 'notice' AS kind, server_id, finding_id AS named, channel, {TS.format('notified_at')} AS at FROM notices UNION ALL SELECT 'withdrawal', server_id, finding_id, NULL, NULL FROM f WHERE event_id % 50 = 0 UNION ALL SELECT 'extension', server_id, finding_id, NULL, {TS.format('ts + INTERVAL 120 DAY')} FROM f WHERE event_id % 35 = 0 UNION ALL SELECT 'opt_out', 's9', NULL, NULL, NULL FROM f WHERE event_id % 100 = 7) SELECT * FROM al"
)
def ledger_file(spark, d):
    path = io.scratch(spark)
    io.write_ledger(v.ledger(spark, d), path)
    named = F.coalesce(F.get("finding_ids", F.lit(0)), F.col("finding_id"))
    return io.read_ledger(spark, path).select("kind", "server_id", named.alias("named"), "channel", stamp(F.coalesce("notified_at", "until")).alias("at"))


@query(f"WITH {sv.FINDINGS}, t AS (SELECT strftime(night, '%Y-%m-%dT00:00:00Z') AS scanned_at, rule_id, count(*) AS n FROM f GROUP BY 1, 2) SELECT scanned_at, CAST(sum(n) AS BIGINT) AS findings_found, string_agg(rule_id || '=' || n, ',' ORDER BY rule_id) AS by_rule FROM t GROUP BY 1")
def trend_file(spark, d):
    path = io.scratch(spark)
    points = _trend(spark, d).select(F.concat("night", F.lit("T00:00:00Z")).alias("scanned_at"), "findings_found", "findings_published", "withheld", "servers_affected", "by_rule")
    io.write_lines(points, path)
    rules = F.array_join(F.transform(F.array_sort(F.map_entries("by_rule")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return io.read_trend(spark, path).select("scanned_at", "findings_found", rules.alias("by_rule"))


@query(f"WITH {sv.GOLDEN} SELECT CAST(entry_id AS VARCHAR) AS entry_id, label, reason, annotator, seq FROM an")
def annotations_file(spark, d):
    path = io.scratch(spark)
    io.write_lines(v.annotations(spark, d), path)
    return io.read_annotations(spark, path)


@query("SELECT sha256(CAST(event_id AS VARCHAR)) AS key, (event_id % 101) / 100.0 AS probability, (event_id % 7) / 1000.0 AS cost_usd FROM events")
def cache_file(spark, d):
    path = io.scratch(spark)
    e = F.col("event_id")
    answers = v.table(spark, d, "events").select(F.sha2(e.cast("string").cast("binary"), 256).alias("key"), ((e % 101) / 100.0).alias("probability"), ((e % 7) / 1000.0).alias("cost_usd"), F.lit(1.0).alias("latency_ms"))
    io.write_lines(answers, path)
    return io.read_cache(spark, path).select("key", "probability", "cost_usd")


@query(f"WITH {sv.ENTRIES}, c AS (SELECT repo_url, count(DISTINCT server_id) AS claims FROM el GROUP BY 1), i AS (SELECT min(server_id) AS server_id, repo_url FROM el GROUP BY repo_url), s AS (SELECT repo_url FROM i ORDER BY sha256('7:' || server_id), server_id, repo_url LIMIT 20) SELECT repo_url, claims, repo_url IN (SELECT repo_url FROM s) AS sampled FROM c")
def corpus_files(spark, d):
    path = io.scratch(spark)
    records = intake.eligible_entries(v.entries(spark, d))
    io.write_corpus(intake.build_corpus(records), sampling.sample_index(intake.collapse_to_index(records), 20, 7), path)
    corpus, sample = spark.read.parquet(f"{path}/corpus"), spark.read.parquet(f"{path}/sample")
    marked = corpus.join(sample.select("repo_url", F.lit(True).alias("sampled")), "repo_url", "left")
    return marked.select("repo_url", F.col("claim_count").alias("claims"), F.coalesce("sampled", F.lit(False)).alias("sampled"))
