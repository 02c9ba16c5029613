"""Thin compositions of the operators, one per workload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..operators import disclosure, files, history, intake, publish, rules, sampling
from ..schemas import rule_dimension
from ..sources import io


def job_crawl(pages: DataFrame, sample_size: int, seed: int) -> dict[str, DataFrame]:
    """Registry pages to corpus, index, sample and the figures that reconcile them."""
    entries = io.parse_registry_pages(pages)
    records = intake.eligible_entries(entries)
    index = intake.collapse_to_index(records)
    return {"corpus": intake.build_corpus(records, strict=True), "index": index, "sample": sampling.sample_index(index, sample_size, seed), "stats": intake.corpus_stats(records), "coverage": intake.coverage_reconciliation(entries)}


def job_nightly(previous: DataFrame, current: DataFrame, ledger: DataFrame, now: Column, gate_clock: Column) -> dict[str, DataFrame]:
    """Fold tonight's findings, gate them, and publish: merge before gate, never after."""
    valid, rejected = history.validate_findings(current)
    folded = history.nightly_fold(previous, history.with_identity(valid), now)
    facts, opted = disclosure.disclosure_records(ledger)
    stated = disclosure.state_by_ledger(folded, facts, opted, gate_clock)
    shown = disclosure.publish_findings(stated, now)
    return {"history": folded, "rejected": rejected, "states": disclosure.state_counts(stated), "published": shown}


def job_scan(checkouts: DataFrame, own: list | None = None) -> dict[str, DataFrame]:
    """Files to findings, skips and server evidence."""
    sources = files.decoded(checkouts)
    found = {"unicode": rules.unicode_conceal(sources), "patterns": rules.pattern_scan(sources, rules.line_rules(checkouts.sparkSession)), "skipped": files.skipped_files(checkouts), "evidence": files.server_evidence(sources)}
    if own:
        found["own"] = rules.apply_rules(sources, own)
    return found


def job_site(published: DataFrame, findings: DataFrame) -> dict[str, DataFrame]:
    """The tables a site shows."""
    decided = publish.decisions(published)
    return {"decisions": decided, "rules": publish.rule_summary(rule_dimension(published.sparkSession), findings, published), "severities": publish.severity_counts(published), "top": publish.top_decisions(decided), "servers": publish.server_index(decided)}


def job_notices(verified: DataFrame, folded: DataFrame, ledger: DataFrame, servers: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Who is to be told what."""
    facts, opted = disclosure.disclosure_records(ledger)
    chosen = disclosure.select_findings(verified, folded, facts, opted, now)
    return {"selected": chosen, "notices": disclosure.notice_table(chosen, folded, servers, now), "summary": disclosure.ledger_summary(ledger, now)}
