"""Registry entries to distinct repositories, and what code search adds to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import canonical_url, permits_cloning
from ..sources.io import Refused


def eligible_entries(entries: DataFrame) -> DataFrame:
    """Server records of the entries (name, repo_url) whose repository may be cloned."""
    return entries.where(permits_cloning(F.col("repo_url"))).select(F.col("name").alias("server_id"), "repo_url", F.lit("registry").alias("discovered_via"))


def crawl_totals(entries: DataFrame) -> DataFrame:
    ok = permits_cloning(F.col("repo_url"))
    return entries.agg(F.count_if(ok).alias("records"), F.count("*").alias("entries_seen"), F.count_if(~ok).alias("skipped_without_source"))


def build_corpus(records: DataFrame, strict: bool = False) -> DataFrame:
    """repo_url, server_ids (distinct, sorted), claim_count (distinct names)."""
    if strict and not records.limit(1).count():
        raise Refused("no records to build a corpus from")
    names = records.groupBy("repo_url").agg(F.array_sort(F.collect_set("server_id")).alias("server_ids"))
    return names.withColumn("claim_count", F.size("server_ids").cast("long"))


def corpus_stats(records: DataFrame) -> DataFrame:
    """repository_count, entries_seen, entries_collapsed, most_claimed; counts names without gathering them."""
    claims = records.groupBy("repo_url").agg(F.count_distinct("server_id").alias("n"))
    total, count = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    return claims.agg(count.alias("repository_count"), total.alias("entries_seen"), (total - count).alias("entries_collapsed"), F.coalesce(F.max("n"), F.lit(0)).alias("most_claimed"))


def collapse_to_index(records: DataFrame) -> DataFrame:
    """One record per repository: the first name that claims it."""
    first = records.groupBy("repo_url").agg(F.min(F.struct("server_id", "discovered_via")).alias("r"))
    return first.select("r.server_id", "repo_url", "r.discovered_via")


def discoveries(pages: DataFrame) -> DataFrame:
    """Server records of code-search pages (items: array of full names), distinct by name."""
    names = pages.select(F.explode("items").alias("full_name")).where("full_name is not null").dropDuplicates(["full_name"])
    return names.select(F.col("full_name").alias("server_id"), F.concat(F.lit("https://github.com/"), "full_name").alias("repo_url"), F.lit("code-search").alias("discovered_via"))


def census_overlap(sample: DataFrame, census: DataFrame) -> DataFrame:
    """Size of a sample of repositories, how many the census has (by canonical URL), how many it lacks, and their share."""
    known = census.select(canonical_url(F.col("repo_url")).alias("url")).distinct().withColumn("in_census", F.lit(True))
    urls = sample.select(canonical_url(F.col("repo_url")).alias("url")).distinct()
    size, inside = F.count("*"), F.count_if(F.col("in_census"))
    return urls.join(known, "url", "left").agg(size.alias("sample_size"), inside.alias("in_census"), (size - inside).alias("beyond_census"), ((size - inside) / F.greatest(size, F.lit(1))).alias("beyond_share"))


def coverage_reconciliation(entries: DataFrame) -> DataFrame:
    """skipped + collapsed + repositories = entries_seen, with the check."""
    totals = crawl_totals(entries)
    stats = corpus_stats(eligible_entries(entries))
    both = totals.crossJoin(F.broadcast(stats.select("repository_count", F.col("entries_seen").alias("claims"))))
    return both.select(
        "entries_seen", F.col("skipped_without_source").alias("skipped"), (F.col("records") - F.col("repository_count")).alias("collapsed"), F.col("repository_count").alias("repositories"),
        (F.col("skipped_without_source") + F.col("records") == F.col("entries_seen")).alias("closes"),
    )
