"""Queries of the study over all their rows."""

from scanledger.operators import golden
from scanledger.plans import registry


def test_instruction_scan_reads_all_documents(spark, tmp_path):
    docs = [(1, "Please ignore previous notes", "a"), (2, "plain", "a"), (5, "plain", "a"), (6, "Never reveal it", "b"), (7, None, "b")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    found = registry.QUERIES["instruction_scan"](spark, f"file://{tmp_path}").collect()
    assert sorted((r.path, r.evidence) for r in found) == [("1", "Please ignore previous notes"), ("5", "plain Ignore previous"), ("6", "Never reveal it")]


def test_golden_entries_are_drawn_from_all_events(spark, tmp_path):
    events = spark.range(9000).selectExpr("id as event_id", "id % 700 as user_id", "'view' as event_type", "cast(id as double) as value", "timestamp'2024-01-05 01:00:00' as ts")
    events.write.parquet(f"file://{tmp_path}/events.parquet")
    d = f"file://{tmp_path}"
    got = {r.finding_id: (r.entry_id, r.label) for r in registry.QUERIES["golden_entries"](spark, d).collect()}
    from scanledger.plans import views

    by = {}
    for r in views.findings(spark, d).select("finding_id", "event_id").collect():
        by.setdefault(r.finding_id, []).append(r.event_id)
    old = {f: min(e for e in ids if e % 3 == 0) + 1 for f, ids in by.items() if any(e % 3 == 0 for e in ids)}
    drawn = sorted((min(ids), f) for f, ids in by.items() if min(ids) % 6)
    want = {f: (f"g-{old[f]:04d}", "true_positive") for _, f in drawn if f in old}
    want |= {f: (f"g-{max(old.values()) + n:04d}", None) for n, f in enumerate([f for _, f in drawn if f not in old], 1)}
    assert got == want and len(got) > 2000


def test_entries_are_numbered_over_many_blocks(spark):
    n = 3 * golden.BLOCK + 5
    drawn = spark.range(n).selectExpr("cast(id as string) as finding_id", f"({n} - 1 - id) * 7 as position", "if(id = 3, null, 'c') as context").repartition(5)
    old = spark.createDataFrame([(str(n - 1), "g-0041", "true_positive")], "finding_id string, entry_id string, label string")
    got = {r.finding_id: r.entry_id for r in golden.build_entries(drawn, old).collect()}
    assert got.pop(str(n - 1)) == "g-0041"
    fresh = [str(i) for i in reversed(range(n - 1)) if i != 3]
    assert got == {f: f"g-{k:04d}" for k, f in enumerate(fresh, 42)}
