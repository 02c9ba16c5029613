"""Laws of the library's operators on small tables of their own."""

import hashlib

import pytest
from pyspark.sql import functions as F

from scanledger.functions import columns as co
from scanledger.operators import disclosure, evaluate, files, golden, history, intake, publish, rules, sampling, triage
from scanledger.sources import io


def ts(s):
    return F.lit(s).cast("timestamp")


def col(df, *names):
    return sorted((tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()), key=repr)


def finding(server="s", rule="r", file="f", line=1, evidence="e", severity="high"):
    return (server, "a" * 40, rule, severity, "low", file, line, evidence)


SCHEMA = "server_id string, commit_sha string, rule_id string, severity string, confidence string, file string, line int, evidence string"


def rows(spark, *found):
    return history.with_identity(spark.createDataFrame(list(found), SCHEMA))


def empty_history(spark):
    return spark.createDataFrame([], SCHEMA + ", finding_id string, first_seen timestamp, last_seen timestamp, previous_ids array<string>")


def test_identity_is_stable_and_not_forged(spark):
    df = rows(spark, finding(), finding(evidence="e|x"))
    want = hashlib.sha256(f"s|r|f:1|{hashlib.sha256(b'e').hexdigest()}".encode()).hexdigest()
    assert want in col(df, "finding_id") and df.select("finding_id").distinct().count() == 2


def test_draw_ignores_order_and_keeps_order_when_growing(spark):
    a = spark.range(100).selectExpr("cast(id as string) as k")
    b = a.orderBy(F.desc("k"))
    assert col(sampling.hashed_draw(a, 10, 1, ["k"]), "k") == col(sampling.hashed_draw(b, 10, 1, ["k"]), "k")
    more = sampling.hashed_draw(a, 20, 1, ["k"])
    assert set(col(sampling.hashed_draw(a, 10, 1, ["k"]), "k")) <= set(col(more, "k"))
    assert sampling.hashed_draw(a, 1000, 1, ["k"]).count() == 100
    with pytest.raises(io.Refused):
        sampling.sample_index(a.selectExpr("k as server_id", "k as repo_url"), 0, 1)


def test_corpus_collapses_names(spark):
    e = spark.createDataFrame([("b", "HTTPS://x/1"), ("a", "HTTPS://x/1"), ("a", "HTTPS://x/1"), ("c", "http://x/2"), ("d", None), ("e", "https://x/3")], "name string, repo_url string")
    records = intake.eligible_entries(e)
    assert col(intake.build_corpus(records), "repo_url", "claim_count") == [("HTTPS://x/1", 2), ("https://x/3", 1)]
    assert col(intake.collapse_to_index(records), "server_id") == ["a", "e"]
    assert intake.coverage_reconciliation(e).first()["closes"]


def test_registry_page_without_servers_is_fatal(spark):
    with pytest.raises(Exception, match="no list of servers"):
        io.parse_registry_pages(spark.createDataFrame([("{}",)], "value string")).collect()
    with pytest.raises(Exception, match="empty name"):
        io.parse_registry_pages(spark.createDataFrame([('{"servers":[{"server":{"name":""}}]}',)], "value string")).collect()


def test_fold_keeps_absent_rows_and_carries_equal_repeats(spark):
    one, two = ts("2024-01-01"), ts("2024-01-02")
    h = history.nightly_fold(empty_history(spark), rows(spark, finding(line=1), finding(line=5), finding(rule="q", line=9)), one)
    h = history.nightly_fold(h, rows(spark, finding(line=3), finding(line=8)), two)
    got = col(h, "rule_id", "line", "first_seen", "previous_ids")
    assert [(r, n, str(f.date()), len(p)) for r, n, f, p in got] == [("q", 9, "2024-01-01", 0), ("r", 3, "2024-01-01", 1), ("r", 8, "2024-01-01", 1)]


def test_unequal_repeats_are_not_paired(spark):
    h = history.nightly_fold(empty_history(spark), rows(spark, finding(line=1), finding(line=5)), ts("2024-01-01"))
    h = history.nightly_fold(h, rows(spark, finding(line=3)), ts("2024-01-02"))
    assert h.count() == 3 and all(not p for p in col(h, "previous_ids"))


def test_window_closes_strictly_after_ninety_days(spark):
    led = spark.createDataFrame([("notice", "s", [col(rows(spark, finding()), "finding_id")[0]], "email", "2024-01-01 00:00:00")], "kind string, server_id string, finding_ids array<string>, channel string, notified_at string")
    led = led.withColumn("notified_at", F.col("notified_at").cast("timestamp")).withColumns({"finding_id": F.lit(None).cast("string"), "until": F.lit(None).cast("timestamp")})
    facts, opted = disclosure.disclosure_records(led)
    at = lambda when: col(disclosure.with_state(rows(spark, finding()), facts, opted, ts(when)), "disclosure_state")
    assert at("2024-03-31 00:00:00") == ["withheld"] and at("2024-03-31 00:00:01") == ["disclosed"]
    counts = dict(col(disclosure.state_counts(disclosure.with_state(rows(spark, finding(severity="low")), facts, opted, ts("2024-01-02"))), "disclosure_state", "n"))
    assert counts["published"] == 1 and len(counts) == 6 and sum(counts.values()) == 1


def test_opt_out_goes_before_all_and_withdrawal_retracts(spark):
    f = rows(spark, finding(severity="low"), finding(server="o", severity="low"))
    ids = dict(col(f, "server_id", "finding_id"))
    facts = spark.createDataFrame([("s", ids["s"], None, None, True), ("o", ids["o"], None, None, True)], "server_id string, finding_id string, notified_at timestamp, extended_until timestamp, withdrawn boolean")
    opted = spark.createDataFrame([("o",)], "server_id string")
    assert col(disclosure.with_state(f, facts, opted, ts("2024-01-01")), "server_id", "disclosure_state") == [("o", "opted_out"), ("s", "retracted")]


def test_rule_summary_keeps_silent_rules(spark):
    p = rows(spark, finding(rule="r")).withColumns({"disclosure_state": F.lit("published"), "no_longer_seen_since": F.lit(None).cast("string")})
    dim = spark.createDataFrame([("r", "R"), ("z", "Z")], "rule_id string, title string")
    assert col(publish.rule_summary(dim, p, p), "rule_id", "found", "servers") == [("r", 1, 1), ("z", 0, 0)]


def test_file_selection(spark):
    paths = ["src/a.ts", "src/a.test.ts", "contest.ts", "config.ts", "Tests/x.py", "node_modules/x.js", "Node_modules/x.js", "a/.eslintrc.json", "x.txt", "TESTS.md", "src/.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert col(files.scannable_files(df), "path") == sorted(["src/a.ts", "contest.ts", "config.ts", "Node_modules/x.js", "a/.eslintrc.json", "TESTS.md"])


def test_unicode_rule_splits_at_line_feeds_only(spark):
    text = "﻿ok\nx ​y​\n‍ fine \U000e0041"
    found = rules.unicode_conceal(spark.createDataFrame([("s", "p", text)], "server_id string, path string, source string"))
    assert col(found, "line", "confidence", "evidence") == [(2, "medium", "zero-width-space U+200B at line 2"), (3, "high", "unicode-tag-block U+E0041 at line 3")]


def test_instruction_length_is_strict(spark):
    pad = "x" * (200 - len("you must "))
    df = spark.createDataFrame([("a", "you must " + pad), ("b", "you must x" + pad), ("c", "Ignore PREVIOUS"), ("d", None)], "k string, t string")
    assert col(df.where(rules.reads_as_instruction(F.col("t"))), "k") == ["b", "c"]


def test_descriptions_are_unescaped(spark):
    src = 'x = {description: "a\\u0041\\x42\\u{43}\\n\\"q\\""}; z.string().describe(\'it\\\'s\')'
    found = rules.extract_descriptions(spark.createDataFrame([("s", "p", src)], "server_id string, path string, source string"))
    assert sorted(col(found, "text")) == sorted(['aABC\n"q"', "it's"])


def test_own_rule_failures_are_isolated_and_udtf_agrees(spark):
    class Own(rules.FileRule):
        def analyze(self, path, source):
            if source == "bad":
                raise RuntimeError("no")
            yield 1, "info", "low", source

    df = spark.createDataFrame([("s", "a.py", "x"), ("t", "b.py", "bad")], "server_id string, path string, source string")
    assert col(rules.isolate_failures(rules.apply_rules(df, [Own()])), "server_id", "status", "message") == [("s", "scanned", None), ("t", "failed", "RuntimeError: no")]
    spark.udtf.register("own_rule", rules.rule_function(Own()))
    assert spark.sql("select evidence from own_rule('a.py', 'x')").first()[0] == "x"


def test_context_clamps_and_uses_universal_breaks(spark):
    df = spark.createDataFrame([("a\r\nb\x0bc\n", 2), ("a", 2), ("", 1), ("a\n\n", 2)], "source string, line int")
    assert [r.context for r in golden.capture_context(df, 1).collect()] == ["a\nb\nc", None, None, "a\n"]


def test_label_merge_and_adjudication(spark):
    a = spark.createDataFrame([(1, "true_positive", "r", "a", 1), (1, "false_positive", "r", "a", 2), (1, "false_positive", "r", "b", 3), (2, "unsure", "r", "a", 4), (2, "true_positive", "r", "b", 5), (3, "unsure", "r", "a", 6), (3, "true_positive", "r", "b", 7)], "entry_id int, label string, reason string, annotator string, seq long")
    settled = spark.createDataFrame([(3, "true_positive")], "entry_id int, label string")
    assert [(r.entry_id, r.label, r.conflict) for r in golden.merge_human_labels(golden.latest_annotations(a), settled).orderBy("entry_id").collect()] == [(1, "false_positive", False), (2, None, True), (3, "true_positive", False)]


def test_budget_counts_each_question_once(spark):
    e = spark.createDataFrame([(i, f"k{i % 3}", f"t{i % 3}") for i in range(9)], "entry_id int, key string, shown string")
    cache = spark.createDataFrame([("k0", 0.1)], "key string, probability double")
    out, fresh = triage.adjudicate(e, cache, lambda t: (0.5, 0.1), 1)
    assert dict(out.groupBy("source").count().collect()) == {"cache": 3, "judge": 3, "over budget": 3} and fresh.count() == 1


def test_scores_exclude_unsure_and_sweep_agrees(spark):
    labels = spark.createDataFrame([(1, "r", "true_positive"), (2, "r", "false_positive"), (3, "r", "unsure"), (4, "q", "false_positive")], "entry_id int, rule_id string, label string")
    said = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "entry_id int, verdict boolean")
    assert col(evaluate.score_rules(labels, said), "rule_id", "precision", "recall", "support") == [("q", 0.0, 0.0, 1), ("r", 0.5, 1.0, 2)]
    assert evaluate.choose_threshold(evaluate.sweep_thresholds(labels.withColumn("probability", F.lit(0.3)))).count() == 0


def test_sign_test_and_kappa_closed_forms(spark):
    df = spark.createDataFrame([(0, 0), (5, 0), (3, 3), (1, 9)], "a long, b long")
    got = [round(r[0], 9) for r in df.select(evaluate.sign_test(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0625, 1.0, round(22 / 1024, 9)]
    one = spark.createDataFrame([("x", "x")] * 3, "a string, b string")
    assert evaluate.cohens_kappa(one, "a", "b").first()["kappa"] is None


def test_rows_repeated_inside_a_cluster_do_not_narrow_the_interval(spark):
    base = spark.createDataFrame([(c, int(c < 4)) for c in range(10)], "c int, x int")
    many = base.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("k")
    a, b = (evaluate.cluster_bootstrap_ci(d, "c", F.col("x"), 100).first() for d in (base, many))
    assert tuple(a) == tuple(b) and a["low"] < 0.4 < a["high"]


def test_predicates(spark):
    df = spark.createDataFrame([(" https://A/b.git/",), ("ftp://x",), ("http:///x",), ("HTTP://x",)], "u string")
    assert [tuple(r) for r in df.select(co.permits_cloning(F.col("u")), co.linkable(F.col("u")), co.canonical_url(F.col("u"))).collect()] == [(True, True, " https://a/b"), (False, False, "ftp://x"), (False, False, "http:///x"), (False, True, "http://x")]


def test_round_trips(spark, tmp_path):
    index = spark.createDataFrame([("a", "https://x/a", "registry")], "server_id string, repo_url string, discovered_via string")
    io.write_index(index, f"file://{tmp_path}/index")
    assert col(io.read_index(spark, f"file://{tmp_path}/index"), "server_id") == ["a"]
    assert io.read_history(spark, f"file://{tmp_path}/none").count() == 0
    (tmp_path / "ledger").mkdir()
    (tmp_path / "ledger" / "x.json").write_text('{"kind":"rumour","server_id":"s"}\n')
    with pytest.raises(Exception, match="unknown kind"):
        io.read_ledger(spark, f"file://{tmp_path}/ledger").collect()


def test_stream_equals_folding_night_by_night(spark, tmp_path):
    from scanledger.streaming.merge_stream import fold_night, merge_stream, read_version

    names = ["server_id", "commit_sha", "rule_id", "severity", "confidence", "file", "line", "evidence", "finding_id"]
    nights = {"2024-01-01": rows(spark, finding(line=1)), "2024-01-02": rows(spark, finding(line=4), finding(rule="q"))}
    state = read_version(spark, f"file://{tmp_path}/none", 0)
    for i, (night, df) in enumerate(nights.items()):
        df.select(*names).withColumn("night", F.lit(night).cast("date")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/land/{i}")
        state = fold_night(state, df.select(*names), night)
    out = merge_stream(spark, f"file://{tmp_path}/land/*", f"file://{tmp_path}/state", f"file://{tmp_path}/cp", files_per_batch=10)
    assert col(out, "finding_id", "first_seen", "last_seen") == col(state, "finding_id", "first_seen", "last_seen")
