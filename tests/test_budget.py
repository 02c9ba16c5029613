"""The budget of successful calls, against asking one question after the other."""

import random

from pyspark.sql import functions as F

from scanledger.operators import triage


def judge(text):
    asked = text.split(" ", 1)
    if asked[0] == "fails":
        raise ValueError("no answer")
    if asked[0] == "odd":
        return 1.5, 0.1
    return len(text) / 100, 0.1


def by_hand(entries, cached, most):
    """entry to (probability, source)."""
    first, shown = {}, {}
    for e, k, t in entries:
        first[k] = min(first.get(k, e), e)
        shown[k] = min(shown.get(k, t), t)
    answers, left = {}, most
    for k in sorted((k for k in first if k not in cached), key=lambda k: (first[k], k)):
        if left:
            good = shown[k].split(" ", 1)[0] not in ("fails", "odd")
            answers[k] = (len(shown[k]) / 100, "judge") if good else (None, "failed")
            left -= good
    return {e: (cached[k], "cache") if k in cached else answers.get(k, (None, "over budget")) for e, k, _ in entries}


def test_only_successful_calls_count(spark):
    rng = random.Random(3)
    entries = [(i, f"k{(i * 7) % 40:02d}", "") for i in rng.sample(range(200), 90)]
    say = {k: rng.choice(["fails", "odd", "good", "good", "good"]) + " " + k for _, k, _ in entries}
    entries = [(e, k, say[k]) for e, k, _ in entries]
    cached = {"k03": 0.5, "k10": 0.25}
    df = spark.createDataFrame(entries, "entry_id int, key string, shown string")
    cache = spark.createDataFrame(list(cached.items()) + [("k03", 0.5)], "key string, probability double")
    for most in (0, 1, 7, 1000):
        out, fresh = triage.adjudicate(df, cache, judge, most)
        assert {r.entry_id: (r.probability, r.source) for r in out.collect()} == by_hand(entries, cached, most), most
        n = {k for k, v in ((k, v) for (_, k, _), v in zip(entries, [by_hand(entries, cached, most)[e] for e, _, _ in entries], strict=True)) if v[1] == "judge"}
        assert {r.key for r in fresh.collect()} == n and len(n) <= most


def test_no_question_goes_out_twice(spark, tmp_path):
    log = str(tmp_path / "asked")

    def logged(text):
        with open(log, "a") as f:
            f.write(text + "\n")
        if len(text) % 3 == 0:
            raise ValueError("no answer")
        return 0.5, 0.1

    df = spark.createDataFrame([(i, f"k{i % 30}", "x" * (i % 30)) for i in range(90)], "entry_id int, key string, shown string")
    out, _ = triage.adjudicate(df, spark.createDataFrame([], "key string, probability double"), logged, 12)
    assert dict(out.dropDuplicates(["key"]).groupBy("source").count().collect()) == {"judge": 12, "failed": 6, "over budget": 12}
    out.collect()  # answers are kept, not asked for again
    asked = open(log).read().split("\n")[:-1]
    assert len(asked) == len(set(asked)) == 18


def test_every_call_fails_and_nothing_to_ask(spark):
    df = spark.createDataFrame([(i, f"k{i}", "fails") for i in range(10)], "entry_id int, key string, shown string")
    none = spark.createDataFrame([], "key string, probability double")
    out, fresh = triage.adjudicate(df, none, judge, 4)
    assert out.where(F.col("source") == "failed").count() == 10 and fresh.count() == 0
    assert triage.adjudicate(df.limit(0), none, judge, 4)[0].collect() == []


def test_the_cap_holds_across_blocks(spark):
    rng = random.Random(9)
    calls = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([0, 1, 3, None, 20])) for i in range(400)]
    df = spark.createDataFrame(calls, "at int, arm string, cost_usd long").selectExpr("*", "1 as _spent_x").repartition(5)
    want, spent = {}, {}
    for at, arm, cost in sorted(calls, key=lambda c: c[0]):
        if spent.get(arm, 0) < 300:
            want[at] = spent.get(arm, 0)
        spent[arm] = spent.get(arm, 0) + (cost or 0)
    for block in (7, 100, 50_000):
        out = triage.spend_cap(df, 300, "at", "arm", block)
        assert {r.at: r.spent_before for r in out.collect()} == want and out.columns == [*df.columns, "spent_before"]
    plan = triage.spend_cap(df, 300, "at", "arm", 7)._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(arm#" in plan and all("_block#" in w for w in plan.split("windowspecdefinition(arm#")[1:])  # no window over a whole arm
    assert triage.spend_cap(df.limit(0), 300, "at", "arm").collect() == []
