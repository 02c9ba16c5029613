"""The history and the incremental fold over all nights."""

from scanledger.plans import registry, views


def test_history_holds_all_nights(spark, tmp_path):
    events = spark.createDataFrame([(i, 1, "view", float(10 * v), f"2024-01-{n:02d} 01:00:00") for i, (v, n) in enumerate([(1, 1), (2, 12), (3, 22), (4, 27), (5, 30)])], "event_id long, user_id long, event_type string, value double, ts string")
    d = f"file://{tmp_path}"
    events.selectExpr("event_id", "user_id", "event_type", "value", "cast(ts as timestamp) as ts").write.parquet(f"{d}/events.parquet")
    day = lambda t: str(t)[:10]
    assert {(r.evidence, day(r.first_seen)) for r in views.previous(spark, d).collect()} == {("v1", "2024-01-01"), ("v2", "2024-01-12"), ("v3", "2024-01-22")}
    assert {r.evidence for r in views.current(spark, d).collect()} == {"v4", "v5"}
    got = registry.QUERIES["merge_stream"](spark, d).collect()
    assert sorted(day(r.first_seen) for r in got) == ["2024-01-01", "2024-01-12", "2024-01-22", "2024-01-27", "2024-01-30"]


def by_hand(rows):
    """The history after all nights, in order: id to (first, last, earlier ids)."""
    state = {}
    for night in sorted({r["night"] for r in rows}):
        tonight = {r["finding_id"]: r for r in rows if r["night"] == night}
        for i, r in tonight.items():
            first, earlier = (state[i][1], state[i][3]) if i in state else (night, ())
            state[i] = (r, first, night, earlier)
        keys = {(r["server_id"], r["rule_id"], r["file"], r["evidence"]) for r in tonight.values()}
        for key in keys:
            of = sorted(((r["line"], i) for i, (r, *_) in state.items() if (r["server_id"], r["rule_id"], r["file"], r["evidence"]) == key))
            gone = [i for _, i in of if state[i][2] != night]
            came = [i for _, i in of if state[i][1] == state[i][2] == night]
            if len(gone) == len(came):
                for old, new in zip(gone, came, strict=True):
                    _, first, _, earlier = state.pop(old)
                    state[new] = (state[new][0], first, night, (*earlier, old))
    return {i: (first, last, earlier) for i, (_, first, last, earlier) in state.items()}


def test_the_stream_folds_as_by_hand(spark, tmp_path, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from scanledger.operators import history
    from scanledger.streaming import merge_stream as ms

    rng = random.Random(4)
    found = {(n, s, f, line) for n in range(1, 9) for s in "ab" for f in "xyz" for line in rng.sample(range(6), rng.randint(0, 2))}
    data = [(f"2024-01-{n:02d}", s, "a" * 40, "r", "high", "low", f, line, "e") for n, s, f, line in sorted(found)]
    df = history.with_identity(spark.createDataFrame(data, "night string, server_id string, commit_sha string, rule_id string, severity string, confidence string, file string, line int, evidence string"))
    names = ["server_id", "commit_sha", "rule_id", "severity", "confidence", "file", "line", "evidence", "finding_id"]
    for night in sorted({r[0] for r in data}):  # a file a night, in order
        df.where(F.col("night") == night).select(*names, F.col("night").cast("date").alias("night")).coalesce(1).write.parquet(f"file://{tmp_path}/land/{night}")
    want = by_hand([r.asDict() for r in df.collect()])
    day = lambda t: str(t)[:10]
    for k, each in enumerate((1, 3, 100)):
        out = ms.merge_stream(spark, f"file://{tmp_path}/land/*", f"file://{tmp_path}/state{k}", f"file://{tmp_path}/cp{k}", files_per_batch=each)
        assert {r.finding_id: (day(r.first_seen), day(r.last_seen), tuple(r.previous_ids)) for r in out.collect()} == want, each
    kept = {p.name for p in (tmp_path / "state0" / "manifest").iterdir()}
    assert kept == {"version=6", "version=7"} and not list((tmp_path / "state0").glob("step=*"))
    named = {(int(r.part), r.version) for v in (6, 7) for r in spark.read.parquet(f"file://{tmp_path}/state0/manifest/version={v}").where("kind = 'history'").collect()}
    assert {(int(p.name[7:]), int(p.parent.name[8:])) for p in (tmp_path / "state0" / "data").glob("version=*/bucket=*")} == named
    ms.fold_batch(df.where("night = '2024-01-08'").select(*names, F.col("night").cast("date").alias("night")), f"file://{tmp_path}/state0", 7)  # again, as after a failure
    assert {r.finding_id: (day(r.first_seen), day(r.last_seen), tuple(r.previous_ids)) for r in ms.read_version(spark, f"file://{tmp_path}/state0", 7).collect()} == want


def pieces(spark):
    """Findings of four nights: the second in two pieces, the first late; one finding comes in both pieces."""
    from pyspark.sql import functions as F

    from scanledger.operators import history

    rows = [("2024-01-02", "a", "r1", "low", 1), ("2024-01-02", "a", "r2", "high", 2), ("2024-01-03", "b", "r1", "low", 3)]
    more = [("2024-01-02", "a", "r1", "low", 1), ("2024-01-02", "c", "r1", "info", 4)]
    late = [("2024-01-01", "a", "r3", "low", 5), ("2024-01-04", "a", "r1", "critical", 1)]
    out = []
    for part in (rows, more, late):
        df = spark.createDataFrame([(n, s, "a" * 40, r, sev, "low", "f", line, "e") for n, s, r, sev, line in part], "night string, server_id string, commit_sha string, rule_id string, severity string, confidence string, file string, line int, evidence string")
        names = ["server_id", "commit_sha", "rule_id", "severity", "confidence", "file", "line", "evidence", "finding_id"]
        out.append(history.with_identity(df).select(*names, F.col("night").cast("date").alias("night")))
    return out


def points(df):
    return [(r.scanned_at, r.findings_found, r.findings_published, r.withheld, r.servers_affected, r.by_rule) for r in df.collect()]


AFTER = [
    [("2024-01-02", 2, 1, 1, 1, {"r1": 1, "r2": 1}), ("2024-01-03", 1, 1, 0, 1, {"r1": 1})],
    [("2024-01-02", 3, 2, 1, 2, {"r1": 2, "r2": 1}), ("2024-01-03", 1, 1, 0, 1, {"r1": 1})],
    [("2024-01-01", 1, 1, 0, 1, {"r3": 1}), ("2024-01-02", 3, 2, 1, 2, {"r1": 2, "r2": 1}), ("2024-01-03", 1, 1, 0, 1, {"r1": 1}), ("2024-01-04", 1, 0, 1, 1, {"r1": 1})],
]


def test_the_trend_of_the_stream_is_upserted_by_day(spark, tmp_path):
    from scanledger.streaming import merge_stream as ms

    for i, df in enumerate(pieces(spark)):
        ms.fold_batch(df, f"file://{tmp_path}/state", i)
        assert points(ms.read_trend(spark, f"file://{tmp_path}/state", i)) == AFTER[i]
    assert ms.read_trend(spark, f"file://{tmp_path}/none", 5).collect() == []
    ms.fold_batch(pieces(spark)[0].limit(0), f"file://{tmp_path}/state", 3)  # nothing came
    assert points(ms.read_trend(spark, f"file://{tmp_path}/state", 3)) == AFTER[2]
    ms.fold_batch(pieces(spark)[0], f"file://{tmp_path}/other", 0, shown=ms.F.lit(True))
    assert [p[2] for p in points(ms.read_trend(spark, f"file://{tmp_path}/other", 0))] == [2, 1]


def test_a_batch_killed_between_the_tables_is_run_again_whole(spark, tmp_path, monkeypatch):
    import pytest

    from scanledger.streaming import merge_stream as ms

    parts = pieces(spark)
    for where in ("write_sightings", "write_points", "_remove"):  # after the history, after the sightings, after the manifest
        folder = f"file://{tmp_path}/{where}"
        ms.fold_batch(parts[0], folder, 0)
        history = {tuple(map(str, r)) for r in ms.read_version(spark, folder, 1).collect()}

        def dies(*_):
            raise RuntimeError("killed")

        with monkeypatch.context() as m:
            m.setattr(ms, where, dies)
            if where == "_remove":
                ms.fold_batch(parts[1], folder, 1)  # one night leaves nothing to remove
            else:
                with pytest.raises(RuntimeError):
                    ms.fold_batch(parts[1], folder, 1)
                assert {tuple(map(str, r)) for r in ms.read_version(spark, folder, 1).collect()} == history  # neither table shows the batch
                assert points(ms.read_trend(spark, folder, 1)) == AFTER[0]
        ms.fold_batch(parts[1], folder, 1)
        ms.fold_batch(parts[1], folder, 1)  # its acknowledgement was lost
        ms.fold_batch(parts[2], folder, 2)
        assert points(ms.read_trend(spark, folder, 2)) == AFTER[2]
        whole = f"file://{tmp_path}/{where}-whole"
        for i, df in enumerate(parts):
            ms.fold_batch(df, whole, i)
        assert {tuple(map(str, r)) for r in ms.read_version(spark, folder, 2).collect()} == {tuple(map(str, r)) for r in ms.read_version(spark, whole, 2).collect()}
