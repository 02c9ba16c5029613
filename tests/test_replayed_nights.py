"""All nights of a batch in one pass, against the fold night by night."""

import random

from pyspark.sql import functions as F

from scanledger.operators import history
from scanledger.streaming import merge_stream as ms

NAMES = ["server_id", "commit_sha", "rule_id", "severity", "confidence", "file", "line", "evidence", "finding_id"]


def findings(spark, rng, nights):
    most = {"v": 1, "w": 1, "x": 2, "y": 3, "z": 3}  # lines that a file shows a night
    data = {(n, f, line, rng.choice("ab") * 40) for n in nights for f in most for line in rng.sample([None, *range(1, 5 if f > "w" else 30)], rng.randint(f < "x", most[f]))}
    schema = "night string, server_id string, commit_sha string, rule_id string, severity string, confidence string, file string, line int, evidence string"
    rows = [(f"2024-01-{n:02d}", "s", sha, "r", "high", "low", f, line, None if f == "z" else "e") for n, f, line, sha in sorted(data, key=str)]
    return history.with_identity(spark.createDataFrame(rows, schema)).select(*NAMES, F.col("night").cast("date").alias("night")).localCheckpoint()


def told(df):
    return sorted(repr(r) for r in df.select(*sorted(ms.NAMES)).collect())


def test_batches_of_partial_and_late_nights_equal_the_fold_night_by_night(spark, tmp_path):
    rng = random.Random(11)
    state, newest = ms.read_version(spark, f"file://{tmp_path}/none", 0), ""
    for batch, nights in enumerate([(3, 4, 5), (5, 6), (1, 2, 4, 6, 7), (2,), (7, 8, 9)]):  # the 5th, 6th and 7th in pieces, the 1st, 2nd and 4th late
        df = findings(spark, rng, nights)
        for night in sorted({str(r.night) for r in df.select("night").collect()}):
            state = ms.fold_night(state, df.where(F.col("night") == night).drop("night"), night, newest).select(*ms.NAMES).localCheckpoint()
            newest = max(newest, night)
        ms.fold_batch(df, f"file://{tmp_path}/state", batch)
        got = ms.read_version(spark, f"file://{tmp_path}/state", batch)
        assert told(got) == told(state), batch
    assert got.where("size(previous_ids) > 1").count()  # moves that follow moves


def test_the_jobs_of_a_batch_do_not_grow_with_its_nights(spark, tmp_path):
    tracker, counts = spark.sparkContext.statusTracker(), []
    for k, nights in enumerate([range(1, 4), range(1, 16)]):
        df = findings(spark, random.Random(2), nights)
        spark.sparkContext.setJobGroup(f"fold-{k}", "", False)
        ms.fold_batch(df, f"file://{tmp_path}/state{k}", 0)
        counts.append(len(tracker.getJobIdsForGroup(f"fold-{k}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < counts[1] <= counts[0] + 3, counts  # each night was a job or more before
