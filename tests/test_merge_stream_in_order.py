"""The query merge_stream folds the nights in their order, however fast their files are written."""

from itertools import groupby

from pyspark.sql import functions as F

from scanledger.plans import registry, views

from .test_all_nights import by_hand


def test_merge_stream_equals_the_fold_by_hand(spark, tmp_path):
    d, e = f"file://{tmp_path}", F.col("event_id")
    at = F.timestamp_add("HOUR", (e * 7919 % 720).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    spark.range(900).withColumnRenamed("id", "event_id").select("event_id", (e * 31 % 17).alias("user_id"), F.lit("view").alias("event_type"), (e % 3 * 10.0).alias("value"), at.alias("ts")).write.parquet(f"{d}/events.parquet")
    rows = [r.asDict() for r in views.findings(spark, d).selectExpr("server_id", "rule_id", "file", "evidence", "line", "finding_id", "cast(night as string) as night").distinct().collect()]
    key = lambda r: (r["server_id"], r["rule_id"], r["file"], r["evidence"])
    want = {i: told[:2] for _, of in groupby(sorted(rows, key=key), key=key) for i, told in by_hand(list(of)).items()}
    got = registry.QUERIES["merge_stream"](spark, d).collect()
    assert len({r["night"] for r in rows}) == 30 and len(want) < len({r["finding_id"] for r in rows})
    assert {r.finding_id: (r.first_seen[:10], r.last_seen[:10]) for r in got} == want
