"""Notices that share a server and a second."""

import pytest

from scanledger.operators import disclosure
from scanledger.plans import registry

LEDGER = "kind string, server_id string, reference string, notified_at timestamp, acknowledged_at timestamp, fixed_at timestamp"


def ledger(spark):
    from datetime import datetime as at

    t, u = at(2024, 1, 1, 5), at(2024, 1, 1, 5, 0, 0, 900)
    rows = [("notice", "a", "1", t, None, None), ("notice", "a", "2", u, None, None), ("notice", "a", "2", at(2024, 1, 2), None, None), ("notice", "b", None, t, None, None), ("opt_out", "a", None, None, None, None)]
    return spark.createDataFrame(rows, LEDGER)


def updates(spark, rows, schema):
    types = {"id": "notice_id string", "ref": "reference string"}
    df = spark.createDataFrame([(*r, "2024-02-01", None) for r in rows], ", ".join(types[s] for s in schema) + ", a string, f string")
    return df.selectExpr(*[types[s].split()[0] for s in schema], "cast(a as timestamp) as acknowledged_at", "cast(f as timestamp) as fixed_at")


def test_only_the_notice_meant_is_marked_and_stays_one_row(spark):
    told = updates(spark, [("a@2024-01-01T05:00:00Z", "2"), ("a@2024-01-01T05:00:00Z", "2"), ("b@2024-01-01T05:00:00Z", None)], ["id", "ref"])
    got = disclosure.mark_notices(ledger(spark), told).collect()
    assert sorted((r.server_id, r.reference or "", str(r.notified_at)[:10], str(r.acknowledged_at)[:10]) for r in got) == [
        ("a", "1", "2024-01-01", "None"), ("a", "2", "2024-01-01", "2024-02-01"), ("a", "2", "2024-01-02", "None"), ("b", "", "2024-01-01", "2024-02-01"),
    ]


def test_an_update_that_means_several_notices_is_refused(spark):
    with pytest.raises(Exception, match="several notices are meant"):
        disclosure.mark_notices(ledger(spark), updates(spark, [("a@2024-01-01T05:00:00Z",)], ["id"])).collect()
    got = disclosure.mark_notices(ledger(spark), updates(spark, [("a@2024-01-02T00:00:00Z",)], ["id"])).where("acknowledged_at is not null").collect()
    assert [str(r.notified_at)[:10] for r in got] == ["2024-01-02"]


def test_marked_notices_of_one_second(spark, tmp_path):
    d = f"file://{tmp_path}"
    rows = [(i, i, "view", 1.0, "2024-01-01 01:00:00") for i in (0, 10, 20, 30)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts string").selectExpr("event_id", "user_id", "event_type", "value", "cast(ts as timestamp) as ts").write.parquet(f"{d}/events.parquet")
    got = sorted(r.acknowledged_at for r in registry.QUERIES["marked_notices"](spark, d).collect())
    assert got == ["2024-01-02T01:00:00Z", "2024-01-02T01:00:00Z", "2024-01-04T01:00:00Z", "2024-01-04T01:00:00Z"]
