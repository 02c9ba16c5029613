"""SARIF files: written whole or not at all, and read back."""

import pytest
from pyspark.sql import functions as F

from scanledger.sources import io


def test_documents_are_read_back_as_written(spark, tmp_path):
    rows = [("io.github.x/y", 0, "{}"), ("a b/ü?*..", 0, "ü"), ("..", 1, "x"), ("x" * 700, 3, "long"), ("", 0, "none"), ("s", 0, ""), ("s", 12, "two")]
    df = spark.createDataFrame(rows, "server_id string, part int, document string")
    path = f"file://{tmp_path}/out"
    io.write_sarif(df.repartition(3), path)
    assert sorted(map(tuple, io.read_sarif(spark, path).collect())) == sorted(rows)
    assert len(list((tmp_path / "out").rglob("*.sarif.json"))) == len(rows) and (tmp_path / "out" / "_SUCCESS").exists()
    io.write_sarif(df.limit(1), path, "append")
    assert io.read_sarif(spark, path).count() == len(rows) + 1
    io.write_sarif(df.limit(2), path)
    assert io.read_sarif(spark, path).count() == 2
    io.write_sarif(df.limit(0), path)
    assert io.read_sarif(spark, path).count() == 0 and [p.name for p in (tmp_path / "out").iterdir()] == ["_SUCCESS"]


def test_an_aborted_write_leaves_what_was_there(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    io.write_sarif(spark.createDataFrame([("s", 0, "first")], "server_id string, part int, document string"), path)
    many = spark.range(200).select(F.col("id").cast("string").alias("server_id"), F.lit(0).alias("part"), F.when(F.col("id") < 190, "x").alias("document")).repartitionByRange(4, "server_id")
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="missing"):
            io.write_sarif(many, path, mode)
        assert [tuple(r) for r in io.read_sarif(spark, path).collect()] == [("s", 0, "first")]
        assert not list((tmp_path / "out").glob("_staging*")) and len(list((tmp_path / "out").rglob("*.sarif.json"))) == 1


def test_servers_without_results_have_a_document(spark):
    results = spark.createDataFrame([("a", f"{i:08x}", "r", 0, "note", "m", "f", i) for i in range(7)], "server_id string, finding_id string, rule_id string, rule_index int, level string, message string, file string, line int")
    rules = spark.createDataFrame([("r", 0)], "rule_id string, rule_index int")
    servers = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "server_id string")
    got = {(r.server_id, r.part): r.document for r in io.sarif_documents(results, rules, most=3, servers=servers).collect()}
    assert {k[0] for k in got} == {"a", "b"} and len(got) == 4
    assert got["b", 0] == '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"scanledger","rules":[{"id":"r","index":0}]}},"results":[]}]}'
    assert len(io.sarif_documents(results.limit(0), rules.limit(0), servers=servers).collect()) == 2
    assert io.sarif_documents(results.limit(0), rules).collect() == []
