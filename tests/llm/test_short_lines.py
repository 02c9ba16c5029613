"""Short lines in the registered line dedup and in the pipeline."""

import hashlib

import corpus_pipeline as cp
from scanledger.llm import line_dedup, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_short_lines_go_by_equality(spark, tmp_path):
    texts = ["Les.\n\nAnd ornd.\nA line that is long enough to count.", "Les.\nLes!\n\nA line that is long enough to count!", " \n\t\nLet.\nAnd ornd.", None, "", "Les."]
    want = ["Les.\n\nAnd ornd.\nA line that is long enough to count.", "Les!\n", " \n\t\nLet.", None, "", ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(3)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_line_dedup(spark, f"file://{tmp_path}").collect()}
    assert {d: r.kept_sha256 for d, r in got.items()} == {d: None if t is None else hashlib.sha256(t.encode()).hexdigest() for d, t in enumerate(want)}
    assert [got[d].n_removed for d in range(6)] == [0, 2, 1, 0, 0, 1]
    assert {r.doc_id: r.text for r in cp.drop_repeated_lines(spark, docs, "").collect()} == {d: t for d, t in enumerate(want) if d != 5}
    assert {r.doc_id for r in line_dedup.dedup_lines(docs).collect()} == {1}
