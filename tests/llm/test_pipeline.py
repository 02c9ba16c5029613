"""The stages of the corpus pipeline on a small folder of tables."""

import corpus_pipeline as cp
from scanledger.llm import line_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, tmp_path, rows):
    d = f"file://{tmp_path}"
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], int("!!" not in (r[1] or ""))) for r in rows if r[1]]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, tmp_path):
    say = lambda k: " ".join(f"w{(k * 7 + i * i * (k + 3)) % 97}x{(i * k) % 13}" for i in range(60)) + "."
    rows = [(i, say(i) + "\n" + say(i + 100), "en", f"s{i % 2}", 0) for i in range(12)]
    rows += [(50 + i, "BUY!! NOW!! " * 10 + str(i), "en", "s0", 0) for i in range(12)]
    rows += [(80, rows[3][1], "en", "s1", 0), (81, rows[4][1].replace("w", "w", 1) + " more", "en", "s1", 0), (82, None, "en", None, None), (83, "", "en", "s0", 0)]
    d = tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = cp.keep_quality(spark, docs, d)
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(12)) | {80, 81} <= ids and not ids & set(range(50, 62)) and kept.columns == docs.columns
    lines = cp.drop_repeated_lines(spark, kept, d)
    left = {r.doc_id: r.text for r in lines.collect()}
    assert 80 not in left and lines.columns == docs.columns and left[81].count("\n") == 0 and len(left[81]) > line_dedup.SHORTEST
    one = cp.keep_one_of_each(spark, kept, d)
    assert {r.doc_id for r in one.collect()} == ids - {80, 81} and one.columns == docs.columns
    assert cp.keep_one_of_each(spark, kept.union(kept), d).where("doc_id is not null and text <> ''").count() == len(ids - {80, 81, 82, 83})
    mixed = cp.mix_to_targets(spark, one, d)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= ids
    out = cp.run(spark, d)
    assert out.count() > 0 and [n for n, _ in cp.STAGES] and cp.ORACLE_SQL is None


def test_empty_table(spark, tmp_path):
    d = f"file://{tmp_path}"
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    assert cp.run(spark, d).count() == 0
