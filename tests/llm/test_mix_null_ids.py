"""Documents without an id in the pipeline's mix."""

import collections

import corpus_pipeline as cp
from scanledger.llm import mixing


def test_documents_without_an_id_are_mixed(spark):
    rows = [(None if i % 3 == 0 else i, " ".join(["w"] * (i % 4 + 1)) + f" x{i}", "en", f"s{i % 2}" if i % 5 else None, 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want, got = collections.Counter(), collections.Counter()
    for r in mixing.mix_documents(docs).collect():
        want[r.doc_id, r.source, r["size"]] += r.copies
    for r in cp.mix_to_targets(spark, docs, "").collect():
        got[r.doc_id, r.source, len(r.text.split())] += 1
    assert got == +want and any(d is None for d, _, _ in got)
