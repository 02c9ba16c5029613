"""The stages of the pipeline, one by one and as a chain, against brute force."""

import collections
import random

import pytest

import corpus_pipeline as cp
from scanledger.llm import mixing, packing, quality
from scanledger.llm.common import table
from tests.llm.test_operators import edits, shingles, union_find

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    good = [(i, "\n".join(say(rng.randint(6, 30)) for _ in range(rng.randint(1, 4))), f"s{i % 3}") for i in range(24)]
    line = say(12)
    good += [(30, good[1][1], "s1"), (31, good[2][1].replace("a", "b", 1), "s1"), (32, say(8) + "\n" + line, "s0"), (33, line[:-1] + "!\n" + say(9), "s2"), (34, line, "s2"), (35, say(400), "s0")]
    bad = [(50 + i, "BUY!! NOW!! $$$ " * 8 + str(i), "s0") for i in range(14)]
    odd = [(70, None, None), (71, "", "s1"), (72, "x " * 3000, "s1"), (None, say(10), "s2"), good[5]]
    return [(d, t, "en", s, len(t or "")) for d, t, s in good + bad + odd]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('pipeline')}"
    docs = spark.createDataFrame(fixture(), DOCS).selectExpr("*", "1 as _size", "'c' as hits", "2 as copies", "3 as _copy", "'l' as label", "4 as n_chars_2")
    docs.repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], int("!!" not in r[1])) for r in fixture() if r[1] and r[0] is not None], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    return d


def of(df):
    return collections.Counter((r.doc_id, r.text, r.source) for r in df.collect())


def judged(spark, d, rows):
    field = quality.fit_quality(table(spark, d, "documents"), table(spark, d, "labels"))
    return collections.Counter({r: n for r, n in rows.items() if quality.document_scores(field, [(r[1] or "").encode()])[0] >= quality.THRESHOLD})


def without_repeats(rows):
    first = {}
    for d, t, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k, line in enumerate(t.split("\n") if t is not None else []):
            if line.strip(" \t\n\v\f\r") or len(line) >= 20:
                first.setdefault(line, (d, k))
    long = [x for x in first if 20 <= len(x) < 2500]
    root = union_find(first.values(), [(first[a], first[b]) for a in long for b in long if first[a] < first[b] and abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2])
    out = collections.Counter()
    for (d, t, s), n in rows.items():
        if d is None or t is None:
            out[d, t, s] += n
            continue
        lines = t.split("\n")
        kept = [x for k, x in enumerate(lines) if x not in first or root[first[x]] == (d, k)]
        if len(kept) == len(lines) or "\n".join(kept).strip(" "):
            out[d, "\n".join(kept), s] += n
    return out


def one_of_each(rows):
    texts = {}
    for d, t, s in rows:
        if d is not None and (d not in texts or (t or "") < (texts[d][0] or "")):
            texts[d] = (t, s)
    sets = {d: shingles(t) for d, (t, _) in texts.items()}
    root = union_find(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    return collections.Counter({(d, *texts[d]): 1 for d in texts if root[d] == d}) + collections.Counter({r: n for r, n in rows.items() if r[0] is None})


def test_each_stage_and_the_chain_by_brute_force(spark, made):
    docs = table(spark, made, "documents")
    rows = collections.Counter((d, t, s) for d, t, _, s, _ in fixture())
    frame = lambda c: spark.createDataFrame([(*r[:2], "en", r[2], len(r[1] or "")) for r, n in c.items() for _ in range(n)], DOCS).repartition(3)

    kept = cp.keep_quality(spark, docs, made)
    want = judged(spark, made, rows)
    assert of(kept) == want and kept.columns == docs.columns and 0 < len(want) < len(rows)
    assert not any(d is not None and 50 <= d < 70 for d, *_ in want)

    lines = cp.drop_repeated_lines(spark, docs, made)
    assert of(lines) == without_repeats(rows) and lines.columns == docs.columns
    assert all(r.n_chars == len(r.text or "") for r in lines.collect())
    one = cp.keep_one_of_each(spark, docs, made)
    assert of(one) == one_of_each(rows) and one.columns == docs.columns

    mixed = cp.mix_to_targets(spark, docs, made)
    taken = collections.Counter()
    for r in mixing.mix_documents(docs).collect():
        taken[r.doc_id, r.source, r["size"]] += r.copies
    got = collections.Counter()
    for (d, t, s), n in of(mixed).items():
        got[d, s, len((t or "").split())] += n
    assert got == +taken and mixed.columns == docs.columns and set(of(mixed)) <= set(rows)

    chain = one_of_each(without_repeats(want))
    last = of(cp.mix_to_targets(spark, frame(chain), made))
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    tokens = collections.Counter()
    for (d, t, _), n in last.items():
        tokens[d] += n * (len(plain.encode(t or "", add_special_tokens=False).ids) + 1)
    packed = collections.Counter()
    for r in cp.run(spark, made).collect():
        packed[r.doc_id] += r.length
    assert packed == tokens and [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing to target weights", "packing"]


def test_stages_of_an_empty_table(spark, made):
    none = table(spark, made, "documents").where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, none, made).count() == 0
