"""The manifest, the spelling variants and the divergence rules against brute force on awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest

from scanledger.llm import divergence, manifest, queries, spelling
from tests.llm.test_queries import DOCS, awkward

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def joined(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, more=0):
    d, t, lang, s, n = row
    return joined(*map(told, (d, s, lang, n if n is None else n + more, t)))


def levels(x):
    out = [x]
    while len(out[-1]) > 1:
        out.append([joined(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def proofs(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs]
    trees = [levels([leaf(r) for r in m]) for m in members]
    top = levels([t[-1][0] for t in trees])
    out = collections.Counter()
    for k, (m, tree) in enumerate(zip(members, trees, strict=True)):
        for i, row in enumerate(m):
            beside, h = [], leaf(row, int(row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0))
            for t, p in ((tree, i), (top, k)):
                for level in t[:-1]:
                    s = p ^ 1
                    h = joined(h) if s >= len(level) else joined(level[s], h) if s < p else joined(h, level[s])
                    beside += level[s : s + 1]
                    p >>= 1
            root = top[-1][0]
            out[row[0], leaf(row), tree[-1][0], root, joined(*beside), h, h == root] += 1
    return out


def mixed_rows(n, seed=3):
    rng = random.Random(seed)
    langs = ["en"] * 6 + ["de", "é", "", None]
    rows = [(i, f"text {i}", rng.choice(langs), f"s{i % 3}", rng.choice([i, None])) for i in range(n)]
    return rows + [(5, "twice", "en", None, 3)] * 3 + [(None, None, None, None, None), (None, "", "en", "s", 0)] + [(7, "x", "only", "s", 1)]


@pytest.mark.parametrize(("block_levels", "n"), [(12, 40), (1, 23), (2, 150), (3, 0)])
def test_proofs_equal_brute_force_for_any_size_of_block(spark, block_levels, n):
    rows = mixed_rows(n)
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as Leaf", "2 as grp", "3 as pos").repartition(3)
    assert collections.Counter(map(tuple, manifest.tampered_manifest(df, block_levels=block_levels).collect())) == proofs(rows)


def test_manifest_of_awkward_rows_and_of_none(spark, tmp_path):
    df = spark.createDataFrame(awkward(), DOCS)
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert collections.Counter(map(tuple, queries.op11_merkle_manifest(spark, f"file://{tmp_path}").collect())) == proofs(awkward())
    assert manifest.tampered_manifest(df.limit(0)).collect() == []


def test_slots_are_a_permutation_with_subtrees_in_one_stretch():
    for height in range(1, 14):
        every = np.concatenate([manifest.slot(height, d, np.arange(1 << d)) for d in range(height)])
        assert sorted(every.tolist()) == list(range((1 << height) - 1))
    upper = 13 // 2
    for top in range(1 << upper):  # each lower subtree lies in one aligned stretch
        below = np.concatenate([manifest.slot(13, upper + d, (top << d) + np.arange(1 << d)) for d in range(13 - upper)])
        assert below.max() - below.min() == len(below) - 1


def test_a_written_manifest_proves_some_leaves(spark, tmp_path):
    rows = mixed_rows(60)
    df = spark.createDataFrame(rows, DOCS)
    keyed = df.select("doc_id", "lang", manifest.leaf_digest(**{n: df[n] for n in manifest.FIELDS}).alias("leaf"))
    made = manifest.build_manifest(keyed, 3)
    made.write(f"file://{tmp_path}/m")
    read = manifest.read_manifest(spark, f"file://{tmp_path}/m")
    assert read.root().collect() == made.root().collect()
    assert {tuple(r) for r in read.subroots().collect()} == {(r[2], p[2]) for r in rows for p in proofs(rows) if p[1] == leaf(r)}
    some = manifest.prove(read, read.leaves.where("doc_id in (5, 9)"), 3)
    got = {(r.doc_id, r.p, r.f) for r in some.select("doc_id", manifest.proof_digest("path").alias("p"), manifest.folded(some.leaf, "path").alias("f")).collect()}
    want = {(p[0], p[4], p[3]) for p in proofs(rows) if p[0] in (5, 9)}
    assert got == want


def counted_words(rows):
    found = collections.Counter()
    for d, t, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            low = run.translate(str.maketrans(UP, LOW))
            h = zlib.crc32(f"{'' if d is None else d}:{low}".encode())
            found[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 199 == 0 else low] += 1
    return found


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts, ratio=5):
    near = collections.defaultdict(set)
    for a, b in itertools.combinations(counts, 2):
        if one_edit(a, b):
            near[a].add(b)
            near[b].add(a)
    form = {w: f for w in counts if near[w] and counts[f := min(near[w], key=lambda x: (-counts[x], x))] >= ratio * counts[w]}
    out = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, counts[w], len(near[w]), counts.get(form.get(w))))
    return out


def test_variants_equal_brute_force(spark):
    rng = random.Random(5)
    counts = {}
    for letters in ("ab", "abcdé", "abcdefghijklmnop"):
        for _ in range(40):
            w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 10)))
            counts[w] = rng.choice([5, 30, 200])
            for _ in range(4):
                k = rng.randrange(len(w) + 1)
                v = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
                counts.setdefault(v if len(v) > 5 else w, rng.choice([5, 6, 40]))
    counts |= {"a" * 300: 9, "a" * 301: 90, "a" * 150 + "b" + "a" * 150: 7}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    for part in (4096, 3):  # keys in one part and in many
        assert {tuple(r) for r in spelling.group_variants(df, part=part).collect()} == variants(counts)
    assert spelling.group_variants(df.limit(0)).collect() == []
    assert [tuple(r) for r in spelling.group_variants(df.where("word = repeat('a', 300)")).collect()] == [("a" * 300, None, "a" * 300, 9, 0, None)]


def test_forms_are_followed_to_the_last(spark):
    words = ["letter" + "x" * i for i in range(12)]
    counts = {w: 5 * 6**i for i, w in enumerate(words)}
    got = {tuple(r) for r in spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == variants(counts) and {r[2] for r in got} == {words[-1]}


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(2)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 6)))
        weights = [rng.randint(1, 9) for _ in places]
        pairs = [(weights[i] + weights[j], places[i], places[j]) for i, j in itertools.combinations(range(len(places)), 2) if places[j] - places[i] > 1]
        a, b = spelling.choose_pivots(places, weights)
        assert b - a > 1 and weights[places.index(a)] + weights[places.index(b)] == min(pairs)[0]


def test_op12_counts_planted_errors(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeÀÿ") for _ in range(rng.randint(5, 8))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary).title() if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(90)), "en", "s", 1) for i in range(60)]
    rows += [(None, rows[0][1], "en", "s", 1), (1, None, None, None, None), (2, "", "", "", 0), (3, rows[3][1], "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as word", "'x' as run", "2 as h").write.parquet(f"file://{tmp_path}/documents.parquet")
    counts = {w: n for w, n in counted_words(rows).items() if len(w) >= 6 and n >= 5}
    assert {tuple(r) for r in queries.op12_spelling_variants(spark, f"file://{tmp_path}").collect()} == variants(counts)


def base_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def kind(c):
    k = unicodedata.category(c)
    if c in " \t\n\v\f\r":
        return 0
    if k[0] == "N":
        return None
    if k == "Ll":
        return 1
    if k in ("Lu", "Lt"):
        return 2
    if k[0] in "LM":
        return 3
    if c in "#*%&@/_\\" or k[0] == "S":
        return 5
    return 4 if k[0] == "P" else 6


def classes_of(text):
    found = collections.Counter(map(kind, text or ""))
    return [found[i] for i in range(7)]


def distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    return math.sqrt(max(0, sum(x * math.log2(2 * x / (x + y)) if x else 0 for a, b in ((p, q), (q, p)) for x, y in zip(a, b, strict=True)) / 2))


def judged(rows):
    base = [base_of(t) for _, t, *_ in rows]
    failed = [b[0] < 50 or 100 * b[4] > 50 * b[0] for b in base]
    low = lambda t: [w.translate(str.maketrans(UP, LOW)) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    medians, words, number = {}, {}, collections.Counter()
    copies, rows_of = collections.Counter((r[2], r[1] or "") for r in rows), collections.Counter(r[2] for r in rows)
    hot = {k for k, n in copies.items() if n >= 20 and 100 * n > rows_of[k[0]]}
    for lang in {r[2] for r in rows} | {"*every"}:
        mine = [r for r, f in zip(rows, failed, strict=True) if not f and lang in (r[2], "*every") and (r[2], r[1] or "") not in hot]
        number[lang] = len(mine)
        shares = [[c * 1024 // sum(cs) for c in cs] for cs in (classes_of(r[1]) for r in mine) if sum(cs)]
        medians[lang] = [2 * m + 1 if m else 0 for m in (sorted(x)[(len(x) - 1) // 2] for x in zip(*shares, strict=True))] or None
        sums = collections.Counter()
        for r in mine:
            every = low(r[1])
            for w, n in collections.Counter(every).items():
                sums[w] += n * (1 << 20) // len(every)
        words[lang] = {w: s // len(mine) for w, s in sums.items() if s * 400 >= len(mine) << 20}
    out = []
    for (d, t, lang, *_), b, f in zip(rows, base, failed, strict=True):
        known = number[lang] >= 20
        near = far = None
        cs, ref = classes_of(t), medians[lang] if known else medians["*every"]
        if ref and sum(cs) >= 100:
            near = distance(cs, ref)
        if known and words[lang] and b[0] >= 50:
            n = collections.Counter(low(t))
            p = [n[w] for w in words[lang]]
            far = distance([*p, b[0] - sum(p)], [*words[lang].values(), (1 << 20) - sum(words[lang].values())])
        kept = not f and (near is None or near <= 0.14) and (far is None or far <= 0.18 + 2.6 / math.sqrt(b[0]))
        out.append((d, *b, f, kept, near, far))
    return out


def documents_of_two_languages():
    rng = random.Random(4)
    vocabulary = {x: ["".join(rng.choice(x) for _ in range(rng.randint(2, 8))) for _ in range(400)] for x in ("abcdefgh", "éèmnopqr")}
    rows = []
    for i in range(120):
        letters, lang = (("abcdefgh", "en"), ("éèmnopqr", "fr"))[i % 3 == 0]
        words = [rng.choice(vocabulary[letters][: rng.choice([4, 30, 400])]) for _ in range(rng.choice([20, 60, 200, 700]))]
        text = " ".join(words)
        if i % 10 == 1:
            text = text.upper().replace(" ", "!! ")
        if i % 10 == 2:
            text = text.replace(" ", "&&& ")
        if i % 10 == 3:
            text += ("\n" + words[0] + " again and again") * 30
        rows.append((i, text, lang, "s", len(text)))
    rows += [rows[5]] * 40 + [rows[0], (None, rows[4][1], "en", None, None), (5, None, None, None, None), (6, "", "", "", 0), (7, " \n\t\n ", "en", "s", 5), (8, "1 2 3 " * 40, "en", "s", 1), (9, "x\U0001f600 ́y ٣ " * 40, None, "s", 1), (10, rows[1][1], "xx", "s", 1)]
    return rows


def test_divergence_equals_brute_force(spark, tmp_path):
    rows = documents_of_two_languages()
    spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as n_words", "'x' as classes", "true as every").repartition(4).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op13_divergence(spark, f"file://{tmp_path}").collect()]
    want = [(*r[:8], *[x if x is None else round(x, 6) for x in r[8:]]) for r in judged(rows)]
    assert collections.Counter(got) == collections.Counter(want)
    assert {r[7] for r in want} == {True, False} and any(not r[6] and not r[7] for r in want)


def test_divergence_of_awkward_rows_and_of_none(spark):
    df = spark.createDataFrame(awkward(), DOCS)
    got = divergence.judge_divergence(df).collect()
    assert collections.Counter(r[:8] for r in map(tuple, got)) == collections.Counter(r[:8] for r in judged(awkward()))
    assert divergence.judge_divergence(df.limit(0)).collect() == []


def test_copies_of_junk_do_not_speak_for_a_language(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice(LOW) for _ in range(rng.randint(2, 7))) for _ in range(500)]
    weights = [1 / (i + 3) for i in range(500)]
    clean = [" ".join(rng.choices(vocabulary, weights, k=rng.choice([60, 120, 400]))) for _ in range(60)]
    junk = " ".join(rng.choice(vocabulary) + "###" for _ in range(120))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(clean)] + [(100 + i, junk, "en", "s", 1) for i in range(30)]
    kept = {r.doc_id for r in divergence.judge_divergence(spark.createDataFrame(rows, DOCS)).where("kept").collect()}
    assert kept == set(range(60))
