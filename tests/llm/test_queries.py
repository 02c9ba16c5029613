"""Every registered query on a folder of awkward rows: repeated rows, shared and missing ids, nulls, empty and long texts."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from scanledger.llm import packing, quality, queries, sharding, sketches
from tests.llm.test_operators import edits, shingles, union_find, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = say(40), say(9)
    rows = [(i, say(rng.randint(1, 80)) + ("\n" + passage if i % 5 == 0 else "") + ("\n" + line if i % 4 == 0 else ""), f"s{i % 3}") for i in range(40)]
    rows += [(40, rows[3][1], "s0"), (41, rows[3][1] + " more", "s1"), (42, None, None), (43, "", "s1"), (44, " \n\t", "s2"), (45, say(9000), "s0"), (46, "word", "s1"), (47, "word", "s9")]
    rows += [rows[7], rows[7], (8, "another text of the same id " + say(20), "s1"), (None, say(12), "s1"), (None, None, None), (None, rows[5][1], "s2")]
    return [(d, t, "en", s, len(t or "")) for d, t, s in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('tables')}"
    df = spark.createDataFrame(awkward(), DOCS).selectExpr("*", "1 as hits", "'x' as label", "2.5 as weight", "'y' as _size", "3 as sub", "array(1) as dropped")
    df.repartition(5).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 0, 0), (None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "https://a", "<p>x y</p>"), (2, None, None), (2, None, None), (None, "", "")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


def counted(rows, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in rows)


def test_op1_gives_equal_rows_for_equal_texts(spark, folder):
    got = queries.op1_media_columns(spark, folder).collect()
    want = collections.Counter()
    for d, t, *_ in awkward():
        b = (t or "").encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        want[d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert counted(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want


def test_op2_sizes_every_row_and_agrees_with_itself(spark, folder):
    got = queries.op2_mix_sources(spark, folder).collect()
    assert counted(got, "doc_id", "size") == collections.Counter((d, len(words(t))) for d, t, *_ in awkward())
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert counted(got, "doc_id", "size", "taken") == counted(queries.op2_mix_sources(spark, folder).collect(), "doc_id", "size", "taken")


def test_op3_keeps_all_pages(spark, folder):
    assert counted(queries.op3_html_text(spark, folder).collect(), "page_id", "url", "text", "n_chars") == {(1, "https://a", "x y", 3): 1, (2, None, "", 0): 2, (None, "", "", 0): 1}


def test_op4_estimates_likeness_and_containment(spark, folder):
    got = queries.op4_fingerprints(spark, folder).collect()
    rows = [r for r in awkward() if r[0] is not None]
    assert counted(got, "doc_id", "n_chars") == collections.Counter((d, len(t or "")) for d, t, *_ in rows)
    smallest = {}
    for d, t, *_ in rows:
        smallest[d] = min(smallest.get(d, t or ""), t or "")
    ids = sorted(smallest)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    want = collections.Counter()
    for d, t, *_ in rows:
        t, u = t or "", smallest[after[d]]
        want[d, hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()] += 1
    assert counted(got, "doc_id", "edited_sha256") == want
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next, r.in_edited, r.in_next))
    prints = collections.defaultdict(set)
    for r in got:
        prints[r.doc_id].add(r.fingerprint)
    assert len(prints[7]) == 1 and len(prints[8]) == 2 and prints[3] == prints[40] and prints[42] == prints[43] == prints[44]


def test_sketches_against_exact_sets(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    texts = {0: base, 1: base[:3000] + [f"x{i}" for i in range(1000)], 2: base[500:1300], 3: [f"y{i}" for i in range(2000)], 4: base[:4], 5: []}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "id int, text string")
    df = sketches.with_sketch(df, "text", "sketch")
    every = sketches.shingle_hashes("_w")
    hashed = {r.id: set(r.s) for r in df.select("id", sketches.word_array_hashes(df.text).alias("_w")).select("id", every.alias("s")).collect()}
    below = -(1 << 63) + (1 << 64) // sketches.SCALE
    kept = {r.id: r.sketch for r in df.collect()}
    for k, s in hashed.items():
        assert kept[k] == (sorted(h for h in s if h < below) or sorted(s)[:1])
    pairs = df.alias("a").crossJoin(df.alias("b").withColumnsRenamed({"sketch": "other", "id": "to"})).select("a.id", "to", sketches.likeness("sketch", "other").alias("j"), sketches.containment("sketch", "other").alias("c"), sketches.merged("sketch", "other").alias("m"))
    for r in pairs.collect():
        union = hashed[r.id] | hashed[r.to]
        assert r.m == (sorted(h for h in union if h < below) or sorted(union)[:1])
        x, y = hashed[r.id], hashed[r.to]
        exact, inside = (len(x & y) / len(x | y), len(x & y) / len(x) if x else 0.0) if x and y else (float(x == y), float(x == y))
        if min(len(x), len(y)) > 100 or not (x and y):
            assert abs(r.j - exact) < 0.08 and abs(r.c - inside) < 0.15, r


def test_op5_links_by_brute_force(spark, folder):
    texts = {}
    for d, t, *_ in awkward():
        texts[d] = min(texts.get(d, t or ""), t or "") if d is not None else None
    sets = {d: shingles(t) for d, t in texts.items() if d is not None}
    root = union_find(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    got = queries.op5_ngram_jaccard(spark, folder).collect()
    assert counted([r for r in got if r.doc_id is not None], "doc_id", "n_shingles", "component_id") == collections.Counter((d, len(sets[d]), root[d]) for d, *_ in awkward() if d is not None)
    assert sorted((r.n_shingles, r.component_id or -1) for r in got if r.doc_id is None) == sorted([(8, -1), (0, -1), (len(sets[5]), 5)])


def test_op6_lines_by_brute_force(spark, folder):
    rows = [r for r in awkward() if r[0] is not None and r[0] != 8]  # rows that share an id share their decisions
    first = {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate(t.split("\n") if t is not None else []):
            if line.strip(" \t\n\v\f\r") or len(line) >= 20:
                first.setdefault(line, (d, k))
    long = [x for x in first if 20 <= len(x) < 2000]
    root = union_find(first.values(), [(first[a], first[b]) for a in long for b in long if first[a] < first[b] and abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2])
    want = collections.Counter()
    for d, t, *_ in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for k, x in enumerate(lines) if x not in first or root[first[x]] == (d, k)]
        want[d, len(lines), len(lines) - len(kept), None if t is None else hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    got = [r for r in queries.op6_line_dedup(spark, folder).collect() if r.doc_id is not None and r.doc_id != 8]
    assert counted(got, "doc_id", "n_lines", "n_removed", "kept_sha256") == want


def test_op6_links_classes_that_no_pivot_joins(spark):
    """Chains of lines of which neighbours alone are near, and many lines that share a segment."""
    rng = random.Random(17)
    head, lines = "a heading that all of them share: ", []
    for _ in range(12):
        x = "".join(rng.choice("abcdefgh") for _ in range(30))
        for _ in range(5):
            lines.append(head + x)
            k = rng.randrange(len(x))
            x = x[:k] + rng.choice("xyz") + x[k + 1 :]
            x = x[: k // 2] + rng.choice(["", "q"]) + x[k // 2 :]
    rng.shuffle(lines)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string").repartition(3)
    root = union_find(range(len(lines)), [(i, j) for i in range(len(lines)) for j in range(i) if edits(lines[i], lines[j]) <= 2])
    from scanledger.llm import line_dedup

    assert {r.doc_id for r in line_dedup.dedup_lines(docs).collect()} == {i for i in root if root[i] != i}


def test_op7_by_brute_force(spark, folder):
    apart = collections.defaultdict(set)
    for d, t, *_ in awkward():
        apart[d].add((t or "").encode())
    seen, places = set(), {}
    for d in sorted(x for x in apart if x is not None and x != 8):
        (b,) = apart[d]
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        places[d] = (len(b), sum(gone))
    got = queries.op7_repeated_strings(spark, folder).collect()
    assert counted([r for r in got if r.doc_id not in (None, 8)], "doc_id", "n_bytes", "n_removed") == collections.Counter((d, *places[d]) for d, *_ in awkward() if d not in (None, 8))
    assert all(r.n_removed == 0 for r in got if r.doc_id is None) and len(got) == len(awkward())


def test_op8_packs_every_row(spark, folder):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    want, got = collections.Counter(), collections.Counter()
    for d, t, *_ in awkward():
        want[d] += len(plain.encode(t or "", add_special_tokens=False).ids) + 1
    filled = collections.defaultdict(list)
    for r in queries.op8_packing(spark, folder).collect():
        got[r.doc_id] += r.length
        filled[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in filled.values():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and pieces[0][0] == 0
        whole = sum(n for _, n in pieces)
        assert whole == 4096 or whole & (whole - 1) == 0


def test_any_tokenizer_gives_its_own_ids(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    other = path("byte_bpe_50k.json")
    texts = ["Don't  split\nthis, please!", "", "A a Ä b"]
    plain = Tokenizer.from_file(other)
    assert not packing.splits_like_words(plain) and packing.splits_like_words(Tokenizer.from_file(packing.default_tokenizer()))
    assert [x.tolist() for x in packing.ChunkEncoder(other).encode(texts)] == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_windows_hold_their_proportions():
    rng = random.Random(5)
    shares = {"a": 0.5, "b": 0.3, None: 0.2}
    filler, taken, filled = packing.WindowFiller(dict(shares), lambda k: k, 100), collections.Counter(), 0
    for d in range(3000):
        filler.add(rng.choice(list(shares)), d, np.arange(rng.randint(1, 30), dtype=np.uint32), 0, 30)
    while min(filler.queued.values()) >= 100:
        filler.fill(100)
        filled += 100
        pieces, filler.pieces = filler.pieces, []
        for p in pieces:
            taken[p[1]] += p[3]
        assert sum(p[3] for p in pieces) == 100
        for s, share in shares.items():  # what a source is owed or ahead never exceeds a token per source
            assert abs(taken[s] - share * filled) <= len(shares) and abs(share * filled - taken[s] - filler.credit[s]) < 1e-6
    assert filled > 10_000
    # A source that runs dry is owed its share, the others fill the windows.
    dry = packing.WindowFiller({"a": 0.5, "b": 0.5}, lambda k: k, 100)
    dry.add("b", 1, np.arange(1000, dtype=np.uint32), 0, 1000)
    dry.fill(100)
    assert dry.credit == {"a": 50.0, "b": -50.0}
    dry.add("a", 2, np.arange(1000, dtype=np.uint32), 0, 1000)
    dry.fill(100)
    assert dry.credit == {"a": 0.0, "b": 0.0}


def test_sources_beyond_the_bound_are_grouped(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_SOURCES", 3)
    df = spark.createDataFrame([(i, f"text {i}", f"s{i % 10}") for i in range(50)], "doc_id long, text string, source string")
    assert packing.bounded_sources(df).select("source").distinct().count() <= 3
    assert sum(r.length for r in packing.pack_documents(df, window=16).collect()) == sum(r.length for r in packing.pack_documents(df, window=16, shares={f"s{k}": 0.1 for k in range(10)}).collect())


def test_op9_shards_every_row(spark, folder):
    got = queries.op9_shards(spark, folder).collect()
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in awkward())
    assert counted(got, "doc_id", "size", "text_crc32") == want
    slots, of = collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        of[r["size"], r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of.values()) and {r.law for r in got} == {"bytes"}


def test_differencing_by_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        shards = rng.randint(2, 5)
        sizes = sorted((rng.randint(1, 50) for _ in range(rng.randint(1, 14))), reverse=True)
        nodes = {i: [(x, [i])] + [(0, [])] * (shards - 1) for i, x in enumerate(sizes)}
        while len(nodes) > 1:
            a, b = sorted(nodes, key=lambda k: (nodes[k][-1][0] - nodes[k][0][0], k))[:2]
            x, y = nodes.pop(a), nodes.pop(b)
            both = [(p + q, m + n) for (p, m), (q, n) in zip(x, reversed(y), strict=True)]
            nodes[max([*nodes, a, b, len(sizes) - 1]) + 1] = sorted(both, key=lambda t: -t[0])
        (want,) = nodes.values()
        sums, places = sharding.difference([[x] + [0] * (shards - 1) for x in sizes], shards)
        assert sums == [p for p, _ in want]
        parts = collections.defaultdict(set)
        for i, at in enumerate(places[:, 0]):
            parts[int(at)].add(i)
        assert all(sum(sizes[i] for i in parts[k]) == sums[k] for k in range(shards))


def test_op10_scores_every_row(spark, folder):
    got = queries.op10_quality_field(spark, folder).collect()
    assert counted(got, "doc_id") == collections.Counter((d,) for d, *_ in awkward())
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_the_field_climbs_its_likelihood():
    rng = np.random.default_rng(3)
    lines, labels = np.array([3, 1, 4, 2, 5, 1]), np.array([1, 0, 1, 0, 1, 0])
    truth = np.repeat(labels, lines)
    x = np.concatenate([rng.normal(size=(lines.sum(), 3)) + truth[:, None], np.ones((lines.sum(), 1))], axis=1)

    def likelihood(field):
        _, _, z = field.marginals(x, lines)
        emit = ((x - field.mean) / field.scale) @ field.weights
        return (emit[truth == 1].sum() + sum(field.ties[k, k] * (n - 1) for k, n in zip(labels, lines, strict=True)) - z) / len(x)

    fitted = quality.fit_field(x, lines, labels, steps=400)
    best = likelihood(fitted) - 0.5e-4 * (fitted.weights**2).sum() - 0.01 * (fitted.ties**2).sum()
    assert best > likelihood(quality.LineField(np.zeros(4), np.zeros((2, 2)), fitted.mean, fitted.scale)) + 0.3
    for i in range(4):  # no step away from it is better
        for by in (0.05, -0.05):
            moved = quality.LineField(fitted.weights.copy(), fitted.ties, fitted.mean, fitted.scale)
            moved.weights[i] += by
            assert likelihood(moved) - 0.5e-4 * (moved.weights**2).sum() - 0.01 * (moved.ties**2).sum() < best + 1e-4


def test_the_fit_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    rows = [(i, "text of some length " * 20 + str(i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit_field", lambda x, lines, said: seen.append(len(lines)))
    for most, size in ((4000, 1 << 26), (10, 1 << 26), (4000, 2000), (4000, 10)):
        quality.fit_quality(docs, labels, rows=most, size=size)
    assert 40 < seen[0] < 60 and seen[1] == 10 and seen[2] == 4 and len(seen) == 3
