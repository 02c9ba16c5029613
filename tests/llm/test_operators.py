"""The operators for corpora against brute force on a small fixture with awkward rows."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest

from scanledger.llm import html_text, line_dedup, media, mixing, ngram_join, packing, quality, repeats, sharding, sketches, suffix_array

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice(["th", "an", "er", "on", "ré", "ß", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = "\n".join(say(30) for _ in range(4))
    passage = say(70)
    out = [base, base, base.replace("th", "TH", 1), base + " tail", None, "", " ", "a", "one two three", "one two three", "one two three four"]
    out += [say(20) + "\n" + passage + "\n" + say(20) for _ in range(4)]
    out += ["\n".join(["Share this boilerplate line with everyone.", say(25), "Page 1 of this long report here", say(8)]), "\n".join(["Share this boilerplate line with everyone!", say(25), "Page 2 of this long report here"])]
    out += ["x" * 3000, "ab" * 2000, say(4000), "!!! ???\n" * 5]
    for _ in range(12):
        w = base.split(" ")
        w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", [None, "a", "b", "b", "b"][i % 5], len(t or "")) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "'clash' as TAKEN", "1 as hits", "2 as label", "'z' as _word").repartition(3), {r[0]: r for r in rows}


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_media_round_trip_and_sniffing(spark, docs, none):
    df, rows = docs
    got = media.media_features(media.store_texts(df)).collect()
    for r in got:
        b = (rows[r.doc_id][1] or "").encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_type) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), "image/png")
    assert len(got) == len(rows) and media.media_features(media.store_texts(none)).count() == 0
    png = media.encode_rgb(b"q" * 192)
    bad = bytearray(png)
    bad[40] ^= 1
    odd = spark.createDataFrame([(1, b"junk" + png + b"BM tail", "image/gif"), (2, png, "image/gif"), (3, None, "a/b"), (4, b"", None), (5, bytes(bad), "image/png")], "id int, media binary, declared string")
    found = collections.defaultdict(list)
    for r in media.sniff_media(odd, "id", "media", "declared").collect():
        found[r.id].append((r.item, r.media_type, r.corrected, r.start, r.length))
    assert found[1] == [(0, media.UNKNOWN, True, 0, len(png) + 11), (1, "image/png", False, 4, len(png))]
    assert found[2] == [(0, "image/png", True, 0, len(png))] and found[3][0][1] is None and found[4][0][1] == found[5][0][1] == media.UNKNOWN


def test_mix_meets_targets(docs, none):
    df, rows = docs
    got = mixing.mix_documents(df).collect()
    size = {d: len(WORD.findall(r[1] or "")) for d, r in rows.items()}
    assert {r.doc_id: r["size"] for r in got} == size and len(got) == len(rows)
    by = collections.Counter()
    for d, r in rows.items():
        by[r[3]] += size[d]
    order = [*sorted(s for s in by if s), None]
    weight, most, total = {s: i % 3 + 1 for i, s in enumerate(order)}, {s: 3 * by[s] for s in by}, sum(by.values())
    full = set()
    while True:
        level = (total - sum(most[s] for s in full)) / sum(weight[s] for s in by if s not in full)
        over = {s for s in by if s not in full and level * weight[s] > most[s]}
        if not over:
            break
        full |= over
    for r in got:
        s = rows[r.doc_id][3]
        assert abs(r.target - (most[s] if s in full else level * weight[s])) < 1e-6 and r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"]
    taken = collections.Counter()
    for r in got:
        taken[rows[r.doc_id][3]] += r.taken
    for r in got:
        s = rows[r.doc_id][3]
        assert taken[s] <= r.target + 1 and taken[s] >= r.target - max(size[d] for d in rows if rows[d][3] == s)
    assert sorted(map(tuple, mixing.mix_documents(df.repartition(5)).select("doc_id", "taken").collect())) == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.mix_documents(none).count() == 0
    twice = mixing.mix_documents(df.union(df))
    assert twice.count() == 2 * len(rows)


def test_pareto_sample_by_brute_force(spark, docs):
    df, rows = docs
    odd = [(1000 + k, "w " * (k % 40 + 1) + str(k), "en", "big" if k % 3 else "c", 0) for k in range(400)] + [(None, "no id at all", "en", "big", 0)] * 2 + [(7, "again", "en", "c", 0)] * 3
    sized = mixing.sized_documents(df.select("doc_id", "text", "source").union(spark.createDataFrame(odd, DOCS).select("doc_id", "text", "source")))
    targets = mixing.source_targets(sized)
    ranked = mixing.ranked_documents(sized, targets).collect()
    got = {(r.doc_id, r.source, r["size"], r.copy_no): r.copies for r in mixing.pareto_mix(sized, targets).collect()}
    assert len(got) == len(ranked) == len(rows) + len(odd) and any(k[0] is None for k in got)
    unequal = 0
    for source in {r.source for r in ranked}:
        mine = [r for r in ranked if r.source == source]
        target = mine[0].target
        expected = sum(r["size"] * (r.whole + r.p) for r in mine)
        assert abs(expected - target) < 1e-6 * max(target, 1) and all(0 <= r.p < 1 and 0 < r.u < 1 and r.whole + r.p <= mixing.MOST_COPIES + 1e-9 for r in mine)
        unequal += len({round(r.whole + r.p, 9) for r in mine}) > 1
        want = {(r.doc_id, source, r["size"], r.copy_no): r.whole for r in mine}
        room = target - sum(r["size"] * r.whole for r in mine)
        open_ = sorted((r for r in mine if r.p > 0 and r["size"]), key=lambda r: (r.u / (1 - r.u)) / (r.p / (1 - r.p)))
        for n, r in enumerate(open_):
            if r["size"] > room:
                fits = [x for x in open_[n:] if x["size"] <= room]
                if fits:
                    r = max(fits, key=lambda x: (x["size"], -x.rank))
                    want[r.doc_id, source, r["size"], r.copy_no] += 1
                break
            room -= r["size"]
            want[r.doc_id, source, r["size"], r.copy_no] += 1
        assert {k: v for k, v in got.items() if k[1] == source} == want
    assert unequal >= 2


def test_mix_of_given_weights_and_of_sources_without_words(spark):
    empty = spark.createDataFrame([(1, "", "en", "y", 0), (2, None, "en", "y", 0)], DOCS)
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in mixing.mix_documents(empty).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    both = empty.union(spark.createDataFrame([(3, "a b c", "en", "x", 0)], DOCS))
    assert sorted((r.doc_id, r.taken) for r in mixing.mix_documents(both).collect()) == [(1, 0), (2, 0), (3, 3)]
    sized = spark.createDataFrame([(k, "s", 10, 0, [0.0, 1.0, 4.0, None][k % 4]) for k in range(400)], "doc_id long, source string, size long, copy_no int, weight double")
    targets = spark.createDataFrame([("s", 4000, 2000.0)], "source string, source_size long, target double")
    got = collections.defaultdict(list)
    for r in mixing.ranked_documents(sized, targets).collect():
        got[r.doc_id % 4].append(r.whole + r.p)
    assert set(got[0]) == set(got[3]) == {0.0} and {round(x, 6) for x in got[1]} == {0.4} and {round(x, 6) for x in got[2]} == {1.6}
    assert sum(r.copies * 10 for r in mixing.pareto_mix(sized, targets).collect()) == 2000


def test_html_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body><nav><ul><li>menu</li></ul></nav>
    <header class="top">Head</header><div class="cookie-notice">We use cookies</div><aside>side</aside><article><h1>Big  &amp; bold</h1><p>One<b> two</b>&nbsp;three<p>Short</p>
    <div class="ad">Buy</div><form><input>Send</form><p>Four &lt;five&gt;</p></article><section id="comments"><p>First!</p></section><footer>&copy; me</footer></body></html>"""
    assert html_text.main_text(page) == "Big & bold\nOne two three\nShort\nFour <five>"
    plain = "<body><div><a href=x>Home</a> <a href=y>News</a></div>" + "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(3)) + "<div>(c)</div></body>"
    assert html_text.main_text(plain).count("\n") >= 2 and "Home" not in html_text.main_text(plain)
    assert html_text.main_text("") == "" and html_text.main_text("<nav>only</nav>") == "" and html_text.main_text("just text") == "just text"
    assert html_text.main_text("<article><p>cut of") == "cut of" and html.unescape("&amp;") == "&"


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>é</p>"), (2, None, None), (2, None, None)], "page_id long, url string, html string").selectExpr("*", "'c' as TEXT")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract_text(df).collect()) == [(1, "é", 1), (2, "", 0), (2, "", 0)]


def words(t):
    return WORD.findall(t or "")


def shingles(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_sketches(docs, none):
    df, rows = docs
    found = sketches.fingerprint_documents(df)
    got = {r.doc_id: r for r in found.withColumn("f", sketches.as_string("sketch")).withColumn("near", sketches.likeness("sketch", "edited_sketch")).collect()}
    ids = sorted(rows)
    for d, e in zip(ids, ids[1:] + ids[:1], strict=True):
        t, u = rows[d][1] or "", rows[e][1] or ""
        assert got[d].edited == t[: len(t) - len(t) // 2] + u[: len(t) // 2] and got[d].n_chars == len(t)
        assert bool(got[d].sketch) == bool(words(t)) and got[d].sketch == sorted(set(got[d].sketch))
    assert got[0].f == got[3].f and got[12].f == got[15].f and len(got) == len(rows)
    long = max(rows, key=lambda d: len(words(rows[d][1])))
    assert abs(len(got[long].sketch) / len({tuple(words(rows[long][1])[i : i + 5]) for i in range(3996)}) - 1 / sketches.SCALE) < 0.03
    assert 0.4 < got[long].near < 0.6
    assert sketches.fingerprint_documents(none).count() == 0
    assert sketches.fingerprint_documents(df.where("doc_id = 0")).first().edited


def union_find(ids, links):
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {d: root(d) for d in ids}


def test_jaccard_components(docs, none):
    df, rows = docs
    sets = {d: shingles(r[1]) for d, r in rows.items()}
    links = [(a, b) for a in rows for b in rows if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = union_find(rows, links)
    got = ngram_join.jaccard_components(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(sets[d]), want[d]) for d in rows} and len(got) == len(rows)
    assert ngram_join.jaccard_components(none).count() == 0
    assert ngram_join.jaccard_components(df.union(df)).count() == 2 * len(rows)


def components_of(rows):
    sets = {d: shingles(t) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), c) for d, c in union_find(sets, links).items()}


@pytest.mark.parametrize("kept", [1, 1 << 16])
@pytest.mark.parametrize("partitions", [1, 4])
def test_members_of_a_prefix_group_meet(spark, monkeypatch, partitions, kept):
    monkeypatch.setattr(ngram_join, "KEPT_GROUPS", kept)
    rng, rows = random.Random(11), []
    for k in range(60):
        w = [f"t{k}w{rng.randrange(10**6)}" for _ in range(30)]
        rows += [(5 * k, " ".join(w[:24])), (5 * k + 1, " ".join(w[:22] + ["x1", "x2"])), (5 * k + 2, " ".join(w[:22] + ["x1", "y2"])), (5 * k + 3, " ".join(["z", *w[1:24]]))]
    for k in range(60):  # the leader shares 10 words with the others, those share 12
        w = [f"u{k}v{rng.randrange(10**6)}" for _ in range(20)]
        rows += [(1000 + 3 * k, " ".join(w[:10] + [f"a{k}", f"b{k}", f"c{k}"])), (1001 + 3 * k, " ".join([*w[:10], "d", "e", "f"])), (1002 + 3 * k, " ".join([*w[:10], "d", "e", "g"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions, "doc_id").sortWithinPartitions("doc_id")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()} == components_of(rows)


def test_jaccard_rows_that_share_an_id_or_have_none(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "ein zwei drei vier fuenf sechs")
    rows = [(1, a), (1, b), (2, b), (3, a), (4, c), (4, None), (None, a), (None, "nobody has this text at all here"), (5, "")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got if r.doc_id) == [(1, 2, 1), (1, 2, 1), (2, 3, 2), (3, 2, 1), (4, 0, 4), (4, 0, 4), (5, 0, 5)]
    assert sorted((r.n_shingles, r.component_id or -1) for r in got if r.doc_id is None) == [(2, 1), (3, -1)]


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_line_dedup(spark, docs, none):
    df, rows = docs
    first, places = {}, []
    for d in sorted(rows):
        for k, line in enumerate((rows[d][1] or "").split("\n") if rows[d][1] is not None else []):
            if len(line) >= line_dedup.SHORTEST:
                first.setdefault(line, (d, k))
                places.append((d, k, line))
    lines = [x for x in first if len(x) < 400]
    links = [(first[a], first[b]) for a in lines for b in lines if a < b and abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2]
    assert links
    root = union_find(first.values(), links)
    gone = collections.defaultdict(list)
    for d, k, line in places:
        if root[first[line]] != (d, k):
            gone[d].append(k)
    got = {r.doc_id: r.dropped for r in line_dedup.dedup_lines(df).collect()}
    assert got == dict(gone)
    left = line_dedup.without_lines(df, line_dedup.dedup_lines(df)).collect()
    for r in left:
        t = rows[r.doc_id][1]
        assert r.text == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[r.doc_id])) and r._gone == len(gone[r.doc_id])
    assert len(left) == len(rows) and line_dedup.dedup_lines(none).count() == 0


def test_banded_distance_by_bits(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(1, 9)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").where("b <> ''").selectExpr("a", "b", "split(a, '') as x", "split(b, '') as y")
    for k in (1, 2, 3):
        assert sorted((r.a, r.b) for r in line_dedup.within(df, "x", "y", k).collect()) == sorted((a, b) for a, b in pairs if b and edits(a, b) <= k)


def test_suffix_arrays():
    rng = np.random.default_rng(2)
    for trial in range(60):
        s = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 50)), 0).astype(np.int64)
        sa = suffix_array.suffix_array(s, int(s.max()) + 1)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        shared = suffix_array.permuted_common_prefixes(s, sa, 20)
        for a, b in zip(sa, sa[1:], strict=False):
            n = 0
            while n < 20 and max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert shared[b] == n


def test_repeats(docs, none):
    df, rows = docs
    seen, want = set(), {}
    for d in sorted(rows):
        b = (rows[d][1] or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                m[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        kept = bytes(x for x, k in zip(b, m, strict=True) if not k)
        want[d] = (len(b), sum(m), sum(1 for i in range(len(m)) if m[i] and not (i and m[i - 1])), hashlib.sha256(kept).hexdigest())
    got = repeats.remove_repeats(df).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len(got) == len(rows)
    assert repeats.remove_repeats(none).count() == 0


@pytest.mark.parametrize("shard", [1, 2000])
def test_repeats_of_anchors_that_fill_several_shards(docs, monkeypatch, shard):
    df, rows = docs
    want = {r.doc_id: tuple(r) for r in repeats.remove_repeats(df).collect()}
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    monkeypatch.setattr(repeats, "SLICE_BYTES", 1000)  # contexts are met again in later slices
    assert {r.doc_id: tuple(r) for r in repeats.remove_repeats(df.repartition(2)).collect()} == want


def test_repeats_of_rows_that_share_an_id(spark):
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b, c = say(260), say(269), say(120)
    rows = [(1, a), (1, a), (1, b), (2, "x" + c + b[50:200]), (3, c), (None, a), (4, None), (4, "")]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == [(0, 260, 0), (1, 260, 0), (1, 260, 0), (1, 269, 0), (2, 271, 150), (3, 120, 120), (4, 0, 0), (4, 0, 0)]


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    df, rows = docs
    plain = Tokenizer.from_file(packing.default_tokenizer())
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack_documents(df, window=256).collect():
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, row in rows.items():
        ids = np.array([*plain.encode(row[1] or "", add_special_tokens=False).ids, 2], np.uint32)
        at = 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 256 or at & (at - 1) == 0 and at < 256
    assert packing.pack_documents(none).count() == 0


def test_chunk_encoder_equals_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHED_CHUNKS", 40)
    monkeypatch.setattr(packing, "CACHED_PARTS", 30)
    own, plain, rng = packing.ChunkEncoder(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer()), random.Random(1)
    letters = "aAbzZéÉßΣσςİıǅáñ１²½x'sS'tT.,!-_#<|>@ \n\t\r\x0b\x1c\x85\xa0  ​中文🙂"
    for _ in range(80):
        many = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(5)] + ["<|endoftext|> don't I'll WE'VE ΑΣ ΑΣ. word''s"]
        for t, ids in zip(many, own.encode(many), strict=True):
            assert ids.tolist() == [*plain.encode(t, add_special_tokens=False).ids, 2], t


def test_shards_are_even_and_keep_copies_together(docs, none):
    df, rows = docs
    got = sharding.shard_by_bytes(df, shards=4).collect()
    of, slots, size = collections.defaultdict(set), collections.defaultdict(list), collections.Counter()
    for r in got:
        t = rows[r.doc_id][1] or ""
        assert r["size"] == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
        of[t].add(r.shard)
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
    assert len(got) == len(rows) and all(len(s) == 1 for s in of.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_by_bytes(none).count() == 0
    sums, places = sharding.difference([[x, 0] for x in (8, 7, 6, 5, 4)], 2)
    assert sums == [16, 14] and sum(x for x, p in zip((8, 7, 6, 5, 4), places[:, 0], strict=True) if p == 0) == 16


def test_line_field(spark, none):
    rng = random.Random(4)
    good = lambda: "\n".join(" ".join(rng.choice(["plain", "words", "of", "prose"]) for _ in range(12)) + "." for _ in range(rng.randint(1, 5)))
    bad = lambda: "\n".join(" ".join(rng.choice(["BUY", "NOW", "$$$"]) + "!!" for _ in range(12)) for _ in range(rng.randint(1, 5)))
    rows = [(i, good() if i % 2 else bad(), "en", "s", 0) for i in range(120)] + [(500, None, "en", "s", 0), (501, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify_quality(df, labels).collect()}
    assert len(got) == 122 and all(0 <= r.score <= 1 for r in got.values()) and got[500].score == got[501].score
    assert all(got[i].predicted == i % 2 and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(120))
    assert quality.classify_quality(none, labels).count() == 0
    assert {round(r.score, 9) for r in quality.classify_quality(df, labels.where("doc_id < 0")).collect()} == {0.5}
    kept = quality.keep_good(df, quality.fit_quality(df, labels)).select("doc_id").collect()
    assert {r.doc_id for r in kept if r.doc_id < 120} == set(range(1, 120, 2))


def test_forward_backward_by_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 3))
    field = quality.LineField(rng.normal(size=3), rng.normal(size=(2, 2)), np.zeros(3), np.ones(3))
    good, pairs, z = field.marginals(x, np.array([3, 2]))
    emit, want, total = x @ field.weights, np.zeros(5), 0.0
    for a, n in ((0, 3), (3, 2)):
        weights = {}
        for y in itertools.product((0, 1), repeat=n):
            weights[y] = np.exp(sum(emit[a + k] * y[k] for k in range(n)) + sum(field.ties[y[k], y[k + 1]] for k in range(n - 1)))
        s = sum(weights.values())
        total += np.log(s)
        for k in range(n):
            want[a + k] = sum(w for y, w in weights.items() if y[k]) / s
    assert np.allclose(good, want) and np.isclose(z, total) and np.isclose(pairs.sum(), 3)
