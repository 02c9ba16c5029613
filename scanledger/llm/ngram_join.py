"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

1.  Shingles are counted in a fixed number of hash bins; those in crowded bins come last in the order of all shingles.
2.  Documents with the same set form one class, whose smallest id stands for it.  A document's prefix are the first
    n - ceil(t n) + 1 shingles of its set in that order; two documents that link share a shingle of their prefixes.
    Within a task, documents with identical prefixes and size are sent on once, as a group.
3.  In each prefix shingle's bucket every document meets one pivot of like size; with the pivot it meets in most buckets
    it is verified on whole texts, and linked documents are joined to components.  Only documents of different
    components that still share a bucket are paired with each other, expanded and verified.  Links within one component
    can't change it, so large groups of near copies cost a pair per member and not per pair of members.
4.  Before texts are fetched, a pair's sizes, the positions of its shared shingle and its parity sketches must allow the
    overlap.  A parity sketch has bits that are each flipped by the shingles that hash to it, ``PARITY`` of them or 8 or 64
    times as many for larger sets: two sketches differ in at most as many bits as the sets differ in shingles, which is at
    most (1 - t) / (1 + t) of the sum of their sizes.

Defined results: a null or wordless text has an empty set and stays alone; a text with fewer words than a shingle has
the whole sequence as its one shingle; repeated rows are copies; rows with the same doc_id are one document, whose text is
the smallest of theirs by bytes; rows without a doc_id have the component of the documents with the same set, null where there are none; ties do not arise (ids decide);
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, may_hold, pick, settle, sliced, without
from .words import SHINGLE, shingle_set

BINS = 1 << 18
PERCENT = 80
PARITY = 1024
#: Bytes of texts that are cut into shingles together.
SLICE_BYTES = 2 << 20
#: Groups that a task keeps in mind at once.
KEPT_GROUPS = 1 << 16


def _classes(rows: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, sig, parity of each row, and at the end of each task the counts of its shingles by bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS, np.int64)
        names = ["doc_id", "n_shingles", "sig", "parity", "bin", "hits"]
        kind = None
        for batch in sliced(batches, column=1, size=SLICE_BYTES):
            kind = batch.column(0).type
            sizes, sigs, places, parity = [], [], [np.zeros(0, np.uint64)], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text or b"", n=n)
                sizes.append(len(found))
                sigs.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                places.append(found)
                bits = PARITY if len(found) <= PARITY else 8 * PARITY if len(found) <= 8 * PARITY else 64 * PARITY
                parity.append(np.packbits((np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes())
            counts += np.bincount((np.concatenate(places) >> np.uint64(45)).astype(np.int64), minlength=BINS)
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(parity, pa.binary()), none, none], names=names)
        used = np.flatnonzero(counts)
        if kind is not None and len(used):
            m = len(used)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=names)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_shingles long, sig binary, parity binary, bin long, hits long")


def crowded_bins(counts: DataFrame) -> np.ndarray:
    """Which of the bins hold far more shingles than the mean bin (``BINS`` bits come to the driver, at any size)."""
    sums = counts.groupBy("bin").agg(F.sum("hits").alias("hits"))
    total = sums.agg(F.sum("hits")).first()[0] or 0
    mean = total / BINS
    full = np.zeros(BINS, bool)
    full[[r[0] for r in sums.where(F.col("hits") > mean + 8 * mean**0.5 + 64).select("bin").collect()]] = True
    return full


def _prefixes(rows: DataFrame, crowded: np.ndarray, n: int, percent: int) -> DataFrame:
    """token, doc_id, n, pos of each shingle in a document's prefix.

    Within a task, documents of one prefix and size form a group: only its first document is sent with its tokens, the
    others as one row each (token null, member set).  Copies of a whole set are sent once.
    """
    packed = np.packbits(crowded).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(np.uint64) << np.uint64(63)
        seen: set[bytes] = set()
        leaders: dict[bytes, object] = {}
        for batch in sliced(batches, column=1, size=SLICE_BYTES):
            at, tokens, members = [], [], []
            ids = batch.column(0)
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = shingle_set(text or b"", n=n)
                if not len(found):
                    continue
                keys = np.sort(found | full[(found >> np.uint64(45)).astype(np.int64)])
                keys = keys[: len(found) - -(-percent * len(found) // 100) + 1] & np.uint64((1 << 63) - 1)
                whole = hashlib.blake2b(found.tobytes(), digest_size=12).digest()
                if whole in seen:
                    continue
                seen.add(whole)
                group = hashlib.blake2b(keys.tobytes(), digest_size=12, salt=len(found).to_bytes(8, "big")).digest()
                if group in leaders:
                    members.append((leaders[group], ids[i].as_py(), len(found)))
                    continue
                if len(leaders) >= KEPT_GROUPS:  # what comes after forms groups of its own
                    leaders.clear()
                    seen.clear()
                leaders[group] = ids[i].as_py()
                at.append((i, len(found), len(keys)))
                tokens.append(keys)
            names = ["token", "doc_id", "n", "pos", "member"]
            if at:
                i, size, m = np.array(at).T
                where = np.repeat(np.arange(len(m)), m)
                pos = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).astype(np.int64)), ids.take(pa.array(i[where])), pa.array(size[where].astype(np.int32)), pa.array(pos.astype(np.int32)), pa.nulls(len(pos), ids.type)], names=names)
            if members:
                leader, member, size = zip(*members, strict=True)
                none = len(member)
                yield pa.RecordBatch.from_arrays([pa.nulls(none, pa.int64()), pa.array(leader, ids.type), pa.array(size, pa.int32()), pa.nulls(none, pa.int32()), pa.array(member, ids.type)], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"token long, doc_id {kind}, n int, pos int, member {kind}")


def _alike(pairs: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sizes and parity sketches allow a link."""
    x, y = (parities.select(F.col("doc_id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("parity").alias(f"p_{s}")) for s in "ab")
    fits = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            good = []
            for m, n, p, q in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                p, q = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
                size = min(len(p), len(q))  # a longer sketch folds onto a shorter one
                p, q = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (p, q))
                good.append((100 + percent) * int(np.bitwise_count(p ^ q).sum()) <= (100 - percent) * (m + n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(x, "a").join(y, "b").where(fits).select("a", "b", "n_a", "n_b", "p_a", "p_b")
    return joined.mapInArrow(run, pairs.select("a", "b").schema)


def _verified(pairs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole texts link."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = settle(may_hold(rows, "doc_id", ids).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    joined = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = lru_cache(128)(lambda text: shingle_set(text, n=n))
        for batch in sliced(batches, rows=256):
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = cached(x or b""), cached(y or b"")
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                good.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def _one_text_each(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text) with the smallest of its texts for every doc_id that has several."""
    hashed = rows.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("hash")).groupBy("doc_id").agg(F.min("hash").alias("a"), F.max("hash").alias("z"))
    several = settle(hashed.where("a <> z").select("doc_id"))
    if not several.limit(1).count():
        return rows
    held = may_hold(rows, "doc_id", several)
    chosen = held.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(b""))).alias("chosen"))
    return without(rows, "doc_id", several).unionByName(held.join(chosen, "doc_id", "left").select("doc_id", F.coalesce("chosen", "text").alias("text")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; component_id is the smallest doc_id reachable by links."""
    rows = _one_text_each(pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.encode("text", "UTF-8")))
    first = settle(_classes(rows, n))
    crowded = crowded_bins(first.where("bin is not null"))
    known = first.where("bin is null").select("doc_id", "n_shingles", "sig")
    classes = known.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    classes = settle(known.join(classes, "sig", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")))
    copies = classes.where("rep <> doc_id").select("doc_id", "rep").distinct()

    # Buckets of one document are dropped at once; what is left is small.  Rows of members (token null) stay apart: their
    # leader spreads them over the buckets' partitions.
    sent = _prefixes(rows.where("doc_id is not null"), crowded, n, percent).withColumn("bucket", F.coalesce("token", F.xxhash64("member")))
    shared = F.expr("count(token) over (partition by bucket) > 1 or token is null")
    renamed = copies.select(F.col("doc_id").alias("member"), F.col("rep").alias("member_rep"))
    sent = sent.withColumn("shared", shared).where("shared").join(copies, "doc_id", "left").join(renamed, "member", "left")
    sent = settle(sent.select("token", F.coalesce("rep", "doc_id").alias("doc_id"), "n", "pos", F.coalesce("member_rep", "member").alias("member")).distinct())
    buckets = sent.where("token is not null").drop("member")
    members = sent.where("token is null and member <> doc_id").select("doc_id", "member", "n").distinct()

    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    binned = buckets.withColumn("bin", size_class)
    pivots = binned.groupBy("token", "bin").agg(F.min("doc_id").alias("pivot"))
    stars = binned.join(pivots, ["token", "bin"]).where("doc_id <> pivot").groupBy("doc_id", "pivot").agg(F.count("*").alias("hits"))
    stars = stars.groupBy("doc_id").agg(F.max_by("pivot", F.struct("hits", -F.col("pivot"))).alias("pivot"))
    parities = settle(first.where("sig is not null").select("doc_id", "n_shingles", "parity").dropDuplicates(["doc_id"]))
    stars = settle(_alike(stars.select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).union(members.select("member", "doc_id")).distinct(), parities, percent))
    links = settle(_verified(stars, rows, n, percent))
    labels = components(links)

    # A group's members stand in all buckets of its leader that others share, and with it in a bucket of their own (below 0).
    own = F.xxhash64("doc_id").bitwiseOR(F.lit(-(1 << 63)))
    grouped = members.select(own.alias("token"), F.explode(F.array("doc_id", "member")).alias("doc_id"), "n", F.lit(0).alias("pos"))
    expanded = buckets.union(buckets.join(members.drop("n"), "doc_id").select("token", F.col("member").alias("doc_id"), "n", "pos")).union(grouped).distinct()
    marked = expanded.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    mixed = marked.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    marked = settle(marked.join(mixed, "token", "left_semi"))
    x, y = (marked.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "pos", "label")]) for s in "xy")
    fits = F.expr(
        f"doc_id_x < doc_id_y and label_x <> label_y and 100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)"
        f" and {100 + percent} * least(n_x - pos_x, n_y - pos_y) >= {percent} * (n_x + n_y)"
    )
    rest = x.join(y, "token").where(fits).select(F.col("doc_id_x").alias("a"), F.col("doc_id_y").alias("b")).distinct()
    rest = settle(_alike(rest, parities, percent).join(stars, ["a", "b"], "left_anti").join(stars.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"))
    more = settle(_verified(rest, rows, n, percent))
    labels = components(links.union(more))
    return classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
