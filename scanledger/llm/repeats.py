"""Suffix-array dedup: bytes covered by strings of ``LENGTH`` bytes that also start earlier.

1.  Every window of ``LENGTH`` bytes is assigned to its anchor, the k-gram in it with the smallest hash, which depends on
    the window's bytes alone: equal windows have equal anchors.  Neighbouring windows of one anchor form a run.
2.  Runs are gathered by anchor.  Runs of anchors that occur once are done.  Runs with equal contexts (all their windows)
    collapse to the first, the others repeat it as they stand; within a slice of documents, and for contexts that are frequent
    within a task, this is settled before the shuffle.
3.  The different contexts of an anchor are dealt to shards of about ``SHARD_BYTES`` by anchor; a shard sorts its suffixes
    by induced sorting, takes permuted common prefixes, and in every stretch of suffixes that share ``LENGTH`` bytes keeps
    the earliest start.  An anchor whose contexts fill more than one shard is dealt to several; of each stretch in one of
    those, the first window is ranked across the shards by its digest.
4.  The spans found are merged per document and cut from its bytes.

Defined results: a null text counts as empty; texts shorter than ``LENGTH`` bytes lose nothing; rows with the same doc_id
and text count as one document, and rows with the same doc_id but other texts as documents of their own, in the order of
their texts' hashes; the smaller start wins ties within one; rows without a doc_id have no place in the order: they lose
nothing and cost others nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import may_hold, pick, settle, sliced, without
from .suffix_array import permuted_common_prefixes, suffix_array
from .words import _powers, mixed

LENGTH = 100
GRAM = 24
SHARD_BYTES = 1 << 18
#: Contexts that a task keeps in mind.
KEPT_CONTEXTS = 1 << 16
#: Bytes of texts whose runs are found together.
SLICE_BYTES = 4 << 20
_SEGMENT = 1 << 19
#: A place is the number of a document among those of its id, and below these bits the start in it.
_START_BITS = 40
_START = (1 << _START_BITS) - 1


def _digests(b: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int, sums: np.ndarray) -> np.ndarray:
    _, down = _powers(len(b) + 1)
    return mixed((sums[starts + lengths] - sums[starts]) * down[starts] + np.asarray(lengths).astype(np.uint64))


def _sums(b: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return sums


def anchor_runs(b: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor digest, context digest, first start and number of starts of each run of windows of ``b``."""
    n = len(b) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    wide = length - gram + 1
    parts = []
    for at in range(0, n, _SEGMENT):  # positions must fit into 20 bits beside the digests
        piece = b[at : min(at + _SEGMENT + length - 1, len(b))]
        sums = _sums(piece)
        m = len(piece) - length + 1
        grams = _digests(piece, np.arange(len(piece) - gram + 1), gram, sums)
        best = (grams & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while size * 2 <= wide:
            best = np.minimum(best[: len(best) - size], best[size:])
            size *= 2
        best = np.minimum(best[:m], best[wide - size : wide - size + m])
        anchor = (best & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        count = np.diff(np.append(first, m))
        where = anchor[first]
        context = _digests(piece, first, count + (length - 1), sums) + mixed((where - first).astype(np.uint64))
        parts.append((grams[where], context, first + at, count))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint union of intervals of one document, touching ones joined."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _told_apart(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text in bytes; the different texts of ids that have several: doc_id, hash, sub)."""
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    hashes = rows.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"))
    several = hashes.groupBy("doc_id").agg(F.min("hash").alias("a"), F.max("hash").alias("z")).where("a <> z").select("doc_id")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("hash")) - 1
    return rows, settle(hashes.join(several, "doc_id", "left_semi").distinct().withColumn("sub", nth))


def _with_sub(rows: DataFrame, several: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text, ...) with sub, 0 where an id has one text."""
    if not several.limit(1).count():
        return rows.withColumn("sub", F.lit(0))
    held = several.select("doc_id").distinct()
    told = may_hold(rows, "doc_id", held).withColumn("hash", F.xxhash64("text")).join(several, ["doc_id", "hash"], "left").withColumn("sub", F.coalesce("sub", F.lit(0)))
    return without(rows, "doc_id", held).withColumn("sub", F.lit(0)).unionByName(told.drop("hash"))


class _Often:
    """Contexts that occurred more than once in a slice, with their earliest run so far: at most ``KEPT_CONTEXTS`` of a task."""

    def __init__(self) -> None:
        self.code = self.key = self.context = np.zeros(0, np.uint64)
        self.doc = self.place = np.zeros(0, np.int64)

    def repeats(self, key: np.ndarray, context: np.ndarray, doc: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which of a slice's first runs repeat an earlier one of a former slice; ``size`` is how many runs of its context the slice has."""
        code = mixed(key + context * np.uint64(3))
        at = np.minimum(np.searchsorted(self.code, code), max(len(self.code) - 1, 0))
        known = np.zeros(len(code), bool)
        if len(self.code):
            known = (self.code[at] == code) & (self.key[at] == key) & (self.context[at] == context)
        later = known.copy()
        at = at[known]
        later[known] = (doc[known] > self.doc[at]) | (doc[known] == self.doc[at]) & (place[known] > self.place[at])
        sooner = known & ~later
        at = np.searchsorted(self.code, code[sooner])
        self.doc[at], self.place[at] = doc[sooner], place[sooner]
        new = np.flatnonzero(~known & (size > 1))[: max(KEPT_CONTEXTS - len(self.code), 0)]
        if len(new):
            code = np.append(self.code, code[new])
            order = np.argsort(code, kind="stable")
            self.code = code[order]
            self.key, self.context, self.doc, self.place = (np.append(a, b[new])[order] for a, b in ((self.key, key), (self.context, context), (self.doc, doc), (self.place, place)))
        return later


def _runs(rows: DataFrame, length: int) -> DataFrame:
    """key, context, doc_id, place, count: the first run of each context in its slice, and with null context the spans
    (place, count in bytes) of those that are repeats of one in the slice, or of one that a former slice of the task had often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = _Often()
        for batch in sliced(batches, column=1, size=SLICE_BYTES):
            docs, subs, parts = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).to_pylist(), []
            for d, text, sub in zip(docs, batch.column(1), subs, strict=True):
                key, context, start, count = anchor_runs(np.frombuffer(text.as_buffer() or b"", np.uint8), length)
                if len(key):
                    parts.append((key, context, start + (sub << _START_BITS), count.astype(np.int32), np.full(len(key), d, np.int64)))
            if not parts:
                continue
            key, context, place, count, doc = (np.concatenate(p) for p in zip(*parts, strict=True))
            del parts
            order = np.lexsort((place, doc, context, key))
            key, context, place, count, doc = (a[order] for a in (key, context, place, count, doc))
            head = np.append(True, (key[1:] != key[:-1]) | (context[1:] != context[:-1]))
            lead = np.flatnonzero(head)[np.cumsum(head) - 1]
            later = ~head & ((doc != doc[lead]) | (place != place[lead]))
            first = np.flatnonzero(head)
            again = first[often.repeats(key[first], context[first], doc[first], place[first], np.diff(np.append(first, len(head))))]
            later[again], head[again] = True, False
            spans = []
            if later.any():
                d, s, e = doc[later], place[later], place[later] + count[later] + (length - 1)
                by = np.argsort(d, kind="stable")
                d, s, e = d[by], s[by], e[by]
                cut = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                for x, y in zip(cut, np.append(cut[1:], len(d)), strict=True):
                    s2, e2 = _merged(s[x:y], e[x:y])
                    spans.append((np.full(len(s2), d[x]), s2, e2 - s2))
            names = ["key", "context", "doc_id", "place", "count"]
            yield pa.RecordBatch.from_arrays([pa.array(key[head].view(np.int64)), pa.array(context[head].view(np.int64)), pa.array(doc[head]), pa.array(place[head]), pa.array(count[head])], names=names)
            if spans:
                d, s, n = (np.concatenate(p) for p in zip(*spans, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(mixed((d * 4099 + s).astype(np.uint64)).view(np.int64)), pa.nulls(len(d), pa.int64()), pa.array(d), pa.array(s), pa.array(n.astype(np.int32))], names=names)

    return rows.mapInArrow(run, "key long, context long, doc_id long, place long, count int")


def _edges(rows: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """key, part, parts, doc_id, place, body: the contexts of ``edges`` (doc_id, sub, runs: key, part, parts, place, count), cut from the texts."""
    joined = may_hold(rows, "doc_id", edges.select("doc_id")).dropDuplicates(["doc_id", "sub"]).join(edges, ["doc_id", "sub"]).select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column=1, size=SLICE_BYTES):
            out = []
            for d, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for r in runs:
                    start = r["place"] & _START
                    out.append((r["key"], r["part"], r["parts"], d, r["place"], text[start : start + r["count"] + length - 1]))
            if out:
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["key", "part", "parts", "doc_id", "place", "body"])

    return joined.mapInArrow(run, "key long, part int, parts int, doc_id long, place long, body binary")


def ranked_windows(bodies: list[bytes], docs: np.ndarray, places: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(number of the context, offset in it, doc, place, whether it is the first of its kind) of all windows of ``bodies``.

    Of equal windows the earliest in (doc, place) is the first; windows at the same doc and place are one.
    """
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    s = np.zeros(int(sizes.sum()) + len(bodies) + 1, np.int32)
    begins = np.cumsum(sizes + 1) - sizes - 1
    s[:-1] = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int32) + 2
    s[begins + sizes] = 1
    sa = suffix_array(s, 258)
    shared = permuted_common_prefixes(s, sa, length)
    of = np.repeat(np.arange(len(bodies)), sizes + 1)
    offset = np.arange(len(of)) - begins[of]
    whole = np.append(offset + length <= sizes[of], False)
    ranked = sa[whole[sa]]
    group = np.cumsum(np.append(True, shared[ranked[1:]] < length))
    of, offset = of[ranked], offset[ranked]
    doc, place = docs[of], places[of] + offset
    order = np.lexsort((place, doc, group))
    of, offset, doc, place, group = (x[order] for x in (of, offset, doc, place, group))
    head = np.append(True, group[1:] != group[:-1])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    return of, offset, doc, place, (doc == doc[lead]) & (place == place[lead])


def _sorted_shards(contexts: DataFrame, length: int) -> DataFrame:
    """doc_id, place, count (bytes) of what repeats among contexts of the same key and part, with null key; and the first
    windows of keys of several parts, with key and digest.  A shard never splits a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "digest", "doc_id", "place", "count"]

        def sort_shard(shard: list[tuple]) -> Iterator[pa.RecordBatch]:
            bodies = [x[5] for x in shard]
            of, offset, doc, place, first = ranked_windows(bodies, np.array([x[3] for x in shard], np.int64), np.array([x[4] for x in shard], np.int64), length)
            split = np.array([x[2] > 1 for x in shard])[of] & first
            if split.any():
                begins = np.cumsum([0, *map(len, bodies)])[:-1]
                b = np.frombuffer(b"".join(bodies), np.uint8)
                digest = _digests(b, begins[of[split]] + offset[split], length, _sums(b))
                key = np.array([x[0] for x in shard], np.int64)[of[split]]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(digest.view(np.int64)), pa.array(doc[split]), pa.array(place[split]), pa.array(np.full(len(key), length, np.int32))], names=names)
            doc, place = doc[~first], place[~first]
            if len(doc):
                order = np.lexsort((place, doc))
                doc, place = doc[order], place[order]
                begin = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + length)))
                last = np.append(begin[1:], len(doc)) - 1
                none = pa.nulls(len(begin), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(doc[begin]), pa.array(place[begin]), pa.array((place[last] - place[begin] + length).astype(np.int32))], names=names)

        held: list[tuple] = []
        size = 0
        for batch in sliced(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SHARD_BYTES and row[:2] != held[-1][:2]:
                    yield from sort_shard(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield from sort_shard(held)

    dealt = contexts.repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(run, "key long, digest long, doc_id long, place long, count int")


def repeat_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, sub, start, count: bytes (from 0) of the texts of ``rows`` (doc_id, sub, text) covered by strings of
    ``length`` bytes that start earlier; spans may overlap."""
    judged = _runs(rows, length).selectExpr(
        "*",
        "rank() over (partition by key, context order by doc_id, place) as nth",
        "count(context) over (partition by key) as hits",
        "min(context) over (partition by key) <> max(context) over (partition by key) as differ",
    )
    judged = settle(
        judged.where("context is null or hits > 1 and (nth > 1 or differ)").select("key", "context", "doc_id", "place", "count", F.expr("context is not null and nth = 1").alias("edge")).distinct()
    )
    spans = judged.where("not edge").select("doc_id", "place", F.expr(f"if(context is null, count, count + {length - 1})").alias("count"))
    edge = judged.where("edge")
    full = max(SHARD_BYTES // (2 * length), 1)  # a context has less than twice ``length`` bytes
    parts = edge.groupBy("key").count().where(F.col("count") > full).select("key", F.ceil(F.col("count") / full).cast("int").alias("parts"))
    edge = edge.join(parts, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("doc_id", "place"), F.col("parts")).cast("int"))
    edge = edge.groupBy("doc_id", F.expr(f"cast(place >> {_START_BITS} as int)").alias("sub")).agg(F.collect_list(F.struct("key", "part", "parts", "place", "count")).alias("runs"))
    found = settle(_sorted_shards(_edges(rows, settle(edge), length), length))
    # A window stands at most once in each of a key's parts.
    across = found.where("key is not null").selectExpr("doc_id", "place", "count", "rank() over (partition by key, digest order by doc_id, place) as nth")
    spans = spans.unionByName(found.where("key is null").select("doc_id", "place", "count")).unionByName(across.where("nth > 1").drop("nth"))
    return spans.selectExpr("doc_id", f"cast(place >> {_START_BITS} as int) as sub", f"place & {_START} as start", "count")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes left), kept_sha256 of every row."""
    rows, several = _told_apart(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = _with_sub(rows, several)
    found = repeat_spans(rows.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long")), length)
    spans = settle(found.groupBy("doc_id", "sub").agg(F.collect_list(F.struct("start", "count")).alias("spans")))
    maybe = may_hold(rows, "doc_id", spans.select("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column=1, size=SLICE_BYTES):
            out = []
            for text, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not cut:
                    out.append((len(text), 0, 0, text, hashlib.sha256(text).hexdigest()))
                    continue
                start, end = _merged(np.array([c["start"] for c in cut]), np.array([c["start"] + c["count"] for c in cut]))
                kept = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True))
                out.append((len(text), len(text) - len(kept), len(start), kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    none = F.lit(None).cast(spans.schema["spans"].dataType)
    clear = without(rows, "doc_id", spans.select("doc_id")).select("doc_id", "text", none.alias("spans"))
    return clear.mapInArrow(run, schema).union(maybe.join(spans, ["doc_id", "sub"], "left").select("doc_id", "text", "spans").mapInArrow(run, schema))
