"""Packing: mixture-controlled packing by deficit round-robin over source queues.

Documents are dealt to lanes by a hash of their id and tokenised there.  A lane keeps a queue of tokens per source and
fills one window after another: each source is credited with its share of the window, gives what its credit and its
queue allow, and keeps the difference as a deficit or surplus for the windows to come; room that is left goes to the
sources with the largest deficits.  What a lane can't fill (less than a window) goes with its deficits to a second
round over groups of lanes.  The rest of that is cut into runs whose lengths are powers of two, which need no padding.

Defined results: a null or empty text is the end token alone; a null source is a source of its own; repeated rows and
rows without a doc_id are packed as often as they occur; ties between deficits go to the source that comes first by name; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, pick, settle

WINDOW = 4096
END = 2
LANE_BYTES = 24 << 20
GROUP_LANES = 64
#: Most queues that a lane keeps.
MOST_SOURCES = 4096
LOOK_AHEAD = 96 * WINDOW
#: Most chunks and most parts of chunks that a worker keeps.
CACHED_CHUNKS = 320_000
CACHED_PARTS = 400_000
PIECES = "doc_id {id}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, credit double"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Fixed value: how a tokenizer splits words whose ids may be put together from parts.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_like_words(tokenizer) -> bool:
    """Whether a tokenizer drops white space, ignores case and parts letters from marks, so that ``ChunkEncoder`` may cut texts."""
    told = json.loads(tokenizer.to_str())
    steps = [x["type"] for x in (told.get("normalizer") or {}).get("normalizers", [])]
    split = ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return steps == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and bool(split.get("invert")) and split.get("pattern") == {"Regex": _WORD_SPLIT}


#: Key of the end token; no chunk holds a blank.
_END_KEY = "\0 end"


class _Places(dict):
    """Numbers of strings; one that isn't there gets the next and is noted as new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class _Ids:
    """Token ids of numbered strings in one flat array."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        self.size[self.count : self.count + len(sizes)] = sizes
        self.start[self.count : self.count + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.count += len(sizes)

    def cut_to(self, count: int) -> None:
        if count < self.count:
            self.used = int(self.start[count])
            self.count = count

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings ``at`` in a row, and where each string's end."""
        size = self.size[at]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], ends


# ASCII characters that are neither letters nor digits nor white space.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class ChunkEncoder:
    """Token ids of whole texts, by way of the ids of their chunks between blanks and line feeds.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its chunks in a row.  Within
    a chunk of letters followed by ASCII marks only, it parts the letters from the marks and ignores case, so such a chunk
    is put together from the two.  What recurs is encoded once; the tables stop growing at fixed sizes, and what comes
    after is encoded for its batch alone.
    """

    def __init__(self, path: str, end: int = END):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_chunks = splits_like_words(self.tokenizer)
        self.chunks, self.parts = _Places(), _Places()
        self.chunk_ids, self.part_ids = _Ids(), _Ids()
        self.end = self.chunks[_END_KEY]
        self.chunks.new.clear()
        self.chunk_ids.add(np.array([end], np.uint32), np.array([1]))

    def _encode_new(self) -> None:
        new, parts, halves = self.chunks.new, self.parts, []
        put, bare, normal = halves.append, self.parts[""], unicodedata.is_normalized
        for chunk in new:
            low = chunk.lower()
            core = low.rstrip(_MARKS)
            if core.isalpha() and (chunk.isascii() or "\u03a3" not in chunk and normal("NFC", chunk)):
                put(parts[core])
                put(parts[low[len(core) :]] if len(core) < len(low) else bare)
            else:
                put(parts[chunk])
                put(bare)
        if self.parts.new:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(self.parts.new, add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.part_ids.add(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes)
        flat, ends = self.part_ids.gather(np.array(halves, np.int64))
        self.chunk_ids.add(flat, np.diff(np.append(0, ends[1::2])))

    def _forget(self, places: _Places, ids: _Ids, most: int) -> None:
        if len(places) > most:
            for key in places.new:
                del places[key]
            ids.cut_to(len(places))
        places.new.clear()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, closed by the end token."""
        if not self.by_chunks:
            last = self.chunk_ids.flat[:1]
            return [np.append(np.array(e.ids, np.uint32), last) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        find, at = self.chunks.__getitem__, []
        for t in texts:
            chunks = t.replace("\n", " ").split(" ")
            chunks.append(_END_KEY)
            at.append(np.fromiter(map(find, chunks), np.int64, len(chunks)))
        if self.chunks.new:
            self._encode_new()
        flat, ends = self.chunk_ids.gather(np.concatenate(at) if at else np.zeros(0, np.int64))
        lengths = np.fromiter(map(len, at), np.int64, len(at))
        self._forget(self.parts, self.part_ids, CACHED_PARTS)
        self._forget(self.chunks, self.chunk_ids, CACHED_CHUNKS)
        return np.split(flat, ends[np.cumsum(lengths) - 1])[:-1]


@lru_cache(1)
def encoder_of(path: str) -> ChunkEncoder:
    """One encoder for all tasks of a worker."""
    return ChunkEncoder(path)


class WindowFiller:
    """Queues by source, their deficits, and the pieces cut from them so far."""

    def __init__(self, shares: dict, sequence: Callable[[int], int], window: int = WINDOW):
        self.shares, self.window, self.sequence = shares, window, sequence
        self.queues: dict = {s: deque() for s in shares}
        self.queued = dict.fromkeys(shares, 0)
        self.credit = dict.fromkeys(shares, 0.0)
        self.total = self.made = 0
        self.pieces: list[tuple] = []

    def add(self, source, doc_id, ids: np.ndarray, start: int, doc_tokens: int) -> None:
        if source not in self.queues:
            self.queues[source], self.queued[source], self.credit[source], self.shares[source] = deque(), 0, 0.0, 0.0
        self.queues[source].append((doc_id, ids, start, doc_tokens))
        self.queued[source] += len(ids)
        self.total += len(ids)

    def _take(self, source, n: int, sequence: int, offset: int) -> None:
        queue = self.queues[source]
        self.queued[source] -= n
        self.credit[source] -= n
        while n:
            doc_id, ids, start, whole = queue.popleft()
            cut = ids[:n]
            if len(ids) > n:
                queue.appendleft((doc_id, ids[n:], start + n, whole))
            self.pieces.append((doc_id, source, start, len(cut), zlib.crc32(cut.tobytes()), whole, sequence, offset, None, None))
            n -= len(cut)
            offset += len(cut)

    def fill(self, size: int) -> None:
        """One sequence of ``size`` tokens; at least so many are queued."""
        sequence, room = self.sequence(self.made), size
        for s, share in self.shares.items():
            self.credit[s] += share * size
            if n := min(int(self.credit[s]), self.queued[s], room):
                if n > 0:
                    self._take(s, n, sequence, size - room)
                    room -= n
        while room:
            s = max((s for s in self.shares if self.queued[s]), key=self.credit.__getitem__)
            n = min(room, self.queued[s], max(1, int(self.credit[s]) if self.credit[s] >= 1 else room))
            self._take(s, n, sequence, size - room)
            room -= n
        self.made += 1
        self.total -= size

    def fill_while(self, least: int) -> list[tuple]:
        while self.total >= max(least, self.window):
            self.fill(self.window)
        out, self.pieces = self.pieces, []
        return out

    def fill_rest(self) -> list[tuple]:
        """What is left, in sequences whose lengths are powers of two, largest first."""
        size = self.window
        while self.total:
            size = min(size, 1 << (self.total.bit_length() - 1))
            self.fill(size)
        out, self.pieces = self.pieces, []
        return out

    def rest(self) -> list[tuple]:
        """What is left, with ids and deficits, for the next round."""
        return [(d, s, start, len(ids), None, whole, None, None, ids.tobytes(), self.credit[s]) for s, q in self.queues.items() for d, ids, start, whole in q]


def bounded_sources(rows: DataFrame) -> DataFrame:
    """``rows`` with their sources, or with ``MOST_SOURCES`` groups of sources by hash where there are more of them than that."""
    if rows.select("source").distinct().limit(MOST_SOURCES + 1).count() <= MOST_SOURCES:
        return rows
    return rows.withColumn("source", F.pmod(F.xxhash64("source"), F.lit(MOST_SOURCES)).cast("string"))


def source_shares(rows: DataFrame) -> dict:
    """Each source's share of all UTF-8 bytes (plus one per text), by name, null last: at most ``MOST_SOURCES`` and one entries."""
    sums = rows.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size")).collect()
    total = sum(r["size"] for r in sums)
    return {r["source"]: r["size"] / total for r in sorted(sums, key=lambda r: (r["source"] is None, r["source"] or ""))}


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str | None = None, window: int = WINDOW, shares: dict | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``shares`` are the target proportions by source; unless given, those of the corpus.  ``tokenizer`` is the path of a file
    whose normaliser and splitting rules are those of the default one (``splits_like_words``); with any other, whole texts
    are encoded.
    """
    path = tokenizer or default_tokenizer()
    rows = pick(docs, doc_id=id_col, source=source_col, text=text_col).withColumn("source", F.col("source").cast("string"))
    sized = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    if shares is None:
        rows = bounded_sources(rows)
        shares = source_shares(rows)
    targets = shares
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = PIECES.format(id=kind)

    def batch_of(pieces: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*pieces, strict=True))
        long = pa.int64()
        types = [id_type, pa.string(), long, long, long, long, long, long, pa.binary(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "credit"])

    def lane(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        filler, encoder, id_type = WindowFiller(dict(targets), lambda k: (number << 32) | k, window), encoder_of(path), None
        for batch in batches:
            id_type = batch.column(0).type
            for i in range(0, batch.num_rows, 256):
                ids, sources, texts = (batch.column(c).slice(i, 256).to_pylist() for c in range(3))
                for d, s, tokens in zip(ids, sources, encoder.encode([t or "" for t in texts]), strict=True):
                    filler.add(s, d, tokens, 0, len(tokens))
                if pieces := filler.fill_while(LOOK_AHEAD):
                    yield batch_of(pieces, id_type)
        if pieces := filler.fill_while(0) + filler.rest():
            yield batch_of(pieces, id_type)

    def round_two(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        filler = WindowFiller(dict(targets), lambda k: (((1 << 24) | int(key[0])) << 32) | k, window)
        group = group.sort_values(["lane", "doc_id", "start"])
        for r in group.itertuples():
            filler.add(r.source, r.doc_id, np.frombuffer(r.ids, np.uint32), r.start, r.doc_tokens)
        for (_, s), c in group.groupby(["lane", "source"], dropna=False)["credit"].first().items():
            filler.credit[s if isinstance(s, str) else None] += c
        return pd.DataFrame(filler.fill_while(0) + filler.fill_rest(), columns=["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "credit"])

    count = blocks_for(sized, LANE_BYTES)
    lanes = rows.repartition(count, F.xxhash64("doc_id"))
    first = settle(lanes.mapInArrow(lane, schema).withColumn("lane", F.spark_partition_id()))
    groups = blocks_for(count, GROUP_LANES)
    left = first.where("ids is not null").withColumn("group", F.col("lane") % groups)
    second = left.groupBy("group").applyInPandas(round_two, schema)
    columns = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return first.where("ids is null").select(*columns).unionByName(second.select(*columns))
