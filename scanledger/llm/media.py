"""Media columns: signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a value; a validator per format
then checks the structure behind each hit and measures the item's length, so that a chance hit is not taken for an
item.  The item at the front corrects the declared type, the others are carved out as embedded media.

``encode_rgb`` stores 8-bit samples losslessly as an RGB picture in PNG, ``read_rgb`` reads them back.

Defined results: a null value has type null and no items; an empty value, or one without any valid item, has the type
``application/octet-stream``; where hits tie at one place the longer magic wins; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, sliced

# Magic bytes and where they stand from the start of an item.
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"RIFF", 0, "riff"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "application/ogg"),
    (b"ftyp", 4, "video/mp4"),
    (b"%PDF-", 0, "application/pdf"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"PK\x03\x04", 0, "application/zip"),
]
RIFF_KINDS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
UNKNOWN = "application/octet-stream"
OGG_POLY = 0x04C11DB7
PIXELS_WIDE = 64
ROW_BYTES = PIXELS_WIDE * 3
SLICE_BYTES = 4 << 20


@lru_cache(1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, offset, kind in SIGNATURES:
        found.add_word(magic.decode("latin-1"), (len(magic), offset, kind))
    found.make_automaton()
    return found


class _Value:
    """A value's bytes, with the last place of each needle that was sought, so that seeking stays linear over ascending places."""

    def __init__(self, data: bytes):
        self.data, self.size, self.places = data, len(data), {}
        self.chains: dict[str, dict[int, tuple[int, bool]]] = {}
        self.sums = array("I", [0])

    def find(self, needle: bytes, at: int) -> int:
        """Where ``needle`` stands next from ``at`` on, or -1."""
        begin, place = self.places.get(needle, (0, -2))
        if place == -2 or at < begin or 0 <= place < at:
            place = self.data.find(needle, at)
            self.places[needle] = at, place
        return place

    def chain(self, name: str, at: int, step: Callable[[int], tuple[int, bool] | None]) -> tuple[int, bool]:
        """Where the steps from ``at`` on end, and whether any of them was marked.

        Walks that meet go on alike, so what is known of every eighth place of a walk spares later ones the rest of it.
        """
        known, path = self.chains.setdefault(name, {}), []
        while at not in known:
            after = step(at)
            if after is None:
                known[at] = at, False
                break
            path.append((at, after[1]))
            at = after[0]
        end, marked = known[at]
        for n in range(len(path) - 1, -1, -1):
            marked = marked or path[n][1]
            if n % 8 == 0:
                known[path[n][0]] = end, marked
        return end, marked

    def check_sum(self, start: int, end: int) -> int:
        """The 32-bit check sum, highest bit first, of a stretch: a difference of those of two beginnings of the value, each byte read once."""
        table, sums = _crc_table(32, OGG_POLY), self.sums
        c = sums[-1]
        for x in memoryview(self.data)[len(sums) - 1 : end]:
            c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ x]
            sums.append(c)
        return sums[end] ^ _shifted(sums[start], end - start)


def _png(v: _Value, at: int) -> int:
    b, i, first, data = v.data, at + 8, True, False
    while i + 12 <= v.size:
        n, kind = struct.unpack_from(">I4s", b, i)
        end = i + 12 + n
        if end > v.size or (first and (kind != b"IHDR" or n != 13)) or zlib.crc32(memoryview(b)[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return 0
        if kind == b"IEND":
            return end - at if data else 0
        i, first, data = end, False, data or kind == b"IDAT"
    return 0


def _jpeg(v: _Value, at: int) -> int:
    """Segments up to the end mark; within a scan, any mark but a restart ends it."""
    b, i, scanned, framed = v.data, at + 2, False, False
    while i + 4 <= v.size and b[i] == 0xFF or i + 2 == v.size and b[i] == 0xFF:
        mark = b[i + 1]
        if mark == 0xD9:
            return i + 2 - at if scanned and framed else 0
        if i + 4 > v.size or mark in (0x00, 0x01, 0xFF) or 0xD0 <= mark <= 0xD8:
            return 0
        n = struct.unpack_from(">H", b, i + 2)[0]
        if n < 2:
            return 0
        framed = framed or 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        i += 2 + n
        if mark == 0xDA:
            scanned = True
            while (i := v.find(b"\xff", i)) >= 0 and i + 1 < v.size and (b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7):
                i += 2
            if i < 0:
                return 0
    return 0


def _gif(v: _Value, at: int) -> int:
    """Blocks up to the trailer, a picture among them."""
    b = v.data
    if at + 13 > v.size:
        return 0

    def piece(i: int) -> tuple[int, bool] | None:
        return (i + b[i] + 1, False) if i < v.size and b[i] else None

    def block(i: int) -> tuple[int, bool] | None:
        if i < v.size and b[i] == 0x21:
            start = i + 2
        elif i + 10 <= v.size and b[i] == 0x2C:
            start = i + 11 + (3 << ((b[i + 9] & 7) + 1) if b[i + 9] & 0x80 else 0)
        else:
            return None
        return v.chain("pieces", start, piece)[0] + 1, b[i] == 0x2C

    flags = b[at + 10]
    end, pictured = v.chain("blocks", at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0), block)
    return end + 1 - at if pictured and end < v.size and b[end] == 0x3B else 0


def _bmp(v: _Value, at: int) -> int:
    if at + 30 > v.size:
        return 0
    size, zero, start, head, wide, high, planes, bits = struct.unpack_from("<IIIIiiHH", v.data, at + 2)
    good = zero == 0 and head in (40, 52, 56, 108, 124) and wide > 0 and high != 0 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + head <= start <= size
    return size if good and at + size <= v.size else 0


def _riff(v: _Value, at: int) -> int:
    if at + 12 > v.size or v.data[at + 8 : at + 12] not in RIFF_KINDS:
        return 0
    size = struct.unpack_from("<I", v.data, at + 4)[0] + 8
    if size < 20 or at + size > v.size:
        return 0
    i = at + 12
    while i + 8 <= at + size:
        n = struct.unpack_from("<I", v.data, i + 4)[0]
        i += 8 + n + (n & 1)
    return size if i in (at + size, at + size + 1) else 0


@lru_cache(4)
def _crc_table(bits: int, poly: int) -> list[int]:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    table = []
    for c in range(256):
        c <<= bits - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        table.append(c)
    return table


def _crc(data: bytes, bits: int, poly: int) -> int:
    """Check sum whose highest bit comes first."""
    table, c, shift, mask = _crc_table(bits, poly), 0, bits - 8, (1 << bits) - 1
    for x in data:
        c = (c << 8 & mask) ^ table[c >> shift ^ x]
    return c


@lru_cache(1 << 12)
def _power(n: int) -> int:
    """x to the power 8 n, modulo the polynomial."""
    if n == 0:
        return 1
    half = _times(_power(n // 2), _power(n // 2)) if n > 1 else 1
    return _times(half, 1 << 8) if n & 1 else half


def _times(a: int, c: int) -> int:
    """Product of two polynomials modulo that of Ogg."""
    out = 0
    while c:
        if c & 1:
            out ^= a
        c >>= 1
        a <<= 1
        if a >> 32:
            a ^= 1 << 32 | OGG_POLY
    return out


def _shifted(c: int, n: int) -> int:
    """What a check sum becomes behind ``n`` zero bytes."""
    return _times(c, _power(n)) if c else 0


def _flac_head(b: bytes, i: int) -> tuple[int, int]:
    """(length of the frame header at ``i``, samples of the frame), zeros where there is none."""
    if i + 6 > len(b) or b[i] != 0xFF or b[i + 1] & 0xFE != 0xF8 or b[i + 3] & 1:
        return 0, 0
    block, rate = b[i + 2] >> 4, b[i + 2] & 15
    lead = next((k for k in range(8) if not b[i + 4] & 0x80 >> k), 8)
    at = i + 4 + max(lead, 1)
    if block == 0 or rate == 15 or lead in (1, 8):
        return 0, 0
    samples = 192 if block == 1 else 576 << block - 2 if block < 6 else 256 << block - 8
    if block in (6, 7):
        samples = int.from_bytes(b[at : at + block - 5], "big") + 1
        at += block - 5
    at += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    return (at + 1 - i, samples) if at < len(b) and _crc(b[i:at], 8, 0x07) == b[at] else (0, 0)


def _flac(v: _Value, at: int) -> int:
    """Metadata, then frames by their check sums until the stream's samples are complete; a stream of unknown length ends with the last good frame."""
    b, i, whole = v.data, at + 4, None
    while i + 4 <= v.size:
        last, kind, n = b[i] & 0x80, b[i] & 0x7F, int.from_bytes(b[i + 1 : i + 4], "big")
        if whole is None:
            if kind != 0 or n != 34 or i + 38 > v.size:
                return 0
            whole = int.from_bytes(b[i + 17 : i + 22], "big") & 0xFFFFFFFFF
        i += 4 + n
        if last:
            break
    else:
        return 0
    done, table = 0, _crc_table(16, 0x8005)
    while not whole or done < whole:
        head, samples = _flac_head(b, i)
        if not head:
            break
        c, j, final = _crc(b[i : i + head], 16, 0x8005), i + head, bool(whole) and done + samples >= whole
        while j < v.size:
            c = (c << 8 & 0xFFFF) ^ table[c >> 8 ^ b[j]]
            j += 1
            if c == 0 and (final or j == v.size or _flac_head(b, j)[0]):
                break
        if c:
            break
        i, done = j, done + samples
    return i - at if done and (not whole or done >= whole) else 0


def _ogg(v: _Value, at: int) -> int:
    """Pages with right check sums, from one that begins a stream to the last that follows without a gap."""
    b = v.data

    def page(i: int) -> tuple[int, bool] | None:
        if i + 27 > v.size or b[i : i + 5] != b"OggS\0":
            return None
        body = i + 27 + b[i + 26]
        if body > v.size or (end := body + sum(b[i + 27 : body])) > v.size:
            return None
        told = struct.unpack_from("<I", b, i + 22)[0]
        blank = _shifted(_crc(b[i + 22 : i + 26], 32, OGG_POLY), end - i - 26)  # the page's own sum counts as zeros in it
        return (end, False) if v.check_sum(i, end) ^ blank == told else None

    return v.chain("pages", at, page)[0] - at if b[at + 5 : at + 6] and b[at + 5] & 2 else 0


def _mp4(v: _Value, at: int) -> int:
    """Boxes with printable kinds that follow without a gap, one of which holds media or tells of them."""
    b = v.data

    def box(i: int) -> tuple[int, bool] | None:
        if i + 8 > v.size:
            return None
        n, kind = struct.unpack_from(">I4s", b, i)
        if n == 1 and i + 16 <= v.size:
            n = struct.unpack_from(">Q", b, i + 8)[0]
        if n < 8 or i + n > v.size or not all(32 <= c < 127 for c in kind):
            return None
        return i + n, kind in (b"moov", b"mdat", b"moof", b"meta")

    end, held = v.chain("boxes", at, box)
    return end - at if held else 0


_PDF_END = re.compile(rb"startxref[\r\n ]+(\d{1,12})[\r\n ]+$")
_PDF_TABLE = re.compile(rb"xref[\r\n ]|\d+ +\d+ +obj")


def _pdf(v: _Value, at: int) -> int:
    """Up to the last end mark before the next header whose startxref names a cross-reference table in the item."""
    b = v.data
    if not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b".":
        return 0
    stop = v.find(b"%PDF-", at + 5)
    stop, found, end = v.size if stop < 0 else stop, 0, at
    while 0 <= (end := v.find(b"%%EOF", end + 5)) < stop:
        told = _PDF_END.search(b, max(at, end - 64), end)
        if told and int(told[1]) < end - at and _PDF_TABLE.match(b, at + int(told[1])):
            found = end + 5 - at
    return found


def _gzip(v: _Value, at: int) -> int:
    """One member: the header's fields are skipped, the stream is read in pieces, and its check sum and length must agree."""
    b, i = v.data, at + 10
    if i > v.size or (flags := b[at + 3]) & 0xE0:
        return 0
    if flags & 4:
        i += 2 + int.from_bytes(b[i : i + 2], "little")
    for field in (8, 16):  # name and comment, each up to a zero byte
        if flags & field:
            if (i := v.find(b"\0", i) + 1) == 0:
                return 0
    i += flags & 2
    reader, crc, size, view = zlib.decompressobj(-15), 0, 0, memoryview(b)
    try:
        while i < v.size and not reader.eof:
            left = view[i : i + 16384]
            i += len(left)
            while len(left) and not reader.eof:
                out = reader.decompress(left, 1 << 20)
                crc, size, left = zlib.crc32(out, crc), size + len(out), reader.unconsumed_tail
    except zlib.error:
        return 0
    i -= len(reader.unused_data)
    good = reader.eof and i + 8 <= v.size and struct.unpack_from("<II", b, i) == (crc, size & 0xFFFFFFFF)
    return i + 8 - at if good else 0


def _zip(v: _Value, at: int) -> int:
    end = v.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > v.size:
        return 0
    size, start, note = struct.unpack_from("<IIH", v.data, end + 12)
    whole = start + size == end - at and end + 22 + note <= v.size and (size == 0 or v.data[at + start : at + start + 4] == b"PK\x01\x02")
    return end + 22 + note - at if whole else 0


VALIDATORS = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "riff": _riff, "audio/flac": _flac,
    "application/ogg": _ogg, "video/mp4": _mp4, "application/pdf": _pdf, "application/gzip": _gzip, "application/zip": _zip,
}


def items(value: bytes) -> list[tuple[int, int, str]]:
    """(start, length, type) of each valid item, by start; items inside another are listed too."""
    held, hits = _Value(value), {}
    for end, (n, offset, kind) in automaton().iter(value.decode("latin-1")):
        at = end + 1 - n - offset
        if at >= 0 and (at not in hits or hits[at][0] < n):
            hits[at] = (n, kind)
    out = []
    for at in sorted(hits):
        kind = hits[at][1]
        if length := VALIDATORS[kind](held, at):
            out.append((at, length, RIFF_KINDS[value[at + 8 : at + 12]] if kind == "riff" else kind))
    return out


def outermost(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those items that don't begin inside an earlier one."""
    out, end = [], 0
    for at, length, kind in found:
        if at >= end:
            out.append((at, length, kind))
            end = at + length
    return out


def encode_rgb(payload: bytes) -> bytes:
    """PNG of the samples, ``PIXELS_WIDE`` RGB pixels to a row; their number is a multiple of ``ROW_BYTES``."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    lines = np.zeros((len(rows), ROW_BYTES + 1), np.uint8)
    lines[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", PIXELS_WIDE, len(rows), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def read_rgb(media: bytes) -> np.ndarray:
    """Samples of a PNG whose rows are unfiltered 8-bit RGB, as height x width x 3."""
    wide, high, bits, colour, _, _, laced = struct.unpack_from(">IIBBBBB", media, 16)
    if (bits, colour, laced) != (8, 2, 0):
        raise ValueError("only plain 8-bit RGB is read")
    i, data = 8, []
    while i < len(media):
        n, kind = struct.unpack_from(">I4s", media, i)
        if kind == b"IDAT":
            data.append(media[i + 8 : i + 8 + n])
        i += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(high, wide * 3 + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return lines[:, 1:].reshape(high, wide, 3)


def _feature(pixels: np.ndarray) -> str:
    flat = pixels.reshape(-1, 3)
    counts = np.bincount(flat.ravel() >> 4, minlength=16)
    mean = flat.mean(axis=0, dtype=np.float64)
    return f"{pixels.shape[1]}x{pixels.shape[0]};mean=" + ",".join(f"{m:.4f}" for m in mean) + ";hist=" + ",".join(map(str, counts))


def sniff_media(df: DataFrame, id_col: str, media_col: str, declared_col: str | None = None) -> DataFrame:
    """One row per value and item: id, item (0: the value itself), declared, media_type, corrected, start, length, valid.

    ``media_type`` of item 0 is the type of the valid item at its front, ``corrected`` whether that differs from the
    declared one; further items are those embedded behind the front, with their own types and spans.
    """
    rows = pick(df, id=id_col, media=media_col, **({"declared": declared_col} if declared_col else {}))
    rows = rows if declared_col else rows.withColumn("declared", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0), []
            for i, (value, said) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if value is None:
                    out.append((i, 0, said, None, False, 0, 0, False))
                    continue
                found = items(value)
                front = next(((n, k) for at, n, k in found if at == 0), (len(value), UNKNOWN))
                out.append((i, 0, said, front[1], said is not None and said != front[1], 0, front[0], front[1] != UNKNOWN))
                out += [(i, k, None, kind, False, at, n, True) for k, (at, n, kind) in enumerate((x for x in found if x[0] > 0), 1)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            types = [pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), *[pa.array(c, t) for c, t in zip(cols[1:], types, strict=True)]], names=["id", "item", "declared", "media_type", "corrected", "start", "length", "valid"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "media", "declared").mapInArrow(run, f"id {kind}, item int, declared string, media_type string, corrected boolean, start long, length long, valid boolean")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text as media: doc_id, n_bytes, media (a PNG of its UTF-8 bytes, blanks filling the last row).  Null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column=1, size=SLICE_BYTES):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            media = [encode_rgb(t + b" " * (-len(t) % ROW_BYTES if t else ROW_BYTES)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.encode("text", "UTF-8").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


#: What stands before and behind a stored picture, and the type it is declared as: by the length of the text, as in a dump
#: whose labels can't be trusted.  The second holds magics without items.
ENVELOPES = [
    (b"", b"", "image/png"),
    (b"Content-Type: image/gif\r\n\r\n", b"\r\n--end--\r\n", "image/gif"),
    (b"GIF89a, BM, PK\x03\x04 and %PDF-1.4 are magics; %%EOF ends one.\n", b"\x1f\x8b\x08", "application/pdf"),
]


def wrap_media(stored: DataFrame) -> DataFrame:
    """``stored`` (doc_id, n_bytes, media) with every value inside one of the ``ENVELOPES``, and its declared type."""
    kinds = F.array(*[F.struct(F.lit(a).alias("front"), F.lit(z).alias("back"), F.lit(t).alias("declared")) for a, z, t in ENVELOPES])
    picked = F.get(kinds, (F.col("n_bytes") % len(ENVELOPES)).cast("int"))
    rows = stored.select("doc_id", "n_bytes", "media", picked.alias("e"))
    return rows.select("doc_id", "n_bytes", F.concat("e.front", "media", "e.back").alias("media"), F.col("e.declared").alias("declared"))


def media_features(stored: DataFrame) -> DataFrame:
    """Sniff, carve and read back what ``store_texts`` wrote, wrapped by ``wrap_media`` or bare.

    Every value is sniffed by its bytes alone; the first item that doesn't stand inside another is carved out, its type
    corrects the declared one, and an RGB picture is decoded; all digests are those of what was carved and read.  A value
    without an item has the unknown type and null digests, a null value null ones throughout.
    """
    stored = stored if "declared" in stored.columns else stored.withColumn("declared", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, said in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if value is None:
                    out.append([None] * 11)
                    continue
                found = outermost(items(value))
                if not found:
                    out.append([UNKNOWN, 0, None, None, None, None, None, None, said, said is not None, None])
                    continue
                at, length, kind = found[0]
                carved = value[at : at + length]
                row = [kind, len(found) - (at == 0), None, None, None, length, hashlib.sha256(carved).hexdigest(), None, said, said is not None and said != kind, at]
                if kind == "image/png":
                    pixels = read_rgb(carved)
                    payload = pixels.tobytes()
                    row[2:5] = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])
                    row[7] = _feature(pixels)
                out.append(row)
            cols = list(zip(*out, strict=True)) if out else [[]] * 11
            types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["doc_id", "n_bytes", *names])

    names = ["media_type", "embedded", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "corrected", "item_start"]
    kind = stored.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, media_type string, embedded int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, corrected boolean, item_start long"
    return stored.select("doc_id", "n_bytes", "media", "declared").mapInArrow(run, schema)
