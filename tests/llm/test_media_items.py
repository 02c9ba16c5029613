"""Every format that is sniffed: valid items, cut ones, and magics without an item."""

import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

import pytest

from scanledger.llm import media, queries


def wav():
    data = bytes(range(40))
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def bmp():
    pixels = bytes(12)
    return b"BM" + struct.pack("<IIIIiiHHIIIIII", 54 + len(pixels), 0, 54, 40, 2, 2, 1, 24, 0, 0, 0, 0, 0, 0)[:52] + pixels


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x4c\x01\x00;"


def jpeg():
    part = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + part(0xE0, b"JFIF\0abc") + part(0xC0, b"\x08\0\x01\0\x01\x01\x01\x11\0") + part(0xDA, b"\x01\x01\0\0\x3f\0") + b"ab\xff\0cd\xff\xd0ef" + b"\xff\xd9"


def pdf():
    body = b"%PDF-1.4\n1 0 obj <<>> endobj\n"
    return body + b"xref\n0 1\ntrailer <<>>\nstartxref\n" + str(len(body)).encode() + b"\n%%EOF"


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "some text")
        z.writestr("b.txt", "more text")
    return out.getvalue()


def ogg():
    def page(flags, n, body):
        head = b"OggS\0" + bytes([flags]) + struct.pack("<QII", 0, 7, n) + b"\0\0\0\0" + bytes([1, len(body)])
        return head[:22] + struct.pack("<I", media._crc(head + body, 32, 0x04C11DB7)) + head[26:] + body

    return page(2, 0, b"vorbis") + page(4, 1, b"data of a page")


def mp4():
    box = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body
    return box(b"ftyp", b"isom\0\0\2\0isom") + box(b"moov", box(b"mvhd", bytes(20))) + box(b"mdat", b"12345")


def flac():
    info = struct.pack(">HH", 192, 192) + bytes(6) + ((8000 << 44) | (7 << 36) | 384).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + bytes([0x80, 0, 0, 34]) + info
    for n in range(2):
        head = bytes([0xFF, 0xF8, 0x10, 0x02, n])
        frame = head + bytes([media._crc(head, 8, 0x07)]) + bytes([0, 17 + n])
        out += frame + struct.pack(">H", media._crc(frame, 16, 0x8005))
    return out


VALID = {
    "image/png": media.encode_rgb(b"q" * 192), "image/jpeg": jpeg(), "image/gif": gif(), "image/bmp": bmp(), "audio/wav": wav(), "audio/flac": flac(),
    "application/ogg": ogg(), "video/mp4": mp4(), "application/pdf": pdf(), "application/gzip": gzip.compress(b"some text " * 9), "application/zip": zipped(),
}


@pytest.mark.parametrize("kind", VALID)
def test_valid_cut_and_wrapped_items(kind):
    whole = VALID[kind]
    assert media.outermost(media.items(whole)) == [(0, len(whole), kind)]
    for before, behind in ((b"junk ", b" tail"), (b"BM RIFF PK\x03\x04 %PDF- ", b""), (b"", b"\x00" * 9)):
        assert (len(before), len(whole), kind) in media.items(before + whole + behind), (before, behind)
    two = media.outermost(media.items(whole + b"--" + whole))
    assert two == [(0, len(whole), kind), (len(whole) + 2, len(whole), kind)]
    for cut in (1, len(whole) // 3):
        assert not [x for x in media.items(whole[:-cut]) if x[0] == 0 and x[1] >= len(whole) - cut and kind not in ("application/ogg", "video/mp4")]
    assert not media.items(whole[: len(whole) // 2]) or kind in ("application/ogg", "video/mp4")


@pytest.mark.parametrize("kind", ["image/png", "application/ogg", "audio/flac", "application/gzip"])
def test_a_wrong_check_sum_is_no_item(kind):
    bad = bytearray(VALID[kind])
    bad[-1 if kind != "application/gzip" else -6] ^= 1
    assert (0, len(bad), kind) not in media.items(bytes(bad))


def test_prose_about_magics_is_no_item():
    said = b"text %PDF- is a magic and %%EOF ends; BM, RIFF, GIF89a, OggS, fLaC and ftyp too. PK\x03\x04 \x1f\x8b\x08 \xff\xd8\xff \x89PNG\r\n\x1a\n and more"
    assert media.items(said) == []


def test_many_magics_take_linear_time():
    for magic, offset, _ in media.SIGNATURES:
        began = time.time()
        media.items((b"\0" * offset + magic) * (400_000 // (len(magic) + offset)))
        assert time.time() - began < 8, magic


def test_wrapped_texts_are_carved_and_their_types_corrected(spark, tmp_path):
    texts = [None, "", "a", "ab", "x" * 191, "x" * 192, "x" * 193, "äöü" * 500, "%PDF-1.4 %%EOF BM", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op1_media_columns(spark, f"file://{tmp_path}").collect()}
    assert len(got) == len(texts)
    for d, t in enumerate(texts):
        b = (t or "").encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        stored, r = media.encode_rgb(p), got[d]
        front, _, declared = media.ENVELOPES[len(b) % 3]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert (r.media_type, r.declared, r.corrected, r.item_start) == ("image/png", declared, declared != "image/png", len(front))
        hist = ",".join(str(sum(x >> 4 == k for x in p)) for k in range(16))
        assert r.feature == f"64x{len(p) // 192};mean=" + ",".join(f"{sum(p[c::3]) / (len(p) // 3):.4f}" for c in range(3)) + f";hist={hist}"
    assert {k: v for k, v in got[2].asDict().items() if k != "doc_id"} == {k: v for k, v in got[9].asDict().items() if k != "doc_id"}
