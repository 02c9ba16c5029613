"""Chains of boxes, pages and blocks are walked once, whatever number of items begins in them."""

import random
import struct
import time

import pytest

from scanledger.llm import media


def ogg_page(flags, body, number=0):
    laces = [255] * (len(body) // 255) + [len(body) % 255]
    page = b"OggS\0" + bytes([flags]) + struct.pack("<QIIIB", 0, 7, number, 0, len(laces)) + bytes(laces) + body
    return page[:22] + struct.pack("<I", media._crc(page, 32, media.OGG_POLY)) + page[26:]


def gif(pictures=1):
    picture = b"\x2c" + bytes(9) + b"\x02" + b"\x03abc" * 3 + b"\0"
    return b"GIF89a" + bytes(7) + b"\x21\xf9\x04abcd\0" + picture * pictures + b"\x3b"


BOX = struct.pack(">I4s", 8, b"ftyp")
PATTERNS = {
    "boxes": BOX * (1 << 17),
    "boxes around media": BOX * (1 << 17) + struct.pack(">I4s", 8, b"mdat"),
    "pages": ogg_page(2, b"x") * (1 << 15),
    "pages that claim much": (b"OggS\0\2" + bytes(20) + b"\xff" * 2) * (1 << 15),
    "pages within a page": b"".join(ogg_page(2, ogg_page(2, b"ab") * 2000) for _ in range(17)),
    "blocks": (b"GIF89a" + bytes(7) + b"\x21\x01\x04ab!\x01") * (1 << 16),
}


@pytest.mark.parametrize("name", PATTERNS)
def test_a_megabyte_of_beginnings_takes_seconds(name):
    began = time.time()
    found = media.items(PATTERNS[name])
    assert time.time() - began < 8
    if name == "boxes around media":
        assert found[0][:2] == (0, (1 << 20) + 8) and len(found) == 1 << 17
    if name == "pages within a page":
        assert len(found) == 17 * 2001


def test_check_sums_of_stretches():
    data = random.Random(1).randbytes(3000)
    held = media._Value(data)
    for a, z in ((0, 0), (0, 1), (5, 2000), (1999, 3000), (7, 7), (1, 2999)):
        assert held.check_sum(a, z) == media._crc(data[a:z], 32, media.OGG_POLY)


def test_items_between_other_bytes():
    r = random.Random(4)
    stream = ogg_page(2, b"head") + ogg_page(0, r.randbytes(600), 1) + ogg_page(4, b"", 2)
    boxes = struct.pack(">I4sI", 12, b"ftyp", 1) + struct.pack(">I4sQ", 1, b"mdat", 20) + b"data" + struct.pack(">I4s", 8, b"free")
    for kind, item in (("application/ogg", stream), ("video/mp4", boxes), ("image/gif", gif(2))):
        value = b"\0noise" + item + b"\0\0\0\0\xff" + item + b"\0"
        assert media.outermost(media.items(value)) == [(6, len(item), kind), (11 + len(item), len(item), kind)]
    broken = bytearray(stream)
    broken[40] ^= 1  # in the second page
    assert [n for _, n, _ in media.items(bytes(broken))] == [len(ogg_page(2, b"head"))]
    assert media.items(ogg_page(0, b"no beginning")) == media.items(gif(0)) == media.items(boxes[:12]) == media.items(gif(1)[:-1]) == []
