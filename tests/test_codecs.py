"""Vectors that state the format itself, independent of the encoders."""

import random
import struct

import pytest

from quire.functions.codecs import Damaged, Phrases, assemble_documents, number_at_end, page_spreads, read_font, read_header, read_index, read_number, strip_trailers, toc_order, unpack_palmdoc, write_number
from quire.pack import encode as e

H = bytes.fromhex


@pytest.mark.parametrize(("data", "value"), [("80", 0), ("FF", 127), ("0180", 128), ("7FFF", 16383), ("010080", 16384), ("040080", 65536), ("7F" * 8 + "FF", 2**63 - 1)])
def test_number(data, value):
    assert read_number(H(data), 0) == (value, len(data) // 2)
    assert write_number(value) == H(data)


@pytest.mark.parametrize("data", ["0102", "", "00" * 10 + "80"])
def test_number_bad(data):
    with pytest.raises(Damaged):
        read_number(H(data), 0)


@pytest.mark.parametrize(("data", "value"), [("85", 5), ("DEADBEEF85", 5), ("8101", 129), ("01020304", (1 << 21) + (2 << 14) + (3 << 7) + 4)])
def test_number_at_end(data, value):
    assert number_at_end(H(data)) == value


def pair(back, length):
    return struct.pack(">H", 0x8000 | back << 3 | length - 3)


@pytest.mark.parametrize(("data", "out"), [(H("03616263"), b"abc"), (H("C1"), b" A"), (H("C0"), b" @"), (H("FF"), b" \x7f"), (H("02808178E9"), b"\x80\x81x i"), (b"A" + pair(1, 10), b"A" * 11), (b"AB" + pair(2, 7), b"ABABABABA"), (b"", b"")])
def test_palmdoc(data, out):
    assert unpack_palmdoc(data) == out


@pytest.mark.parametrize("data", ["056162", "01", "4180", "BF", "418000", "4180F8"])
def test_palmdoc_damaged(data):
    with pytest.raises(Damaged):
        unpack_palmdoc(H(data))


def test_palmdoc_round_trip():
    rng = random.Random(1)
    for _ in range(60):
        data = bytes(rng.choice(b"abc \x00\x01\x08\x80\xff\xc3") for _ in range(rng.randrange(600)))
        assert unpack_palmdoc(e.palmdoc(data)) == data


def tables(quick, ranges):
    return b"HUFF" + struct.pack(">5I", 24, 24, 24 + 1024, 0, 0) + struct.pack(">256I", *quick) + struct.pack(">64I", *ranges)


def cdic(phrases, total=None, bits=8):
    heads, body = [], b""
    for head, data in phrases:
        heads.append(2 * len(phrases) + len(body))
        body += struct.pack(">H", head | len(data)) + data
    return b"CDIC" + struct.pack(">3I", 16, len(phrases) if total is None else total, bits) + struct.pack(f">{len(heads)}H", *heads) + body


def uniform():
    """Four-bit codes of phrases a to h: number = 8 - code."""
    quick = [4 | 0x80 | (8 << 8)] * 256
    return Phrases(tables(quick, [0] * 64), [cdic([(0x8000, bytes([c])) for c in b"abcdefgh"])])


def test_huffman_by_hand():
    # number = 8 - code, so code 1 is the eighth phrase
    plain = Phrases(tables([4 | 0x80 | (8 << 8)] * 256, [0] * 64), [cdic([(0x8000, bytes([c])) for c in b"abcdefgh"])])
    assert plain.unpack(H("1234")) == b"hgfe"
    with pytest.raises(Damaged):
        plain.unpack(H("90"))
    assert plain.unpack(b"") == b""


def test_huffman_cycle_and_zero_length():
    with pytest.raises(Damaged):
        Phrases(tables([4 | 0x80 | (8 << 8)] * 256, [0] * 64), [cdic([(0, H("88"))] * 9)]).unpack(H("88"))
    with pytest.raises(Damaged):
        Phrases(tables([0] * 256, [0] * 64), [cdic([(0x8000, b"a")])]).unpack(b"a")


def test_huffman_deep_nesting():
    n = 3000
    quick, ranges = [16] * 256, []
    for length in range(1, 33):
        ranges += [1 << length if length < 16 else 0, n if length == 16 else 0]
    chain = [(0, struct.pack(">H", n - k - 1)) for k in range(n)] + [(0x8000, b"end")]
    book = Phrases(tables(quick, [x & 0xFFFFFFFF for x in ranges]), [cdic(chain, bits=14)])
    assert book.unpack(struct.pack(">H", n)) == b"end"


def test_huffman_round_trip():
    rng = random.Random(2)
    for nested in (False, True):
        for _ in range(20):
            text = b" ".join(rng.choice([b"the", b"quick", b"fox\xff", b"\x00x", b"jumps\n"]) for _ in range(rng.randrange(1, 300)))
            book = e.HuffBook(text, nested)
            recs = book.records()
            assert Phrases(recs[0], recs[1:]).unpack(book.pack(text)) == text


@pytest.mark.parametrize("flags", [0, 1, 2, 6, 0x0E, 0b1011, 0xFFFF])
def test_trailers(flags):
    assert strip_trailers(e.with_trailers(b"record text", flags), 6, flags) == b"record text"
    assert strip_trailers(b"abc", 4, 0xFFFF) == b"abc"


def test_trailers_damaged():
    for record, flags in ((b"", 1), (b"", 2), (b"\x80", 2), (b"a\xff", 2), (b"\x03", 1)):
        with pytest.raises(Damaged):
            strip_trailers(record, 6, flags)


def test_index_round_trip():
    rng = random.Random(3)
    rows = [(1, 1, 1), (2, 2, 6), (3, 1, 8)]
    for _ in range(60):
        entries = []
        for k in range(rng.randrange(1, 150)):
            values = {}
            if rng.random() < 0.7:
                values[1] = [rng.randrange(1 << rng.randrange(1, 60))]
            if rng.random() < 0.7:
                values[2] = [rng.randrange(1 << 20) for _ in range(2 * rng.randrange(1, 6))]
            if rng.random() < 0.5:
                values[3] = [rng.randrange(300)]
            entries.append((b"%d" % k, values))
        pool, where = e.phrase_pool([[b"one", b"two"], [b"three"]])
        page, got, phrases = read_index(e.index(rows, entries, pool))
        assert (page, got) == (65001, entries)
        assert {v: k for k, v in where.items()} == phrases and where[b"three"] == 0x10000


def test_index_truncations():
    records = e.index([(1, 1, 1)], [(b"x", {1: [70000]})], e.phrase_pool([[b"p"]])[0])
    for k in range(len(records)):
        for cut in range(0, len(records[k]), 3):
            broken = records[:k] + [records[k][:cut]] + records[k + 1 :]
            try:
                read_index(broken)
            except Damaged as d:
                assert d.status in ("Corrupt", "RecordRange")


def node(**kw):
    return {"level": -1, "parent": -1, "first": -1, "last": -1} | kw


def test_toc_modes():
    by_parent = [node(level=0), node(level=1, parent=0), node(level=1, parent=0), node(level=0), node(level=2, parent=2)]
    assert toc_order(by_parent) == [(0, -1, 0), (1, 0, 1), (2, 0, 1), (4, 2, 2), (3, -1, 0)]
    by_range = [node(level=0, first=2, last=3), node(level=0), node(level=1), node(level=1)]
    assert toc_order(by_range) == [(0, -1, 0), (2, 0, 1), (3, 0, 1), (1, -1, 0)]
    assert toc_order([node(), node()]) == [(0, -1, 0), (1, -1, 0)]


def test_toc_odd_shapes():
    assert toc_order([node(parent=1), node(parent=0)]) == []
    assert toc_order([node(level=0, parent=0)]) == [(0, -1, 0)]
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 12)
        nodes = [node(level=rng.randrange(-1, 3), parent=rng.randrange(-1, n + 1), first=rng.randrange(-1, n + 1), last=rng.randrange(-1, n + 1)) for _ in range(n)]
        seen = [k for k, _, _ in toc_order(nodes)]
        assert len(seen) == len(set(seen))
    deep = [node(level=0)] + [node(level=k, parent=k - 1) for k in range(1, 5000)]
    assert len(toc_order(deep)) == 5000


@pytest.mark.parametrize("key", [b"", b"k" * 16, b"0123456789"])
@pytest.mark.parametrize("squeeze", [False, True])
def test_font(key, squeeze):
    data = bytes(range(256)) * 9
    assert read_font(e.font(data, key, squeeze)) == data
    for cut in range(0, 24):
        with pytest.raises(Damaged):
            read_font(e.font(data, key, squeeze)[:cut])


def test_page_spreads():
    assert page_spreads(e.resc({1: "page-spread-left x", 3: "rendition:page-spread-center", 4: "none"})) == {1: "left", 3: "center"}
    assert page_spreads(b"RESC....<spine><itemref skelid='2' properties='page-spread-right'/></spine>\0\0") == {2: "right"}
    assert page_spreads(b"RESC<spine><broken") == page_spreads(b"RESC") == {}


def test_documents():
    doc = b"<html><body>abcdef</body></html>"
    skeleton, parts = doc[:12] + doc[18:], (doc[12:15], doc[15:18])
    raw = skeleton + b"".join(parts)
    frags = [{"insert_offset": 12, "length": 3}, {"insert_offset": 15, "length": 3}]
    (got,) = assemble_documents(raw, 0, [{"num_frag": 2, "offset": 0, "length": len(skeleton)}], frags)
    assert got["content"] == doc and got["linear"]
    for bad in ({"insert_offset": 99, "length": 3}, {"insert_offset": 12, "length": 99}, {"insert_offset": -1, "length": 1}, {"insert_offset": 12, "length": -1}):
        with pytest.raises(Damaged):
            assemble_documents(raw, 0, [{"num_frag": 1, "offset": 0, "length": len(skeleton)}], [bad])
    with pytest.raises(Damaged):
        assemble_documents(raw, 0, [{"num_frag": 1 << 62, "offset": 0, "length": 1}], frags)


def test_header_truncations():
    whole = e.record0(5, 1, title=b"Title", exth=[(100, b"A"), (503, b"B")])
    assert read_header(whole)["exth"] == [(100, b"A"), (503, b"B")] and read_header(whole)["title"] == b"Title"
    for cut in range(len(whole)):
        with pytest.raises(Damaged):
            read_header(whole[:cut])


def test_header_precedence():
    status = lambda **kw: pytest.raises(Damaged, read_header, e.record0(5, 1, **kw)).value.status
    assert status(encryption=2, codepage=7, compression=9) == "DRM"
    assert status(drm_offset=1, drm_count=1, codepage=7) == "DRM"
    assert status(codepage=7, compression=9) == "Corrupt"
    assert status(compression=9) == "UnsupportedCompression"
