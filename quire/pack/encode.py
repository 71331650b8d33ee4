"""Encoders for fixtures and round trips: text to records, records to containers. Written from the format's facts."""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np

from quire.functions.codecs import write_number

RECORD = 4096
NONE, PALMDOC, HUFFCDIC = 1, 2, 17480
ABSENT = 0xFFFFFFFF


def container(records: list[bytes], name: bytes = b"book", ident: bytes = b"BOOKMOBI") -> bytes:
    at, table = 78 + 8 * len(records) + 2, b""
    for k, r in enumerate(records):
        table += struct.pack(">II", at, 2 * k)
        at += len(r)
    head = name[:31].ljust(32, b"\0") + bytes(28) + ident + bytes(8) + struct.pack(">H", len(records))
    return head + table + b"\0\0" + b"".join(records)


def exth_block(entries: list[tuple[int, bytes]]) -> bytes:
    body = b"".join(struct.pack(">II", kind, 8 + len(data)) + data for kind, data in entries)
    size = 12 + len(body)
    return b"EXTH" + struct.pack(">II", size, len(entries)) + body + bytes(-size % 4)


#: Place and bytes of the fields that ``record0`` can set by name.
PLACES = {"first_image": (108, 4), "huffcdic": (112, 4), "num_huffcdic": (116, 4), "drm_offset": (168, 4), "drm_count": (172, 4), "fdst": (192, 4), "num_fdst": (196, 4), "flags": (242, 2), "indx": (244, 4), "frag": (248, 4), "skel": (252, 4), "guide": (260, 4), "region": (94, 1), "language": (95, 1)}
_INDEXES = ("first_image", "huffcdic", "drm_offset", "fdst", "indx", "frag", "skel", "guide")


def record0(text_length: int, text_records: int, compression: int = NONE, *args, exth: list | None = None, **fields) -> bytes:
    """See ``_record0``. Headers without metadata are mostly alike."""
    if exth is None:
        return _plain_record0(text_length, text_records, compression, *args, **fields)
    return _record0(text_length, text_records, compression, *args, exth=exth, **fields)


def _record0(text_length: int, text_records: int, compression: int = NONE, codepage: int = 65001, version: int = 6, title: bytes = b"", exth: list | None = None, encryption: int = 0, **fields: int) -> bytes:
    size = 264 if version >= 8 else 232
    r = bytearray(16 + size)
    struct.pack_into(">HHIHHHH", r, 0, compression, 0, text_length, text_records, RECORD, encryption, 0)
    r[16:20] = b"MOBI"
    struct.pack_into(">5I", r, 20, size, 2, codepage, 1, version)
    block = exth_block(exth) if exth is not None else b""
    struct.pack_into(">II", r, 84, len(r) + len(block), len(title))
    struct.pack_into(">I", r, 128, 0x40 if block else 0)
    for name in _INDEXES:
        at, n = PLACES[name]
        if at + n <= len(r):
            struct.pack_into(">I", r, at, ABSENT)
    for name, value in fields.items():
        at, n = PLACES[name]
        r[at : at + n] = (value & (1 << 8 * n) - 1).to_bytes(n, "big")
    return bytes(r) + block + title


_plain_record0 = lru_cache(1024)(_record0)
#: Bytes of a PalmDOC match, at least and at most, how far back it may begin, and how many records are packed at a time.
_SHORTEST, _LONGEST, _WINDOW, _TOGETHER = 3, 10, 2047, 15


def palmdoc(data: bytes) -> bytes:
    """Greedy: the longest match of three to ten bytes among the last 2,047 (of several the nearest), then literals."""
    return palmdoc_all([data])[0]


def palmdoc_all(records: list[bytes]) -> list[bytes]:
    """Each record by itself."""
    return [x for k in range(0, len(records), _TOGETHER) for x in _palmdoc_some(records[k : k + _TOGETHER])]


def _matches(d: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and distance of the longest match before each place of the same record, of several the nearest; 0 for none.

    For each length in turn the places are sorted by the bytes that stand there, then by place, so that the nearest place
    with the same bytes is the neighbour. A place whose bytes stand nowhere else is left out of the longer ones.
    """
    length, back = np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
    at = np.flatnonzero(d[:-_LONGEST] < 256)
    key = (record[at] << 27 | d[at] << 18 | d[at + 1] << 9 | d[at + 2]) << 17 | at
    for size in range(_SHORTEST, _LONGEST + 1):
        key.sort()
        at = key & 0x1FFFF
        key >>= 17
        new = np.ones(len(at) + 1, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:-1])
        twin = np.flatnonzero(~new[:-1])
        gap = at[twin] - at[twin - 1]
        near = gap <= _WINDOW
        length[at[twin[near]]] = size
        back[at[twin[near]]] = gap[near]
        more = np.flatnonzero(~(new[:-1] & new[1:]))
        if not len(more) or size == _LONGEST:
            break
        at = at[more]
        key = (np.cumsum(new[more].astype(np.int64)) << 9 | d[at + size]) << 17 | at
    return length, back


def _palmdoc_some(records: list[bytes]) -> list[bytes]:
    sizes = [len(r) + _LONGEST for r in records]
    b = np.frombuffer(b"".join(r + bytes(_LONGEST) for r in records), np.uint8)
    d, ends = b.astype(np.int64), [e - _LONGEST for e in accumulate(sizes)]
    # what stands behind a record equals nothing else
    behind = np.concatenate([np.arange(e, e + _LONGEST) for e in ends])
    d[behind] = 256 + np.arange(len(behind))
    length, back = _matches(d, np.repeat(np.arange(len(records)), sizes))
    odd = (d >= 0x80) & (d < 256) | (d >= 1) & (d <= 8)
    # bytes that each place takes if an item begins there
    takes = np.ones(len(d), np.uint8)
    takes[:-1][(d[:-1] == 0x20) & (d[1:] >= 0x40) & (d[1:] < 0x80)] = 2
    places, plain = np.flatnonzero(odd), np.flatnonzero(~odd)
    takes[places] = np.minimum(plain[np.searchsorted(plain, places)] - places, 8)
    np.copyto(takes, length, where=length > 0, casting="unsafe")
    step, items, counts = takes.tobytes(), [], [0]
    put = items.append
    for end, size in zip(ends, sizes, strict=True):
        at = end + _LONGEST - size
        while at < end:
            put(at)
            at += step[at]
        counts.append(len(items))
    at = np.array(items, np.int64)
    takes, found = takes[at], length[at] > 0
    odd = odd[at] & ~found
    spaced = (takes == 2) & ~found & ~odd
    size = np.ones(len(at), np.int64)
    size[found] = 2
    size[odd] += takes[odd]
    edge = np.concatenate(([0], np.cumsum(size)))
    to, out = edge[:-1], np.empty(int(edge[-1]), np.uint8)
    out[to] = b[at]
    out[to[spaced]] = b[at[spaced] + 1] ^ 0x80
    pair = 0x8000 | back[at[found]] << 3 | takes[found] - 3
    out[to[found]] = pair >> 8
    out[to[found] + 1] = pair & 0xFF
    to, at, takes = to[odd], at[odd], takes[odd]
    out[to] = takes
    for k in range(int(takes.max(initial=0))):
        m = takes > k
        out[to[m] + 1 + k] = b[at[m] + k]
    whole, cuts = out.tobytes(), edge[counts].tolist()
    return [whole[x:y] for x, y in pairwise(cuts)]


class HuffBook:
    """Codes of one length for a dictionary of words and single bytes; the first phrase can be nested in codes of others."""

    def __init__(self, text: bytes, nested: bool = False):
        common = [w for w, _ in Counter(w for w in re.findall(rb"[^\s]+\s*", text) if 1 < len(w) <= 100).most_common(2000)]
        self.phrases = [*common, *(bytes([k]) for k in range(256))]
        self.number = {p: k for k, p in enumerate(self.phrases)}
        self.nested = nested and len(common) > 2
        self.bits = max(9, (len(self.phrases) - 1).bit_length())

    def _code(self, number: int) -> int:
        return len(self.phrases) - 1 - number

    def _pack(self, numbers: list[int]) -> bytes:
        value = 0
        for x in numbers:
            value = value << self.bits | self._code(x)
        size = len(numbers) * self.bits
        # filled up with ones: they are the code of no phrase, and shorter than one
        pad = -size % 8
        return ((value << pad) | (1 << pad) - 1).to_bytes((size + pad) // 8, "big")

    def _numbers(self, data: bytes) -> list[int]:
        out = []
        for piece in re.findall(rb"[^\s]+\s*|\s+", data):
            k = self.number.get(piece)
            out += [k] if k is not None else list(map(self.number.__getitem__, (bytes([x]) for x in piece)))
        return out

    def pack(self, data: bytes) -> bytes:
        return self._pack(self._numbers(data))

    def records(self) -> list[bytes]:
        quick = [8] * 256
        ranges = []
        for length in range(1, 33):
            low = 0 if length == self.bits else (1 << length) & 0xFFFFFFFF if length < self.bits else 0
            ranges += [low if length != 32 or self.bits == 32 else 0, len(self.phrases) - 1 if length == self.bits else 0]
        huff = b"HUFF" + struct.pack(">5I", 24, 24, 24 + 1024, 0, 0) + struct.pack(">256I", *quick) + struct.pack(">64I", *ranges)
        out, step = [huff], 256
        for at in range(0, len(self.phrases), step):
            heads, body = [], b""
            part = self.phrases[at : at + step]
            for k, p in enumerate(part):
                heads.append(2 * len(part) + len(body))
                if self.nested and at + k == 0:
                    coded = self._pack([self.number[bytes([x])] for x in p])
                    body += struct.pack(">H", len(coded)) + coded
                else:
                    body += struct.pack(">H", 0x8000 | len(p)) + p
            out.append(b"CDIC" + struct.pack(">3I", 16, len(self.phrases), 8) + struct.pack(f">{len(part)}H", *heads) + body)
        return out


def with_trailers(record: bytes, flags: int) -> bytes:
    """The record with what flags announce behind it: overlapping characters next to the text, then an entry a higher bit."""
    if flags & 1:
        record += b"\xee\x01"
    for _ in range((flags >> 1).bit_count()):
        record += b"\xde\xad\xbe\xef\x85"
    return record


def text_records(raw: bytes, compression: int, flags: int = 0, book: HuffBook | None = None) -> list[bytes]:
    pieces = [raw[k : k + RECORD] for k in range(0, len(raw), RECORD)]
    if compression == PALMDOC:
        pieces = palmdoc_all(pieces)
    elif compression != NONE:
        pieces = list(map(book.pack, pieces))
    return [with_trailers(p, flags) for p in pieces] if flags else pieces


def mobi6(raw: bytes, compression: int = NONE, flags: int = 0, resources: list[bytes] = (), ncx: list[bytes] = (), nested: bool = False, name: bytes = b"book", **head) -> bytes:
    return container(mobi6_records(raw, compression, flags, resources, ncx, nested, **head), name)


def mobi6_records(raw: bytes, compression: int = NONE, flags: int = 0, resources=(), ncx=(), nested: bool = False, **head) -> list[bytes]:
    """Record 0, text, dictionary, resources, contents index, end."""
    book = HuffBook(raw, nested) if compression == HUFFCDIC else None
    text = text_records(raw, compression, flags, book)
    tables = book.records() if book else []
    at = 1 + len(text)
    fields = {"flags": flags}
    if tables:
        fields |= {"huffcdic": at, "num_huffcdic": len(tables)}
    if resources:
        fields["first_image"] = at + len(tables)
    if ncx:
        fields["indx"] = at + len(tables) + len(resources)
    return [record0(len(raw), len(text), compression, **(fields | head)), *text, *tables, *resources, *ncx, b"\xe9\x8e\x0d\x0a"]


# -- indexes --------------------------------------------------------------------------------------------------------


def phrase_pool(groups: list[list[bytes]]) -> tuple[list[bytes], dict[bytes, int]]:
    """(records, offset of each phrase)."""
    records, where = [], {}
    for k, group in enumerate(groups):
        body = b""
        for p in group:
            where.setdefault(p, (k << 16) + len(body))
            body += write_number(len(p)) + p
        records.append(body + bytes(-len(body) % 4))
    return records, where


@lru_cache(64)
def _tagx(rows: tuple[tuple[int, int, int], ...]) -> bytes:
    return b"TAGX" + struct.pack(">2I", 12 + 4 * (len(rows) + 1), 1) + b"".join(bytes((t, n, m, 0)) for t, n, m in rows) + bytes((0, 0, 0, 1))


def index(rows: list[tuple[int, int, int]], entries: list[tuple[bytes, dict[int, list[int]]]], pool: list[bytes] = (), codepage: int = 65001, per_record: int = 64) -> list[bytes]:
    """Index records. rows: tag, values a group, mask (all in one control byte)."""
    tagx = _tagx(tuple(rows))
    packed = [_entry(rows, name, values) for name, values in entries]
    groups = [packed[k : k + per_record] for k in range(0, len(packed), per_record)]
    first = _index_record(192, 0, len(groups), codepage, len(entries), len(pool), b"\0" * (192 - 56) + tagx)
    out = [first]
    for g in groups:
        body, places = b"", []
        for e in g:
            places.append(56 + len(body))
            body += e
        body += bytes(-len(body) % 4)
        out.append(_index_record(56, 56 + len(body), len(g), codepage, len(g), 0, body + b"IDXT" + struct.pack(f">{len(places)}H", *places)))
    return out + list(pool)


def _index_record(length: int, offsets: int, count: int, codepage: int, total: int, pools: int, body: bytes) -> bytes:
    w = [0] * 13
    w[0], w[4], w[5], w[6], w[7], w[8], w[12] = length, offsets, count, codepage, 0, total, pools
    return b"INDX" + struct.pack(">13I", *w) + body


def _entry(rows, name: bytes, values: dict[int, list[int]]) -> bytes:
    control, sizes, body = 0, b"", b""
    for tag, per, mask in rows:
        v = values.get(tag)
        if not v:
            continue
        if len(v) == per == 1 and mask & (mask - 1) == 0:
            control |= mask
            body += write_number(v[0])
            continue
        groups, low = len(v) // per, (mask & -mask).bit_length() - 1
        coded = b"".join(map(write_number, v))
        if mask.bit_count() == 1 and groups == 1:
            control |= mask
        elif groups < mask >> low:
            control |= groups << low
        else:
            control |= mask
            sizes += write_number(len(coded))
        body += coded
    return bytes((len(name),)) + name + bytes((control,)) + sizes + body


NCX_ROWS = [(1, 1, 1), (2, 1, 2), (3, 1, 4), (4, 1, 8), (6, 2, 16), (21, 1, 32), (22, 1, 64), (23, 1, 128)]


def ncx(nodes: list[dict], codepage: int = 65001) -> list[bytes]:
    """Contents index of nodes with label and any of start, length, level, pos (pair), parent, first, last."""
    labels = [n["label"].encode("cp1252" if codepage == 1252 else "utf-8") for n in nodes]
    pool, where = phrase_pool([labels[k : k + 500] for k in range(0, len(nodes), 500)])
    tags = {"start": 1, "length": 2, "level": 4, "parent": 21, "first": 22, "last": 23}
    entries = []
    for k, n in enumerate(nodes):
        values = {tags[x]: [n[x]] for x in tags if n.get(x) is not None}
        values[3] = [where[labels[k]]]
        if n.get("pos"):
            values[6] = list(n["pos"])
        entries.append((b"%03d" % k, values))
    return index(NCX_ROWS, entries, pool, codepage)


# -- Kindle Format 8 ------------------------------------------------------------------------------------------------


def fdst(ranges: list[tuple[int, int]]) -> bytes:
    return b"FDST" + struct.pack(">2I", 12, len(ranges)) + b"".join(struct.pack(">2I", a, b) for a, b in ranges)


def resc(spreads: dict[int, str]) -> bytes:
    items = "".join(f'<itemref skelid="{k}" properties="{v}"/>' for k, v in spreads.items())
    return b"RESC" + struct.pack(">3I", 16, 1, 0) + f"<package><spine>{items}</spine></package>".encode() + bytes(4)


def kf8_records(documents: list[tuple[bytes, list[tuple[int, int]]]], flows: list[bytes] = (), compression: int = NONE, resources: list[bytes] = (), toc: list[dict] = (), guide: list[tuple[bytes, str, tuple[int, int]]] = (), spreads: dict | None = None, drop: tuple[str, ...] = (), **head) -> list[bytes]:
    """documents: bytes, and the ranges of them that go into fragments. toc: nodes of ``ncx``; guide: type, label, place."""
    raw, skels, frags = b"", [], []
    for k, (doc, cuts) in enumerate(documents):
        at, bare, payload, last = len(raw), b"", b"", 0
        for a, b in sorted(cuts):
            bare += doc[last:a]
            frags.append((at + a, k, len(payload), doc[a:b]))
            payload += doc[a:b]
            last = b
        bare += doc[last:]
        skels.append((len(cuts), at, len(bare)))
        raw += bare + payload
    edges = [(0, len(raw))]
    for f in flows:
        edges.append((len(raw), len(raw) + len(f)))
        raw += f
    book = HuffBook(raw) if compression == HUFFCDIC else None
    text = text_records(raw, compression, head.get("flags", 0), book)
    records = [b"", *text]
    fields = {}
    if book:
        tables = book.records()
        fields |= {"huffcdic": len(records), "num_huffcdic": len(tables)}
        records += tables
    extra = list(resources) + ([resc(spreads)] if spreads else [])
    if extra:
        fields["first_image"] = len(records)
        records += extra
    if toc:
        fields["indx"] = len(records)
        records += ncx(list(toc))
    skel = index([(1, 1, 3), (6, 2, 12)], [(b"SKEL%010d" % k, {1: [n], 6: [a, m]} if n else {1: [n], 6: [a, m]}) for k, (n, a, m) in enumerate(skels)])
    pool, where = phrase_pool([[b"P-//*[@aid='%d']" % k for k in range(len(frags))]])
    frag = index([(2, 1, 1), (3, 1, 2), (4, 1, 4), (6, 2, 8)], [(b"%010d" % place, {2: [where[b"P-//*[@aid='%d']" % k]], 3: [n], 4: [k], 6: [at, len(data)]}) for k, (place, n, at, data) in enumerate(frags)], pool)
    for name, recs in (("skel", skel), ("frag", frag)):
        if name not in drop:
            fields[name] = len(records)
            records += recs
    if guide:
        gpool, gwhere = phrase_pool([[label.encode() for _, label, _ in guide]])
        fields["guide"] = len(records)
        records += index([(1, 1, 1), (6, 2, 2)], [(kind, {1: [gwhere[label.encode()]], 6: list(place)}) for kind, label, place in guide], gpool)
    if "fdst" not in drop:
        fields |= {"fdst": len(records), "num_fdst": len(edges)}
        records.append(fdst(edges))
    records[0] = record0(len(raw), len(text), compression, version=8, **(fields | head))
    return [*records, b"\xe9\x8e\x0d\x0a"]


def kf8(*args, name: bytes = b"book", **kw) -> bytes:
    return container(kf8_records(*args, **kw), name)


def combo(old: list[bytes], new: list[bytes], old_head: dict, name: bytes = b"book") -> bytes:
    """Both halves in one file. old_head: arguments of the old half's record 0, whose metadata then names the new half."""
    edge = len(old) + 1
    head = record0(**(old_head | {"exth": [*(old_head.get("exth") or []), (121, struct.pack(">I", edge))]}))
    return container([head, *old[1:], b"BOUNDARY", *new], name)


def font(data: bytes, key: bytes = b"", squeeze: bool = True) -> bytes:
    body = zlib.compress(data) if squeeze else data
    if key:
        n = min(1024 if len(key) == 16 else 1040, len(body))
        body = bytes(b ^ key[k % len(key)] for k, b in enumerate(body[:n])) + body[n:]
    return b"FONT" + struct.pack(">5I", len(data), (1 if squeeze else 0) | (2 if key else 0), 24 + len(key), len(key), 24) + key + body
