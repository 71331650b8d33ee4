"""Byte codecs that SQL cannot express. Each raises ``Damaged`` on bytes that it cannot read."""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache
from itertools import accumulate
from xml.etree import ElementTree

import numpy as np

OK, CORRUPT, RANGE = "OK", "Corrupt", "RecordRange"
#: Fixed limits of the format's readers: depth of nested phrases, bytes that one record may expand to.
MOST_NESTED, MOST_OUTPUT = 4096, 32 << 20


class Damaged(ValueError):
    """Bytes that don't follow the format; ``status`` names the kind of damage."""

    def __init__(self, status: str = CORRUPT):
        super().__init__(status)
        self.status = status


_ONE_BYTE = [bytes((0x80 | k,)) for k in range(0x80)]


# -- variable-length numbers ----------------------------------------------------------------------------------------


def read_number(data: bytes, at: int) -> tuple[int, int]:
    """(value, bytes): seven bits a byte, the last byte marked by its top bit; nine bytes at most."""
    if at < len(data) and data[at] & 0x80:
        return data[at] & 0x7F, 1
    value = 0
    for k, byte in enumerate(data[at : at + 9]):
        value = value << 7 | byte & 0x7F
        if byte & 0x80:
            return value, k + 1
    raise Damaged


def number_at_end(data: bytes) -> int:
    """Value that the last four bytes at most hold, read up to the end; a marked byte begins it anew."""
    value = 0
    for byte in data[-4:]:
        value = (0 if byte & 0x80 else value) << 7 | byte & 0x7F
    return value


def write_number(value: int) -> bytes:
    if value < 0x80:
        return _ONE_BYTE[value]
    groups = [value & 0x7F]
    while value := value >> 7:
        groups.append(value & 0x7F)
    groups[0] |= 0x80
    return bytes(reversed(groups))


# -- record 0 -------------------------------------------------------------------------------------------------------

#: Fields of record 0: name, place, struct code, whether it is a record index (which has -1 for none).
HEADER = (
    ("compression", 0, "H", False),
    ("text_length", 4, "I", False),
    ("text_records", 8, "H", False),
    ("record_size", 10, "H", False),
    ("encryption", 12, "H", False),
    ("length", 20, "I", False),
    ("type", 24, "I", False),
    ("codepage", 28, "I", False),
    ("uid", 32, "I", False),
    ("version", 36, "I", False),
    ("title_offset", 84, "I", False),
    ("title_length", 88, "I", False),
    ("region", 94, "B", False),
    ("language", 95, "B", False),
    ("first_image", 108, "I", True),
    ("huffcdic", 112, "I", True),
    ("num_huffcdic", 116, "I", False),
    ("exth_flag", 128, "I", False),
    ("drm_offset", 168, "I", True),
    ("drm_count", 172, "I", False),
    ("flags", 242, "H", False),
    ("indx", 244, "I", True),
    ("fdst", 192, "I", True),
    ("num_fdst", 196, "I", False),
    ("frag", 248, "I", True),
    ("skel", 252, "I", True),
    ("guide", 260, "I", True),
)
_ONLY_KF8 = {"fdst", "num_fdst", "frag", "skel", "guide"}


def _layout(kf8: bool) -> tuple[list[str], int, struct.Struct]:
    """Names of a whole header's fields by their place, where the last ends, and all of them as one struct."""
    names, at, code = [], 0, ">"
    for name, place, kind, _ in sorted((f for f in HEADER if kf8 or f[0] not in _ONLY_KF8), key=lambda f: f[1]):
        names.append(name)
        code += f"{place - at}x{kind}"
        at = place + struct.calcsize(kind)
    return names, at, struct.Struct(code)


_INDEXES = [name for name, _, _, is_index in HEADER if is_index]
_WHOLE = {kf8: _layout(kf8) for kf8 in (False, True)}
_ENCRYPTED, _UNKNOWN_PACKING = "DRM", "UnsupportedCompression"


def read_header(record: bytes) -> dict:
    """Fields, title, metadata entries and edge (the second half's record 0, if any) of a record 0.

    A field beyond the declared length keeps its default.

    The order of the checks is the format's readers': a protected book is refused as such before any later damage shows.
    """
    if len(record) < 24 or record[16:20] != b"MOBI":
        raise Damaged
    if struct.unpack_from(">H", record, 12)[0]:
        raise Damaged(_ENCRYPTED)
    end = 16 + struct.unpack_from(">I", record, 20)[0]
    if end < 40 or end > len(record):
        raise Damaged
    out = {}
    # a header that has every field is read at once
    version = struct.unpack_from(">I", record, 36)[0]
    fields, last, layout = _WHOLE[version >= 8]
    if end >= last:
        out = dict(zip(fields, layout.unpack_from(record), strict=True))
        for name in _INDEXES:
            if out.setdefault(name, -1) >= 1 << 31:
                out[name] -= 1 << 32
        out.setdefault("num_fdst", 0)
    for name, at, code, is_index in HEADER if not out else ():
        there = at + struct.calcsize(code) <= end and (name not in _ONLY_KF8 or out["version"] >= 8)
        value = struct.unpack_from(">" + code, record, at)[0] if there else -1 if is_index else 0
        out[name] = value - (1 << 32) if is_index and value >= 1 << 31 else value
    if out["drm_offset"] != -1 and out["drm_count"]:
        raise Damaged(_ENCRYPTED)
    if out["codepage"] not in (1252, 65001):
        raise Damaged
    if out["compression"] not in (1, 2, 17480):
        raise Damaged(_UNKNOWN_PACKING)
    last = out["title_offset"] + out["title_length"]
    if out["title_length"] and last > len(record):
        raise Damaged
    title = record[out["title_offset"] : last] if out["title_length"] else None
    exth = read_exth(record, end) if out["exth_flag"] & 0x40 else None
    places = [data for kind, data in exth or () if kind == 121][-1:]
    edge = int.from_bytes(places[0], "big") if places and len(places[0]) in (1, 2, 4) else 0xFFFFFFFF
    return out | {"title": title, "exth": exth, "edge": None if edge == 0xFFFFFFFF or out["version"] >= 8 else edge}


def read_exth(record: bytes, at: int) -> list[tuple[int, bytes]]:
    """(type, data) of the metadata block's entries, in file order."""
    if at + 12 > len(record) or record[at : at + 4] != b"EXTH":
        raise Damaged
    length, count = struct.unpack_from(">2I", record, at + 4)
    if length < 12 or at + length > len(record):
        raise Damaged
    end, at, out = min(at + length + -length % 4, len(record)), at + 12, []
    for _ in range(count):
        if at + 8 > end:
            raise Damaged
        kind, size = struct.unpack_from(">2I", record, at)
        if size < 8 or at + size > end:
            raise Damaged
        out.append((kind, record[at + 8 : at + size]))
        at += size
    return out


# -- text records ---------------------------------------------------------------------------------------------------


def strip_trailers(record: bytes, version: int, flags: int) -> bytes:
    """A text record without the entries that the flags announce behind it, and without overlapping characters."""
    if version < 5:
        return record
    for _ in range((flags >> 1).bit_count()):
        size = number_at_end(record)
        if not 0 < size <= len(record):
            raise Damaged
        record = record[:-size]
    if flags & 1:
        if not record or (size := (record[-1] & 3) + 1) > len(record):
            raise Damaged
        record = record[:-size]
    return record


#: Records that are unpacked at a time, and bytes of one from which on it is read item by item.
_TOGETHER, _LONG = 16, 1 << 16
#: Bytes that an item takes, by its first byte.
_TAKES = bytes([1, *range(2, 10), *[1] * 0x77, *[2] * 0x40, *[1] * 0x40])


def unpack_palmdoc(data: bytes) -> bytes:
    return unpack_palmdoc_all([data])


def unpack_palmdoc_all(records: list[bytes]) -> bytes:
    """The records' text, laid end to end; no record reaches back into another."""
    if any(len(r) > _LONG for r in records):
        return b"".join(_unpack_long(r) if len(r) > _LONG else _unpack_some([r]) for r in records)
    return b"".join(_unpack_some(records[k : k + _TOGETHER]) for k in range(0, len(records), _TOGETHER))


def _unpack_some(records: list[bytes]) -> bytes:
    joined = b"".join(records)
    if not joined:
        return b""
    step, items, firsts, at, end = joined.translate(_TAKES), [], [], 0, 0
    put = items.append
    for r in records:
        firsts.append(len(items))
        end += len(r)
        while at < end:
            put(at)
            at += step[at]
        if at > end:
            raise Damaged
    d, at = np.frombuffer(joined, np.uint8), np.array(items, np.int64)
    op = d[at]
    copies, pairs, runs = np.flatnonzero((op >= 0x80) & (op < 0xC0)), np.flatnonzero(op >= 0xC0), np.flatnonzero((op >= 1) & (op <= 8))
    word = op[copies].astype(np.int64) << 8 | d[at[copies] + 1]
    size = np.ones(len(at), np.int64)
    size[pairs], size[runs], size[copies] = 2, op[runs], (word & 7) + 3
    edge = np.concatenate(([0], np.cumsum(size)))
    to, out = edge[:-1], np.empty(int(edge[-1]), np.uint8)
    out[to] = op
    out[to[pairs]] = 0x20
    out[to[pairs] + 1] = op[pairs] ^ 0x80
    for k in range(int(op[runs].max(initial=0))):
        m = runs[op[runs] > k]
        out[to[m] + k] = d[at[m] + 1 + k]
    if not len(copies):
        return out.tobytes()
    back, size, to, firsts = word >> 3 & 0x7FF, size[copies], to[copies], np.array(firsts)
    if not back.all() or (to - back < edge[firsts[np.searchsorted(firsts, copies, "right") - 1]]).any():
        raise Damaged
    turn = np.cumsum(size)
    places = np.arange(int(turn[-1])) + np.repeat(to - turn + size, size)
    source, there = np.arange(len(out)), places - np.repeat(back, size)
    source[places] = there
    # a byte may be the copy of a copy: each round doubles the way back that is gone at once
    while len(places):
        further = source[there]
        more = np.flatnonzero(further != there)
        places, there = places[more], further[more]
        source[places] = there
    return out[source].tobytes()


_RUN = re.compile(rb"[\x00\x09-\x7f]+")


def _unpack_long(data: bytes) -> bytes:
    """Item by item: takes no more memory than the text."""
    out, at, end, size, run = bytearray(), 0, len(data), 0, _RUN.match
    while at < end:
        op = data[at]
        if op >= 0xC0:
            out.append(0x20)
            out.append(op ^ 0x80)
            at += 1
            size += 2
        elif op >= 0x80:
            if at + 2 > end:
                raise Damaged
            back, length = (op & 0x3F) << 5 | data[at + 1] >> 3, (data[at + 1] & 7) + 3
            first = size - back
            if not back or first < 0:
                raise Damaged
            # a copy that reaches itself repeats its beginning
            out += out[first : first + length] if back >= length else (out[first:] * (length // back + 1))[:length]
            at += 2
            size += length
        elif op >= 9 or not op:
            stop = run(data, at).end()
            out += data[at:stop]
            size += stop - at
            at = stop
        else:
            at += 1
            if at + op > end:
                raise Damaged
            out += data[at : at + op]
            at += op
            size += op
    return bytes(out)


class Phrases:
    """A book's Huffman tables and phrase dictionary. Phrases are expanded once, in order of first use."""

    def __init__(self, tables: bytes, dictionaries: list[bytes]):
        if len(tables) < 24 or tables[:4] != b"HUFF":
            raise Damaged
        quick, ranges = struct.unpack_from(">2I", tables, 8)
        if quick + 1024 > len(tables) or ranges + 256 > len(tables):
            raise Damaged
        self.quick = [(v & 0x1F, bool(v & 0x80), v >> 8) for v in struct.unpack_from(">256I", tables, quick)]
        flat = struct.unpack_from(">64I", tables, ranges)
        self.low, self.high = (0, *flat[::2]), (0, *flat[1::2])
        self.phrases: list[bytes] = []
        self.plain: list[bool] = []
        for d in dictionaries:
            self._add(d)

    def _add(self, data: bytes) -> None:
        if len(data) < 16 or data[:4] != b"CDIC":
            raise Damaged
        area, total, bits = struct.unpack_from(">3I", data, 4)
        n = total - len(self.phrases)
        if area > len(data) or n < 0:
            raise Damaged
        n = min(n, 1 << min(bits, 40))
        if area + 2 * n > len(data):
            raise Damaged
        # places of the phrases' heads, and the heads: length, and whether the phrase is text as it stands
        at = np.frombuffer(data, ">u2", n, area).astype(np.int64) + area
        if n and int(at.max()) + 2 > len(data):
            raise Damaged
        raw = np.frombuffer(data, np.uint8)
        head = raw[at].astype(np.int64) << 8 | raw[at + 1]
        end = at + 2 + (head & 0x7FFF)
        if n and int(end.max()) > len(data):
            raise Damaged
        self.phrases += [data[a:b] for a, b in zip((at + 2).tolist(), end.tolist(), strict=True)]
        self.plain += (head >= 0x8000).tolist()

    def codes(self, data: bytes) -> list[int]:
        """Phrase numbers of a bit string."""
        length, padded, at, out = 8 * len(data), data + bytes(8), 0, []
        quick, low, high, known, word = self.quick, self.low, self.high, len(self.phrases), struct.Struct(">Q").unpack_from
        while at < length:
            # the 32 bits from this place on
            bits = word(padded, at >> 3)[0] >> (32 - (at & 7)) & 0xFFFFFFFF
            size, final, value = quick[bits >> 24]
            if not size:
                raise Damaged
            if not final:
                while size <= 32 and bits >> (32 - size) < low[size]:
                    size += 1
                if size > 32:
                    raise Damaged
                value = high[size]
            at += size
            if at > length:
                break
            # numbers wrap at 32 bits, as the tables are unsigned
            number = value - (bits >> (32 - size)) & 0xFFFFFFFF
            if number >= known:
                raise Damaged
            out.append(number)
        return out

    def unpack(self, data: bytes) -> bytes:
        """Expansion with a stack of our own: phrases nest deeper than Python's calls may."""
        phrases, plain = self.phrases, self.plain
        stack, busy = [(None, iter(self.codes(data)), bytearray())], set()
        while True:
            number, codes, out = stack[-1]
            for code in codes:
                if not plain[code]:
                    if code in busy or len(stack) > MOST_NESTED:
                        raise Damaged
                    busy.add(code)
                    stack.append((code, iter(self.codes(phrases[code])), bytearray()))
                    break
                out += phrases[code]
                if len(out) > MOST_OUTPUT:
                    raise Damaged
            else:
                stack.pop()
                if not stack:
                    return bytes(out)
                busy.discard(number)
                phrases[number], plain[number] = bytes(out), True
                stack[-1][2].extend(out)
                if len(stack[-1][2]) > MOST_OUTPUT:
                    raise Damaged


def assemble_text(records: list[bytes | None], tables: list[bytes], tables_status: str, compression: int, version: int, flags: int) -> bytes:
    """A half's text: each record stripped, unpacked, and laid end to end. None stands for a record past the file."""
    unpack, out = None, []
    for record in records:
        if record is None:
            # damage of the records before it comes first
            if compression == 2:
                unpack_palmdoc_all(out)
            raise Damaged(RANGE)
        record = strip_trailers(record, version, flags)
        if compression == 17480 and unpack is None:
            if tables_status != OK:
                raise Damaged(tables_status)
            unpack = Phrases(tables[0], tables[1:]).unpack
        out.append(unpack(record) if unpack else record)
    return unpack_palmdoc_all(out) if compression == 2 else b"".join(out)


# -- indexes --------------------------------------------------------------------------------------------------------


def _index_head(record: bytes) -> dict:
    if len(record) < 56 or record[:4] != b"INDX":
        raise Damaged
    w = struct.unpack_from(">14I", record)
    return {"tags": w[1], "offsets": w[5], "count": w[6], "codepage": w[7], "pools": w[13]}


def _tag_rows(record: bytes, at: int) -> tuple[int, bytes]:
    if at + 12 > len(record) or record[at : at + 4] != b"TAGX":
        raise Damaged
    size, controls = struct.unpack_from(">2I", record, at + 4)
    if size < 12 or at + size > len(record):
        raise Damaged
    return controls, record[at + 12 : at + size - size % 4]


@lru_cache(1024)
def _simple_plan(rows: bytes, control: int) -> list[tuple[int, int]] | None:
    """Tags and numbers of values that one control byte tells; None where a tag's values are told by their size, or rows go on behind the byte."""
    marks = rows[3::4]
    if not marks or not marks[-1] & 1 or any(m & 1 for m in marks[:-1]):
        return None
    out = []
    for tag, per, mask, _ in struct.iter_unpack("4B", rows[:-4]):
        bits = control & mask
        if bits and bits == mask and mask.bit_count() > 1:
            return None
        if bits:
            out.append((tag, per if bits == mask else per * (bits >> ((mask & -mask).bit_length() - 1))))
    return out


def _tag_values(record: bytes, at: int, controls: int, rows: bytes) -> dict[int, list[int]]:
    """Values of an entry's tags: first what the control bytes say of each tag, then the values one after another."""
    data = at + controls
    if data > len(record):
        raise Damaged
    if controls == 1 and (simple := _simple_plan(rows, record[at])) is not None:
        out = {}
        for tag, count in simple:
            values = out[tag] = []
            for _ in range(count):
                value, used = read_number(record, data)
                values.append(value)
                data += used
        return out
    plan, control = [], at
    for tag, per, mask, last in struct.iter_unpack("4B", rows):
        if last & 1:
            control += 1
            continue
        if control >= len(record):
            raise Damaged
        bits = record[control] & mask
        if not bits:
            continue
        if bits == mask and mask.bit_count() > 1:
            size, used = read_number(record, data)
            data += used
            plan.append((tag, None, size))
        else:
            groups = 1 if bits == mask else bits >> ((mask & -mask).bit_length() - 1)
            plan.append((tag, groups * per, None))
    out = {}
    for tag, count, size in plan:
        values, begin = [], data
        while len(values) < count if size is None else data - begin < size:
            value, used = read_number(record, data)
            values.append(value)
            data += used
        if size is not None and data - begin != size:
            raise Damaged
        out[tag] = values
    return out


def _pool(records: list[bytes]) -> dict[int, bytes]:
    out = {}
    for k, record in enumerate(records):
        at = 0
        while at < len(record) and record[at]:
            size, used = read_number(record, at)
            if at + used + size > len(record):
                raise Damaged
            out[(k << 16) + at] = record[at + used : at + used + size]
            at += used + size
    return out


def read_index(records: list[bytes]) -> tuple[int, list[tuple[bytes, dict]], dict[int, bytes]]:
    """(code page, entries, phrases) of an index. records: its first record and what the file holds after it."""
    if not records:
        raise Damaged(RANGE)
    head = _index_head(records[0])
    if head["codepage"] not in (1252, 65001):
        raise Damaged
    controls, rows = _tag_rows(records[0], head["tags"])
    n, pools = head["count"], head["pools"]
    if pools and 1 + n + pools > len(records):
        raise Damaged(RANGE)
    phrases = _pool(records[1 + n : 1 + n + pools])
    entries = []
    for k in range(n):
        if 1 + k >= len(records):
            raise Damaged(RANGE)
        record = records[1 + k]
        own = _index_head(record)
        if own["offsets"] + 4 + 2 * own["count"] > len(record):
            raise Damaged
        for (at,) in struct.iter_unpack(">H", record[own["offsets"] + 4 : own["offsets"] + 4 + 2 * own["count"]]):
            if at >= len(record) or at + 1 + record[at] > len(record):
                raise Damaged
            name = record[at + 1 : at + 1 + record[at]]
            entries.append((name, _tag_values(record, at + 1 + len(name), controls, rows)))
    return head["codepage"], entries, phrases


# -- Kindle Format 8 ------------------------------------------------------------------------------------------------


def read_flows(record: bytes | None, named: bool, size: int) -> list[tuple[int, int]]:
    """Ranges of the raw text; one of all of it where no table is named or the table is empty."""
    if not named:
        return [(0, size)]
    if record is None:
        raise Damaged(RANGE)
    if len(record) < 12 or record[:4] != b"FDST" or 8 * (n := struct.unpack_from(">I", record, 8)[0]) > len(record) - 12:
        raise Damaged
    ranges = list(struct.iter_unpack(">2I", record[12 : 12 + 8 * n]))
    if any(not a <= b <= size for a, b in ranges):
        raise Damaged
    return ranges or [(0, size)]


def read_skeletons(records: list[bytes] | None) -> list[dict]:
    if records is None:
        raise Damaged
    out = []
    for _, v in read_index(records)[1]:
        count, place = v.get(1), v.get(6, ())
        if not count or len(place) < 2:
            raise Damaged
        out.append({"num_frag": count[0], "offset": place[0], "length": place[1]})
    return out


def read_fragments(records: list[bytes] | None) -> list[dict]:
    """Fragments with their place in the text, selector (bytes), file and sequence number and payload range (-1: none)."""
    if records is None:
        raise Damaged
    _, entries, phrases = read_index(records)
    out = []
    for name, v in entries:
        if not re.fullmatch(rb"[+-]?[0-9]+", name) or not -(1 << 63) <= int(name) < 1 << 63:
            raise Damaged
        at, size = (v[6][0], v[6][1]) if len(v.get(6, ())) > 1 else (-1, -1)
        out.append({"insert_offset": int(name), "selector": phrases.get(v[2][0], b"") if v.get(2) else b"", "file_num": v[3][0] if v.get(3) else -1, "seq": v[4][0] if v.get(4) else -1, "offset": at, "length": size})
    return out


def assemble_documents(raw: bytes, base: int, skeletons: list[dict], fragments: list[dict]) -> list[dict]:
    """A document a skeleton: each of its fragments in turn is put in, at a place counted in the document as it has grown.

    The fragments' bytes follow the skeleton's, in the table's order. Text is cut into pieces and joined once, so
    many fragments cost no copy of the document each.
    """
    docs, row = [], 0
    for s in skeletons:
        at = base + s["offset"]
        payload = at + s["length"]
        if payload > len(raw) or row + s["num_frag"] > len(fragments):
            raise Damaged
        document = _Pieces(raw[at:payload])
        for f in fragments[row : row + s["num_frag"]]:
            place = f["insert_offset"] - at
            if f["length"] < 0 or payload + f["length"] > len(raw) or not 0 <= place <= document.size:
                raise Damaged
            document.insert(place, raw[payload : payload + f["length"]])
            payload += f["length"]
        docs.append({"content": b"".join(document.pieces), "linear": s["num_frag"] > 0, "offset": s["offset"], "first_frag": row, "end_frag": row + s["num_frag"]})
        row += s["num_frag"]
    return docs


class _Pieces:
    """Bytes into which others are put. The search for a place starts at the last one, as fragments mostly follow each other."""

    def __init__(self, data: bytes):
        self.pieces, self.size, self.turn, self.start = [data], len(data), 0, 0

    def insert(self, place: int, data: bytes) -> None:
        k, at = self.turn, self.start
        while place < at:
            k -= 1
            at -= len(self.pieces[k])
        while place > at + len(self.pieces[k]):
            at += len(self.pieces[k])
            k += 1
        p = self.pieces[k]
        self.pieces[k : k + 1] = [x for x in (p[: place - at], data, p[place - at :]) if x] or [b""]
        self.turn, self.start, self.size = k, at, self.size + len(data)


def toc_order(nodes: list[dict]) -> list[tuple[int, int, int]]:
    """(node, parent, depth) in reading order. Each node appears once at most, at its first place.

    Parents that are named decide; else ranges of children; else all nodes are roots.
    """
    n = len(nodes)
    children: list = [[] for _ in range(n)]
    if any(x["parent"] >= 0 for x in nodes):
        for k, x in enumerate(nodes):
            if 0 <= x["parent"] < n and x["parent"] != k:
                children[x["parent"]].append(k)
        roots = [k for k, x in enumerate(nodes) if x["level"] == 0] or [k for k, x in enumerate(nodes) if x["parent"] < 0]
    elif any(x["first"] >= 0 or x["last"] >= 0 for x in nodes):
        claimed = [0] * (n + 1)
        own = [0] * n
        for k, x in enumerate(nodes):
            if x["first"] < 0 and x["last"] < 0:
                continue
            low = max(x["first"], 0)
            high = x["last"] if low <= x["last"] < n else n - 1
            if low > high:
                continue
            children[k] = range(low, high + 1)
            claimed[low] += 1
            claimed[high + 1] -= 1
            own[k] = int(low <= k <= high)
        levels = any(x["level"] >= 0 for x in nodes)
        roots = [k for k, c in enumerate(accumulate(claimed[:n])) if c == own[k] and not (levels and nodes[k]["level"] > 0)]
    else:
        roots = list(range(n))
    out, used = [], [False] * n
    for root in roots:
        if used[root]:
            continue
        used[root] = True
        out.append((root, -1, 0))
        path = [(root, iter(children[root]))]
        while path:
            top, rest = path[-1]
            for child in rest:
                if not used[child]:
                    used[child] = True
                    out.append((child, top, len(path)))
                    path.append((child, iter(children[child])))
                    break
            else:
                path.pop()
    return out


# -- resources ------------------------------------------------------------------------------------------------------


def read_font(record: bytes) -> bytes:
    """A font's own bytes: the masked beginning restored, then inflated."""
    if len(record) < 24:
        raise Damaged
    flags, start, size, key = struct.unpack_from(">4I", record, 8)
    if start > len(record):
        raise Damaged
    data = record[start:]
    if flags & 2:
        if not size or key + size > len(record):
            raise Damaged
        n = min(1024 if size == 16 else 1040, len(data))
        mask = (record[key : key + size] * (n // size + 1))[:n]
        data = bytes(a ^ b for a, b in zip(data, mask, strict=False)) + data[n:]
    if flags & 1:
        try:
            inflate = zlib.decompressobj()
            data = inflate.decompress(data)
        except zlib.error:
            raise Damaged from None
        if not inflate.eof:
            raise Damaged
    return data


_SPREAD = {"page-spread-left": "left", "rendition:page-spread-left": "left", "page-spread-right": "right", "rendition:page-spread-right": "right", "rendition:page-spread-center": "center"}


def page_spreads(record: bytes) -> dict[int, str]:
    """Section number to its page's side, from the spine that the record holds; nothing if it can't be read."""
    at = record.find(b"<")
    if at < 0:
        return {}
    doc = record[at:].rstrip(b"\0")
    if b"<package" not in doc:
        doc = b"<package>" + doc + b"</package>"
    try:
        root = ElementTree.fromstring(doc)
    except (ElementTree.ParseError, ValueError, LookupError):
        return {}
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    out = {}
    for spine in (x for x in root if local(x) == "spine"):
        for item in (x for x in spine if local(x) == "itemref"):
            attrs = {k.rpartition("}")[2]: v for k, v in item.attrib.items()}
            side = next((_SPREAD[p] for p in attrs.get("properties", "").split() if p in _SPREAD), "")
            if side and re.fullmatch(r"[+-]?[0-9]{1,9}", attrs.get("skelid", "")):
                out[int(attrs["skelid"])] = side
    return out
