"""A book file in memory: its halves, each with header, text, documents, contents, places of note and resources.

One pass over a file gives whatever a table asks for, so no text is decoded twice. Offsets are byte offsets; text is kept
as bytes, so that bytes which are no UTF-8 come through as they are.
"""

from __future__ import annotations

import html
import re
import struct
from bisect import bisect_right

from .codecs import CORRUPT, OK, RANGE, Damaged, assemble_documents, assemble_text, page_spreads, read_flows, read_fragments, read_header, read_index, read_skeletons, toc_order
from .columns import CP1252, CP1252_HIGH

TABLE, ENTRY = 78, 8
PACKED = 17480
NOT_A_CONTAINER = "NotPalmDB"
#: What ``halves`` can give besides headers; "status" decodes the text and gives nothing of it.
PARTS = ("status", "raw", "sections", "flows", "docs", "places", "toc", "guide")
#: Fixed by the format: the tag at which pages, and so sections, begin.
PAGEBREAK = rb"(?i)<[\t\n\f\r ]*(?:mbp:)?pagebreak[^>]*>"

_HIGH = {0x80 + k: c for k, c in enumerate(CP1252_HIGH)}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


class Container:
    """Records of a file whose table is sound."""

    def __init__(self, content: bytes | None):
        size = len(content or b"")
        if size < TABLE or content[60:68] not in (b"BOOKMOBI", b"TEXtREAd"):
            raise Damaged(NOT_A_CONTAINER)
        n = int.from_bytes(content[76:78], "big")
        end = TABLE + n * ENTRY
        if not n or end > size:
            raise Damaged
        starts = list(struct.unpack_from(f">{2 * n}I", content, TABLE)[::2])
        if starts[0] < end or starts != sorted(starts) or starts[-1] > size:
            raise Damaged
        self.content, self.offsets, self.n = content, [*starts, size], n
        self.name = content[:32].split(b"\0", 1)[0].rstrip(b" ")

    def record(self, i: int) -> bytes | None:
        return self.content[self.offsets[i] : self.offsets[i + 1]] if 0 <= i < self.n else None

    def run(self, first: int, count: int) -> list[bytes | None]:
        return [self.record(first + k) for k in range(count)]

    def magic(self, i: int) -> bytes:
        return self.record(i)[:4]

    def index(self, at: int) -> list[bytes | None]:
        """Records of the index at record ``at``, as far as the file has them, counted by its first record."""
        head = self.record(at) or b""
        word = lambda k: int.from_bytes(head[k : k + 4], "big") if len(head) >= k + 4 else 0
        return self.run(at, max(0, min(1 + word(24) + word(52), self.n - at)))


# -- text -----------------------------------------------------------------------------------------------------------


def utf8(data: bytes, codepage: int) -> bytes:
    """Text of a code page as UTF-8; bytes of UTF-8 are taken over unchecked."""
    return data.decode("latin-1").translate(_HIGH).encode() if codepage == CP1252 else data


def unescaped(text: bytes) -> bytes:
    """UTF-8 with character references replaced; other bytes stay as they are."""
    return html.unescape(text.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape") if b"&" in text else text


def section_ends(raw: bytes, tag: re.Pattern) -> list[tuple[int, int]]:
    """Gapless ranges: a tag belongs to the section that it begins; the first starts at 0."""
    cuts = [m.start() for m in tag.finditer(raw)]
    return list(zip([0, *cuts], [*cuts, len(raw)], strict=True))


# -- markup ---------------------------------------------------------------------------------------------------------


def block(raw: bytes, name: bytes) -> bytes:
    """What the first element of that name (without attributes) holds, up to the nearest end tag; names have no case."""
    m = re.search(b"(?is)<%s>(.*?)</%s>" % (name, name), raw)
    return m[1] if m else b""


def tags(text: bytes, name: bytes):
    """(attributes, text up to the next tag) of each tag of that name."""
    for m in re.finditer(rb"(?is)<%s(?![0-9a-z_])([^>]*)>([^<]*)" % name, text):
        yield m[1], m[2]


def attribute(attributes: bytes, name: bytes, read):
    """What read makes of the bytes behind the first ``name =`` for which that is something."""
    for m in re.finditer(rb"(?i)%s[\t\n\f\r ]*=[\t\n\f\r ]*" % name, attributes):
        value = read(attributes[m.end() :])
        if value is not None:
            return value
    return None


def number(rest: bytes) -> int | None:
    """Leading digits, behind a quotation mark or none."""
    m = re.match(rb"['\"]?([0-9]+)", rest)
    return int(m[1]) if m else None


def quoted(rest: bytes) -> bytes | None:
    """What stands between quotation marks of either kind."""
    m = re.match(rb"['\"]([^'\"]*)['\"]", rest)
    return m[1] if m else None


def _fits(value: int | None) -> bool:
    return value is not None and value < 1 << 63


# -- contents and places of note ------------------------------------------------------------------------------------


def _row(node, parent, depth, preorder, label, start=-1, length=-1, fid=-1, off=-1, section=-1, section_offset=-1) -> dict:
    return {"node": node, "parent": parent, "depth": depth, "preorder": preorder, "label": label, "start_byte": start, "length": length, "fid": fid, "off": off, "section": section, "section_offset": section_offset}


def marked_toc(raw: bytes, codepage: int) -> list[dict]:
    """Contents from the text's own markup. An entry's parent is the nearest one before it of a lesser depth."""
    out, path = [], []
    for attributes, label in tags(block(raw, b"toc"), b"tocpoint"):
        start, depth = attribute(attributes, b"filepos", number), attribute(attributes, b"tocdepth", number)
        if not _fits(start):
            continue
        depth = depth if _fits(depth) else 0
        while path and path[-1][1] >= depth:
            path.pop()
        out.append(_row(len(out), path[-1][0] if path else -1, len(path), len(out), unescaped(utf8(label, codepage)), start))
        path.append((len(out) - 1, depth))
    return out


_NONE = (-1,)


def indexed_toc(records: list, places: dict) -> list[dict]:
    """Contents from an index, in reading order."""
    codepage, entries, phrases = read_index(records)
    nodes = [{"level": (v.get(4) or _NONE)[0], "parent": (v.get(21) or _NONE)[0], "first": (v.get(22) or _NONE)[0], "last": (v.get(23) or _NONE)[0]} for _, v in entries]
    out = []
    for turn, (node, parent, depth) in enumerate(toc_order(nodes)):
        v = entries[node][1]
        pair = v.get(6) or _NONE
        fid, off = pair[0], pair[1] if len(pair) > 1 else -1
        at = fid >= 0 and locate(places, fid, off) or (-1, -1)
        label = utf8(phrases.get(v[3][0], b""), codepage) if v.get(3) else b""
        out.append({"node": node, "parent": parent, "depth": depth, "preorder": turn, "label": unescaped(label), "start_byte": (v.get(1) or _NONE)[0], "length": (v.get(2) or _NONE)[0], "fid": fid, "off": off, "section": at[0], "section_offset": at[1]})
    return out


def marked_guide(raw: bytes, codepage: int) -> list[dict]:
    out = []
    for attributes, _ in tags(block(raw, b"guide"), b"reference"):
        at = attribute(attributes, b"filepos", number)
        if _fits(at):
            label = unescaped(utf8(attribute(attributes, b"title", quoted) or b"", codepage))
            out.append({"label": label, "type": attribute(attributes, b"type", quoted) or b"", "href": "", "filepos": at})
    return out


def base32(value: int, digits: int) -> str:
    out = ""
    while value or len(out) < digits:
        out, value = _DIGITS[value % 32] + out, value // 32
    return out


def indexed_guide(records: list) -> list[dict]:
    codepage, entries, phrases = read_index(records)
    out = []
    for name, v in entries:
        pair, single = v.get(6, ()), v.get(3, ())
        fid = pair[0] if pair else single[0] if single else -1
        off = pair[1] if len(pair) > 1 else 0
        label = utf8(phrases.get(v[1][0], b""), codepage) if v.get(1) else b""
        kind = name.split(None, 1)
        out.append({"label": unescaped(label), "type": kind[0] if kind else b"", "href": f"kindle:pos:fid:{base32(fid, 4)}:off:{base32(off, 10)}" if fid >= 0 else "", "filepos": -1})
    return out


def fragment_places(base: int, docs: list[dict], frags: list[dict]) -> dict[int, tuple[int, int, int, int]]:
    """Fragment number to (section, place in it, length, section's size). A fragment goes by its sequence number (the first row that has it), else by its row."""
    rows = {}
    for k, f in enumerate(frags):
        if f["seq"] >= 0:
            rows.setdefault(f["seq"], k)
    for k in range(len(frags)):
        rows.setdefault(k, k)
    starts, out = [d["first_frag"] for d in docs], {}
    for fid, k in rows.items():
        s = bisect_right(starts, k) - 1
        if s >= 0 and k < docs[s]["end_frag"]:
            f, d = frags[k], docs[s]
            out[fid] = (s, f["insert_offset"] - base - d["offset"], f["length"], len(d["content"]))
    return out


def locate(places: dict, fid: int, off: int) -> tuple[int, int] | None:
    """(section, offset) of a byte of a fragment; None if it can't be resolved."""
    if fid < 0 or off < 0 or (place := places.get(fid)) is None:
        return None
    section, at, length, size = place
    return (section, at + off) if off <= length and 0 <= at + off <= size else None


# -- halves ---------------------------------------------------------------------------------------------------------


def _status(run) -> tuple[str, object]:
    try:
        return OK, run()
    except Damaged as e:
        return e.status, None


def _header(file: Container, at: int) -> dict:
    record = file.record(at)
    if record is None:
        raise Damaged(RANGE)
    return read_header(record)


def _resources(file: Container, half: dict) -> tuple[int, int]:
    """(number of resources, first record after them): the run ends at the contents index if that lies in it, else at the first index record, else at the half's end."""
    h, first = half["h"], half["h"]["first_image"]
    if first < 0:
        return 0, first
    end = min([file.n, *([half["boundary"] - 1] if half["boundary"] >= 0 else []), *([half["m6_end"]] if half["m6_end"] > 0 else [])])
    indx = half["start"] + h["indx"] if h["indx"] >= 0 else -1
    if first < indx < end:
        end = indx
    else:
        end = next((i for i in range(first, min(end, file.n)) if file.magic(i) == b"INDX"), end)
    return max(end - first, 0), end


def _body(file: Container, half: dict, want: frozenset, tag: re.Pattern) -> None:
    """Adds what is wanted of a half's text; damage of an index of contents refuses no book, but shows as that table's status."""
    h, start = half["h"], half["start"]
    first, count = start + h["huffcdic"], h["num_huffcdic"]
    tables_status = CORRUPT if h["huffcdic"] < 0 or count < 1 else RANGE if first + count > file.n else OK
    tables = file.run(first, count) if h["compression"] == PACKED and tables_status == OK else []
    raw = assemble_text(file.run(start + 1, h["text_records"]), tables, tables_status, h["compression"], h["version"], h["flags"])
    flows, docs, places = None, None, {}
    if half["is_kf8"]:
        flows = read_flows(file.record(start + h["fdst"]) if h["fdst"] >= 0 else None, h["fdst"] >= 0, len(raw))
        index = lambda name: file.index(start + h[name]) if h[name] >= 0 else None
        skeletons, frags = read_skeletons(index("skel")), read_fragments(index("frag"))
        docs = assemble_documents(raw, flows[0][0], skeletons, frags)
        if want & {"places", "toc"}:
            places = fragment_places(flows[0][0], docs, frags)
    if "raw" in want:
        half["raw"] = raw
    if "sections" in want and not half["is_kf8"]:
        half["sections"] = [{"start": a, "end": b} for a, b in section_ends(raw, tag)]
    if flows is not None:
        half["flow_count"] = len(flows)
        if "flows" in want:
            half["flows"] = [{"start": a, "end": b, "content": raw[a:b]} for a, b in flows]
        if "docs" in want:
            half["docs"] = docs
        if "places" in want:
            half["places"] = [{"fid": fid, "section": p[0], "at": p[1], "length": p[2], "size": p[3]} for fid, p in sorted(places.items())]
    if "toc" in want:
        if h["indx"] >= 0:
            half["toc_status"], half["toc"] = _status(lambda: indexed_toc(file.index(start + h["indx"]), places))
        elif not half["is_kf8"]:
            half["toc"] = marked_toc(raw, h["codepage"])
    if "guide" in want:
        if half["is_kf8"]:
            if h["guide"] >= 0:
                half["guide_status"], half["guide"] = _status(lambda: indexed_guide(file.index(start + h["guide"])))
        else:
            half["guide"] = marked_guide(raw, h["codepage"])


def halves(content: bytes | None, want: frozenset, tag: re.Pattern) -> list[dict]:
    """A dict a half. ``main`` is the half that a book opens as: of a combined file that is the Kindle Format 8 half, which
    then shares the other half's images; ``mobi6`` is the other. A file that is refused has one row, with the reason.
    """
    row = {"half": "main", "status": OK, "start": 0, "boundary": -1, "m6_end": -1, "is_kf8": False, "has_mobi6_half": False, "num_resources": 0, "toc_status": OK, "guide_status": OK}
    row["status"], file = _status(lambda: Container(content))
    if file is None:
        return [row]
    row |= {"name": file.name, "offsets": file.offsets, "num_records": file.n}
    row["status"], h = _status(lambda: _header(file, 0))
    if h is None:
        return [row]
    row |= {"h": h, "is_kf8": h["version"] >= 8}
    out = [row]
    if (edge := h["edge"]) is not None:
        status, new = _status(lambda: _header(file, edge))
        if new is not None and new["version"] < 8:
            status = CORRUPT
        if status != OK:
            return [row | {"status": status}]
        shared = new | {"first_image": h["first_image"]} if h["first_image"] >= 0 else new
        out = [row | {"h": shared, "start": edge, "boundary": edge, "is_kf8": True, "has_mobi6_half": True}, row | {"half": "mobi6", "m6_end": edge - 1}]
    for half in out:
        half["num_resources"], end = _resources(file, half)
        if half["is_kf8"] and half["num_resources"]:
            spine = next((i for i in range(half["h"]["first_image"], end) if file.magic(i) == b"RESC"), None)
            half["spreads"] = page_spreads(file.record(spine)) if spine is not None else None
        if want:
            damage, _ = _status(lambda half=half: _body(file, half, want, tag))
            if damage != OK:
                half["status"] = damage
    return out
