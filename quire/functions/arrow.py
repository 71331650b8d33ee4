"""The codecs as Arrow functions, a batch at a time. Damage becomes a status, so one bad book never fails a job.

Result types are objects: this module is imported by workers, which have no session to parse a type's text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import book
from .codecs import HEADER, OK, Damaged, read_font, read_index


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("status", T.StringType()), *(T.StructField(k, v) for k, v in fields.items())])


_ENTRY = T.StructType([T.StructField("name", T.BinaryType()), T.StructField("values", T.MapType(T.IntegerType(), T.ArrayType(T.LongType())))])


def _each(kind: pa.DataType, run, *columns: pa.Array) -> pa.Array:
    """run over the rows; its result becomes struct(status, ...) with nulls behind a status that isn't OK."""
    rows = []
    for values in zip(*(c.to_pylist() for c in columns), strict=True):
        try:
            rows.append({"status": OK} | run(*values))
        except Damaged as e:
            rows.append({"status": e.status})
    return pa.array(rows, kind)


_HEADER = _struct(**{name: T.LongType() for name, *_ in HEADER}, edge=T.LongType(), title=T.BinaryType(), exth=T.ArrayType(T.StructType([T.StructField("type", T.LongType()), T.StructField("data", T.BinaryType())])))
_LONGS = lambda *names: [T.StructField(n, T.LongType()) for n in names]
_DOC = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("linear", T.BooleanType()), *_LONGS("offset", "first_frag", "end_frag")])
_SECTION = T.StructType(_LONGS("start", "end"))
_FLOW = T.StructType([*_LONGS("start", "end"), T.StructField("content", T.BinaryType())])
_PLACE = T.StructType(_LONGS("fid", "section", "at", "length", "size"))
_TOC = T.StructType([*(T.StructField(n, T.IntegerType()) for n in ("node", "parent", "depth", "preorder")), T.StructField("label", T.BinaryType()), *_LONGS("start_byte", "length", "fid", "off", "section", "section_offset")])
_GUIDE = T.StructType([T.StructField("label", T.BinaryType()), T.StructField("type", T.BinaryType()), T.StructField("href", T.StringType()), *_LONGS("filepos")])
_INDEX = _struct(codepage=T.LongType(), entries=T.ArrayType(_ENTRY), phrases=T.MapType(T.LongType(), T.BinaryType()))
#: Columns that each part of a book adds to a half's row.
_PARTS = {
    "status": [],
    "raw": [T.StructField("raw", T.BinaryType())],
    "sections": [T.StructField("sections", T.ArrayType(_SECTION))],
    "flows": [T.StructField("flows", T.ArrayType(_FLOW))],
    "docs": [T.StructField("docs", T.ArrayType(_DOC))],
    "places": [T.StructField("places", T.ArrayType(_PLACE))],
    "toc": [T.StructField("toc_status", T.StringType()), T.StructField("toc", T.ArrayType(_TOC))],
    "guide": [T.StructField("guide_status", T.StringType()), T.StructField("guide", T.ArrayType(_GUIDE))],
}
_HALF = [
    T.StructField("half", T.StringType()), T.StructField("status", T.StringType()), T.StructField("is_kf8", T.BooleanType()), T.StructField("has_mobi6_half", T.BooleanType()), T.StructField("name", T.BinaryType()), T.StructField("num_records", T.IntegerType()),
    T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("h", T.StructType([f for f in _HEADER if f.name != "status"])), *_LONGS("start", "boundary", "m6_end"), T.StructField("num_resources", T.IntegerType()), T.StructField("spreads", T.MapType(T.IntegerType(), T.StringType())), *_LONGS("flow_count"),
]


#: Bytes of files whose halves become one Arrow array.
_TOGETHER = 8 << 20


def halves_of(content: Column, parts: frozenset, tag: bytes = book.PAGEBREAK, fields: frozenset | None = None) -> Column:
    """Array of the halves of a book file (its bytes), with those parts of them (see book.PARTS) that are asked for; fields: of the others, those that are wanted."""
    kind = T.ArrayType(T.StructType([*(f for f in _HALF if fields is None or f.name in fields), *(f for p in book.PARTS if p in parts for f in _PARTS[p])]))

    @F.arrow_udf(kind)
    def run(files: pa.Array) -> pa.Array:
        pattern, typed = re.compile(tag), to_arrow_type(kind)
        arrays, rows, size = [], [], 0
        for x in files:
            x = x.as_py()
            found = book.halves(x, parts, pattern)
            for half in found:
                half["h"] = _plain(half.get("h"))
                half["spreads"] = _pairs(half.get("spreads"))
            rows.append(found)
            size += len(x or b"")
            if size > _TOGETHER:
                arrays.append(pa.array(rows, typed))
                rows, size = [], 0
        return pa.concat_arrays([*arrays, pa.array(rows, typed)])

    return run(content)


def _plain(header: dict | None) -> dict | None:
    if header is None or header["exth"] is None or header["exth"] and isinstance(header["exth"][0], dict):
        return header
    return header | {"exth": [{"type": t, "data": d} for t, d in header["exth"]]}


def _pairs(spreads: dict | None) -> list | None:
    return None if spreads is None else list(spreads.items())


@F.arrow_udf(_INDEX)
def index_of(records: pa.Array) -> pa.Array:
    def run(r):
        if r is None:
            return {"status": None}
        codepage, entries, phrases = read_index(r)
        return {"codepage": codepage, "entries": [{"name": n, "values": list(v.items())} for n, v in entries], "phrases": list(phrases.items())}

    return _each(to_arrow_type(_INDEX), run, records)


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def unescaped_all(texts: pa.Array) -> pa.Array:
    """HTML character references replaced in UTF-8; bytes that are no UTF-8 stay."""
    return pa.array([None if x is None else [book.unescaped(t) for t in x] for x in texts.to_pylist()], pa.list_(pa.binary()))


def section_ranges(raw: Column, tag: bytes = book.PAGEBREAK) -> Column:
    """Array of struct(start, end): gapless; a tag belongs to the section that it begins; the first starts at 0."""

    @F.arrow_udf(T.ArrayType(_SECTION))
    def run(texts: pa.Array) -> pa.Array:
        pattern = re.compile(tag)
        return pa.array([None if x is None else [{"start": a, "end": b} for a, b in book.section_ends(x, pattern)] for x in texts.to_pylist()], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

    return run(raw)


@F.arrow_udf(_struct(data=T.BinaryType()))
def font_of(record: pa.Array) -> pa.Array:
    return _each(pa.struct([("status", pa.string()), ("data", pa.binary())]), lambda r: {"data": None if r is None else read_font(r)}, record)
