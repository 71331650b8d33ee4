"""Native column helpers over BINARY: every offset is a byte offset, counted from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABSENT = 0xFFFFFFFF
UTF8, CP1252 = 65001, 1252

#: The characters of Windows-1252 for bytes 80 to 9F, as published by the Unicode consortium
#: (the five unassigned bytes stay control characters).
CP1252_HIGH = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
_LATIN_HIGH = "".join(map(chr, range(0x80, 0xA0)))


def part(data: Column, start: Column | int, length: Column | int) -> Column:
    """Bytes [start, start + length) of data, cut off at its end."""
    return F.substring(data, F.lit(start).cast("int") + 1, F.lit(length).cast("int"))


def unsigned(data: Column, at: Column | int, size: int) -> Column:
    """Big-endian unsigned number; null where data ends before it."""
    piece = part(data, at, size)
    return F.when(F.octet_length(piece) == size, F.conv(F.hex(piece), 16, 10).cast("long"))


def index_field(value: Column) -> Column:
    """A record index: all bits set means none (-1); else a signed 32-bit number."""
    return F.when(value == ABSENT, -1).when(value >= 1 << 31, value - (1 << 32)).otherwise(value)


def latin(data: Column) -> Column:
    """One character a byte, so that string functions count bytes."""
    return F.decode(data, "ISO-8859-1")


def unlatin(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def decoded(data: Column, codepage: Column) -> Column:
    """Text of bytes in one of the two code pages; UTF-8 bytes are taken over unchecked."""
    return F.when(codepage == CP1252, F.translate(latin(data), _LATIN_HIGH, CP1252_HIGH)).otherwise(data.cast("string"))


def magic(record: Column) -> Column:
    """First four bytes, filled up with zero bytes."""
    return F.rpad(part(record, 0, 4), F.lit(4), F.lit(b"\0"))


def ascii_bytes(text: str) -> Column:
    return F.lit(text.encode("ascii"))


def base32(value: Column, digits: int) -> Column:
    """Upper-case base-32 digits, at least so many."""
    plain = F.upper(F.conv(value.cast("string"), 10, 32))
    return F.lpad(plain, F.greatest(F.lit(digits), F.length(plain)), F.lit("0"))


def from_base32(text: Column) -> Column:
    """Signed 64-bit number of base-32 digits in either case; null for other characters or a number too large."""
    fits = text.rlike(r"\A0*(?:[0-7][0-9A-Va-v]{12}|[0-9A-Va-v]{1,12})\z")
    return F.when(fits, F.conv(F.when(fits, text).otherwise("0"), 32, 10).cast("long"))
