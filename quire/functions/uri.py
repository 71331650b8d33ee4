"""kindle: references: parsing and rendering, native.

Fixed by the format: ``kindle:flow:N`` and ``kindle:embed:N``, both with ``?mime=TYPE`` or without, and
``kindle:pos:fid:N:off:N``; numbers are base 32.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import base32, from_base32

SCHEME, TYPED = "kindle", "?mime="


def parse_uri(uri: Column) -> Column:
    """struct(status, kind, flow, embed, fid, off, mime); fields of another kind are 0 or empty."""
    words = F.split(uri, ":", -1)
    word = lambda k: F.get(words, F.lit(k))
    ours, size, kind = word(0) == SCHEME, F.size(words), word(1)
    # what stands before and behind the type's mark
    cut = F.instr(word(2), TYPED)
    value = F.when(cut > 0, F.substring(word(2), F.lit(1), cut - 1)).otherwise(word(2))
    mime = F.when(cut > 0, F.substring(word(2), cut + len(TYPED), F.length(word(2)))).otherwise("")
    number, fid, off = from_base32(value), from_base32(word(3)), from_base32(word(5))
    resource = ours & (size == 3) & kind.isin("flow", "embed") & number.isNotNull() & ((cut == 0) | mime.rlike(r"\A[0-9A-Za-z_/+.-]+\z"))
    place = ours & (size == 6) & (kind == "pos") & (word(2) == "fid") & (word(4) == "off") & fid.isNotNull() & off.isNotNull()
    resource, place = F.coalesce(resource, F.lit(False)), F.coalesce(place, F.lit(False))
    none = F.lit(0).cast("long")
    return F.struct(
        F.when(resource | place, "OK").otherwise("NotKindleURI").alias("status"),
        F.when(resource | place, kind).otherwise("").alias("kind"),
        F.when(resource & (kind == "flow"), number).otherwise(none).alias("flow"),
        F.when(resource & (kind == "embed"), number).otherwise(none).alias("embed"),
        F.when(place, fid).otherwise(none).alias("fid"),
        F.when(place, off).otherwise(none).alias("off"),
        F.when(resource, mime).otherwise("").alias("mime"),
    )


def place_uri(fid: Column, off: Column) -> Column:
    """The reference to a byte of a fragment."""
    return F.concat(F.lit(f"{SCHEME}:pos:fid:"), base32(fid, 4), F.lit(":off:"), base32(off, 10))
