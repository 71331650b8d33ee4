"""Text of a half, its sections and the byte positions that it links to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.arrow import section_ranges
from quire.functions.book import PAGEBREAK
from quire.functions.columns import decoded, latin, part

#: Fixed by the format: links to byte positions; of several in a tag the last counts.
_FILEPOS = r"(?i)<[^<>]+filepos=['\"]?([0-9]+)[^<>]*>"


def cut_sections(raw: Column, tag: bytes = PAGEBREAK) -> Column:
    """Array of struct(start, end): gapless; a tag belongs to the section that it begins; the first starts at 0."""
    return section_ranges(raw, tag)


def text_sections(books: DataFrame) -> DataFrame:
    """path, half, ord, start, end, content (bytes), codepage: sections of the halves before format 8 (books opened with parts raw and sections)."""
    t = books.where("status = 'OK' and not is_kf8").select("path", "half", "raw", F.col("h.codepage").alias("codepage"), F.posexplode("sections").alias("ord", "s"))
    return t.select("path", "half", "ord", "s.start", "s.end", part(F.col("raw"), F.col("s.start"), F.col("s.end") - F.col("s.start")).alias("content"), "codepage")


def load(content: Column, codepage: Column) -> Column:
    """A section's text."""
    return decoded(content, codepage)


def filepos_targets(raw: Column) -> Column:
    """Byte positions that the text links to, each once, ascending; numbers from 2^62 on are left out."""
    found = F.regexp_extract_all(latin(raw), F.lit(_FILEPOS), F.lit(1))
    numbers = F.transform(found, lambda x: x.try_cast("bigint"))
    return F.sort_array(F.array_distinct(F.filter(numbers, lambda x: x < 1 << 62)))
