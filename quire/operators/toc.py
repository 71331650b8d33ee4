"""Tables of contents and guides, from an index or, in books without one, from markup in the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("node", "parent", "depth", "preorder", "label", "start_byte", "length", "fid", "off", "section", "section_offset")


def toc(books: DataFrame) -> DataFrame:
    """A row an entry, in reading order: path, half, node, parent (-1: a root), depth, preorder, label, start_byte, length, fid, off, section, section_offset.

    Numbers that an entry lacks are -1 (books opened with part toc).
    """
    t = books.where("status = 'OK'").select("path", "half", F.explode("toc").alias("e"))
    return t.select("path", "half", *(F.col(f"e.{c}").cast("string").alias(c) if c == "label" else F.col(f"e.{c}") for c in COLUMNS))


def toc_status(books: DataFrame) -> DataFrame:
    """path, half, toc_status, guide_status: damage of an index, which refuses no book, shows here (books opened with parts toc and guide)."""
    return books.where("status = 'OK'").select("path", "half", "toc_status", "guide_status")


def guide(books: DataFrame) -> DataFrame:
    """path, half, ord, label, type, href, filepos: places of note; href of format 8, filepos of the older one, else -1 (books opened with part guide)."""
    t = books.where("status = 'OK'").select("path", "half", F.posexplode("guide").alias("ord", "e"))
    return t.select("path", "half", "ord", F.col("e.label").cast("string").alias("label"), F.col("e.type").cast("string").alias("type"), "e.href", "e.filepos")
