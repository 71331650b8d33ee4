"""Kindle Format 8: positions, documents and flows of opened books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import decoded


def locate(fid: Column, off: Column, places: str = "places") -> Column:
    """struct(section, offset) of a byte of a fragment; null if it can't be resolved.

    places are sorted by the fragments' numbers, which mostly count from 0, so a number is nearly always its place.
    """
    there = F.get(F.col(places), fid.cast("int"))
    p = F.when(there["fid"] == fid, there).otherwise(F.get(F.filter(places, lambda x: x["fid"] == fid), F.lit(0)))
    at = p["at"] + off
    good = (fid >= 0) & (off >= 0) & (off <= p["length"]) & (at >= 0) & (at <= p["size"])
    return F.when(good, F.struct(p["section"].alias("section"), at.alias("offset")))


def kf8_sections(books: DataFrame) -> DataFrame:
    """path, half, ord, size_bytes, linear, page_spread, content (bytes), xhtml (books opened with part docs)."""
    t = books.where("status = 'OK' and is_kf8").select("path", "half", "spreads", F.col("h.codepage").alias("_c"), F.posexplode("docs").alias("ord", "d"))
    spread = F.coalesce(F.try_element_at("spreads", F.col("ord")), F.lit(""))
    return t.select("path", "half", "ord", F.octet_length("d.content").cast("long").alias("size_bytes"), "d.linear", spread.alias("page_spread"), "d.content", decoded(F.col("d.content"), F.col("_c")).alias("xhtml"))


def flows(books: DataFrame) -> DataFrame:
    """path, half, ord, start, end, content (bytes): pieces of the raw text; the first is the text itself (books opened with part flows)."""
    t = books.where("status = 'OK' and is_kf8").select("path", "half", F.posexplode("flows").alias("ord", "f"))
    return t.select("path", "half", "ord", "f.start", "f.end", "f.content")
