"""Resources: images, fonts and media records, covers, page spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.arrow import font_of
from quire.functions.columns import ABSENT, ascii_bytes, magic, part

from .container import number_of, record


def image_type(data: Column) -> Column:
    """MIME type by the first bytes."""
    starts = lambda head: F.startswith(data, F.lit(head))
    return (
        F.when(starts(b"GIF87a") | starts(b"GIF89a"), "image/gif")
        .when(starts(b"\xff\xd8\xff"), "image/jpeg")
        .when(starts(b"\x89PNG\r\n\x1a\n"), "image/png")
        .when(starts(b"BM"), "image/bmp")
        .otherwise("application/octet-stream")
    )


def decode_resources(rows: DataFrame, data: str = "record") -> DataFrame:
    """rows with status, data, mime from the raw record: fonts are restored, media lose their 12-byte head."""
    kind, rec = magic(F.col(data)), F.col(data)
    font, media = kind == ascii_bytes("FONT"), kind.isin(b"VIDE", b"AUDI")
    t = rows.withColumn("_font", font_of(F.when(font, rec)))
    size = F.octet_length(rec)
    t = t.withColumn("status", F.when(font, F.col("_font.status")).when(media & (size < 12), "Corrupt").otherwise("OK"))
    t = t.withColumn("data", F.when(F.col("status") != "OK", F.lit(None)).when(font, F.col("_font.data")).when(media, part(rec, 12, size - 12)).otherwise(rec))
    return t.withColumn("mime", F.when(F.col("status") == "OK", image_type(F.col("data")))).drop("_font")


def resources(books: DataFrame) -> DataFrame:
    """path, half, ord, rec_no, status, data, mime: resource n of a book's markup (from 1) is ord n - 1."""
    t = books.where("status = 'OK' and num_resources > 0")
    t = t.select("path", "half", "content", "offsets", F.col("h.first_image").alias("_f"), F.explode(F.sequence(F.lit(0), F.col("num_resources") - 1)).alias("ord"))
    t = t.withColumn("rec_no", F.col("_f") + F.col("ord")).withColumn("record", record(F.col("rec_no")))
    return decode_resources(t.drop("content", "offsets")).select("path", "half", "ord", "rec_no", "status", "data", "mime")


def covers(books: DataFrame) -> DataFrame:
    """path, half, status, ord, data, mime: the cover named by the metadata, else the thumbnail; NoCover without either."""
    given = lambda kind: F.when(number_of(F.col("h.exth"), kind) != ABSENT, number_of(F.col("h.exth"), kind))
    t = books.where("status = 'OK'").withColumn("ord", F.coalesce(given(201), given(202)))
    inside = F.col("ord") < F.col("num_resources")
    t = t.withColumn("record", F.when(inside, record(F.col("h.first_image") + F.col("ord"))))
    t = decode_resources(t.select("path", "half", "ord", "num_resources", "record"))
    status = F.when(F.col("ord").isNull(), "NoCover").when(~inside, "RecordRange").otherwise(F.col("status"))
    return t.select("path", "half", status.alias("status"), "ord", F.when(inside, F.col("data")).alias("data"), F.when(inside, F.col("mime")).alias("mime"))
