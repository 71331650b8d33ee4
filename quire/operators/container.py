"""Palm-database containers: validation and records, natively, for tables of records. Books are opened by ``functions.book``.

A container is one row; ``status`` names the first rule that it breaks, in the order in which the format's readers
check them, so a damaged file always reports the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import ascii_bytes, latin, magic, part, unlatin, unsigned

TABLE, ENTRY = 78, 8


def first_failure(*rules: tuple[Column, str]) -> Column:
    """Status of the first rule that is broken; OK if none is."""
    out = F.lit("OK")
    for broken, status in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), status).otherwise(out)
    return out


def containers(files: DataFrame) -> DataFrame:
    """files (path, content, ...) with status, name, num_records and offsets (one more than records: the end of the file)."""
    content = F.col("content")
    size = F.octet_length(content).cast("long")
    table_end = F.lit(TABLE) + F.col("num_records") * ENTRY
    t = files.withColumn("num_records", F.coalesce(unsigned(content, 76, 2), F.lit(0)).cast("int"))
    fits = (size >= TABLE) & (F.col("num_records") > 0) & (table_end <= size)
    starts = F.transform(F.sequence(F.lit(0), F.col("num_records") - 1), lambda i: unsigned(content, F.lit(TABLE) + i * ENTRY, 4))
    t = t.withColumn("offsets", F.when(fits, F.concat(starts, F.array(size))))
    ident = part(content, 60, 8)
    falls = F.exists(F.sequence(F.lit(1), F.col("num_records") - 1), lambda i: F.get("offsets", i) < F.get("offsets", i - 1))
    status = first_failure(
        (content.isNull() | (size < TABLE), "NotPalmDB"),
        ((ident != ascii_bytes("BOOKMOBI")) & (ident != ascii_bytes("TEXtREAd")), "NotPalmDB"),
        (F.col("num_records") == 0, "Corrupt"),
        (table_end > size, "Corrupt"),
        (F.get("offsets", F.lit(0)) < table_end, "Corrupt"),
        ((F.col("num_records") > 1) & falls, "Corrupt"),
        (F.exists("offsets", lambda x: x > size), "Corrupt"),
    )
    name = unlatin(F.rtrim(F.substring_index(latin(part(content, 0, 32)), "\0", 1)))
    return t.withColumn("status", status).withColumn("name", F.when(size >= TABLE, name))


def record(i: Column, content: str = "content", offsets: str = "offsets") -> Column:
    """Bytes of record i; null outside the file's records."""
    inside = (i >= 0) & (i < F.size(offsets) - 1)
    start = F.get(F.col(offsets), i.cast("int"))
    return F.when(inside, part(F.col(content), start, F.get(F.col(offsets), (i + 1).cast("int")) - start))


def record_run(first: Column, n: Column) -> Column:
    """Records first, first + 1, ...; null for those outside the file."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: record(first + i))).otherwise(F.array().cast("array<binary>"))


def records(opened: DataFrame) -> DataFrame:
    """path, rec_no, magic, data: a row a record of the containers that are whole."""
    rows = opened.where("status = 'OK'").select("path", F.posexplode(record_run(F.lit(0), F.col("num_records"))).alias("rec_no", "data"))
    return rows.select("path", "rec_no", magic(F.col("data")).alias("magic"), "data")


def all_of(exth: Column, kind: int) -> Column:
    """Values of a type, in file order."""
    return F.transform(F.filter(exth, lambda e: e["type"] == kind), lambda e: e["data"])


def last_of(exth: Column, kind: int) -> Column:
    return F.try_element_at(all_of(exth, kind), F.lit(-1))


def number_of(exth: Column, kind: int) -> Column:
    """Last value of a type as an unsigned number, if it has four, two or one bytes."""
    data = last_of(exth, kind)
    return F.when(F.octet_length(data).isin(1, 2, 4), F.conv(F.hex(data), 16, 10).cast("long"))
