"""Tagged indexes: entries with their tags' values, and the pool of phrases that they point into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.arrow import index_of
from quire.functions.columns import decoded, unsigned

from .container import record, record_run


def index_records(first: Column) -> Column:
    """Records of the index at record ``first`` of the half, as far as the file has them, counted by its first record; null for none."""
    at = F.when(first >= 0, F.col("start") + first)
    head = record(at)
    n = 1 + F.coalesce(unsigned(head, 24, 4), F.lit(0)) + F.coalesce(unsigned(head, 52, 4), F.lit(0))
    return F.when(at.isNotNull(), record_run(at, F.greatest(F.lit(0), F.least(n, F.col("num_records") - at))))


def with_index(books: DataFrame, first: Column, out: str) -> DataFrame:
    """books with ``out``: struct(status, codepage, entries, phrases) of the index at record ``first`` of the half; null status if there is none."""
    return books.withColumn(out, index_of(F.when(F.col("status") == "OK", index_records(first))))


def value(entry: Column, tag: int, k: int = 0) -> Column:
    """k-th value of a tag; null without it."""
    return F.get(F.try_element_at(entry["values"], F.lit(tag)), F.lit(k))


def phrase(index: Column, offset: Column) -> Column:
    """Text of the phrase at an offset of the pool; null if there is none."""
    return decoded(F.try_element_at(index["phrases"], offset), index["codepage"])


def entries(books: DataFrame, column: str) -> DataFrame:
    """path, half, ord, name, values: a row an entry of the index in ``column``."""
    return books.select("path", "half", F.posexplode(F.col(f"{column}.entries")).alias("ord", "e")).select("path", "half", "ord", "e.name", "e.values")


def phrases(books: DataFrame, column: str) -> DataFrame:
    """path, half, offset, phrase."""
    rows = books.select("path", "half", F.col(f"{column}.codepage").alias("_c"), F.explode(F.col(f"{column}.phrases")).alias("offset", "_p"))
    return rows.select("path", "half", "offset", decoded(F.col("_p"), F.col("_c")).alias("phrase"))
