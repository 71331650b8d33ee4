"""A corpus of books as named DataFrames and SQL views."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.arrow import halves_of
from quire.functions.book import PAGEBREAK, PARTS
from quire.functions.columns import decoded, part
from quire.functions.uri import parse_uri
from quire.sources.files import read_files, tune

from . import container, kf8, metadata, resources, text, toc


def open_books(files: DataFrame, parts: tuple[str, ...] = PARTS, tag: bytes = PAGEBREAK, fields: tuple[str, ...] | None = None) -> DataFrame:
    """A row a half of each file (path, content): files' columns, half, status, is_kf8, has_mobi6_half, h, ..., and the parts asked for.

    One pass of one Arrow function; nothing is shuffled. A file is opened whole or refused whole: its status is that of the
    first stage that fails. Without parts only headers are read, and damage behind them doesn't show. fields: the columns
    besides parts that a table needs; over many small books all of them cost more than the opening.
    """
    t = files.withColumn("_b", F.explode(halves_of(F.col("content"), frozenset(parts), tag, None if fields is None else frozenset(fields))))
    return t.select(*files.columns, "_b.*")


def open_headers(files: DataFrame) -> DataFrame:
    """As open_books, of the headers alone: for metadata over many files."""
    return open_books(files, ())


#: Which half a row is, and whether it can be read.
_KIND = ("half", "status", "is_kf8")


class Refused(ValueError):
    """A file that a library opened in mode FAILFAST does not accept."""


class Library:
    """``Library.open(spark, path)`` or ``Library(files)``; mode PERMISSIVE keeps refused files as rows with a status, FAILFAST raises.

    Each table opens the files anew and decodes no more than it needs; after ``keep()`` all of them share one opening.
    """

    VIEWS = ("status", "records", "exth", "metadata", "raw_text", "sections", "filepos", "toc", "guide", "resources", "cover", "kf8_sections", "flows")

    def __init__(self, files: DataFrame, mode: str = "PERMISSIVE"):
        if mode not in ("PERMISSIVE", "FAILFAST"):
            raise ValueError(f"mode {mode}")
        self.files, self.mode, self._kept, self._checked = files, mode, None, False
        tune(files.sparkSession)

    @classmethod
    def open(cls, spark: SparkSession, path: str | list[str], mode: str = "PERMISSIVE", **options) -> Library:
        return cls(read_files(spark, path, **options), mode)

    @classmethod
    def from_bytes(cls, spark: SparkSession, books: dict[str, bytes], mode: str = "PERMISSIVE") -> Library:
        return cls(spark.createDataFrame([(k, bytearray(v)) for k, v in books.items()], "path string, content binary"), mode)

    def keep(self) -> Library:
        """Opens the books once for all tables, and holds them (on disk where memory is short) until release()."""
        if self._kept is None:
            self._kept = self._opened(PARTS).persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def release(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None

    def _opened(self, parts: tuple[str, ...], fields: tuple[str, ...] | None = None) -> DataFrame:
        if self._kept is not None:
            return self._kept
        if self.mode == "FAILFAST" and not self._checked:
            if bad := open_books(self.files, ("status",)).where("status <> 'OK'").select("path", "status").first():
                raise Refused(f"{bad['path']}: {bad['status']}")
            self._checked = True
        return open_books(self.files, parts, fields=fields)

    @property
    def books(self) -> DataFrame:
        return self._opened(PARTS)

    @property
    def headers(self) -> DataFrame:
        """Of headers alone: also of books whose damage lies behind them, kept or not."""
        return open_headers(self.files)

    @property
    def status(self) -> DataFrame:
        return self._opened(("status",)).select("path", "half", "status", "is_kf8", "has_mobi6_half", "num_resources")

    @property
    def names(self) -> DataFrame:
        """path, name (bytes): the container's own name, also of files that are refused later."""
        return container.containers(self.files).select("path", "name")

    @property
    def records(self) -> DataFrame:
        return container.records(container.containers(self.files))

    @property
    def exth(self) -> DataFrame:
        return metadata.exth(self.headers)

    @property
    def metadata(self) -> DataFrame:
        return metadata.metadata(self.headers)

    @property
    def raw_text(self) -> DataFrame:
        """path, half, raw (bytes), text: halves before format 8."""
        t = self._opened(("raw",)).where("status = 'OK' and not is_kf8")
        return t.select("path", "half", "raw", decoded(F.col("raw"), F.col("h.codepage")).alias("text"))

    @property
    def sections(self) -> DataFrame:
        """path, half, ord, start, end, text: sections of any half; of format 8 each is a document of its own and starts at 0."""
        none = F.lit(0).cast("long")
        old = F.transform("sections", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), part(F.col("raw"), s["start"], s["end"] - s["start"]).alias("content")))
        new = F.transform("docs", lambda d: F.struct(none.alias("start"), F.octet_length(d["content"]).cast("long").alias("end"), d["content"].alias("content")))
        t = self._opened(("raw", "sections", "docs")).where("status = 'OK'")
        t = t.select("path", "half", F.col("h.codepage").alias("_c"), F.posexplode(F.when(F.col("is_kf8"), new).otherwise(old)).alias("ord", "s"))
        return t.select("path", "half", "ord", "s.start", "s.end", decoded(F.col("s.content"), F.col("_c")).alias("text"))

    @property
    def filepos(self) -> DataFrame:
        t = self._opened(("raw",), _KIND).where("status = 'OK' and not is_kf8")
        return t.select("path", "half", F.explode(text.filepos_targets(F.col("raw"))).alias("filepos"))

    @property
    def toc(self) -> DataFrame:
        return toc.toc(self._opened(("toc",), _KIND))

    @property
    def guide(self) -> DataFrame:
        return toc.guide(self._opened(("guide",), _KIND))

    @property
    def resources(self) -> DataFrame:
        return resources.resources(self._opened(("status",)))

    @property
    def cover(self) -> DataFrame:
        return resources.covers(self._opened(("status",)))

    @property
    def kf8_sections(self) -> DataFrame:
        return kf8.kf8_sections(self._opened(("docs",)))

    @property
    def flows(self) -> DataFrame:
        return kf8.flows(self._opened(("flows",), _KIND))

    def resolve_uris(self, uris: DataFrame) -> DataFrame:
        """uris (path, uri) with status, kind, flow, embed, fid, off, section, offset, mime, against each path's main half."""
        return resolve_uris(self._opened(("places",)), uris)

    @property
    def num_resources(self) -> DataFrame:
        """path, half, num_resources."""
        return self.status.where("status = 'OK'").select("path", "half", "num_resources")

    def resolve_recindex(self, references: DataFrame) -> DataFrame:
        """references (path, recindex) with the resource; numbers count from 1, and those out of range have RecordRange."""
        found = self.resources.where("half = 'main'").drop("half")
        t = references.join(found.withColumn("recindex", F.col("ord") + 1), ["path", "recindex"], "left")
        return t.withColumn("status", F.coalesce("status", F.lit("RecordRange")))

    def create_views(self, prefix: str = "") -> None:
        for name in self.VIEWS:
            getattr(self, name).createOrReplaceTempView(prefix + name)


def resolve_uris(books: DataFrame, uris: DataFrame) -> DataFrame:
    b = books.where("half = 'main' and status = 'OK'").select(F.col("path").alias("_p"), "is_kf8", "flow_count", "places", "num_resources")
    t = uris.join(b, uris["path"] == F.col("_p")).withColumn("u", parse_uri(F.col("uri")))
    t = t.withColumn("at", F.when(F.col("is_kf8") & (F.col("u.kind") == "pos"), kf8.locate(F.col("u.fid"), F.col("u.off"))))
    u = lambda name: F.col(f"u.{name}")
    status = (
        F.when(~F.col("is_kf8"), "Corrupt")
        .when(u("status") != "OK", u("status"))
        .when((u("kind") == "flow") & (u("flow") >= F.col("flow_count")), "RecordRange")
        .when((u("kind") == "embed") & ((u("embed") < 1) | (u("embed") > F.col("num_resources"))), "RecordRange")
        .when((u("kind") == "pos") & F.col("at").isNull(), "Corrupt")
        .otherwise("OK")
    )
    zero = F.lit(0).cast("long")
    t = t.withColumn("status", status)
    field = lambda c, none: F.when(F.col("status") == "OK", F.coalesce(c, none)).otherwise(none)
    return t.select(
        "path", "uri", "status", field(u("kind"), F.lit("")).alias("kind"), *(field(u(n), zero).alias(n) for n in ("flow", "embed", "fid", "off")),
        field(F.col("at.section"), zero).alias("section"), field(F.col("at.offset"), zero).alias("offset"), field(u("mime"), F.lit("")).alias("mime"),
    )


def section_at(sections: DataFrame, positions: DataFrame, path: str = "path", position: str = "filepos") -> DataFrame:
    """positions with the section that each byte position lies in: an equi-join by book, then the range."""
    s = sections.select(F.col("path").alias("_p"), "half", "ord", "start", "end")
    inside = (F.col(position) >= F.col("start")) & (F.col(position) < F.col("end"))
    return positions.join(s, (positions[path] == F.col("_p")) & inside).drop("_p")

