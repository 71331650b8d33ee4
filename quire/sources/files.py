"""Book files as rows: path, modificationTime, length, content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def tune(spark: SparkSession) -> None:
    """Rows here are whole books: keeps the batches that travel to Python small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 256)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20)


def read_files(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(path)


def stream_files(spark: SparkSession, path: str, glob: str | None = None, max_files: int = 1000) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)
