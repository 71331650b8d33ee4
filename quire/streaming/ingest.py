"""Books that arrive as files, a micro-batch at a time: each table is appended to a Parquet folder of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators.library import Library
from quire.sources.files import stream_files

TABLES = ("status", "metadata", "sections", "toc", "guide")


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, tables: tuple[str, ...] = TABLES, glob: str | None = None) -> StreamingQuery:
    """Starts a query that ends once all files present are in. Books are opened once a batch. A batch that is run again overwrites what it wrote before."""

    def batch(files: DataFrame, number: int) -> None:
        library = Library(files).keep()
        try:
            for name in tables:
                getattr(library, name).write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        finally:
            library.release()

    return stream_files(spark, source, glob).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
