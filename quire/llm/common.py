"""Shared plumbing of the training-data operators.

Work tables go to the folder named by ``spark.checkpoint.dir``, which every executor and the driver can
reach; a folder of our own is made only where that setting is missing and the master is local.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table (rows times a stated row width) up to which it is sent to every executor.
BROADCAST_BYTES = 32 << 20

_runs: dict[str, str] = {}


#: Rows and bytes of a batch that travels to Python; whole texts are long rows.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application's own inside the shared checkpoint folder. Also bounds the batches for Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _runs:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quire-")
        _runs[app] = f"{base.rstrip('/')}/quire-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, spark, _runs[app])
    return _runs[app]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter
        pass


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a work table through the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by save() that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_quire_path", None):
            drop_path(t.sparkSession, path)


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df (a saved table), marked for broadcast if its counted size is within the limit; a shuffle join otherwise."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for work columns that df has none of (Spark's names have no case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def text_hash(text: str = "text"):
    """64 bits of a text; with the doc_id they name a row's document, also where ids are null or repeat."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def among(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of docs whose document is (how: left_semi) or is not (left_anti) in keys (a saved table: doc_id, raw). Null ids match each other."""
    i, h = fresh(docs, "key_id", "key_raw")
    d = sized(keys.select(F.col("doc_id").alias(i), F.col("raw").alias(h)), 80)
    return docs.join(d, docs["doc_id"].cast("long").eqNullSafe(d[i]) & (text_hash() == d[h]), how)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the least node that can be reached over the edges, for every node of an edge.

    Alternating large-star and small-star steps: each node hands its neighbours to the least of them, so
    a chain shortens by about half a round. The least neighbour comes from a partial aggregation and a
    join, so a hub with a third of all edges is not gathered in one task.
    """
    spark = edges.sparkSession
    e = save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(small_low, F.col("u") == F.col("k")).select(F.col("v").alias("x"), "m", "u")
        nxt = (
            small.select(F.col("x").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        nxt = save(nxt, "edges")
        row = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        discard(e)
        e = nxt
        # every node names one root, and a round changed nothing
        if tuple(row) == state and row[0] == row[2]:
            break
        state = tuple(row)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
