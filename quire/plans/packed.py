"""Books made of the driver's tables: each row of a table is packed into a file image, on the executors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_FILE = pa.schema([("path", pa.string()), ("content", pa.binary())])


def _values(column: pa.Array) -> list:
    """As to_pylist, but structs in lists are made field by field: a group a row has few values, and a conversion each costs more than packing."""
    if not pa.types.is_list(column.type) or not pa.types.is_struct(column.type.value_type):
        return column.to_pylist()
    inner = column.flatten()
    names = [f.name for f in inner.type]
    dicts = [dict(zip(names, v, strict=True)) for v in zip(*(x.to_pylist() for x in inner.flatten()), strict=True)]
    for k in inner.is_null().to_numpy(zero_copy_only=False).nonzero()[0].tolist() if inner.null_count else ():
        dicts[k] = None
    out, at = [], 0
    for n in column.value_lengths().to_pylist():
        out.append(None if n is None else dicts[at : at + n])
        at += n or 0
    return out


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for values in zip(*map(_values, batch.columns), strict=True):
        yield dict(zip(batch.schema.names, values, strict=True))


def deal(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores: a table's file may be one row group, which one task would read, pack and open alone."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def packed(rows: DataFrame, build: Callable[[dict], bytes | None], key: str, dealt: bool = False) -> DataFrame:
    """(path, content): a file a row of rows, named by the key column; rows that build gives None for are left out.

    dealt: whether rows are dealt over all cores already, by ``deal`` or a grouping.

    Where the setting ``quire.books`` names a folder, files are written there once, over several tasks, and read from then on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in _rows(b):
                content = build(r)
                if content is not None:
                    out.append((str(r[key]), content))
            yield pa.RecordBatch.from_pydict({"path": [p for p, _ in out], "content": [c for _, c in out]}, schema=_FILE)

    folder = rows.sparkSession.conf.get("quire.books", None)
    files = (rows if dealt and not folder else deal(rows)).mapInArrow(run, "path string, content binary")
    if not folder:
        return files
    path = f"{folder}/{re.sub(r'[^A-Za-z0-9]+', '_', build.__qualname__)}"
    files.write.mode("ignore").option("compression", "none").parquet(path)
    return rows.sparkSession.read.parquet(path)
