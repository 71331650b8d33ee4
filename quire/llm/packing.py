"""Sum-of-squares packing of token sequences.

A document is its token ids and an end id; one longer than the capacity is cut so that all its pieces but
the first are full. Which lengths share a sequence depends on the counts of lengths alone, and of those there
are at most as many as the capacity. So the executors count, the driver packs the counts, and the executors give the
n-th piece of a length the n-th place that the packing holds for that length.

Pieces are placed from the longest on. Each goes to the open sequence that makes the sum, over residual gaps, of the
squared counts of open sequences smallest (of several, the one with the smallest gap); a sequence is opened only where
none has room. Every place is chosen by that rule.

Counts above ``ITEMS`` are packed in multiples: one packing of the counts divided by g stands for g equal ones, and
the remainders are packed after it. So the driver's work is bounded, every piece is placed, and a larger table
is packed as densely as one of ``ITEMS`` pieces, but for a few sequences of remainders.

Ids are not shuffled: they are read from the files that the encoding wrote, ``WAVE`` parts a job where there are more;
only (part, length, count) rows are. Null texts are empty: their
sequence is the end id alone. An empty table gives an empty result. Rows that repeat a doc_id, or have none, are
packed each on its own. Columns but doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

ITEMS = 1 << 18
#: Parts (tasks of the encoding) whose ranks are broadcast at once: up to 24 bytes for each of the capacity's lengths.
WAVE = 1024
_PIECE = "doc_id long, piece int, start long, length long, ids binary, part int, turn long"
_PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("turn", pa.int64())])


def sum_of_squares(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of lengths up to the capacity. gaps[h] counts open bins with h left; a full bin is no longer counted."""
    gaps = np.zeros(capacity, np.int64)
    open_: list[list[list[int]]] = [[] for _ in range(capacity)]
    full, far = [], np.iinfo(np.int64).max
    for s in lengths:
        here, then = gaps[s:], gaps[: capacity - s]
        # what the sum of squares changes by where a bin with gap s + k takes the item
        change = 2 * (then - here) + 2
        if len(change):
            change[0] = 1 - 2 * here[0]
            change[here == 0] = far
        k = int(change.argmin()) if len(change) else 0
        if len(change) and change[k] < far:
            h = s + k
            bin_ = open_[h].pop()
            gaps[h] -= 1
        else:
            h, bin_ = capacity, []
        bin_.append(s)
        if h == s:
            full.append(bin_)
        else:
            open_[h - s].append(bin_)
            gaps[h - s] += 1
    return full + [b for bins in open_ for b in bins]


def pack_counts(counts: dict[int, int], capacity: int, items: int = ITEMS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences) for counts of lengths."""
    out: Counter = Counter()
    if n := counts.get(capacity):
        out[(capacity,)] += n
    left = {length: n for length, n in counts.items() if length < capacity and n}
    while left:
        g = min(-(-sum(left.values()) // items), max(left.values()))
        now = {length: n // g for length, n in left.items() if n // g}
        left = {length: n % g for length, n in left.items() if n % g}
        for b in sum_of_squares([length for length in sorted(now, reverse=True) for _ in range(now[length])], capacity):
            out[tuple(b)] += g
    return sorted(out.items())


def places(layout: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank of each run of places, its first sequence, the offset in the sequence."""
    runs, first = defaultdict(list), 0
    for lengths, n in layout:
        at = 0
        for length in lengths:
            runs[length].append((n, first, at))
            at += length
        first += n
    return {k: (np.cumsum([0] + [r[0] for r in v])[:-1], np.array([r[1] for r in v]), np.array([r[2] for r in v])) for k, v in runs.items()}


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, turns = encoder(path), TaskContext.get().partitionId(), Counter()
        for b in batches:
            ids, ends = enc.column(b.column(1))
            ids, ends = np.insert(ids, ends, end_id).astype("<u4"), (ends + np.arange(1, len(ends) + 1)).tolist()
            rows, size, first = [], 0, 0
            for doc, end in zip(b.column(0).to_pylist(), ends, strict=True):
                n = end - first
                at, cut, k = 0, n if n <= capacity else n % capacity or capacity, 0
                while at < n:
                    length = cut - at
                    rows.append((doc, k, at, length, ids[first + at : first + cut].tobytes(), part, turns[length]))
                    turns[length] += 1
                    at, cut, k = cut, cut + capacity, k + 1
                size, first = size + n, end
                if size > 2 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)
        common.trim()

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE_ARROW, strict=True)], schema=_PIECE_ARROW)


def _place(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = table.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                mine = length == x
                start, first, at = found[int(x)]
                k = np.searchsorted(start, rank[mine], "right") - 1
                seq[mine], offset[mine] = first[k] + rank[mine] - start[k], at[k]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "piece", "start", "length", "ids")] + [pa.array(seq), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, wave: int = WAVE) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids (unsigned 32-bit, little-endian), sequence_id, offset."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = common.save(texts.mapInArrow(_pieces(tokenizer, capacity, end_id), _PIECE), "pieces")
    per = common.save(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    table = spark.sparkContext.broadcast(places(pack_counts(counts, capacity)))  # at most ITEMS places a level
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    base = common.save(per.select(F.col("part").alias("p"), F.col("length").alias("l"), before.alias("before")), "ranks")
    common.discard(per)

    def placed(low: int, high: int) -> DataFrame:
        # a piece file has one part, so the range reads its own files alone; at most WAVE * capacity rows are broadcast
        mine = F.broadcast(base.where(F.col("p").between(low, high)))
        ranked = pieces.where(F.col("part").between(low, high)).join(mine, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l")))
        ranked = ranked.select("doc_id", "piece", "start", "length", "ids", (F.col("before") + F.col("turn")).alias("rank"))
        return ranked.mapInArrow(_place(table), "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")

    last = base.agg(F.max("p")).first()[0] or 0
    if last < wave:
        return placed(0, last)
    path = common.new_path(spark, "placed")
    for low in range(0, last + 1, wave):
        placed(low, low + wave - 1).write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
