"""Resharding by minimum-cost flow.

A layout is a folder of block files. A block is what one write task wrote of one shard (tasks are joined where there
would be more than ``MOST_BLOCKS``); its rows carry the task's number and their turn. Resharding reads the blocks' sizes, and solves
a small flow network (old shards, new shards) on the driver: a unit that stays costs nothing, a moved one its size. The
flow tells how many bytes each old shard hands to each new one, and these amounts cut the old shard's row of blocks:
whole blocks stay or go, and only the blocks in which a cut falls (as many as there are amounts) are dealt row by
row. A last step moves single rows of those blocks to even out what atomic rows left over.

Files of blocks that stay are left as they are. Rows of blocks that go, or are cut, are written to the new shards'
folder, by the tasks that read them: nothing is shuffled. ``Resharded`` is the new layout: kept blocks, rewritten rows,
and the shard and slot of each row.

Law ``bytes``: sizes near equal. Size of a row: UTF-8 bytes of its text (null: none) plus 8. Equal texts
need not stay together (a text with a third of all rows fits in no shard). Rows that repeat a doc_id or have none are
rows of their own; as blocks follow the files, a hot id or text is spread over them like any other. Slots follow
the blocks. Extra columns are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

OVERHEAD = 8
#: Blocks that are counted on the driver and broadcast, at 64 bytes each.
MOST_BLOCKS = 1 << 19
#: Rows a shard offers for the last step.
SAMPLE = 400
#: Work columns of a layout: old shard, the task that wrote a row (with the shard: its block), its turn there, its size.
WORK = ("old", "part", "turn", "size")


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Amounts (i, j) that carry all supply within the capacities at the least cost, by shortest augmenting paths."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    head = defaultdict(list)
    to, room, price = [], [], []

    def arc(a, b, r, c):
        for x, y, q, p in ((a, b, r, c), (b, a, 0, -c)):
            head[x].append(len(to))
            to.append(y)
            room.append(q)
            price.append(p)

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        for j in range(m):
            arc(i, n + j, s, cost(i, j))
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    while True:
        far, via, queue, inside = {source: 0}, {}, deque([source]), {source}
        while queue:
            x = queue.popleft()
            inside.discard(x)
            for k in head[x]:
                if room[k] and far[x] + price[k] < far.get(to[k], 1 << 60):
                    far[to[k]], via[to[k]] = far[x] + price[k], k
                    if to[k] not in inside:
                        inside.add(to[k])
                        queue.append(to[k])
        if sink not in via:
            break
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        amount = min(room[k] for k in path)
        for k in path:
            room[k] -= amount
            room[k ^ 1] += amount
    return {(x, to[k] - n): room[k ^ 1] for x in range(n) for k in head[x] if n <= to[k] < n + m and room[k ^ 1]}


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (k < total % parts) for k in range(parts)]


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def hashed_shard(doc_id: Column, shards: int) -> Column:
    """The old layout that the query starts from."""
    return F.pmod(F.xxhash64(doc_id), F.lit(shards)).cast("int")


def _even_out(sizes: list[int], goal: list[int], rows: dict[int, list[tuple[int, int]]]) -> dict[int, int]:
    """Moves (row to shard) that bring sizes nearer to the goals: each step, the best row from the fullest to the emptiest. rows: (size, row) of each shard."""
    sizes, moved = list(sizes), {}
    for _ in range(20 * len(sizes)):
        over = max(range(len(sizes)), key=lambda j: sizes[j] - goal[j])
        under = min(range(len(sizes)), key=lambda j: sizes[j] - goal[j])
        gap = min(sizes[over] - goal[over], goal[under] - sizes[under])
        free = [r for r in rows.get(over, []) if r[1] not in moved and r[0] <= 2 * max(gap, 0)]
        if over == under or not free:
            break
        size, row = min(free, key=lambda r: (abs(r[0] - gap), r[1]))
        moved[row] = under
        sizes[over] -= size
        sizes[under] += size
    return moved


@dataclass
class Layout:
    """Old files (at path) and the names of their work columns."""

    path: str
    files: DataFrame
    shards: int
    names: tuple[str, ...]


def _numbered(old_name: str, more: list[str], shards: int):
    """Rows that know their old shard get their task's number and their turn among its rows of that shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, turns = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for b in batches:
            n, old = b.num_rows, b.column(b.schema.get_field_index(old_name)).to_numpy()
            order = np.argsort(old, kind="stable")
            shard, lead, count = np.unique(old[order], return_index=True, return_counts=True)
            turn = np.empty(n, np.int64)
            turn[order] = np.arange(n) - np.repeat(lead, count) + np.repeat(turns[shard], count)
            turns[shard] += count
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(turn)], [*b.schema.names, *more])

    return run


def lay_out(docs: DataFrame, old: Column, shards: int, path: str) -> Layout:
    """Writes docs as the files of ``shards`` shards, a folder each, without a shuffle."""
    names = tuple(common.fresh(docs, *WORK))
    rows = docs.coalesce(max(1, MOST_BLOCKS // shards)).select("*", size_of(F.col("text")).alias(names[3]), old.cast("int").alias(names[0]))
    schema = T.StructType([*rows.schema, T.StructField(names[1], T.IntegerType()), T.StructField(names[2], T.LongType())])
    numbered = rows.mapInArrow(_numbered(names[0], [names[1], names[2]], shards), schema)
    numbered.write.option("compression", "zstd").partitionBy(names[0]).parquet(path)
    return Layout(path, docs.sparkSession.read.schema(schema).parquet(path), shards, names)


@dataclass
class Resharded:
    """kept: rows of files that stay where they are; written: rows of the new folder. Both have the documents' columns, the old shard, shard and slot."""

    kept: DataFrame
    written: DataFrame
    moved_bytes: int
    rewritten_bytes: int

    def rows(self) -> DataFrame:
        return self.kept.unionByName(self.written)


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A driver's table, marked for broadcast if it is small."""
    out = spark.createDataFrame(rows, schema)
    return F.broadcast(out) if len(rows) * 64 <= common.BROADCAST_BYTES else out


def reshard(layout: Layout, new_shards: int, path: str, shard: str = "shard", slot: str = "slot") -> Resharded:
    """Moves the fewest bytes to ``new_shards`` shards of near equal size; rewritten rows go to path. shard and slot name the new columns."""
    files, spark = layout.files, layout.files.sparkSession
    old, part, turn, size = layout.names
    block = [F.sum(size).alias("bytes"), F.count("*").alias("n"), F.collect_set("file").alias("files")]
    totals = files.select(old, part, size, F.input_file_name().alias("file")).groupBy(F.col(old).alias("o"), F.col(part).alias("p")).agg(*block).orderBy("o", "p").collect()  # at most MOST_BLOCKS rows
    sizes = [0] * layout.shards
    for r in totals:
        sizes[r["o"]] += r["bytes"]
    goal = even(sum(sizes), new_shards)
    # an old shard keeps its first bytes; what goes to the others follows
    ends, heirs = defaultdict(list), defaultdict(list)
    for (i, j), amount in sorted(min_cost_flow(sizes, goal, lambda i, j: int(i != j)).items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        ends[i].append((ends[i][-1] if ends[i] else 0) + amount)
        heirs[i].append(j)
    heir = lambda o, byte: heirs[o][min(bisect_right(ends[o], byte), len(heirs[o]) - 1)]
    whole, cut, now, at = {}, {}, [0] * new_shards, [0] * layout.shards
    for r in totals:
        o, p, n = r["o"], r["p"], r["bytes"]
        j = heir(o, at[o])
        if j == heir(o, at[o] + n - 1):
            whole[o, p] = j
            now[j] += n
        else:
            cut[o, p] = at[o]
        at[o] += n
    # rows of the blocks in which a cut falls (as many blocks as the flow has amounts), each by its middle byte
    place, offers, rows = {}, defaultdict(list), []
    if cut:
        asked = F.broadcast(spark.createDataFrame(sorted(cut), "o int, p int"))
        rows = sorted(map(tuple, files.join(asked, (F.col(old) == F.col("o")) & (F.col(part) == F.col("p"))).select("o", "p", turn, size).collect()))
    for o, p, t, n in rows:
        j = heir(o, cut[o, p] + n // 2)
        cut[o, p] += n
        place[o, p, t] = j
        now[j] += n
        offers[j].append((n, (o, p, t)))
    step = {j: max(1, len(x) // SAMPLE) for j, x in offers.items()}
    place |= _even_out(now, goal, {j: x[:: step[j]] for j, x in offers.items()})
    # slots: whole blocks first, then single rows
    top, blocks, single, moved = [0] * new_shards, [], [], 0
    for r in totals:
        if (key := (r["o"], r["p"])) in whole:
            j = whole[key]
            blocks.append((*key, j, top[j]))
            top[j] += r["n"]
            moved += r["bytes"] * (j != r["o"])
    for o, p, t, n in rows:
        j = place[o, p, t]
        single.append((o, p, t, j, top[j]))
        top[j] += 1
        moved += n * (j != o)
    stay = {(o, p) for o, p, j, _ in blocks if j == o}
    schema, own = files.schema, [F.col(f"`{c}`") for c in files.columns if c not in layout.names]

    def read(keep: bool) -> DataFrame:
        paths = sorted(f for r in totals if ((r["o"], r["p"]) in stay) == keep for f in r["files"])
        return spark.read.schema(schema).option("basePath", layout.path).parquet(*paths) if paths else files.limit(0)

    def numbered(found: DataFrame, first) -> DataFrame:
        return found.select(*own, F.col(old), F.col("j").alias(shard), first.cast("long").alias(slot))

    at_block = (F.col(old) == F.col("o")) & (F.col(part) == F.col("p"))
    table = _small(spark, blocks, "o int, p int, j int, f long")
    touched, first = read(False), F.col("f") + F.col(turn)
    gone = numbered(touched.join(table, at_block), first)
    dealt = numbered(touched.join(_small(spark, single, "o int, p int, t long, j int, f long"), at_block & (F.col(turn) == F.col("t"))), F.col("f"))
    gone.unionByName(dealt).write.option("compression", "zstd").partitionBy(shard).parquet(path)
    kept = numbered(read(True).join(table, at_block), first)
    total = sum(r["bytes"] for r in totals)
    return Resharded(kept, spark.read.schema(kept.schema).parquet(path), moved, total - sum(r["bytes"] for r in totals if (r["o"], r["p"]) in stay))


def shard_digest(docs: DataFrame, shards: int = 24, old_shards: int = 16) -> DataFrame:
    """Lays docs out in ``old_shards`` hashed shards, reshards those files into ``shards``, and reads the digest from kept and rewritten files."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    layout = lay_out(rows, hashed_shard(F.col("doc_id"), old_shards), old_shards, common.new_path(spark, "old-shards"))
    got = reshard(layout, shards, common.new_path(spark, "new-shards")).rows()
    return got.select(
        "doc_id", size_of(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
