"""Mixing sources to target weights by a low-discrepancy schedule.

Slot k of the schedule draws the source at the golden-ratio point frac(k * phi) of the cumulative target
shares, so every stretch of slots is near the shares. Slots are ranked per source. A source's documents are
shuffled by a keyed hash and laid end to end, over and over; that line is cut into as many blocks of equal
tokens as the source has slots, and the slot of rank r takes block r. The words that a source gives are
then its target to within a word a block, and no document is taken more than three times.

There is a slot a block of words, and a source that is drawn fewer than ``FEW`` times gets ``FEW`` more at the end, so
slots never outgrow the words, however small a source is. Texts are counted once; what is shuffled after that are
rows of hashes and sizes. A source's line is made in buckets of about ``BUCKET_ROWS`` rows by hash, and rows that
repeat are counted before they are dealt, so neither a hot source nor a hot document is in one task.

Targets: the sources by code point (null last) weigh 1, 2, 3, repeating, and share the total size; a target
above three times its source's size stops there, and the excess goes to the others by weight until none is
above. Null texts have size 0. Rows that repeat a doc_id are documents of their own. A source without words
has target 0. An empty table gives an empty result. The same rows give the same mix, however they are stored. Columns but
doc_id, text and source are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

REPEATS, BLOCK_TOKENS, BUCKET_ROWS, FEW, SEED = 3, 1024, 2_000, 4, 11
#: The golden ratio's fraction times 2 ** 64.
GOLDEN = 0x9E3779B97F4A7C15
#: Slots that a task draws, and those of a stretch of whole documents at most.
_DRAWS, PART_SLOTS = 1 << 20, 4096


def targets(sizes: list[tuple[str | None, int]], repeats: int = REPEATS) -> dict[str | None, float]:
    """Target of each source."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: 1 + k % 3 for k, (s, _) in enumerate(order)}
    size, out = dict(order), {}
    left, open_ = float(sum(size.values())), [s for s, _ in order]
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > repeats * size[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(repeats * size[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def words_of(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _entries(docs: DataFrame) -> tuple[DataFrame, list[dict]]:
    """(saved rows source, doc_id, h, size, m: m rows that are alike; a dict a source: source, size, rows, target)."""
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), common.text_hash().alias("h"), words_of(F.col("text").cast("string")).alias("size"))
    rows = common.save(rows.groupBy("source", "doc_id", "h", "size").agg(F.count("*").alias("m")), "entries")
    per = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("size"), F.sum("m").alias("rows")).collect()  # a row a source
    goal = targets([(r["source"], r["size"]) for r in per])
    plan = [{"source": r["source"], "size": r["size"], "rows": r["rows"], "target": goal[r["source"]]} for r in sorted(per, key=lambda r: (r["source"] is None, r["source"] or ""))]
    return rows, plan


def _small(spark: SparkSession, rows: list[tuple], schema: str, row_bytes: int) -> DataFrame:
    """A driver's table, marked for broadcast if it is small."""
    out = spark.createDataFrame(rows, schema)
    return F.broadcast(out) if len(rows) * row_bytes <= common.BROADCAST_BYTES else out


def _draw(numbers: list[int], edges: list[float]):
    """(slot, k, part, turn) of slot numbers that come in ascending order; turn counts a part's slots of one source."""
    k_of, upto = np.array(numbers, np.int32), np.array(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, turns = TaskContext.get().partitionId(), np.zeros(len(k_of), np.int64)
        for b in batches:
            slot = b.column(0).to_numpy()
            point = (slot.astype(np.uint64) * np.uint64(GOLDEN)).astype(np.float64) / 2.0**64
            pick = np.minimum(np.searchsorted(upto, point, "right"), len(k_of) - 1)
            order = np.argsort(pick, kind="stable")
            source, lead, count = np.unique(pick[order], return_index=True, return_counts=True)
            turn = np.empty(len(slot), np.int64)
            turn[order] = np.arange(len(slot)) - np.repeat(lead, count) + np.repeat(turns[source], count)
            turns[source] += count
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(k_of[pick]), pa.array(np.full(len(slot), part, np.int32)), pa.array(turn)], ["slot", "k", "part", "turn"])

    return run


def schedule(spark: SparkSession, plan: list[dict], block: int = BLOCK_TOKENS) -> tuple[DataFrame, dict[int, int]]:
    """(saved slots: slot, source index k, rank r; slots of each k)."""
    total, run, numbers, edges = sum(p["target"] for p in plan), 0.0, [], []
    for k, p in enumerate(plan):
        run += p["target"]
        if p["target"] > 0:
            numbers.append(k)
            edges.append(run / total)
    slots = int(total / block) + 1 if numbers else 0
    drawn = spark.range(0, slots, 1, max(1, -(-slots // _DRAWS))).mapInArrow(_draw(numbers, edges), "slot long, k int, part int, turn long")
    drawn = common.save(drawn, "drawn")
    counts = common.save(drawn.groupBy("k", "part").count(), "counts")
    before = F.sum("count").over(Window.partitionBy("k").orderBy("part")) - F.col("count")
    base = common.save(counts.select(F.col("k").alias("bk"), F.col("part").alias("bp"), before.alias("before")), "before")
    out = drawn.join(common.sized(base, 32), (F.col("k") == F.col("bk")) & (F.col("part") == F.col("bp"))).select("slot", "k", (F.col("before") + F.col("turn")).alias("r"))
    held = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("count").alias("n")).collect()}
    more = [(slots + i, k, held.get(k, 0) + t) for i, (k, t) in enumerate((k, t) for k in numbers if held.get(k, 0) < FEW for t in range(FEW))]
    if more:
        out = out.unionByName(spark.createDataFrame(more, "slot long, k int, r long"))
    out = common.save(out, "schedule")
    common.discard(drawn, counts, base)
    return out, {k: held.get(k, 0) + (FEW if held.get(k, 0) < FEW else 0) for k in numbers}


def _buckets(rows: int) -> int:
    """Buckets of a source's line."""
    return max(1, -(-rows // BUCKET_ROWS))


def _at(doc_id, h, turn):
    """A row's place in its source's shuffle."""
    return F.xxhash64(doc_id, h, turn, F.lit(SEED))


def _bucket(at, buckets):
    return F.pmod(F.shiftright(at, 20), buckets)


def _line(rows: DataFrame, plan: list[dict], slots: dict[int, int]) -> DataFrame:
    """A saved row a document: row, k, source, doc_id, h, size, source_size, target, slots, and pos, the words before it in its source's shuffled line."""
    spark = rows.sparkSession
    about = _small(spark, [(k, p["source"], _buckets(p["rows"]), int(p["size"]), float(p["target"]), slots.get(k, 0)) for k, p in enumerate(plan)], "k int, s string, buckets long, source_size long, target double, slots long", 256)
    rows = rows.join(about, F.col("source").eqNullSafe(F.col("s"))).withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    # buckets split a hot source; their order and that inside them are the shuffle
    rows = rows.withColumn("at", _at(F.col("doc_id"), F.col("h"), F.col("turn"))).withColumn("bucket", _bucket(F.col("at"), F.col("buckets")))
    sums = common.save(rows.groupBy("k", "bucket").agg(F.sum("size").alias("w")), "buckets")
    first = F.sum("w").over(Window.partitionBy("k").orderBy("bucket")) - F.col("w")
    start = common.save(sums.select(F.col("k").alias("bk"), F.col("bucket").alias("bb"), first.alias("start")), "starts")
    inside = Window.partitionBy("k", "bucket").orderBy("at", "doc_id", "h", "turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(common.sized(start, 32), (F.col("k") == F.col("bk")) & (F.col("bucket") == F.col("bb")))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "k", "source", "doc_id", "h", "size", "source_size", "target", "slots", (F.col("start") + F.col("inside")).alias("pos"))
    out = common.save(rows, "line")
    common.discard(sums, start)
    return out


def _edge(r, whole):
    """First word of block r of a line of whole words: floor(r * whole / slots)."""
    return F.floor(r.cast("double") * whole / F.col("slots")).cast("long")


def _blocks(line: DataFrame, slots: DataFrame) -> DataFrame:
    """The mix, a row a piece of a document in a block: slot, row, doc_id, first (its first word in the document), words."""
    whole = F.floor("target").cast("double")
    passes = line.where("size > 0 and slots > 0").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    passes = passes.withColumn("lo", F.col("c") * F.col("source_size") + F.col("pos")).withColumn("hi", F.least(F.col("lo") + F.col("size"), whole.cast("long"))).where("lo < hi")
    first = F.greatest(F.lit(0), F.floor(F.col("lo") * F.col("slots") / whole).cast("long") - 1)
    last = F.least(F.col("slots") - 1, F.floor(F.col("hi") * F.col("slots") / whole).cast("long") + 1)
    touched = passes.withColumn("b", F.explode(F.sequence(first, last)))
    begin = F.greatest("lo", _edge(F.col("b"), whole))
    touched = touched.select("row", "doc_id", F.col("k").alias("tk"), "b", (begin - F.col("lo")).alias("first"), (F.least("hi", _edge(F.col("b") + 1, whole)) - begin).alias("words")).where("words > 0")
    return touched.join(slots, (F.col("tk") == F.col("k")) & (F.col("b") == F.col("r"))).select("slot", "row", "doc_id", "first", "words")


def blocks(docs: DataFrame) -> DataFrame:
    """The mix in order: slot, doc_id, first (word of the document), words."""
    rows, plan = _entries(docs)
    slots, counts = schedule(docs.sparkSession, plan)
    line = _line(rows, plan, counts)
    common.discard(rows)
    return _blocks(line, slots).orderBy("slot", "row", "first").drop("row")


def mix(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, size, source_size, target, taken."""
    rows, plan = _entries(docs)
    slots, counts = schedule(docs.sparkSession, plan)
    line = _line(rows, plan, counts)
    common.discard(rows)
    got = _blocks(line, slots).groupBy(F.col("row").alias("g")).agg(F.sum("words").alias("taken"))
    return line.join(got, F.col("row") == F.col("g"), "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, limit: int = common.BROADCAST_BYTES) -> DataFrame:
    """Whole documents in mix order, in docs' own columns. limit: bytes of steps that are broadcast.

    A document goes to the block that holds its middle word, once for each pass over its source in which there is
    one; blocks stand in the order of their slots. The first document of a source whose target ends before that
    document's middle is given once, so that no source with a target is lost. Rows of one doc_id, text and source are
    alike here: each of them that is given has the other columns of one of them.

    Texts are moved once, to the stretch of slots they are given in. Along a source's line slots only rise, so a
    bucket's rows of one stretch and pass are a range of hashes; these few ranges tell a text its stretches without a
    shuffle, and there it meets its own places. Where rows are alike or sources too many for such a table, texts are
    joined by id and hash first and sorted after, which moves them twice.
    """
    spark, columns = docs.sparkSession, docs.columns
    rows, plan = _entries(docs)
    slots, counts = schedule(spark, plan)
    laid = _line(rows, plan, counts)
    line = laid.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    line = line.withColumn("middle", F.col("c") * F.col("source_size") + F.col("pos") + F.col("size") / 2)
    least = (F.col("c") == 0) & (F.col("pos") == 0) & (F.col("size") > 0) & (F.col("target") > 0)
    line = line.where((F.col("middle") < F.col("target")) | least)
    # the block of the middle word; a quotient may be one off the floors of the edges
    whole, word = F.greatest(F.floor("target"), F.lit(1)).cast("double"), F.floor("middle")
    line = line.withColumn("near", F.floor(word * F.col("slots") / whole).cast("long"))
    block = F.col("near") + (_edge(F.col("near") + 1, whole) <= word).cast("long") - (_edge(F.col("near"), whole) > word).cast("long")
    line = line.withColumn("b", F.greatest(F.lit(0), F.least(F.col("slots") - 1, block))).withColumnRenamed("k", "lk")
    placed = line.join(slots, (F.col("lk") == F.col("k")) & (F.col("b") == F.col("r")), "left")
    n = max(1, sum(counts.values()))
    parts = min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_SLOTS)))
    part = F.least(F.lit(parts - 1), F.floor(F.coalesce("slot", F.lit(n - 1)) * parts / n)).cast("int")
    d, h, s, slot, middle, own, key, lk, c, p = common.fresh(docs, "d", "h", "s", "slot", "middle", "own", "key", "lk", "c", "p")
    placed = placed.select(F.col("doc_id").alias(d), F.col("h").alias(h), F.col("source").alias(s), F.col("slot").alias(slot), F.col("middle").alias(middle), F.col("lk").alias(lk), F.col("c").alias(c), part.alias(p))
    placed = common.save(placed, "placed")
    alike = not rows.where("m > 1").isEmpty()
    common.discard(rows, laid, slots)
    texts = docs.withColumn(own, common.text_hash()).withColumn(key, F.col("source").cast("string"))
    id_ = F.col("doc_id").cast("long")
    order, out = [F.asc_nulls_last(slot), F.col(middle)], [F.col(f"`{x}`") for x in columns]

    if not alike and len(plan) * 256 <= limit:
        src, buckets, k, at, bucket, sk, sc, sp, sb, lo, hi = common.fresh(docs, "src", "buckets", "k", "at", "bucket", "sk", "sc", "sp", "sb", "lo", "hi")
        about = F.broadcast(spark.createDataFrame([(i, x["source"], _buckets(x["rows"])) for i, x in enumerate(plan)], f"{k} int, {src} string, {buckets} long"))
        spots = placed.join(about, F.col(lk) == F.col(k)).withColumn(at, _at(F.col(d), F.col(h), F.lit(1).cast("long")))
        steps = spots.groupBy(F.col(lk).alias(sk), _bucket(F.col(at), F.col(buckets)).alias(sb), F.col(c).alias(sc), F.col(p).alias(sp)).agg(F.min(at).alias(lo), F.max(at).alias(hi))
        steps = common.save(steps, "steps")
        if steps.count() * 128 <= limit:
            known = texts.join(about, F.col(key).eqNullSafe(F.col(src))).withColumn(at, _at(id_, F.col(own), F.lit(1).cast("long"))).withColumn(bucket, _bucket(F.col(at), F.col(buckets)))
            sent = known.join(F.broadcast(steps), (F.col(k) == F.col(sk)) & (F.col(bucket) == F.col(sb)) & F.col(at).between(F.col(lo), F.col(hi)))
            sent = sent.select(*out, own, k, sc, sp).repartitionById(parts, F.col(sp))
            same = (F.col(sp) == F.col(p)) & (F.col(sc) == F.col(c)) & (F.col(k) == F.col(lk)) & id_.eqNullSafe(F.col(d)) & (F.col(own) == F.col(h))
            # both sides lie by stretch already, so neither is moved again
            return sent.join(placed.drop(s).repartitionById(parts, F.col(p)).hint("merge"), same).sortWithinPartitions(*order).select(*out)
        common.discard(steps)

    if alike:
        texts = texts.dropDuplicates(["doc_id", own, key])
    asked = common.sized(placed, 192, limit)
    same = id_.eqNullSafe(asked[d]) & (F.col(own) == asked[h]) & F.col(key).eqNullSafe(asked[s])
    return texts.join(asked, same).orderBy(*order).select(*out)
