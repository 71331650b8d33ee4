"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Each scan partition normalises its texts (characters ``[\\x20\\x09-\\x0D]`` deleted), and sends every
   owner the sorted distinct 64-bit fingerprints of that owner's range as one Golomb-Rice blob. A hot
   text is one code in a blob, however many copies the partition has.
2. Each owner decodes its blobs, counts the partitions that sent a fingerprint, and answers each of them
   with a bitmap. A row is a suspect if its bit is set or its fingerprint is repeated in its partition.
3. Only suspects' texts are looked up again and grouped by their bytes. The grouping combines on the map
   side, so a text crosses the shuffle at most once a map task. The look-up joins the suspects' ids by broadcast; where they are
   too many for that, a Bloom filter of 32 MB over them keeps other texts from the join's shuffle.

Of rows that repeat a doc_id with an equal text one stays: rows are known by their scan partition and place there. Null
text counts as empty; a null doc_id sorts after all others as keeper. Extra columns are ignored by ``duplicates`` and
kept by ``deduplicate``. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Slices of the filter that stands before the shuffle of many suspects.
SLICES = 64
SPACE = b" \t\n\x0b\x0c\r"
_OUT = "kind int, part int, row long, doc_id long, raw long, n_chars long, fp long, sha string, owner int, n long, blob binary"
_ARROW = pa.schema(
    [("kind", pa.int32()), ("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("raw", pa.int64()), ("n_chars", pa.int64()), ("fp", pa.int64()), ("sha", pa.string()), ("owner", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())]
)


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned 64-bit values as their first, then the gaps in Golomb-Rice code: unary quotients, remainders."""
    v = values.astype(np.uint64)
    gaps = np.diff(v, prepend=v[:1])
    k = max(0, int(np.log2(max(1.0, float(v[-1] - v[0]) / len(v)))) - 1)
    q = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(q + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    low = (gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)
    return bytes([k]) + v[:1].astype("<u8").tobytes() + len(unary).to_bytes(8, "little") + np.packbits(unary).tobytes() + np.packbits(low.astype(np.uint8).ravel()).tobytes()


def golomb_decode(blob: bytes, n: int) -> np.ndarray:
    k, first, length = blob[0], np.frombuffer(blob[1:9], "<u8")[0], int.from_bytes(blob[9:17], "little")
    cut = 17 + (length + 7) // 8
    unary = np.unpackbits(np.frombuffer(blob[17:cut], np.uint8), count=length)
    q = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    low = np.zeros(n, np.uint64)
    if k:
        bits = np.unpackbits(np.frombuffer(blob[cut:], np.uint8), count=n * k).reshape(n, k).astype(np.uint64)
        low = (bits << np.arange(k, dtype=np.uint64)[None, :]).sum(1, dtype=np.uint64)
    return first + np.cumsum((q.astype(np.uint64) << np.uint64(k)) | low, dtype=np.uint64)


def owners_of(fps: np.ndarray, owners: int) -> np.ndarray:
    """Owner of each fingerprint: equal ranges of the upper 32 bits."""
    return (((fps >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)).astype(np.int64)


def _fingerprints(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, first = TaskContext.get().partitionId(), [], 0
        for b in batches:
            text = b.column(1)
            raw = [(t or b"").translate(None, SPACE) for t in text.cast(pa.binary()).to_pylist()]
            fps = np.fromiter((xxhash.xxh64_intdigest(t) for t in raw), np.uint64, len(raw))
            seen.append(np.unique(fps))
            n = len(raw)
            nothing = {"owner": pa.nulls(n, pa.int32()), "n": pa.nulls(n, pa.int64()), "blob": pa.nulls(n, pa.binary())}
            yield pa.RecordBatch.from_pydict(
                {"kind": np.zeros(n, np.int32), "part": np.full(n, part, np.int32), "row": np.arange(first, first + n), "doc_id": b.column(0), "raw": b.column(2), "n_chars": pc.fill_null(pc.utf8_length(text), 0).cast(pa.int64()), "fp": fps.view(np.int64), "sha": [hashlib.sha256(t).hexdigest() for t in raw]} | nothing,
                schema=_ARROW,
            )
            first += n
        if not seen:
            return
        fps = np.unique(np.concatenate(seen))
        own = owners_of(fps, owners)
        for o in np.unique(own):
            mine = fps[own == o]
            yield pa.RecordBatch.from_pylist([{"kind": 1, "part": part, "owner": int(o), "n": len(mine), "blob": golomb_encode(mine)}], schema=_ARROW)

    return run


_REPLY = pa.schema([("part", pa.int32()), ("owner", pa.int32()), ("bitmap", pa.binary())])


def _answer(t: pa.Table) -> pa.Table:
    """An owner's part: for each sender a bit a fingerprint, set if another partition sent it too."""
    parts, ns, blobs = (t.column(c).to_pylist() for c in ("part", "n", "blob"))
    got = [golomb_decode(b, n) for b, n in zip(blobs, ns, strict=True)]
    values, counts = np.unique(np.concatenate(got), return_counts=True)
    twice = values[counts > 1]
    bits = [np.packbits(np.isin(g, twice, assume_unique=True)).tobytes() for g in got]
    return pa.table({"part": parts, "owner": t.column("owner"), "bitmap": bits}, schema=_REPLY)


_MARKED = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("raw", pa.int64()), ("n_chars", pa.int64()), ("sha", pa.string()), ("suspect", pa.bool_())])


def _mark(owners: int):
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        fps = rows.column("fp").to_numpy().view(np.uint64)
        distinct, at, counts = np.unique(fps, return_inverse=True, return_counts=True)
        own = owners_of(distinct, owners)
        flag = counts > 1
        for o, bitmap in zip(replies.column("owner").to_pylist(), replies.column("bitmap").to_pylist(), strict=True):
            lo, hi = np.searchsorted(own, [o, o + 1])
            flag[lo:hi] |= np.unpackbits(np.frombuffer(bitmap, np.uint8), count=hi - lo).astype(bool)
        return pa.table({c: rows.column(c) for c in ("part", "row", "doc_id", "raw", "n_chars", "sha")} | {"suspect": flag[at]}, schema=_MARKED)

    return run


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [(t or b"").translate(None, SPACE) for t in b.column(0).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in raw])], ["norm", "sha"])


def _places(h: np.ndarray, bits: int, probes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slice, bit) of each probe of 64-bit hashes in a Bloom filter of SLICES slices of 2 ** bits bits."""
    step, at = (h >> np.uint64(34)) | np.uint64(1), h >> np.uint64(6)
    for k in range(probes):
        yield (h % np.uint64(SLICES)).astype(np.int64), ((at + np.uint64(k) * step) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _slices(bits: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for s, at in _places(b.column(0).to_numpy().view(np.uint64), bits, probes):
                for k in np.unique(s).tolist():
                    held.setdefault(k, np.zeros(1 << bits, bool))[at[s == k]] = True
        for k, x in held.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "filled": pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())})

    return run


def bloom(keys: DataFrame, count: int, bits: int = 22) -> Callable[[Column], Column]:
    """A filter over hashes (keys: one column of longs): true for all of keys, and for few others while keys are few for its
    SLICES * 2 ** bits bits. Its size is fixed; each slice is filled by one task."""
    probes = max(1, min(8, round(0.7 * SLICES * (1 << bits) / max(1, count))))
    key = keys.columns[0]
    rows = keys.repartition(SLICES, F.pmod(F.col(key).bitwiseAND(F.lit(SLICES - 1)), F.lit(SLICES))).mapInArrow(_slices(bits, probes), "slice int, filled binary")
    found = keys.sparkSession.sparkContext.broadcast({r["slice"]: bytes(r["filled"]) for r in rows.collect()})  # 32 MB

    @F.arrow_udf(T.BooleanType())
    def maybe(hashes: pa.Array) -> pa.Array:
        h = hashes.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        out = np.ones(len(h), bool)
        for s, at in _places(h, bits, probes):
            for k in np.unique(s).tolist():
                mine = s == k
                if k not in found.value:
                    out[mine] = False
                    continue
                filled = np.frombuffer(found.value[k], np.uint8)
                out[mine] &= (filled[at[mine] >> 3] >> (at[mine] & 7)) & 1 == 1
        return pa.array(out)

    return maybe


def duplicates(docs: DataFrame, limit: int = common.BROADCAST_BYTES) -> DataFrame:
    """A row a document: doc_id, keep_id, group_size, kept, text_sha256. limit: bytes of suspects' ids that are broadcast."""
    return _judged(docs, limit).drop("raw")


def _judged(docs: DataFrame, limit: int = common.BROADCAST_BYTES) -> DataFrame:
    """duplicates, and raw, the text's hash as common.text_hash gives it."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = texts.withColumn("raw", common.text_hash())
    owners = max(8, texts.rdd.getNumPartitions())
    sent = common.save(sent.mapInArrow(_fingerprints(owners), _OUT), "fingerprints")
    rows = sent.where("kind = 0").select("part", "row", "doc_id", "raw", "n_chars", "fp", "sha")
    replies = sent.where("kind = 1").select("part", "owner", "n", "blob").groupBy("owner").applyInArrow(_answer, "part int, owner int, bitmap binary")
    marked = common.save(rows.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_mark(owners), "part int, row long, doc_id long, raw long, n_chars long, sha string, suspect boolean"), "marked")
    common.discard(sent)

    ids = common.save(marked.where("suspect").select(F.col("doc_id").alias("s")).distinct(), "suspects")
    count = ids.count()
    wanted, asked = ids, texts
    if count * 64 <= limit:
        wanted = F.broadcast(ids)
    else:
        # suspects are too many to send to every executor: a filter of fixed size keeps most other texts out of the shuffle
        asked = texts.where(bloom(ids.select(F.xxhash64("s").alias("h")), count)(F.xxhash64("doc_id")))
    again = asked.join(wanted, asked["doc_id"].eqNullSafe(wanted["s"]), "left_semi").select("text").mapInArrow(_normalise, "norm binary, sha string")
    # one row a distinct text: the bytes themselves are the grouping key
    twins = again.groupBy("norm", "sha").count().groupBy("sha").count().where("count > 1").limit(1).collect()
    if twins:
        raise ValueError(f"two texts share SHA-256 {twins[0]['sha']}")
    common.discard(ids)
    first = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("z"), "doc_id", "part", "row")).alias("k")
    groups = marked.where("suspect").groupBy("sha").agg(F.count("*").alias("size"), first).where("size > 1")
    groups = common.sized(common.save(groups.select(F.col("sha").alias("g"), "size", F.col("k.doc_id").alias("keep"), F.col("k.part").alias("kp"), F.col("k.row").alias("kr")), "groups"), 256)
    whole = marked.join(groups, F.col("sha") == F.col("g"), "left")
    alone = F.col("g").isNull()
    return whole.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("size")).cast("long").alias("group_size"),
        (alone | ((F.col("part") == F.col("kp")) & (F.col("row") == F.col("kr")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "raw",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs, with one document of each group of equal texts, in docs' own columns."""
    # a row is known by its id and text, so that null and repeated ids with other texts are documents of their own
    found = common.save(_judged(docs).groupBy("doc_id", "raw").agg(F.max("kept").alias("k"), F.count("*").alias("n")).where("not k or n > 1"), "found")
    out = common.among(docs, found, "left_anti")
    twice = found.where("k")
    if not twice.limit(1).count():
        return out
    once = common.among(docs, twice, "left_semi").withColumn("_raw", common.text_hash()).dropDuplicates(["doc_id", "_raw"])
    return out.unionByName(once.select(*docs.columns))
