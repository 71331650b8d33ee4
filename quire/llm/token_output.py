"""Token ids in Re-Pair-compressed shard files.

Documents are range-partitioned by doc_id and text hash; each partition's ids, in ascending doc_id order, fill shards
of at most ``SHARD_IDS`` ids (a longer document has a shard of its own). In a shard frequent id pairs are replaced
by nonterminals until no pair occurs ``LEAST`` times: a rule and its length cost about what so many places save. Each
step takes the pairs that are at least ``STEP`` times as frequent as the most frequent one; where places overlap,
every other one from the left goes. Counts are kept as pairs come and go, so a step costs what it replaces.

A file holds the distinct ids, the rules, their expansion lengths and the remaining symbols, so any range of ids
is decoded from the symbols that cover it alone. Files are the binary payloads of a Parquet folder, which any
store that Spark writes to can hold.

Null text is empty: its ids are the end id alone. A null doc_id sorts first. Rows that repeat a doc_id follow
each other in the order of their text's hash. Columns but doc_id and text are ignored. An empty table gives a folder
without shards.

File: magic ``QRP2``; unsigned 32-bit numbers of distinct ids, rules, symbols, documents; then doc_ids (signed 64-bit), a
byte each that tells a null doc_id, ends of documents (unsigned 64-bit ids from the shard's start), the distinct ids
(unsigned 32-bit, ascending), rules (two symbols each), lengths (unsigned 32-bit), symbols. A symbol below the number of
distinct ids stands for that id, others for rules. Symbols have two bytes while there are at most 65,536 of them, else
four. All little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

SHARD_IDS, LEAST, STEP = 1 << 20, 8, 0.7
_MAGIC, _HEAD = b"QRP2", struct.Struct("<4s4I")


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted keys) of keys of so many bits. A key and its place share a word where they fit: words sort much faster than places by keys."""
    place = len(key).bit_length()
    if bits + place > 64:
        order = np.argsort(key)
        return order, key[order]
    word = key << np.uint64(place)
    word |= np.arange(len(key), dtype=np.uint64)
    word.sort()
    return (word & np.uint64((1 << place) - 1)).astype(np.int64), word >> np.uint64(place)


class _Pairs:
    """The frequent pairs: how often each occurs, and where it stood when it came up. Counts only fall from then on."""

    def __init__(self, least: int):
        self.least = least
        self.left = self.right = self.count = self.begin = self.size = self.live = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int32)

    def add(self, a: np.ndarray, b: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Pair numbers of the places (-1: not frequent); none of these pairs was seen before."""
        number = np.full(len(a), -1, np.int32)
        low = int(b.max()).bit_length()
        key = a.astype(np.uint64)
        key <<= np.uint64(low)
        key |= b.astype(np.uint64)
        # only places whose hash is frequent can hold a frequent pair
        bits = max(8, len(a).bit_length())
        bucket = key * np.uint64(0x9E3779B97F4A7C15)
        bucket >>= np.uint64(64 - bits)
        bucket = bucket.view(np.int64)
        maybe = np.flatnonzero((np.bincount(bucket, minlength=1 << bits) >= self.least)[bucket])
        if not len(maybe):
            return number
        order, key = _sorted(key[maybe], int(a.max()).bit_length() + low)
        lead = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(lead, append=len(key))
        often = size >= self.least
        keep, size, key = maybe[order[np.repeat(often, size)]], size[often], key[lead[often]]
        number[keep] = np.repeat(len(self.count) + np.arange(len(size), dtype=np.int32), size)
        new = {"left": (key >> np.uint64(low)).astype(np.int64), "right": (key & np.uint64((1 << low) - 1)).astype(np.int64), "count": size, "size": size, "begin": len(self.at) + np.cumsum(size) - size, "live": len(self.count) + np.arange(len(size)), "at": places[keep]}
        for name, more in new.items():
            setattr(self, name, np.concatenate([getattr(self, name), more]))
        return number

    def take(self, step: float) -> np.ndarray:
        """The pairs of this step, the most frequent first."""
        self.live = self.live[self.count[self.live] >= self.least]
        if not len(self.live):
            return self.live
        n = self.count[self.live]
        top = self.live[n >= max(self.least, int(step * n.max()))]
        return top[np.argsort(-self.count[top], kind="stable")]

    def places(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, turn of the pair in pairs), as stored."""
        size = self.size[pairs]
        upto = np.cumsum(size)
        return self.at[np.arange(upto[-1]) + np.repeat(self.begin[pairs] - (upto - size), size)], np.repeat(np.arange(len(pairs), dtype=np.int32), size)


def repair(ids: np.ndarray, terminals: int, least: int = LEAST, step: float = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, lengths): rule k is nonterminal terminals + k and only has symbols below it. No pair is left ``least`` times."""
    n = len(ids)
    s, rules, size = ids.astype(np.int32), [], np.ones(terminals, np.int64)
    if n < 2:
        return s.astype(np.uint32), np.zeros((0, 2), np.uint32), np.zeros(0, np.uint32)
    # places in a row: what follows a place, what comes before it (n and -1: none), and its pair (-1: no frequent one)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    pairs, alive = _Pairs(least), np.ones(n, bool)
    pair = np.append(pairs.add(s[:-1], s[1:], np.arange(n - 1, dtype=np.int32)), np.int32(-1))
    while len(top := pairs.take(step)):
        at, which = pairs.places(top)
        ok = pair[at] == top[which]
        word = np.sort((at[ok].astype(np.int64) << 32) | which[ok])
        at, which = (word >> 32).astype(np.int32), (word & 0xFFFFFFFF).astype(np.int32)
        # of places that overlap, every other one from the left
        lead = np.flatnonzero(np.concatenate([[True], after[at[:-1]] != at[1:]]))
        turn = np.arange(len(at)) - np.repeat(lead, np.diff(lead, append=len(at)))
        at, which = at[turn % 2 == 0], which[turn % 2 == 0]
        gone, prior = after[at], before[at]
        prior = prior[(prior >= 0) & (prior != np.concatenate([[-1], gone[:-1]]))]
        old = np.concatenate([pair[prior], pair[at], pair[gone]])
        pairs.count -= np.bincount(old[old >= 0], minlength=len(pairs.count))
        pair[prior], pair[at], pair[gone], alive[gone] = -1, -1, -1, False
        # the new symbols, and the chain without the places that are gone
        first = terminals + len(rules)
        left, right = pairs.left[top], pairs.right[top]
        rules += zip(left.tolist(), right.tolist(), strict=True)
        size = np.concatenate([size, size[left] + size[right]])
        s[at] = first + which
        follow = after[gone]
        after[at] = follow
        back = follow < n
        before[follow[back]] = at[back]
        prior = before[at]
        new = np.concatenate([at[back], prior[(prior >= 0) & (prior != np.concatenate([[-1], at[:-1]]))]])
        if len(new):
            pair[new] = pairs.add(s[new], s[after[new]], new)
    return s[alive].astype(np.uint32), np.array(rules, np.uint32).reshape(-1, 2), size[terminals:].astype(np.uint32)


def _kind(symbols: int) -> np.dtype:
    return np.dtype("<u2" if symbols <= 1 << 16 else "<u4")


def write_shard(doc_ids: list[int | None], ends: list[int], ids: np.ndarray) -> bytes:
    used = np.bincount(ids) > 0 if len(ids) else np.zeros(0, bool)
    distinct = np.flatnonzero(used)
    symbols, rules, lengths = repair((np.cumsum(used) - 1)[ids] if len(ids) else ids, len(distinct))
    kind = _kind(len(distinct) + len(rules))
    return b"".join(
        [
            _HEAD.pack(_MAGIC, len(distinct), len(rules), len(symbols), len(doc_ids)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            bytes(d is None for d in doc_ids),
            np.array(ends, "<u8").tobytes(),
            distinct.astype("<u4").tobytes(),
            rules.astype(kind).tobytes(),
            lengths.astype("<u4").tobytes(),
            symbols.astype(kind).tobytes(),
        ]
    )


class Shard:
    """A shard file opened for reading."""

    def __init__(self, blob: bytes):
        magic, n, n_rules, n_symbols, n_docs = _HEAD.unpack_from(blob)
        if magic != _MAGIC:
            raise ValueError("not a shard file")
        kind, at = _kind(n + n_rules), _HEAD.size

        def take(dtype, count):
            nonlocal at
            out = np.frombuffer(blob, dtype, count, at)
            at += out.nbytes
            return out

        ids, nulls = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, nulls, strict=True)]
        self.ends = take("<u8", n_docs).astype(np.int64)
        distinct = take("<u4", n)
        self.rules = take(kind, 2 * n_rules).reshape(-1, 2)
        lengths = take("<u4", n_rules).astype(np.int64)
        self.symbols = take(kind, n_symbols)
        self.size = np.concatenate([np.ones(n, np.int64), lengths])
        self.reach = np.cumsum(self.size[self.symbols])
        # the expansions of all symbols, one after another; a rule's halves stand before it
        self.begin = np.cumsum(self.size) - self.size
        parts = [distinct[k : k + 1].tobytes() for k in range(n)]
        for a, b in self.rules.tolist():
            parts.append(parts[a] + parts[b])
        text = np.frombuffer(b"".join(parts), "<u4")
        self.text = text

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end), from the symbols that cover them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        i, j = np.searchsorted(self.reach, [start, end - 1], "right")
        symbols = self.symbols[i : j + 1]
        size = self.size[symbols]
        upto = np.cumsum(size)
        out = self.text[np.arange(upto[-1]) + np.repeat(self.begin[symbols] - (upto - size), size)]
        skip = start - (int(self.reach[i]) - int(size[0]))
        return out[skip : skip + end - start]


_FILE = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])


def _shards(path: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        docs, ends, held, n, before, shard = [], [], [], 0, 0, 0

        def flush():
            nonlocal docs, ends, held, n, before, shard
            blob = write_shard(docs, ends, np.concatenate(held))
            out = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "before": before, "n_ids": n, "payload": blob}], schema=_FILE)
            before, shard, docs, ends, held, n = before + n, shard + 1, [], [], [], 0
            return out

        for b in batches:
            ids, upto = enc.column(b.column(1))
            ids, upto = np.insert(ids, upto, end_id), upto + np.arange(1, len(upto) + 1)
            start = 0
            for doc, end in zip(b.column(0).to_pylist(), upto.tolist(), strict=True):
                if n and n + end - start > shard_ids:
                    yield flush()
                n += end - start
                docs.append(doc)
                ends.append(n)
                held.append(ids[start:end])
                start = end
        if docs:
            yield flush()
        common.trim()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shard_ids: int = SHARD_IDS) -> None:
    """Writes docs' ids to shard files under path."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), common.text_hash().alias("h"))
    # texts of one (or no) doc_id are dealt by their hash
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    rows.drop("h").mapInArrow(_shards(tokenizer, end_id, shard_ids), "part int, shard int, before long, n_ids long, payload binary").write.option("compression", "none").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for base, blob in zip(b.column("start").to_pylist(), b.column("payload").to_pylist(), strict=True):
            s = Shard(blob)
            ids = s.read(0, int(s.ends[-1])).astype("<u4")
            starts = np.concatenate([[0], s.ends[:-1]])
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(starts.tolist(), s.ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(starts + base), pa.array(s.ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digest(spark, path: str) -> DataFrame:
    """A row a document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema("part int, shard int, before long, n_ids long, payload binary").parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row a write task
    first = common.save(parts.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first")), "firsts")
    rows = files.join(common.sized(first, 16), F.col("part") == F.col("p")).select((F.col("first") + F.col("before")).alias("start"), "payload")
    return rows.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = common.new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer)
    return read_digest(docs.sparkSession, path)
