"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are first made distinct (a hot text is one fingerprint). Each is dealt to buckets of equal
masked bit patterns, the upper nodes of the index. In a bucket they are sorted by Gray rank, so that
neighbours differ in few bits, and nodes above them hold the pattern of bits that all members share; a
pair of nodes is dropped as a whole once the shared patterns differ in more than the radius.

``linked`` masks so that two fingerprints within the radius always meet (with radius r, of r + j blocks
some j are equal); the links are then exactly those of a comparison of all pairs. A bucket only passes
on a spanning star of what it linked, never its pairs. Buckets above ``CHUNK`` distinct fingerprints are
split, and every pair of their parts is compared in a task of its own.

``near_duplicates`` (the pipeline's stage: five-word shingles, similarity 0.8 or more) uses 256 bits and
random masks, whose number is set from the wanted recall at the threshold; the Jaccard similarity of both
shingle sets decides on the link. Each node's nearest node in a bucket is judged first. Then every further pair
within the radius is judged inside its bucket, in the first table in which it meets, unless links that held
already join its nodes; only the links that hold leave the bucket.

Null and empty texts have fingerprint zero and are linked like any other in ``linked``; in
``near_duplicates`` a text without words is no near-duplicate. A text of fewer words than a shingle is one
shingle. ``near_links`` takes fingerprints of the distinct shingles, as the similarity does, and its nodes are
distinct shingle sets, so that unlike sets of one fingerprint are compared like any others. A null doc_id is never the least of a component that has another.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
CHUNK = 4096
_LEAF, _FAN, _SMALL, _BATCH, _HELD = 32, 8, 512, 200_000, 64 << 20


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each shingle of the text, A-Z lower-cased, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0] + [e + 1 for e in ends[:-width]]
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)], np.uint64, len(starts))


#: For each byte, its bits as eight counters of eight bits each.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def simhash(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` 64-bit words; a bit is set where over half the hashes have it. Further words mix the hashes anew."""
    out = np.zeros(words, np.uint64)
    n = len(hashes)
    if not n:
        return out
    h = hashes
    for w in range(words):
        if w:
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h = h ^ (h >> np.uint64(29))
        b = _SPREAD[h.view(np.uint8).reshape(n, 8)]
        count = np.zeros(64, np.int64)
        for at in range(0, n, 255):
            count += b[at : at + 255].sum(0, dtype=np.uint64).view(np.uint8)
        out[w] = np.packbits(count * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Place of each word in the Gray code's order."""
    r = v.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class Nodes:
    """The hierarchy over one bucket's words in Gray order: level 0 holds the leaves."""

    def __init__(self, words: np.ndarray):
        self.words, self.levels = words, []
        cut = np.arange(0, len(words), _LEAF)
        both, some = np.bitwise_and.reduceat(words, cut), np.bitwise_or.reduceat(words, cut)
        while True:
            self.levels.append((~(both ^ some), both))
            if len(both) <= _FAN:
                return
            cut = np.arange(0, len(both), _FAN)
            both, some = np.bitwise_and.reduceat(both, cut), np.bitwise_or.reduceat(some, cut)

    def leaf_pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves whose shared patterns differ in no more than radius bits."""
        n = len(self.levels[-1][0])
        a, b = np.triu_indices(n)
        todo = [(len(self.levels) - 1, a, b)]
        while todo:
            level, a, b = todo.pop()
            mask, value = self.levels[level]
            ok = np.bitwise_count((value[a] ^ value[b]) & mask[a] & mask[b]).sum(1, dtype=np.int64) <= radius
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            if not level:
                yield a, b
                continue
            below = len(self.levels[level - 1][0])
            for at in range(0, len(a), 4096):
                x = (a[at : at + 4096, None] * _FAN + np.repeat(np.arange(_FAN), _FAN)[None, :]).ravel()
                y = (b[at : at + 4096, None] * _FAN + np.tile(np.arange(_FAN), _FAN)[None, :]).ravel()
                ok = (x <= y) & (y < below)
                todo.append((level - 1, x[ok], y[ok]))

    def pairs(self, radius: int, skip: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n = len(self.words)
        for la, lb in self.leaf_pairs(radius):
            for at in range(0, len(la), 1024):
                a, b = la[at : at + 1024], lb[at : at + 1024]
                if skip is not None:
                    ok = ~skip(a, b)
                    a, b = a[ok], b[ok]
                i = (a[:, None] * _LEAF + np.repeat(np.arange(_LEAF), _LEAF)[None, :]).ravel()
                j = (b[:, None] * _LEAF + np.tile(np.arange(_LEAF), _LEAF)[None, :]).ravel()
                ok = (i < j) & (j < n)
                i, j = i[ok], j[ok]
                d = _differ(self.words[i], self.words[j])
                ok = d <= radius
                yield i[ok], j[ok], d[ok]


class Stars:
    """Components of a batch of rows; gives each linked row with its component's first row."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            ok = a != b
            i, j = i[ok], j[ok]
            if not len(i):
                return
            np.minimum.at(self.root, np.maximum(a[ok], b[ok]), np.minimum(a[ok], b[ok]))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        i = np.flatnonzero(self.root != np.arange(len(self.root)))
        return i, self.root[i]


class Nearest:
    """Each row's nearest row."""

    def __init__(self, n: int):
        self.best = np.full(n, np.iinfo(np.int64).max)

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        np.minimum.at(self.best, i, (d << 40) | j)
        np.minimum.at(self.best, j, (d << 40) | i)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        i = np.flatnonzero(self.best < np.iinfo(np.int64).max)
        return i, self.best[i] & ((1 << 40) - 1)


class Open:
    """Rows with a row of another component within the radius that they meet here first. root: a row's component."""

    def __init__(self, words: np.ndarray, table: np.ndarray, side: np.ndarray, comp: np.ndarray, masks: list[tuple[int, int]]):
        self.words, self.table, self.side, self.root, self.masks = words, table, side, comp, masks
        self.open = np.zeros(len(words), bool)

    def new(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # side is -1 in a part of its own; of two parts that meet, only pairs across are new
        ok = (self.root[i] != self.root[j]) & ((self.side[i] < 0) | (self.side[i] != self.side[j]))
        i, j = i[ok], j[ok]
        x, t, ok = self.words[i] ^ self.words[j], self.table[i], np.ones(len(i), bool)
        for k, (w, mask) in enumerate(self.masks):
            ok &= (t <= k) | ((x[:, w] & np.uint64(mask)) != 0)
        return i[ok], j[ok]

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        i, j = self.new(i, j)
        self.open[i] = self.open[j] = True

    def links(self) -> np.ndarray:
        return np.flatnonzero(self.open)


class Judged(Open):
    """The pairs of such rows whose sets reach the similarity, without those that earlier ones join."""

    def __init__(self, words, table, side, comp, masks, sets: list[np.ndarray], similarity: float):
        super().__init__(words, table, side, comp, masks)
        self.sets, self.size, self.similarity, self.found = sets, np.array([len(x) for x in sets]), similarity, []

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        i, j = self.new(i, j)
        ok = np.minimum(self.size[i], self.size[j]) >= self.similarity * np.maximum(self.size[i], self.size[j]) - 1e-6
        for a, b in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
            if self.root[a] == self.root[b]:
                continue
            s = jaccard(self.sets[a], self.sets[b])
            if s >= self.similarity:
                self.found.append((a, b, s))
                self.root[self.root == self.root[b]] = self.root[a]

    def links(self) -> list[tuple[int, int, float]]:
        return self.found


def bucket_links(words: np.ndarray, runs: np.ndarray, radius: int, want):
    """What want makes of the pairs: links between rows of the same run (rows sorted by run, in a run by Gray rank)."""
    n = len(runs)
    starts = np.flatnonzero(np.diff(runs, prepend=-1))
    sizes = np.diff(starts, append=n)
    keep = want(n)
    left = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= _SMALL), sizes))
    for step in range(1, _SMALL):
        left = left[left + step < n]
        left = left[runs[left] == runs[left + step]]
        if not len(left):
            break
        d = _differ(words[left], words[left + step])
        ok = d <= radius
        keep.add(left[ok], left[ok] + step, d[ok])
    for s, size in zip(starts[sizes > _SMALL], sizes[sizes > _SMALL], strict=True):
        skip = None if isinstance(keep, Nearest) else _joined(keep, s, size)
        for i, j, d in Nodes(words[s : s + size]).pairs(radius, skip):
            keep.add(i + s, j + s, d)
    return keep.links()


def _joined(stars: Stars | Open, s: int, size: int) -> Callable:
    """Whether two leaves' rows are all in one component already."""
    cut = np.arange(0, size, _LEAF)

    def skip(a, b):
        r = stars.root[s : s + size]
        lo, hi = np.minimum.reduceat(r, cut), np.maximum.reduceat(r, cut)
        return (lo[a] == hi[a]) & (lo[b] == hi[b]) & (lo[a] == lo[b])

    return skip


def _search(n_words: int, radius: int, nearest: bool):
    """Rows sorted by bucket (t, key, lo, hi) in, links out; holds whole buckets and no more than a batch besides."""

    def links(rows: list[tuple]) -> pa.RecordBatch:
        run, node, words = (np.concatenate(x) for x in zip(*rows, strict=True))
        # a node has a row a bucket and part; sorted by Gray rank of its words, the first word leading
        order = np.lexsort([gray_rank(words[:, w]) for w in reversed(range(n_words))] + [run])
        run, node, words = run[order], node[order], words[order]
        i, j = bucket_links(words, run, radius, Nearest if nearest else Stars)
        return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["a", "b"])

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last, runs = [], 0, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], 1)
            new = np.any(key[1:] != key[:-1], axis=1)
            first = last is not None and not np.array_equal(key[0], last)
            run = runs + int(first) + np.concatenate([[0], np.cumsum(new)])
            runs, last = int(run[-1]), key[-1]
            node = b.column(4).to_numpy()
            words = np.stack([b.column(5 + w).to_numpy().view(np.uint64) for w in range(n_words)], 1)
            held.append((run, node, words))
            n += len(run)
            if n >= _BATCH and held[0][0][0] != runs:
                # all but the run that may go on
                run, node, words = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(run, runs))
                yield links([(run[:cut], node[:cut], words[:cut])])
                held, n = [(run[cut:], node[cut:], words[cut:])], len(run) - cut
        if held:
            yield links(held)
        held = []
        common.trim()

    return run_


def _whole(batches: Iterator[pa.RecordBatch], n_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
    """Whole buckets out of rows sorted by bucket (t, key, lo, hi): run, words, rows, in each run by Gray rank."""

    def ready(run: np.ndarray, rows: pa.Table):
        words = np.stack([rows.column(5 + w).to_numpy().view(np.uint64) for w in range(n_words)], 1)
        order = np.lexsort([gray_rank(words[:, w]) for w in reversed(range(n_words))] + [run])
        return run[order], words[order], rows.take(pa.array(order))

    held, runs, n, last, at = [], [], 0.0, None, 0
    weight = lambda b: b.num_rows / _BATCH + b.nbytes / _HELD
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], 1)
        first = last is not None and not np.array_equal(key[0], last)
        run = at + int(first) + np.concatenate([[0], np.cumsum(np.any(key[1:] != key[:-1], axis=1))])
        at, last = int(run[-1]), key[-1]
        held.append(b)
        runs.append(run)
        n += weight(b)
        if n >= 1 and runs[0][0] != at:
            # all but the run that may go on
            run, rows = np.concatenate(runs), pa.Table.from_batches(held)
            cut = int(np.searchsorted(run, at))
            yield ready(run[:cut], rows.slice(0, cut))
            held, runs = rows.slice(cut).to_batches(), [run[cut:]]
            n = sum(map(weight, held))
    if held:
        yield ready(np.concatenate(runs), pa.Table.from_batches(held))
    held = []
    common.trim()


def _sides(rows: pa.Table, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table, side and component of each row, for Open."""
    col = lambda c: rows.column(c).to_numpy().astype(np.int64)
    comp = np.unique(col(6 + n_words), return_inverse=True)[1]
    return col(0), np.where(col(2) == col(3), -1, col(5 + n_words)), comp


def _unjoined(n_words: int, radius: int, masks: list[tuple[int, int]]):
    """Rows in buckets (t, key, lo, hi, node, w0, ..., own, comp) in; out those that Open gives, as they are."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, words, rows in _whole(batches, n_words):
            sink = Open(words, *_sides(rows, n_words), masks)
            yield from rows.take(pa.array(bucket_links(words, run, radius, lambda n: sink))).to_batches()

    return run_


def _judge(n_words: int, radius: int, masks: list[tuple[int, int]], similarity: float):
    """Such rows with their shingle sets in, links (a, b, similarity) out."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, words, rows in _whole(batches, n_words):
            sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column(7 + n_words)]
            sink = Judged(words, *_sides(rows, n_words), masks, sets, similarity)
            found, node = bucket_links(words, run, radius, lambda n: sink), rows.column(4).to_numpy()
            ends = sorted((*sorted((int(node[a]), int(node[b]))), s) for a, b, s in found)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in ends], pa.int64()), pa.array([x[1] for x in ends], pa.int64()), pa.array([x[2] for x in ends], pa.float64())], ["a", "b", "similarity"])

    return run_


def _dealt(nodes: DataFrame, n_words: int, keys: list, more: tuple = ()) -> DataFrame:
    """nodes (saved: node, w0, ...) in each table's bucket, sorted by bucket in every partition; more: further columns, own is a row's part."""
    words = [f"w{k}" for k in range(n_words)] + [c for c in more if c != "own"]
    rows = nodes.select("node", *words, F.posexplode(F.array(*keys)).alias("t", "key"))
    hot = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    hot = common.save(hot.select(F.col("t").alias("ht"), F.col("key").alias("hk"), F.ceil(F.col("n") / CHUNK).cast("int").alias("parts")), "hot")
    rows = rows.join(common.sized(hot, 32), (F.col("t") == F.col("ht")) & (F.col("key") == F.col("hk")), "left")
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("t", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", *words[:n_words], *more)
    return rows.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi")


def block_masks(radius: int, spare: int, bits: int = 64) -> list[int]:
    """Masks of ``spare`` out of radius + spare blocks each: two words within the radius agree under one of them."""
    m = radius + spare
    edge = [bits * k // m for k in range(m + 1)]
    block = [(1 << edge[k + 1]) - (1 << edge[k]) for k in range(m)]
    return [sum(block[k] for k in pick) for pick in itertools.combinations(range(m), spare)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def linked(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """nodes: distinct 64-bit fingerprints (saved: w0 long). (a, b): stars whose components are those of all links."""
    n = nodes.count()
    spare = 1 if n < 1 << 22 else 2 if n < 1 << 30 else 3
    keys = [F.col("w0").bitwiseAND(F.lit(_signed(m))) for m in block_masks(radius, spare)]
    rows = _dealt(nodes.select(F.col("w0").alias("node"), "w0"), 1, keys)
    return rows.mapInArrow(_search(1, radius, False), "a long, b long")


def _fingerprint(width: int, n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shingle_hashes(t or b"", width) for t in b.column(1).cast(pa.binary()).to_pylist()]
            words = np.stack([simhash(h, n_words) for h in got]) if got else np.zeros((0, n_words), np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(h) for h in got], pa.int64()), *(pa.array(np.ascontiguousarray(words[:, w]).view(np.int64)) for w in range(n_words))], ["doc_id", "n", *(f"w{w}" for w in range(n_words))]
            )
        common.trim()

    return run


def fingerprints(docs: DataFrame, width: int = 3, n_words: int = 1) -> DataFrame:
    """A row a document: doc_id, n (shingles), w0, ... (the fingerprint's 64-bit words)."""
    schema = "doc_id long, n long, " + ", ".join(f"w{w} long" for w in range(n_words))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint(width, n_words), schema)


def _set_fingerprint(width: int, n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.unique(shingle_hashes(t or b"", width)) for t in b.column(1).cast(pa.binary()).to_pylist()]
            words = np.stack([simhash(h, n_words) for h in got]) if got else np.zeros((0, n_words), np.uint64)
            names = [xxhash.xxh128_digest(h.tobytes(), SEED) for h in got]
            nodes = pa.array([int.from_bytes(x[:8], "little", signed=True) for x in names], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), nodes, pa.array([len(h) for h in got], pa.int64()), pa.array(names, pa.binary()), *(pa.array(np.ascontiguousarray(words[:, w]).view(np.int64)) for w in range(n_words))],
                ["doc_id", "raw", "node", "n", "name", *(f"w{w}" for w in range(n_words))],
            )
        common.trim()

    return run


def set_fingerprints(docs: DataFrame, width: int, n_words: int) -> DataFrame:
    """A row a document: doc_id, raw (the text's hash), node and name (64 and 128 bits of the set's hash), n (distinct shingles), w0, ... (their fingerprint)."""
    schema = "doc_id long, raw long, node long, n long, name binary, " + ", ".join(f"w{w} long" for w in range(n_words))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), common.text_hash().alias("raw")).mapInArrow(_set_fingerprint(width, n_words), schema)


def fingerprint_components(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """A row a document: doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable over links)."""
    fps = common.save(fingerprints(docs, width).select("doc_id", "w0"), "simhash")
    nodes = common.save(fps.groupBy("w0").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = common.save(common.components(linked(nodes, radius)), "roots")
    led = roots.join(nodes, F.col("node") == F.col("w0")).groupBy("root").agg(F.min("least").alias("top"))
    named = roots.join(led.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select(F.col("node").alias("k"), "top")
    # a fingerprint that one document has and no link needs no look-up: the document is its own component
    ids = nodes.join(named, F.col("w0") == F.col("k"), "left").where("n > 1 or top is not null")
    ids = common.save(ids.select(F.col("w0").alias("f"), F.coalesce("top", "least").alias("component_id"), F.lit(True).alias("shared")), "ids")
    common.discard(nodes, roots)
    out = fps.join(common.sized(ids, 64), F.col("w0") == F.col("f"), "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _angle(similarity: float) -> float:
    """Share of bits that differ, on average, between sets of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def random_masks(n: int, similarity: float, recall: float, n_words: int, seed: int = 7) -> list[tuple[int, int]]:
    """(word, mask) of each table: buckets of about 128 of n nodes, as many tables as the recall at the threshold asks for."""
    k = min(28, max(8, round(math.log2(max(2, n))) - 7))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - _angle(similarity)) ** k))
    rng = np.random.default_rng(seed)
    return [(t % n_words, sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for t in range(tables)]


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t or b"", width).astype(np.uint32)).tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])
        common.trim()

    return run


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sets, each sorted."""
    if len(x) < len(y):
        x, y = y, x
    if not len(y):
        return 0.0
    both = int(np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y))
    return both / (len(x) + len(y) - both)


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [jaccard(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["a", "b", "similarity"])


def near_links(docs: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.98, n_words: int = 4) -> DataFrame:
    """(a, b, similarity): pairs of doc_ids whose shingle sets (32-bit hashes) reach the similarity. Null ids have no pair here."""
    keyed, links = near_nodes(docs, width, similarity, recall, n_words)
    led = common.save(keyed.groupBy("node").agg(F.min("doc_id").alias("lead")).where("lead is not null"), "leads")
    a, b = (led.select(F.col("node").alias(c), F.col("lead").alias(f"l{c}")) for c in "ab")
    far = links.join(a, "a").join(b, "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"), "similarity")
    same = keyed.join(led, "node").select(F.col("lead").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity"))
    return far.union(same).where("a <> b").distinct()


def near_nodes(docs: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.98, n_words: int = 4) -> tuple[DataFrame, DataFrame]:
    """Two tables. (node, doc_id, raw, z): each document with the node of its shingle set. (a, b, similarity): pairs of nodes that reach the similarity."""
    words = [f"w{k}" for k in range(n_words)]
    fps = common.save(set_fingerprints(docs, width, n_words).where("n > 0"), "simhash")
    one = F.when(F.min("name") == F.max("name"), F.min(F.struct("doc_id", "raw"))).otherwise(F.raise_error("two shingle sets share 64 bits of their hash"))
    nodes = common.save(fps.groupBy("node").agg(one.alias("rep"), *(F.min(w).alias(w) for w in words)), "nodes")
    masks = random_masks(nodes.count(), similarity, recall, n_words)
    keys = [F.col(f"w{w}").bitwiseAND(F.lit(_signed(m))) for w, m in masks]
    reach = round(64 * n_words * _angle(similarity - 0.2))
    close = _dealt(nodes, n_words, keys).mapInArrow(_search(n_words, reach, True), "a long, b long")
    pairs = close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    pairs = common.save(pairs, "pairs")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), common.text_hash().alias("raw"))

    def sets_of(ids: DataFrame) -> DataFrame:
        # one document's text a node
        reps = common.save(nodes.join(ids.distinct(), nodes["node"] == F.col("k")).select("node", F.col("rep.doc_id").alias("i"), F.col("rep.raw").alias("h")), "ids")
        asked = common.sized(reps, 24)
        found = texts.join(asked, texts["doc_id"].eqNullSafe(asked["i"]) & (texts["raw"] == asked["h"])).select("node", "text")
        out = common.save(found.mapInArrow(_sets(width), "id long, shingles binary").dropDuplicates(["id"]), "sets")
        common.discard(reps)
        return out

    sets = sets_of(pairs.select(F.col("a").alias("k")).union(pairs.select("b")))
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    judged = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_jaccard, "a long, b long, similarity double")
    first = common.save(judged.where(F.col("similarity") >= similarity), "links")
    common.discard(sets, pairs)
    # the pairs that are left: within the radius, in one bucket, and not joined by the links so far
    roots = common.save(common.components(first), "roots")
    named = common.sized(roots.select(F.col("node").alias("k"), "root"), 24)
    nodes_ = common.save(nodes.join(named, nodes["node"] == named["k"], "left").select("node", *words, F.coalesce("root", "node").alias("comp")), "joined")
    schema = f"t int, key long, lo int, hi int, node long, {', '.join(f'{w} long' for w in words)}, own int, comp long"
    left_ = common.save(_dealt(nodes_, n_words, keys, ("own", "comp")).mapInArrow(_unjoined(n_words, reach, masks), schema), "unjoined")
    sets = sets_of(left_.select(F.col("node").alias("k")))
    rows = left_.join(sets.select(F.col("id").alias("k"), "shingles"), F.col("node") == F.col("k")).drop("k")
    rows = rows.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi")
    rest = rows.mapInArrow(_judge(n_words, reach, masks, similarity), "a long, b long, similarity double")
    out = common.save(first.union(rest), "links")
    common.discard(sets, nodes, nodes_, roots, left_, first)
    return fps.select("node", "doc_id", "raw", F.col("doc_id").isNull().alias("z")), out


def deduplicate(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, with the least doc_id of each group of near-duplicates (null last, then the text's hash), in docs' own columns.

    Rows of one id and text are one document here, which stays or goes as a whole.
    """
    keyed, links = near_nodes(docs, width, similarity)
    heads = common.save(keyed.groupBy("node").agg(F.min(F.struct("z", "doc_id", "raw")).alias("head")), "heads")
    roots = common.save(common.components(links).select(F.col("node").alias("rn"), "root"), "roots")
    tops = common.save(heads.join(common.sized(roots, 24), F.col("node") == F.col("rn")).groupBy("root").agg(F.min("head").alias("top")).withColumnRenamed("root", "r"), "tops")
    named = roots.join(common.sized(tops, 48), F.col("root") == F.col("r")).select(F.col("rn").alias("k"), "top")
    keeper = common.save(heads.join(named, F.col("node") == F.col("k"), "left").select(F.col("node").alias("k"), F.coalesce("top", "head").alias("keep")), "keepers")
    judged = keyed.join(common.sized(keeper, 48), F.col("node") == F.col("k")).where(~F.struct("z", "doc_id", "raw").eqNullSafe(F.col("keep")))
    return common.among(docs, common.save(judged.select("doc_id", "raw").distinct(), "dropped"), "left_anti")
