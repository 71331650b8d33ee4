"""Approximate nearest neighbours by inner product, over robust-pruned directed graphs.

Vectors are dealt to shards of bounded size by a hash. Each shard builds a graph: points are inserted in
batches, a greedy beam search from the medoid proposes each one's neighbours, and relaxed distance pruning
(a candidate goes if a kept neighbour is nearer to it by the factor ``alpha``) keeps few and diverse edges.
Queries travel to every shard in blocks, a beam search answers them there, and the shards' answers are merged.

Inner product becomes Euclidean distance by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm,
so the nearest by distance is the one with the largest product. The graph is built in single precision; scores are
computed in double precision from the original vectors. A query for which a shard's graph reaches fewer points than the
beam holds, though there are more, is compared with all points of that shard. Equal vectors are one point of the graph with its least ``k + 1`` ids, which is all that
ties to smaller ids can need; they are counted down in two salted steps, so a vector that a third of all rows
share is in no single task.

Vectors that are null, all zero, of another length than most, or hold null or non-finite components take no
part, nor do rows with a null vec_id. Rows that repeat a vec_id with an equal vector are one. Columns but vec_id and
embedding are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARD, DEGREE, BEAM, ALPHA, BLOCK = 8192, 32, 64, 1.2, 512


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances), each query's ``beam`` nearest found, nearest first; -1 where there are fewer. All queries step at once."""
    q, norms = len(queries), np.einsum("ij,ij->i", points, points)
    qn = np.einsum("ij,ij->i", queries, queries)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, len(points)), bool)
    ids[:, 0], dist[:, 0], done[:, 0], seen[:, start] = start, norms[start] + qn - 2 * queries @ points[start], False, True
    active = np.arange(q)
    while len(active):
        open_ = ~done[active]
        active = active[open_.any(1)]
        if not len(active):
            break
        at = (~done[active]).argmax(1)
        done[active, at] = True
        near = edges[ids[active, at]]
        row = np.repeat(np.arange(len(active)), near.shape[1])
        flat = near.ravel()
        ok = flat >= 0
        row, flat = row[ok], flat[ok]
        ok = ~seen[active[row], flat]
        row, flat = row[ok], flat[ok]
        seen[active[row], flat] = True
        new = np.full((len(active), near.shape[1]), -1, np.int64)
        lead = np.searchsorted(row, np.arange(len(active)))
        place = np.arange(len(row)) - lead[row]
        new[row, place] = flat
        width = int(place.max()) + 1 if len(place) else 0
        if not width:
            continue
        new = new[:, :width]
        d = np.full(new.shape, np.inf)
        d[row, place] = norms[flat] + qn[active[row]] - 2 * np.einsum("ij,ij->i", points[flat], queries[active[row]])
        all_d, all_i = np.hstack([dist[active], d]), np.hstack([ids[active], new])
        all_done = np.hstack([done[active], new < 0])
        order = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        part = np.take_along_axis(all_d, order, 1)
        order = np.take_along_axis(order, np.argsort(part, axis=1, kind="stable"), 1)
        dist[active], ids[active], done[active] = (np.take_along_axis(x, order, 1) for x in (all_d, all_i, all_done))
    return ids, dist


def robust_prune(points: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each of ``own``, at most ``degree`` of its candidates (-1: none): the nearest stays, and drops those it is alpha times nearer to."""
    c = np.where(cand < 0, own[:, None], cand)
    vec = points[c]
    dist = ((vec - points[own][:, None, :]) ** 2).sum(2)
    dist[c == own[:, None]] = np.inf
    order = np.argsort(dist, axis=1, kind="stable")
    c, dist, vec = np.take_along_axis(c, order, 1), np.take_along_axis(dist, order, 1), np.take_along_axis(vec, order[:, :, None], 1)
    dist[:, 1:][c[:, 1:] == c[:, :-1]] = np.inf
    norm = np.einsum("ijk,ijk->ij", vec, vec)
    out = np.full((len(own), degree), -1, np.int64)
    rows = np.arange(len(own))
    for k in range(degree):
        best = dist.argmin(1)
        ok = np.isfinite(dist[rows, best])
        if not ok.any():
            break
        out[ok, k] = c[rows, best][ok]
        to = norm + norm[rows, best][:, None] - 2 * (vec @ vec[rows, best][:, :, None])[:, :, 0]
        # distances are squared, and so is the factor
        dist[alpha * alpha * to <= dist] = np.inf
        dist[rows, best] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, int]:
    """(edges (n, degree), start). Batches grow from one point on, so that each searches a graph of those before it."""
    n = len(points)
    edges = np.full((n, degree), -1, np.int64)
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at, size = 1, 1
    while at < n:
        new = order[at : at + size]
        found, _ = beam_search(points, edges, start, points[new], beam)
        if len(new) > 1:
            # points of the same batch can be neighbours too
            d = ((points[new][:, None, :] - points[new][None, :, :]) ** 2).sum(2) if len(new) <= 64 else None
            if d is not None:
                found = np.hstack([found, new[np.argsort(d, axis=1)[:, 1 : degree // 2 + 1]]])
        edges[new] = robust_prune(points, new, found, degree, alpha)
        _link_back(points, edges, new, degree, alpha)
        at += len(new)
        size = min(max(1, at // 4), 512)
    return edges, start


def _link_back(points: np.ndarray, edges: np.ndarray, new: np.ndarray, degree: int, alpha: float) -> None:
    """Adds the edges' reverse, and prunes where that makes too many. All of them take part, however many a point gets."""
    src = np.repeat(new, degree)
    dst = edges[new].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    who, lead, count = np.unique(dst, return_index=True, return_counts=True)
    # points with about as many new edges go together
    by_count = np.argsort(count, kind="stable")
    for part in np.array_split(by_count, max(1, -(-len(who) // 256))):
        if not len(part):
            continue
        n, have = count[part], edges[who[part]]
        extra = np.full((len(part), int(n.max())), -1, np.int64)
        row = np.repeat(np.arange(len(part)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        extra[row, place] = src[lead[part][row] + place]
        both = np.hstack([have, extra])
        free = (have < 0).sum(1) >= n
        edges[who[part[free]]] = np.take_along_axis(both[free], np.argsort(both[free] < 0, axis=1, kind="stable"), 1)[:, :degree]
        if not free.all():
            edges[who[part[~free]]] = robust_prune(points, who[part[~free]], both[~free], degree, alpha)


_INDEX = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("vectors", pa.binary()), ("ids", pa.binary()), ("edges", pa.binary()), ("start", pa.int64()), ("scale", pa.float64()), ("top", pa.float64())])
_INDEX_SQL = "shard int, kind int, block long, n long, vectors binary, ids binary, edges binary, start long, scale double, top double"


def _lift(vectors: np.ndarray, top: float) -> np.ndarray:
    """Points whose distance to a query (with 0 added) falls as the inner product rises."""
    v = vectors.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(top * top - np.einsum("ij,ij->i", v, v), 0))[:, None]])


def _vectors(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _index(t: pa.Table) -> pa.Table:
    """A shard's graph: its distinct vectors, the ids of each (padded), the edges."""
    n = t.num_rows
    vectors = _vectors(t.column("v"), n)
    lists = t.column("ids").to_pylist()
    ids = np.full((n, max(map(len, lists))), -1, np.int64)
    for k, x in enumerate(lists):
        ids[k, : len(x)] = x
    shard, scale, top = (t.column(c)[0].as_py() for c in ("shard", "scale", "top"))
    edges, start = build_graph(_lift(vectors / scale, top).astype(np.float32))
    return pa.Table.from_pylist([{"shard": shard, "kind": 0, "block": 0, "n": n, "vectors": vectors.tobytes(), "ids": ids.tobytes(), "edges": edges.astype(np.int32).tobytes(), "start": start, "scale": scale, "top": top}], schema=_INDEX)


def _block(t: pa.Table) -> pa.Table:
    n = t.num_rows
    return pa.Table.from_pylist([{"shard": None, "kind": 1, "block": t.column("block")[0].as_py(), "n": n, "vectors": _vectors(t.column("v"), n).tobytes(), "ids": t.column("vec_id").to_numpy().astype(np.int64).tobytes(), "edges": None, "start": None, "scale": None, "top": None}], schema=_INDEX)


_HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _points(base: np.ndarray, lifted: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, scaled: np.ndarray, width: int) -> np.ndarray:
    """Each query's ``width`` nearest points found (-1: none). Queries for which the graph reaches too few points are compared with all."""
    width = min(width, len(base))
    found, _ = beam_search(lifted, edges, start, np.hstack([scaled, np.zeros((len(scaled), 1))]), width)
    for q in np.flatnonzero((found >= 0).sum(1) < width):
        product = base @ queries[q]
        found[q] = np.argpartition(-product, width - 1)[:width]
    return found


def _answer(k: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for b in batches:
            for r in b.to_pylist():
                n = r["n"]
                vectors = np.frombuffer(r["vectors"], np.float64).reshape(n, -1)
                if r["kind"] == 0:
                    ids = np.frombuffer(r["ids"], np.int64).reshape(n, -1)
                    graph = r["shard"], vectors, _lift(vectors / r["scale"], r["top"]), ids, np.frombuffer(r["edges"], np.int32).reshape(n, -1).astype(np.int64), r["start"]
                    continue
                if graph is None or graph[0] != r["shard"]:
                    continue
                _, base, points, ids, edges, start = graph
                own = np.frombuffer(r["ids"], np.int64)
                found = _points(base, points, edges, start, vectors, vectors / np.abs(vectors).max(1, keepdims=True), max(beam, k + 1))
                row, at = np.nonzero(found >= 0)
                hit = found[row, at]
                score = np.einsum("ij,ij->i", base[hit], vectors[row])
                # every id of a point that a query can need, but its own
                many = ids[hit]
                ok = (many >= 0) & (many != own[row][:, None])
                r2, c2 = np.nonzero(ok)
                q, v, s = row[r2], many[r2, c2], score[r2]
                order = np.lexsort([v, -s, q])
                q, v, s = q[order], v[order], s[order]
                lead = np.searchsorted(q, np.arange(n))
                keep = np.arange(len(q)) - lead[q] < k
                yield pa.RecordBatch.from_arrays([pa.array(own[q[keep]]), pa.array(v[keep]), pa.array(s[keep])], schema=_HIT)

    return run


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v): rows that take part, vectors of the commonest length, in double precision."""
    v = F.col("embedding").cast("array<double>")
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    dims = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return good.where(F.size("v") == (dims[0]["d"] if dims else 0))


def build_index(vectors: DataFrame, k: int, shard: int = SHARD) -> tuple[DataFrame, int]:
    """(saved index with a row a shard, shards) of all rows of vectors (vec_id, v)."""
    key = F.xxhash64("v")
    few = lambda *p: F.row_number().over(Window.partitionBy(*p).orderBy("vec_id"))
    salted = vectors.distinct().withColumn("h", key).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    salted = salted.withColumn("turn", few("h", "v", "salt")).where(F.col("turn") <= k + 1)
    least = salted.withColumn("turn", few("h", "v")).where(F.col("turn") <= k + 1)
    points = common.save(least.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "points")
    # vectors are scaled before they are squared, so that no finite number is too large
    scale = float(points.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("x")).first()["x"] or 1.0)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / scale) * (x / scale)))
    row = points.agg(F.count("*").alias("n"), F.max(norm).alias("top")).first()
    shards = max(1, -(-row["n"] // shard))
    dealt = points.select(F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard"), "v", "ids", F.lit(scale).alias("scale"), F.lit(float(row["top"] or 0.0)).alias("top"))
    return common.save(dealt.groupBy("shard").applyInArrow(_index, _INDEX_SQL), "index"), shards


def search(index: DataFrame, shards: int, queries: DataFrame, k: int = 20, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest, its own row left out. queries: vec_id, v."""
    blocks = queries.distinct().withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, -(-queries.count() // BLOCK)))))
    blocks = blocks.groupBy("block").applyInArrow(_block, _INDEX_SQL)
    sent = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # a shard's graph first, then the blocks: the graph is held once and blocks stream past it
    rows = index.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "block")
    hits = rows.mapInArrow(_answer(k, beam), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(rows: DataFrame, k: int = 20, every: int = 20, shard: int = SHARD) -> DataFrame:
    """Queries: rows whose vec_id is divisible by ``every``; candidates: all rows."""
    vectors = common.save(usable(rows), "vectors")
    index, shards = build_index(vectors, k, shard)
    return search(index, shards, vectors.where(F.col("vec_id") % every == 0), k)
