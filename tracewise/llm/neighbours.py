"""Operator 1: approximate nearest neighbours by largest inner product.

Rows are dealt by hash to shards of about SHARD_ROWS vectors. Per shard
a robust-pruned directed graph is built: vectors enter in random order, a
greedy beam search over the graph so far proposes neighbours, and pruning keeps a
candidate only if no kept neighbour is closer to it by the factor ALPHA,
which leaves diverse edges. Inner products become distances by one more coordinate,
sqrt(M^2 - |x|^2). Searches run over many queries in step as array operations.
Every query runs a beam search on every shard (a stated query set against all
rows, in blocks); beams are rescored in double precision on the original vectors.

Equal vectors of a shard are one node with all their ids; of these only the
smallest ``k + 1`` can be in any answer, and those are returned. Hashing by
vec_id deals a vector that is shared by many rows over all shards.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors are compared with those of their own
dimension; ties go to the smaller vec_id; repeated vec_ids are
candidates each, but never for their own id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, stored

SHARD_ROWS, DEGREE, BUILD_BEAM, ALPHA = 8192, 32, 64, 1.2
BEAM, EXPAND, STARTS, QUERY_BLOCK, STEP = 200, 4, 16, 4096, 256


def usable(v: Column) -> Column:
    """No null or non-finite component, and not all zero."""
    return F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)), F.lit(False)) \
        & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Beams (node ids, distances; -1 and inf where short) of ``queries``, all in
    step, from the start node and STARTS more spread over all nodes. ``graph``
    has n for missing edges; the distance is |x|^2/2 - x.q."""
    b, n = len(queries), len(x)
    half = (x * x).sum(1) / 2
    seen = np.zeros((b, n + 1), bool)       # the last column stands for missing edges
    first = np.unique(np.append(np.arange(STARTS) * n // STARTS, start))[:width]
    seen[:, first] = seen[:, n:] = True
    ids = np.full((b, width), n)
    dist = np.full((b, width), np.inf, np.float32)
    done = np.ones((b, width), bool)
    ids[:, :len(first)], done[:, :len(first)] = first, False
    dist[:, :len(first)] = half[first] - queries @ x[first].T
    live = np.arange(b)
    while len(live):
        order = np.argsort(np.where(done[live], np.inf, dist[live]), axis=1)[:, :EXPAND]
        rows = np.repeat(live, EXPAND).reshape(-1, EXPAND)
        idle = done[rows, order]
        done[rows, order] = True
        near = graph[np.where(idle, n, ids[rows, order])].reshape(len(live), -1)
        near = np.where(seen[live[:, None], near], n, near)
        seen[live[:, None], near] = True
        near.sort(axis=1)       # a node may be reached twice in one step
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        fresh = near < n
        safe = np.where(fresh, near, 0)
        d = half[safe] - np.matmul(x[safe], queries[live][:, :, None])[:, :, 0]
        d = np.where(fresh, d, np.inf).astype(np.float32)
        all_ids, all_dist = np.concatenate((ids[live], near), 1), np.concatenate((dist[live], d), 1)
        all_done = np.concatenate((done[live], ~fresh), 1)
        top = np.argpartition(all_dist, width - 1, axis=1)[:, :width]
        ids[live], dist[live] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_dist, top, 1)
        done[live] = np.take_along_axis(all_done, top, 1)
        live = live[~done[live].all(axis=1)]
    return np.where(np.isinf(dist), -1, ids), dist


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Edges of ``points`` from their candidates (-1: none): the nearest is kept, and all
    that are closer to it (by the factor alpha) than to the point go; and so on."""
    c = np.sort(np.where(candidates == points[:, None], -1, candidates), axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    own = ((x[np.maximum(c, 0)] - x[points][:, None]) ** 2).sum(2)
    own[c < 0] = np.inf
    order = np.argsort(own, axis=1)[:, :3 * degree]
    c, own = np.take_along_axis(c, order, 1), np.take_along_axis(own, order, 1)
    v = x[np.maximum(c, 0)]
    square = (v * v).sum(2)
    alive, out, rows = np.isfinite(own), np.full((len(points), degree), -1), np.arange(len(points))
    for k in range(degree):
        first = alive.argmax(axis=1)
        got = alive[rows, first]
        if not got.any():
            break
        out[got, k] = c[rows, first][got]
        chosen = v[rows, first]
        between = square + square[rows, first][:, None] - 2 * np.matmul(v, chosen[:, :, None])[:, :, 0]
        alive &= ~(got[:, None] & (alpha * alpha * between <= own))
        alive[rows, first] = False
    return out


def build_graph(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, int]:
    """(edges with -1 for none, plus one row of -1 for a missing node; start node)."""
    n = len(x)
    rng = np.random.default_rng(seed)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n + 1, DEGREE), n)
    if n <= DEGREE + 1:
        for p in range(n):
            others = np.delete(np.arange(n), p)
            graph[p, :len(others)] = others
        return graph, start
    graph[:n, :DEGREE // 2] = (np.arange(n)[:, None] + rng.integers(1, n, (n, DEGREE // 2))) % n
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n)
        for s in range(0, n, STEP):
            p = order[s:s + STEP]
            found, _ = beam_search(x, graph, start, x[p], BUILD_BEAM)
            old = np.where(graph[p] == n, -1, graph[p])
            new = robust_prune(x, p, np.concatenate((found, old), 1), alpha, DEGREE)
            graph[p] = np.where(new < 0, n, new)
            back(x, graph, p, new, alpha)
    return graph, start


def back(x: np.ndarray, graph: np.ndarray, points: np.ndarray, edges: np.ndarray, alpha: float) -> None:
    """Add the reverse edges; nodes with too many edges are pruned again."""
    n = len(x)
    source, target = np.repeat(points, edges.shape[1]), edges.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    wide = np.full((len(nodes), int(count.max(initial=1))), n)
    wide[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
    both = np.sort(np.concatenate((graph[nodes], wide), 1), axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = n
    both.sort(axis=1)
    fits = (both < n).sum(1) <= DEGREE
    graph[nodes[fits]] = both[fits][:, :DEGREE]
    if not fits.all():
        over = nodes[~fits]
        new = robust_prune(x, over, np.where(both[~fits] == n, -1, both[~fits]), alpha, DEGREE)
        graph[over] = np.where(new < 0, n, new)


INDEX = "dim int, shard int, node int, vec_ids array<long>, vector array<double>, edges array<int>, start boolean"


def index_shard(table: pa.Table) -> pa.Table:
    """Graph of one shard's rows (dim, shard, vec_id, vector): one row per distinct vector."""
    dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
    original = np.array(table["vector"].combine_chunks().flatten(), np.float64).reshape(-1, dim)
    nodes, member = np.unique(original, axis=0, return_inverse=True)
    member = member.ravel()
    ids = np.array(table["vec_id"].to_pylist(), np.int64)
    order = np.lexsort((ids, member))
    groups = np.split(ids[order], np.cumsum(np.bincount(member, minlength=len(nodes)))[:-1])
    norm = (nodes ** 2).sum(1)
    x = np.concatenate((nodes, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]), 1).astype(np.float32)
    graph, start = build_graph(x / np.float32(max(1e-30, float(np.sqrt(norm.max())))))
    n = len(nodes)
    return pa.table({"dim": pa.array([dim] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()),
                     "node": pa.array(range(n), pa.int32()), "vec_ids": pa.array([g.tolist() for g in groups], pa.list_(pa.int64())),
                     "vector": pa.array(list(nodes), pa.list_(pa.float64())),
                     "edges": pa.array([e[e < n].tolist() for e in graph[:n]], pa.list_(pa.int32())),
                     "start": pa.array([i == start for i in range(n)])})


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """(stored index of all usable rows of (vec_id, embedding), number of shards)."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))) \
        .select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "vector")
    return stored(dealt.groupBy("dim", "shard").applyInArrow(index_shard, INDEX), "neighbour-index"), shards


def search(index: DataFrame, shards: int, queries: DataFrame, k: int = 20, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every usable query (vec_id, embedding)."""

    def search_shard(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left = left.sort_by("node")
        dim, n = left["dim"][0].as_py(), left.num_rows
        nodes = np.array(left["vector"].combine_chunks().flatten()).reshape(n, dim)
        graph = np.full((n + 1, DEGREE), n)
        for i, e in enumerate(left["edges"].to_pylist()):
            graph[i, :len(e)] = e
        groups = left["vec_ids"].to_pylist()
        start = left["start"].to_pylist().index(True)
        norm = (nodes ** 2).sum(1)
        x = np.concatenate((nodes, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]), 1).astype(np.float32)
        scale = np.float32(max(1e-30, float(np.sqrt(norm.max()))))
        ids = right["vec_id"].to_pylist()
        q = np.array(right["vector"].combine_chunks().flatten(), np.float64).reshape(-1, dim)
        qn = np.sqrt((q ** 2).sum(1, keepdims=True))
        flat = np.concatenate((q / qn, np.zeros((len(q), 1))), 1).astype(np.float32)
        out: list[tuple] = []
        for s in range(0, len(q), STEP):
            found, _ = beam_search(x / scale, graph, start, flat[s:s + STEP], beam)
            for j, row in enumerate(found, s):
                row = row[row >= 0]
                exact = (nodes[row] * q[j]).sum(1)
                best, last = [], None
                for at in np.argsort(-exact, kind="stable"):
                    if len(best) >= k and exact[at] < last:
                        break
                    last = exact[at]
                    best += [(-last, v) for v in [v for v in groups[row[at]] if v != ids[j]][:k]]
                out += [(ids[j], v, -score) for score, v in sorted(best)[:k]]
        cols = list(zip(*out)) if out else [(), (), ()]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    q = queries.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))) \
        .select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector")).distinct()      # a repeated query row is one query
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    q = q.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "vector") \
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    i = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = i.groupBy("dim", "shard", "block").cogroup(q.groupBy("dim", "shard", "block")) \
        .applyInArrow(search_shard, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    index, shards = build_index(vectors)
    return search(index, shards, vectors.where("vec_id % 20 = 0"))
