"""Approximate nearest neighbours on robust-pruned directed graphs.

Distinct vectors are dealt to shards of bounded size. Each shard builds a graph:
greedy beam searches from spread entry points propose neighbours of every vector,
pruning with a relaxed distance keeps edges in different directions, and edges
are added both ways (twice over all vectors, the second time more relaxed). Every
query is then beam-searched in every shard, in blocks of bounded size, and each
query's nearest over all shards are kept. Distances are Euclidean, in double
precision, on the vectors as given.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import stored

#: Vectors of a shard and queries of a block, about; edges of a vector; beam widths of building and searching; entry points, so many that separate clusters are met.
SHARD, BLOCK, DEGREE, BUILD_BEAM, BEAM, ENTRIES = 4096, 4096, 24, 48, 112, 64
RELAXED = (1.0, 1.2)
BATCH = 256


def distances(x: np.ndarray, of: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of rows `of` (b x c, -1: none) of x to q (b x dim)."""
    d = x[of] - q[:, None, :]
    out = np.einsum("bcd,bcd->bc", d, d)
    out[of < 0] = np.inf
    return out


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The `width` nearest nodes met by each row of q, nearest first (-1: none), and the nodes expanded on the way."""
    b = len(q)
    nodes = np.full((b, width), -1)
    first = entries[:width]
    nodes[:, : len(first)] = first
    near = distances(x, nodes, q)
    order = np.argsort(near, 1, kind="stable")
    nodes, near = np.take_along_axis(nodes, order, 1), np.take_along_axis(near, order, 1)
    done = nodes < 0
    path = []
    rows = np.arange(b)
    while len(rows):
        at = np.argmin(done[rows], 1)
        current = nodes[rows, at]
        done[rows, at] = True
        path.append(np.full(b, -1))
        path[-1][rows] = current
        found = graph[current]
        found = np.where((found[:, :, None] == nodes[rows][:, None, :]).any(2), -1, found)
        far = distances(x, found, q[rows])
        all_nodes = np.concatenate([nodes[rows], found], 1)
        all_near = np.concatenate([near[rows], far], 1)
        all_done = np.concatenate([done[rows], found < 0], 1)
        order = np.argsort(all_near, 1, kind="stable")[:, :width]
        nodes[rows], near[rows], done[rows] = (np.take_along_axis(a, order, 1) for a in (all_nodes, all_near, all_done))
        done[rows] |= nodes[rows] < 0
        rows = rows[~done[rows].all(1)]
    return nodes, np.stack(path, 1)


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, relax: float) -> np.ndarray:
    """Up to DEGREE candidates of each point: the nearest one removes those that it is `relax` times nearer to than the point is."""
    candidates = np.sort(np.where(candidates == points[:, None], -1, candidates), 1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    near = distances(x, candidates, x[points])
    order = np.argsort(near, 1, kind="stable")
    candidates, near = np.take_along_axis(candidates, order, 1), np.take_along_axis(near, order, 1)
    alive = candidates >= 0
    out = np.full((len(points), DEGREE), -1)
    rows = np.arange(len(points))
    for k in range(DEGREE):
        if not alive.any():
            break
        at = alive.argmax(1)
        some = alive[rows, at]
        chosen = np.where(some, candidates[rows, at], -1)
        out[:, k] = chosen
        alive &= ~((relax**2 * distances(x, candidates, x[chosen]) <= near) & some[:, None])
        alive[rows, at] = False
    return out


def build_graph(x: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The edges (n x DEGREE, -1: none) and the entry points."""
    n = len(x)
    rng = np.random.default_rng(seed)
    medoid = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    entries = np.unique(np.concatenate([[medoid], rng.integers(0, n, ENTRIES - 1)]))
    graph = np.full((n, DEGREE), -1)
    if n > 1:
        graph[:, : DEGREE // 2] = (np.arange(n)[:, None] + rng.integers(1, n, (n, DEGREE // 2))) % n
    for relax in RELAXED:
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            points = order[at : at + BATCH]
            nodes, path = beam_search(x, graph, entries, x[points], BUILD_BEAM)
            graph[points] = robust_prune(x, points, np.concatenate([nodes, path, graph[points]], 1), relax)
            source = np.repeat(points, DEGREE)
            target = graph[points].ravel()
            source, target = source[target >= 0], target[target >= 0]
            order_of = np.argsort(target, kind="stable")
            source, target = source[order_of], target[order_of]
            backs, first, many = np.unique(target, return_index=True, return_counts=True)
            if not len(backs):
                continue
            extra = np.full((len(backs), many.max()), -1)
            extra[np.repeat(np.arange(len(backs)), many), np.arange(len(target)) - np.repeat(first, many)] = source
            graph[backs] = robust_prune(x, backs, np.concatenate([graph[backs], extra], 1), relax)
    return graph, entries


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (array of double) of the rows whose vectors take part."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null and size(vector) > 0")
    ok = F.expr("forall(vector, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(vector, v -> v <> 0)")
    return rows.where(ok).withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0)))


def nearest(vectors: DataFrame, is_query, k: int = 10, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score (distance) of the k nearest rows found for each query.

    Rows that are null, zero, empty, without id or with null or non-finite
    components take no part. Vectors of other lengths are not compared. Repeated
    rows count once; if an id has several vectors, all are candidates and the
    first in order is its query. Equal vectors are indexed together with their
    k + 1 smallest ids: no other can be among the k nearest, as ties go to the
    smaller id. Other columns are left unread. An empty table gives no rows.
    """
    rows = usable(vectors)
    smallest = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    ids = rows.dropDuplicates(["vector", "vec_id"]).withColumn("n", smallest).where(F.col("n") <= k + 1)
    points = stored(ids.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    shards = max(1, -(-points.count() // shard))
    dealt = points.withColumns({"dim": F.size("vector"), "shard": F.pmod(F.xxhash64("vector"), F.lit(shards))})

    def build(own: pd.DataFrame) -> pd.DataFrame:
        own = own.reset_index(drop=True)
        graph, entries = build_graph(np.stack(own["vector"].to_list()).astype(float))
        entry = np.zeros(len(own), bool)
        entry[entries] = True
        return own.assign(node=np.arange(len(own)), edges=[e[e >= 0] for e in graph], entry=entry)

    graphs = stored(dealt.groupBy("dim", "shard").applyInPandas(build, "vector array<double>, ids array<bigint>, dim int, shard bigint, node int, edges array<int>, entry boolean"), "graphs")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-queries.count() // block))
    queries = queries.withColumns({"dim": F.size("vector"), "block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), "shard": F.explode(F.expr(f"sequence(0L, {shards - 1}L)"))})
    parts = graphs.withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))

    def search(_, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        own = own.sort_values("node")
        x = np.stack(own["vector"].to_list()).astype(float)
        graph = np.full((len(own), DEGREE), -1)
        for i, e in enumerate(own["edges"]):
            graph[i, : len(e)] = e
        entries = np.flatnonzero(own["entry"].to_numpy())
        ids = own["ids"].to_list()
        out = []
        for at in range(0, len(asked), BATCH):
            some = asked.iloc[at : at + BATCH]
            q = np.stack(some["vector"].to_list()).astype(float)
            nodes, _ = beam_search(x, graph, entries, q, BEAM)
            score = np.sqrt(distances(x, nodes, q))
            # of k + 1 nodes at most one has no id but the query's; of those that are as far as the last of them, ids decide
            limit = score[:, min(k, score.shape[1] - 1)]
            for query, found, far in zip(some["vec_id"], np.where(score <= limit[:, None], nodes, -1), score, strict=True):
                pairs = {(d, i) for d, node in zip(far.tolist(), found.tolist(), strict=True) if node >= 0 for i in ids[node] if i != query}
                out += [(query, i, d) for d, i in sorted(pairs)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = parts.groupBy("dim", "shard", "block").cogroup(queries.groupBy("dim", "shard", "block")).applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
