"""Approximate nearest neighbours by inner product on robust-pruned directed graphs, one per shard.

Equal vectors form one class, which carries its smallest ids, so that a vector that many rows share is one node of one
graph.  The classes are dealt to shards by a hash of their id, ``SHARD_ROWS`` to a shard.  Each shard's graph is built
in one task: greedy searches from the medoid propose neighbours for every node; relaxed-distance pruning keeps a
neighbour only if no kept one is closer to it by the factor ``alpha``, so that edges point in diverse directions; links
back are added and overfull nodes pruned again; a second pass widens ``alpha``.  Inner product becomes Euclidean
distance by one more coordinate that brings all vectors of a shard to the same norm.  Searches run in batches: one step
expands the best open candidate of every query of the batch at once.

Where norms differ much, the largest products belong to few long vectors, and the added coordinate leaves the short ones
in one dense cloud that a search crosses badly.  So the ``HEAD`` longest vectors of every shard are scored for every query
beside the search, whatever the shard's size; in a shard of up to ``HEAD`` vectors that covers all of them.  Graphs are
built and searched in single precision on vectors divided by the shard's largest component, so that no finite vector
overflows there; the scores that are returned are computed on the vectors as given, in double precision.

The graphs are written to the shared folder.  Queries are sent to every shard, in blocks, and a beam search in each
gives the shard's best classes; scores are then computed on the original vectors in double precision, and the best
``k`` of all shards are taken, ties to the smaller id.  The query set is a stated part of the rows, so the work is
queries times shards, not rows times rows; nothing is broadcast.

Defined cases: vectors that are null, zero, or hold a null or non-finite component take no part, neither do rows with a
null id; vectors of different lengths never meet; rows that are equal in id and vector count once as candidates and
once as queries; with fewer than k other vectors, all are returned; products that tie are ordered by id, and products
beyond double precision are infinite; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import scratch

SHARD_ROWS = 4096
QUERY_BLOCK = 20_000
DEGREE = 32
BEAM = 64
SEARCH_BEAM = 96
ALPHA = 1.2
BATCH = 512
#: Longest vectors of a shard, which every query is held against.
HEAD = 512


# --- one shard, in NumPy -------------------------------------------------------------------------------------------


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors divided by their largest component, in double precision: products keep their order."""
    exact = vectors.astype(np.float64)
    return exact / np.abs(exact).max()


def lift(vectors: np.ndarray) -> np.ndarray:
    """One more coordinate brings all to the largest norm; then the nearest is the one with the largest product."""
    own = scaled(vectors)
    norms = (own**2).sum(axis=1)
    return np.column_stack([own, np.sqrt(np.maximum(norms.max() - norms, 0))]).astype(np.float32)


def beam_search(points: np.ndarray, squares: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The best distinct nodes found for each query (-1: none) and their distances, up to the query's own square.
    graph: -1 is no edge, and no node has an edge twice."""
    n, degree = graph.shape
    count = len(queries)
    ids = np.full((count, beam), -1)
    far = np.full((count, beam), np.inf, np.float32)
    ids[:, 0] = start
    far[:, 0] = squares[start] - 2 * (queries @ points[start])
    done = np.ones((count, beam), bool)
    done[:, 0] = False
    # one column more, for the missing edges
    seen = np.zeros((count, n + 1), bool)
    seen[:, start] = True
    active = np.arange(count)
    while len(active):
        best = np.argmax(~done[active], axis=1)
        done[active, best] = True
        near = graph[ids[active, best]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        seen[active[:, None], near] |= near >= 0
        d = squares[near] - 2 * np.einsum("qd,qkd->qk", queries[active], points[near])
        d[~fresh] = np.inf
        near = np.where(fresh, near, -1)
        all_far = np.concatenate([far[active], d], axis=1)
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_done = np.concatenate([done[active], ~fresh], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        at = np.arange(len(active))[:, None]
        far[active], ids[active], done[active] = all_far[at, order], all_ids[at, order], all_done[at, order]
        active = active[~done[active].all(axis=1)]
    return ids, far


def robust_prune(points: np.ndarray, squares: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Up to ``degree`` of each node's candidates: the closest first, without those that a kept one covers."""
    bad = (candidates < 0) | (candidates == nodes[:, None])
    ordered = np.sort(np.where(bad, -1, candidates), axis=1)
    ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
    own = squares[ordered] + squares[nodes][:, None] - 2 * np.einsum("nd,nkd->nk", points[nodes], points[ordered])
    own[ordered < 0] = np.inf
    order = np.argsort(own, axis=1, kind="stable")[:, : 4 * degree]
    at = np.arange(len(nodes))
    ordered, own = np.take_along_axis(ordered, order, 1), np.maximum(np.take_along_axis(own, order, 1), 0)
    vectors = points[ordered]
    between = squares[ordered][:, :, None] + squares[ordered][:, None, :] - 2 * vectors @ vectors.transpose(0, 2, 1)
    out = np.full((len(nodes), degree), -1)
    open_ = np.isfinite(own)
    for k in range(degree):
        first = np.argmax(open_, axis=1)
        some = open_[at, first]
        if not some.any():
            break
        out[some, k] = ordered[at, first][some]
        covered = alpha * alpha * np.maximum(between[at, first], 0) <= own
        open_ &= ~(covered & some[:, None])
        open_[at[some], first[some]] = False
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """Out-neighbours of each row (-1: none) and the row where searches start."""
    n = len(vectors)
    points = lift(vectors)
    squares = (points**2).sum(axis=1)
    random = np.random.default_rng(seed)
    start = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
    graph = np.where(np.arange(degree) < n - 1, random.integers(0, n, (n, degree)), -1)
    graph[graph == np.arange(n)[:, None]] = -1
    graph.sort(axis=1)
    graph[:, 1:][graph[:, 1:] == graph[:, :-1]] = -1
    for factor in (1.0, alpha):
        order = random.permutation(n)
        for at in range(0, n, BATCH):
            nodes = order[at : at + BATCH]
            found, _ = beam_search(points, squares, graph, start, points[nodes], beam)
            graph[nodes] = robust_prune(points, squares, nodes, np.concatenate([found, graph[nodes]], axis=1), factor, degree)
            # links back, grouped by the node that gets them
            ends, starts = graph[nodes].ravel(), np.repeat(nodes, degree)
            ends, starts = ends[ends >= 0], starts[ends >= 0]
            by = np.argsort(ends, kind="stable")
            ends, starts = ends[by], starts[by]
            targets, first, counts = np.unique(ends, return_index=True, return_counts=True)
            width = min(int(counts.max(initial=0)), 4 * degree)
            more = np.full((len(targets), width), -1)
            place = np.arange(len(ends)) - np.repeat(first, counts)
            fits = place < width
            more[np.repeat(np.arange(len(targets)), counts)[fits], place[fits]] = starts[fits]
            for part in range(0, len(targets), BATCH):
                t = targets[part : part + BATCH]
                both = np.concatenate([graph[t], more[part : part + BATCH]], axis=1)
                graph[t] = robust_prune(points, squares, t, both, factor, degree)
    return graph, start


def search_graph(vectors: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct row numbers (-1: none) and inner products in double precision, the largest first."""
    points = lift(vectors)
    squares = (points**2).sum(axis=1)
    exact = vectors.astype(np.float64)
    head = np.argsort(points[:, -1], kind="stable")[:HEAD]
    in_head = np.zeros(len(vectors), bool)
    in_head[head] = True
    rows, scores = [], []
    for at in range(0, len(queries), BATCH):
        part = queries[at : at + BATCH].astype(np.float64)
        own = part / np.abs(part).max(axis=1, keepdims=True)
        found, _ = beam_search(points, squares, graph, start, np.column_stack([own, np.zeros(len(part))]).astype(np.float32), max(beam, k))
        found[(found >= 0) & in_head[found]] = -1
        near = points[head, :-1] @ own.T.astype(np.float32)
        best = np.argpartition(-near, min(max(beam, k), len(head)) - 1, axis=0)[: max(beam, k)].T
        found = np.concatenate([found, head[best]], axis=1)
        with np.errstate(over="ignore", invalid="ignore"):
            products = (part[:, None, :] * exact[found]).sum(axis=2)
        products[found < 0] = -np.inf
        found[np.isnan(products)] = -1
        products[np.isnan(products)] = -np.inf
        best = np.argsort(-products, axis=1, kind="stable")[:, : max(k, 1)]
        rows.append(np.take_along_axis(found, best, 1))
        scores.append(np.take_along_axis(products, best, 1))
    return np.concatenate(rows), np.concatenate(scores)


# --- on the cluster ------------------------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def vector_classes(rows: DataFrame, k: int) -> scratch.Table:
    """rows (id, vector): a class per vector, with its smallest id and its k + 1 smallest ids, which is all that a list
    of k neighbours without the query itself can hold of it.  The ranking is cut before the shuffle as well."""
    smallest = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    ranked = rows.distinct().withColumn("rank", smallest).where(F.col("rank") <= k + 1)
    grouped = ranked.groupBy("vector").agg(F.min("id").alias("class"), F.array_sort(F.collect_list("id")).alias("ids"))
    return scratch.materialize(grouped.select("class", "vector", "ids", F.size("vector").alias("width")), "vector-classes")


def build_index(classes: DataFrame, shard_rows: int = SHARD_ROWS) -> scratch.Table:
    """A row per class: width, shard, place in the shard, class, vector, ids, neighbours, and whether searches start there."""
    shards = max(1, -(-classes.count() // shard_rows))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("class", ignore_index=True)
        graph, start = build_graph(np.stack(rows["vector"]))
        rows["neighbours"] = [g[g >= 0].astype(np.int32) for g in graph]
        rows["place"] = np.arange(len(rows), dtype=np.int32)
        rows["start"] = rows["place"] == start
        return rows

    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("class"), F.lit(shards)).cast("int"))
    kind = classes.schema["vector"].dataType.simpleString()
    schema = f"class long, vector {kind}, ids array<long>, width int, shard int, neighbours array<int>, place int, start boolean"
    return scratch.materialize(dealt.groupBy("width", "shard").applyInPandas(build, schema), "vector-index")


def search(index: scratch.Table, queries: DataFrame, k: int) -> DataFrame:
    """queries (qclass, vector, width): the best classes of every shard, as (qclass, id, score) over their smallest ids."""
    shards = index.df.select("width", "shard").distinct()
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    sent = queries.withColumn("block", F.pmod(F.xxhash64("qclass"), F.lit(blocks)).cast("int")).join(shards, "width")
    served = index.df.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(key: tuple, nodes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = {"qclass": np.empty(0, np.int64), "id": np.empty(0, np.int64), "score": np.empty(0)}
        if not len(nodes) or not len(asked):
            return pd.DataFrame(empty)
        nodes = nodes.sort_values("place", ignore_index=True)
        graph = np.full((len(nodes), DEGREE), -1)
        for i, near in enumerate(nodes["neighbours"]):
            graph[i, : len(near)] = near
        rows, scores = search_graph(
            np.stack(nodes["vector"]), graph, int(np.argmax(nodes["start"])), np.stack(asked["vector"]), k + 1
        )
        at, which = np.nonzero(rows >= 0)
        ids = nodes["ids"].to_numpy()[rows[at, which]]
        counts = [len(i) for i in ids]
        return pd.DataFrame(
            {
                "qclass": np.repeat(asked["qclass"].to_numpy()[at], counts),
                "id": np.concatenate(ids) if len(ids) else empty["id"],
                "score": np.repeat(scores[at, which], counts),
            }
        )

    pairs = served.groupBy("width", "shard", "block").cogroup(sent.groupBy("width", "shard", "block"))
    found = pairs.applyInPandas(find, "qclass long, id long, score double")
    best = F.row_number().over(Window.partitionBy("qclass").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k + 1).drop("rank")


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For each row that is a query, its k nearest other rows: query_id, rank, the neighbour's id and score."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    classes = vector_classes(rows.select("id", "vector"), k)
    index = build_index(classes.df, shard_rows)
    asked = rows.where("asks").select("id", "vector").distinct().join(classes.df.select("vector", "class", "width"), "vector")
    asked = scratch.materialize(asked.select(F.col("id").alias("query_id"), "class", "vector", "width"), "vector-queries")
    distinct = asked.df.groupBy(F.col("class").alias("qclass")).agg(F.first("vector").alias("vector"), F.first("width").alias("width"))
    found = scratch.materialize(search(index, distinct, k), "vector-found")
    mine = asked.df.select("query_id", F.col("class").alias("qclass")).join(found.df, "qclass").where("id != query_id")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return mine.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
