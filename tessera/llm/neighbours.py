"""Approximate nearest neighbours: stable projections, kd-trees, and a chi-square stopping test.

Vectors are projected to ``DIMS`` Gaussian (2-stable) directions, so the squared projected
distance of two vectors at distance d is d^2 times a chi-square variable.  A kd-tree over the
projected space, split at the medians of a bounded sample, deals all vectors into cells of
about ``CELL_ROWS``; a crowded cell (copies cannot be split by a plane) is dealt on into
sub-cells by hash.  Each cell holds a kd-tree of its own with leaves of ``LEAF`` rows.

A query visits leaves in the order of projected distance and verifies their vectors exactly.
It stops when the next leaf is at a projected distance r with r^2 > d_k^2 * q, where d_k is the
k-th verified distance and q the ``CONFIDENCE`` quantile of chi-square: a nearer neighbour
would then have shown up already but for a probability of 1 - CONFIDENCE.  The same test
routes queries between cells: first their own cell gives d_k, then they visit the cells, and
only those, whose boxes pass the test.

Every row is indexed; the sample only places the splits, and only its projections go to the
driver.  Vectors that are null, zero, or hold null or non-finite components take no part.
Vectors of different lengths have no distance: each length is searched by itself.  Distances are Euclidean in double precision on the
original vectors; ties go to the smaller id; rows with a null id take no part; equal rows
of one id count once, and a query never meets rows of its own id; fewer
candidates than k are all returned, an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.llm.common import durable, hash_sample

DIMS = 8
SAMPLE_ROWS = 8192  # vectors, at least, whose medians place the splits between cells
SAMPLE_A_CELL = 4
CELL_ROWS = 4096
LEAF = 256
CONFIDENCE = 0.95
SEED = 11
MOST_CELLS = 1 << 15  # more rows make fuller cells, which are dealt into sub-cells


def chi_square_quantile(p: float, dims: int) -> float:
    """Quantile for an even number of degrees: the distribution is a short Poisson sum."""
    if dims % 2:
        raise ValueError("an even number of projections is needed")
    lo, hi = 0.0, 10.0 * dims + 200.0
    for _ in range(200):
        x = (lo + hi) / 2
        term, below = 1.0, 0.0
        for i in range(dims // 2):
            below += term
            term *= x / 2 / (i + 1)
        lo, hi = (x, hi) if 1 - np.exp(-x / 2) * below < p else (lo, x)
    return hi


def split_tree(points: np.ndarray, leaf: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Complete kd-tree by medians: axis and threshold of each inner node, and its depth."""
    depth = 0
    while len(points) >> depth > leaf and 1 << (depth + 1) <= most:
        depth += 1
    axes, cuts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    groups = [points]
    for level in range(depth):
        after = []
        for i, g in enumerate(groups):
            node = (1 << level) - 1 + i
            if len(g):
                axes[node] = int(np.argmax(g.max(axis=0) - g.min(axis=0)))
                cuts[node] = np.median(g[:, axes[node]])
            left = g[:, axes[node]] <= cuts[node]
            after += [g[left], g[~left]]
        groups = after
    return axes, cuts, depth


def leaf_of(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    axes, cuts, depth = tree
    node = np.zeros(len(points), np.int64)
    rows = np.arange(len(points))
    for _ in range(depth):
        node = 2 * node + 1 + (points[rows, axes[node]] > cuts[node])
    return node - ((1 << depth) - 1)


def boxes(tree: tuple[np.ndarray, np.ndarray, int], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of the leaves' boxes; outer sides are open."""
    axes, cuts, depth = tree
    low, high = np.full((1, dims), -np.inf), np.full((1, dims), np.inf)
    for level in range(depth):
        first = (1 << level) - 1
        lows, highs = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
        for i in range(1 << level):
            highs[2 * i, axes[first + i]] = min(highs[2 * i, axes[first + i]], cuts[first + i])
            lows[2 * i + 1, axes[first + i]] = max(lows[2 * i + 1, axes[first + i]], cuts[first + i])
        low, high = lows, highs
    return low, high


def box_distance(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    gap = np.maximum(np.maximum(low - point, point - high), 0.0)
    return (gap * gap).sum(axis=1)


def as_matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors], np.float64)


def search(ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, queries: list, k: int, stop: float) -> list[tuple]:
    """Rows (query_id, vec_id, score): up to k of this cell for each (id, vector, projection, bound)."""
    tree = split_tree(projected, LEAF, 1 << 30)
    leaf = leaf_of(projected, tree)
    order = np.argsort(leaf, kind="stable")
    starts = np.searchsorted(leaf[order], np.arange((1 << tree[2]) + 1))
    used = np.flatnonzero(np.diff(starts))
    low = np.array([projected[order[starts[i] : starts[i + 1]]].min(axis=0) for i in used])
    high = np.array([projected[order[starts[i] : starts[i + 1]]].max(axis=0) for i in used])
    out = []
    for qid, vector, point, bound in queries:
        far = box_distance(point, low, high)
        best: list[tuple[float, int]] = []  # of the k best, the worst first: (-score, -id)
        for i in np.argsort(far, kind="stable"):
            kth = min(bound, -best[0][0] if len(best) == k else np.inf)
            if far[i] > kth * kth * stop:
                break
            rows = order[starts[used[i]] : starts[used[i] + 1]]
            rows = rows[ids[rows] != qid]
            gap = vectors[rows] - vector
            score = np.sqrt((gap * gap).sum(axis=1))
            near = np.flatnonzero(score <= kth)
            for s, v in zip(score[near].tolist(), ids[rows[near]].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (-s, -v))
                elif (-s, -v) > best[0]:
                    heapq.heapreplace(best, (-s, -v))
        out += [(qid, -v, -s) for s, v in best]
    return out


def valid(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(rows: DataFrame, is_query: Column, k: int = 10, confidence: float = CONFIDENCE) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) over rows (vec_id, embedding)."""
    rows = rows.filter(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asks"))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy("n").collect()  # different lengths
    if not sizes:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    found = [_nearest_of(rows.filter(F.size("embedding") == r["n"]), r["n"], r["count"], k, confidence) for r in sizes]
    # A query id with vectors of several lengths has the nearest of all.
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    found = reduce(DataFrame.unionByName, found)
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest_of(rows: DataFrame, size: int, total: int, k: int, confidence: float) -> DataFrame:
    """Rows (query_id, vec_id, score), k for each query at least if there are so many; vectors are all of one length."""
    directions = np.random.default_rng(SEED).standard_normal((size, DIMS))
    cells = min(MOST_CELLS, max(1, -(-total // CELL_ROWS)))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"point": list(as_matrix(b["embedding"]) @ directions) if len(b) else []})

    sample = hash_sample(rows.select("vec_id", "embedding"), "vec_id", max(SAMPLE_ROWS, SAMPLE_A_CELL * cells), total)
    drawn = np.array([r["point"] for r in sample.mapInPandas(project, "point array<double>").collect()], np.float64)
    tree = split_tree(drawn, 1, cells)
    stop = chi_square_quantile(confidence, DIMS)
    low, high = boxes(tree, DIMS)

    kind = rows.schema["embedding"].dataType
    placed_schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", kind), T.StructField("asks", T.BooleanType()), T.StructField("cell", T.IntegerType())])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cell=leaf_of(as_matrix(b["embedding"]) @ directions, tree).astype("int32"))

    placed = durable(rows.mapInPandas(place, placed_schema))
    counts = placed.groupBy("cell").count().collect()  # at most MOST_CELLS rows
    parts = {r["cell"]: max(1, -(-r["count"] // (2 * CELL_ROWS))) for r in counts}
    split = F.element_at(F.array(*[F.lit(parts.get(c, 0)) for c in range(len(low))]), F.col("cell") + 1)
    stored = placed.select(F.col("cell"), F.pmod(F.xxhash64("vec_id"), split).cast("int").alias("part"), "vec_id", "embedding")
    asked = placed.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"), "cell")

    def visit(key: tuple, own: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(guests):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        vectors = as_matrix(own["embedding"])
        ids = own["vec_id"].to_numpy()
        if len(np.unique(ids)) < len(ids):  # equal rows of one id are here together
            once = list({(i, v.tobytes()): n for n, (i, v) in enumerate(zip(ids.tolist(), vectors, strict=True))}.values())
            ids, vectors = ids[once], vectors[once]
        asks = as_matrix(guests["asked"])
        queries = list(zip(guests["query_id"].tolist(), asks, asks @ directions, guests["bound"].tolist(), strict=True))
        found = search(ids, vectors, vectors @ directions, queries, k, stop)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    def round_of(guests: DataFrame) -> DataFrame:
        return stored.groupBy("cell", "part").cogroup(guests.groupBy("cell", "part")).applyInPandas(visit, "query_id bigint, vec_id bigint, score double")

    # First round: one part of the query's own cell bounds the k-th distance.
    home = F.pmod(F.xxhash64("query_id"), split).cast("int")
    first = durable(round_of(asked.withColumn("part", home).withColumn("bound", F.lit(float("inf")))))
    enough = first.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("worst"))
    bound = F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(float("inf")))
    asked = asked.join(enough, "query_id", "left").withColumn("bound", F.coalesce(bound, F.lit(float("inf"))))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ways: list[tuple] = []
            points = as_matrix(b["asked"]) @ directions if len(b) else np.empty((0, DIMS))
            for row, (point, d) in enumerate(zip(points, b["bound"].tolist(), strict=True)):
                for cell in np.flatnonzero(box_distance(point, low, high) <= d * d * stop).tolist():
                    ways += [(row, cell, part) for part in range(parts.get(cell, 0))]
            at = [w[0] for w in ways]
            yield b.iloc[at].assign(cell=np.array([w[1] for w in ways], "int32"), part=np.array([w[2] for w in ways], "int32"))

    routed_schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("asked", kind), T.StructField("bound", T.DoubleType()), T.StructField("cell", T.IntegerType()), T.StructField("part", T.IntegerType())])
    routed = asked.select("query_id", "asked", "bound", "cell", F.lit(0).alias("part")).mapInPandas(route, routed_schema)
    return round_of(routed).unionByName(first).distinct()
