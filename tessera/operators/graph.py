"""Graph operators on edge DataFrames: components, DAG depth, closures, topological order.

Loops run on the driver and only counts or sums come back to it; every round is cut by a
checkpoint and bounded.  Nodes may be of any orderable type.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.cut import cut, stored

MOST_ROUNDS = 64
MOST_DEPTH = 50_000
#: Rows of a table that is told to all tasks; rounds' finds that are kept side by side.
BROADCAST_ROWS, MOST_PARTS = 100_000, 8


class GraphError(ValueError):
    """Carries the violation code."""

    def __init__(self, code: str, key: object = None) -> None:
        super().__init__(f"{code}: {key}" if key is not None else code)
        self.code = code


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Rows (node, component), the smallest member's id; ``edges`` has (src, dst), taken both ways.

    Alternating stars: in a round every node hands its larger neighbours, then its smaller ones,
    to the smallest node around it.  The number of edges never grows, and long chains take a
    logarithmic number of rounds.  A hub is one key of a plain join, which adaptive execution
    splits; its minimum is combined before the shuffle.
    """
    one = cut(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        both = one.select("u", "v").unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m")))
        large = cut(both.filter("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"))
        small = large.join(low, F.col("u") == F.col("w")).select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e"))
        one = cut(small.select("e.u", "e.v").filter("u <> v").distinct())
        now = one.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise GraphError("graph.no-fixpoint")
    tails = one.groupBy("u").agg(F.min("v").alias("v"))
    out = tails.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tails.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    if nodes is None:
        return out
    return nodes.select("node").join(out, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chain nodes (node, head, steps), and the edges (src, dst, steps) between all others.

    A chain node has one edge in and one out; its head is the nearest node before it that is none.
    Pointer jumping takes a logarithmic number of rounds; a chain without a head is a cycle.
    """
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    inner = cut(both.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).filter("o = 1 and i = 1").select("node"))
    jump = cut(edges.join(inner, F.col("dst") == F.col("node"), "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("head"), F.lit(1).cast("long").alias("steps")))
    most = max(1, inner.count()).bit_length() + 1
    for turn in range(most + 1):
        far = jump.select(F.col("node").alias("n"), F.col("head").alias("h"), F.col("steps").alias("s"))
        after = jump.join(far, F.col("head") == F.col("n"), "left")
        if after.filter("n is not null").isEmpty():
            break
        if turn == most:
            raise GraphError("lineage.cycle")
        jump = cut(after.select("node", F.coalesce("h", "head").alias("head"), (F.col("steps") + F.coalesce("s", F.lit(0))).alias("steps")))
    rest = edges.join(inner, F.col("dst") == F.col("node"), "left_anti")
    rest = rest.join(jump, F.col("src") == F.col("node"), "left").select(F.coalesce("head", "src").alias("src"), "dst", (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    return jump, cut(rest.groupBy("src", "dst").agg(F.max("steps").alias("steps"), F.count("*").alias("n")))


def dag_depth(edges: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """Rows (node, depth), the longest path that ends at the node; GraphError on a cycle or beyond the cap.

    Chains are drawn together first, so that a path of 10,000 nodes takes some fifteen rounds.
    What is left is peeled level by level, one durable table of all nodes a level.
    """
    edges = cut(edges.select("src", "dst").distinct())
    chain, rest = _chains(edges)
    ends = rest.groupBy(F.col("dst").alias("node")).agg(F.sum("n").alias("waits"))
    nodes = rest.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(ends, "node", "left")
    nodes = cut(nodes.select("node", F.coalesce("waits", F.lit(0)).alias("waits"), F.lit(0).cast("long").alias("depth"), F.col("waits").isNull().alias("now"), F.lit(False).alias("done")))
    while True:
        front = nodes.filter("now").select(F.col("node").alias("src"), "depth")
        if front.isEmpty():
            break
        told = rest.join(front, "src").groupBy(F.col("dst").alias("to")).agg(F.sum("n").alias("less"), F.max(F.col("depth") + F.col("steps")).alias("far"))
        after = nodes.join(told, F.col("node") == F.col("to"), "left").withColumn("left", F.col("waits") - F.coalesce("less", F.lit(0)))
        nodes = cut(after.select(
            "node", F.col("left").alias("waits"), F.greatest("depth", F.coalesce("far", F.lit(0))).alias("depth"),
            ((F.col("left") == 0) & (F.col("waits") > 0)).alias("now"), (F.col("done") | F.col("now")).alias("done")))
    if not nodes.filter("not done").isEmpty():
        raise GraphError("lineage.cycle")
    heads = nodes.select(F.col("node").alias("h"), F.col("depth").alias("base"))
    inner = chain.join(heads, F.col("head") == F.col("h")).select("node", (F.col("base") + F.col("steps")).alias("depth"))
    out = cut(nodes.select("node", "depth").unionByName(inner))
    if (out.agg(F.max("depth")).first()[0] or 0) > most_depth:
        raise GraphError("lineage.traversal-too-deep", most_depth)
    return out.select("node", F.col("depth").cast("int").alias("depth"))


def first_reach(seeds: DataFrame, edges: DataFrame, most_rounds: int = MOST_DEPTH) -> DataFrame:
    """Rows (node, rank): every node reachable from ``seeds`` (node, rank) with the least rank that reaches it.

    Only nodes whose rank improved are expanded again, so cycles end.
    """
    return reached(seeds, stored(edges.select("src", "dst")), most_rounds)


def small(df: DataFrame) -> DataFrame:
    """A stored table, told to all tasks if it has few rows, so that what it meets is not shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def reached(seeds: DataFrame, edges: DataFrame, most_rounds: int = MOST_DEPTH) -> DataFrame:
    """``first_reach`` over stored edges.

    A round's finds are added to those before, and a node's least rank counts; they are drawn
    together only now and then.  Few seeds or finds go to the edges, not the edges to them.
    """
    least = F.min("rank").alias("rank")
    frontier = cut(seeds.groupBy("node").agg(least))
    parts = [frontier]
    for _ in range(most_rounds):
        step = cut(small(frontier).join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("rank").alias("found")))
        met = reduce(DataFrame.unionByName, parts).join(small(step), F.col("dst") == F.col("node")).groupBy("dst").agg(least)
        better = step.join(met.withColumnRenamed("dst", "node"), F.col("dst") == F.col("node"), "left").filter("rank is null or found < rank")
        frontier = cut(better.select(F.col("dst").alias("node"), F.col("found").alias("rank")))
        if frontier.isEmpty():
            return cut(reduce(DataFrame.unionByName, parts).groupBy("node").agg(least))
        parts.append(frontier)
        if len(parts) > MOST_PARTS:
            parts = [cut(reduce(DataFrame.unionByName, parts).groupBy("node").agg(least))]
    raise GraphError("query.closure-too-large")


def mask_closure(seeds: DataFrame, edges: DataFrame, most_rounds: int = MOST_DEPTH) -> DataFrame:
    """Rows (node, mask): bits spread along ``edges`` (src, dst, bit) from ``seeds`` (node, mask) to a fixed point.

    Only nodes whose mask has grown are expanded again.
    """
    edges = cut(edges.groupBy("src", "dst").agg(F.bit_or("bit").alias("bit")))
    known = cut(seeds.groupBy("node").agg(F.bit_or("mask").alias("mask")))
    frontier = known
    for _ in range(most_rounds):
        spread = frontier.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.bit_or(F.col("mask").bitwiseOR(F.col("bit"))).alias("new"))
        grown = spread.join(known, F.col("to") == F.col("node"), "left").withColumn("whole", F.col("new").bitwiseOR(F.coalesce("mask", F.lit(0))))
        frontier = cut(grown.filter("mask is null or whole <> mask").select(F.col("to").alias("node"), F.col("whole").alias("mask")))
        if frontier.isEmpty():
            return known
        known = cut(known.unionByName(frontier).groupBy("node").agg(F.bit_or("mask").alias("mask")))
    raise GraphError("graph.no-fixpoint")


def topological_order(count: int, needs: list[tuple[int, int]], most_each: int = 63, most: int = 256) -> list[int]:
    """Order of a small task board: always the smallest index whose dependencies are done.

    ``needs`` has (task, dependency).  Codes: unknown-dependency, too-many, cycle.
    """
    waits, after = defaultdict(set), defaultdict(list)
    for task, dep in needs:
        if not (0 <= dep < count and 0 <= task < count):
            raise GraphError("planning.unknown-dependency", dep)
        waits[task].add(dep)
        after[dep].append(task)
    if len(needs) > most or any(len(w) > most_each for w in waits.values()):
        raise GraphError("planning.too-many-dependencies")
    ready, out = [t for t in range(count) if not waits[t]], []
    heapq.heapify(ready)
    while ready:
        task = heapq.heappop(ready)
        out.append(task)
        for t in after[task]:
            waits[t].discard(task)
            if not waits[t] and t not in out and t not in ready:
                heapq.heappush(ready, t)
    if len(out) < count:
        raise GraphError("planning.cycle")
    return out
