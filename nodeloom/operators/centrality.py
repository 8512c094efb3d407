"""Betweenness by Brandes' accumulation, as joins over (pivot, node).

With all nodes as pivots the result is exact; with fewer it is the usual estimate, scaled.

A graph of up to ``HELD`` edges is held by every task, as arrays of numbers, and the pivots are dealt
over the tasks; nothing but their sums is written. A larger one is joined: some pivots at a time
advance together, one level a step, forward the number of shortest paths, back the dependencies;
their state, a row per pivot and node, at most ``ROWS``, is written level by level and let go with
their sums. No task holds that graph. Both ways give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.operators.traverse import adjacency
from nodeloom.schema import Graph
from nodeloom.session import discard, materialize, numbered, written

#: Edges up to which the tasks hold the graph; entries of a task's arrays by node and pivot; entries
#: that are summed at once; rows by node and pivot that a batch of the joined way has.
HELD, CELLS, BLOCK, ROWS = 10_000_000, 4_000_000, 1 << 17, 20_000_000


def pivots_for(nodes: int, exact: int, sample: int = 100) -> int | None:
    """All up to ``exact`` nodes, above ``sample`` of them."""
    return None if nodes <= exact else sample


class Held:
    """A graph of nodes 0 to n - 1 as arrays: the neighbours of node i are near[starts[i]:starts[i + 1]]."""

    def __init__(self, n: int, ends: np.ndarray):
        m = len(ends)
        key = np.empty(2 * m, np.int64)
        for half, a, b in ((key[:m], ends[:, 0], ends[:, 1]), (key[m:], ends[:, 1], ends[:, 0])):
            half[:] = a
            half *= n
            half += b
        key.sort()
        self.n, self.starts = n, np.searchsorted(key, np.arange(n + 1, dtype=np.int64) * n)
        key %= n
        self.near = key.astype(np.int32)
        del key
        self.degree = np.diff(self.starts)
        self.own = np.repeat(np.arange(n, dtype=np.int32), self.degree)
        self.place = np.zeros(n, np.int32)

    def links(self, rows: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links from ``rows`` to nodes that are ``wanted`` (a mask): the nodes, sorted, and the
        positions in rows."""
        total = int(self.degree[rows].sum())
        if 16 * total < len(self.near):
            degree = self.degree[rows]
            at = np.arange(total) + np.repeat(self.starts[rows] - np.cumsum(degree) + degree, degree)
            to, origin = self.near[at], np.repeat(np.arange(len(rows)), degree)
            to, origin = to[keep := wanted[to]], origin[keep]
            order = np.argsort(to, kind="stable")
            return to[order], origin[order]
        here = np.zeros(self.n, bool)
        here[rows], self.place[rows] = True, np.arange(len(rows))
        at = np.flatnonzero(here[self.near] & wanted[self.own])
        return self.own[at], self.place[self.near[at]]

    def summed(self, x: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Wanted nodes next to ``rows``, and the sums of their neighbours' rows of ``x``."""
        to, origin = self.links(rows, wanted)
        first = np.flatnonzero(np.diff(to, prepend=-1))
        out = np.empty((len(first), x.shape[1]))
        cuts = np.unique(np.searchsorted(first, np.arange(0, len(to), max(1, BLOCK // x.shape[1]))))
        for i, j in zip(cuts, [*cuts[1:], len(first)]):
            if i < j:
                out[i:j] = np.add.reduceat(x[origin[first[i] : first[j] if j < len(first) else len(to)]], first[i:j] - first[i], axis=0)
        return to[first], out

    def depths(self, start: int) -> np.ndarray:
        depth, rows, far = np.full(self.n, -1), np.array([start]), 0
        depth[start] = 0
        while len(rows):
            far += 1
            rows = np.unique(self.links(rows, depth < 0)[0])
            depth[rows] = far
        return depth

    def once(self) -> tuple[np.ndarray, np.ndarray]:
        """The ends of each link, the smaller first."""
        at = self.own < self.near
        return self.own[at], self.near[at]


def accumulate(graph: Held, pivots: np.ndarray, edges: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Summed dependencies of the nodes and, with ``edges``, of the links as :meth:`Held.once` has
    them, in both directions. Pivots as far from the hub go together, as their levels are alike."""
    n = graph.n
    low, high = graph.once() if edges else (graph.near[:0], graph.near[:0])
    nodes, links = np.zeros(n), np.zeros(len(low))
    pivots = pivots[np.lexsort((pivots, graph.depths(int(np.argmax(graph.degree)))[pivots]))]
    size = max(1, min(32, CELLS // n))
    for at in range(0, len(pivots), size):
        some = pivots[at : at + size]
        each = np.arange(len(some))
        depth, sigma = np.full((n, len(some)), -1, np.int32), np.zeros((n, len(some)))
        depth[some, each], sigma[some, each] = 0, 1.0
        levels, unseen = [np.sort(some)], np.ones(n, bool)
        front = sigma[levels[0]]  # the level's paths, 0 where a row is of another level
        while len(rows := levels[-1]):
            to, paths = graph.summed(front, rows, unseen)
            there = depth[to]
            paths[there >= 0] = 0
            new = paths > 0
            there[new] = len(levels)
            depth[to], unseen[to] = there, (there < 0).any(axis=1)
            some_new = new.any(axis=1)
            front, rows = paths[some_new], to[some_new]
            sigma[rows] += front
            levels.append(rows)
        share = np.zeros((n, len(some)) if edges else 0)
        delta = np.zeros((len(levels[-2]), len(some)))
        for d in range(len(levels) - 2, 0, -1):
            rows, up, wanted = levels[d], levels[d - 1], np.zeros(n, bool)
            part = np.divide(1 + delta, sigma[rows], out=np.zeros_like(delta), where=depth[rows] == d)
            nodes[rows] += delta.sum(axis=1)
            if edges:
                share[rows] += part
            elif d == 1:  # above are the pivots, whose own dependencies don't count
                break
            wanted[up] = True
            to, back = graph.summed(part, rows, wanted)
            delta = np.zeros((len(up), len(some)))
            delta[np.searchsorted(up, to)] = back
            delta *= sigma[up]
            delta[depth[up] != d - 1] = 0
        if edges:
            width = max(1, BLOCK // len(some))
            for i in range(0, len(links), width):
                a, b = low[i : i + width], high[i : i + width]
                deeper = depth[b] - depth[a]
                links[i : i + width] += np.einsum("ij,ij->i", np.where(deeper == 1, sigma[a], 0.0), share[b]) + np.einsum("ij,ij->i", np.where(deeper == -1, sigma[b], 0.0), share[a])
    return nodes, links


def _held(links: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, s) and (u, v, s): summed dependencies, by tasks that hold the graph of ``links``."""
    spark = links.sparkSession
    ids = links.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    mark = written()
    index = materialize(numbered(ids, [F.col("id")], "i"), "index")
    of = lambda x, i: index.select(F.col("id").alias(x), F.col("i").cast("int").alias(i))
    ends = links.join(of("u", "x"), "u").join(of("v", "y"), "v").select("x", "y")
    packed = ends.mapInPandas(lambda parts: (pd.DataFrame({"x": [p.to_numpy(np.int32).tobytes()]}) for p in parts), "x binary")
    held, n = spark.sparkContext.broadcast(b"".join(r[0] for r in packed.toLocalIterator())), index.count()  # 8 bytes an edge
    todo = materialize(chosen.join(index, "id").select("i"), "todo")
    discard(spark, mark, 2)
    todo = todo.repartition(2 * spark.sparkContext.defaultParallelism, "i")

    def run(parts: Iterator[pd.DataFrame], edges: bool) -> Iterator[pd.DataFrame]:
        mine = np.concatenate([p["i"].to_numpy() for p in parts] or [np.zeros(0, np.int64)])
        if len(mine):
            graph = Held(n, np.frombuffer(held.value, np.int32).reshape(-1, 2))
            s = accumulate(graph, mine, edges)[int(edges)]
            x, y = graph.once() if edges else (np.arange(n), np.arange(n))
            for i in range(0, len(s), BLOCK):
                part = i + np.flatnonzero(s[i : i + BLOCK])
                yield pd.DataFrame({"x": x[part], "y": y[part], "s": s[part]})

    sums = lambda edges: todo.mapInPandas(lambda parts: run(parts, edges), "x int, y int, s double").groupBy("x", "y").agg(F.sum("s").alias("s"))
    found = sums(False).join(of("id", "x"), "x").select("id", "s")
    return found, sums(True).join(of("u", "x"), "x").join(of("v", "y"), "y").select("u", "v", "s")


def betweenness(graph: Graph, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, betweenness) of nodes and (u, v, betweenness) of edges of an undirected simple graph,
    normalised as shares of all pairs. ``pivots``: that many nodes by hash of the id, None: all."""
    links = materialize(graph.links().where("u <> v"), "links")
    n = graph.nodes.count()
    chosen = graph.nodes.select("id")
    if pivots is not None and pivots < n:
        chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(pivots)
    k = n if pivots is None else min(pivots, n)
    few = links.count() <= HELD
    sums, edges = _held(links, chosen) if few else _in_batches(materialize(adjacency(Graph(graph.nodes, links)), "adjacency"), chosen, max(1, ROWS // max(n, 1)))
    scale = n / max(k, 1)
    per_node = scale / max((n - 1) * (n - 2), 1)
    nodes = graph.nodes.select("id").join(sums, "id", "left").select("id", F.coalesce(F.col("s") * per_node, F.lit(0.0)).alias("betweenness"))
    every = links.join(edges, ["u", "v"], "left")
    return nodes, every.select("u", "v", F.coalesce(F.col("s") * scale / max(n * (n - 1), 1), F.lit(0.0)).alias("betweenness"))


def _in_batches(pairs: DataFrame, chosen: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The same by joins, ``size`` pivots at a time: what a batch has written goes with its sums."""
    dealt, totals = materialize(numbered(chosen, [F.col("id")], "i"), "pivots"), []
    mark = written()
    for at in range(0, dealt.count(), size):
        sums = _joined(pairs, dealt.where(F.col("i").between(at, at + size - 1)).select("id"))
        rows = [s.unionByName(t) for s, t in zip(sums, totals)] if totals else sums
        totals = [materialize(r.groupBy(*keys).agg(F.sum("s").alias("s")), "sums") for r, keys in zip(rows, (["id"], ["u", "v"]))]
        discard(pairs.sparkSession, mark, 2)
    return (totals[0], totals[1]) if totals else _joined(pairs, chosen)


def _joined(pairs: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sums of some pivots by joins, a level of all of them a step."""
    level = materialize(chosen.select(F.col("id").alias("p"), "id", F.lit(1.0).alias("sigma"), F.lit(0).alias("depth")), "level")
    levels, visited = [level], level.select("p", "id")
    while True:
        step = level.select("p", F.col("id").alias("a"), "sigma").join(pairs, "a").groupBy("p", F.col("b").alias("id")).agg(F.sum("sigma").alias("sigma"))
        step = step.join(visited, ["p", "id"], "left_anti").withColumn("depth", F.lit(len(levels)))
        level = materialize(step, "level")
        if level.isEmpty():
            break
        levels.append(level)
        visited = visited.unionByName(level.select("p", "id"))
    spark = pairs.sparkSession
    deltas, flows = [], []
    below = spark.createDataFrame([], "p string, id string, sigma double, delta double")
    for at in range(len(levels) - 1, 0, -1):
        here = levels[at].select("p", "id", "sigma").join(below.select("p", "id", "delta"), ["p", "id"], "left").select("p", "id", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        deltas.append(here.select("p", "id", "delta"))
        up = levels[at - 1].select("p", F.col("id").alias("a"), F.col("sigma").alias("up"))
        flow = here.join(pairs, F.col("id") == F.col("b")).join(up, ["p", "a"]).select("p", "a", "b", (F.col("up") / F.col("sigma") * (1 + F.col("delta"))).alias("c"))
        flow = materialize(flow, "flow")
        flows.append(flow)
        below = flow.groupBy("p", F.col("a").alias("id")).agg(F.sum("c").alias("delta")).withColumn("sigma", F.lit(0.0))
    if not deltas:
        return pairs.select(F.col("a").alias("id"), F.lit(0.0).alias("s")).limit(0), pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(0.0).alias("s")).limit(0)
    total, every = reduce(DataFrame.unionByName, deltas), reduce(DataFrame.unionByName, flows)
    sums = total.where("id <> p").groupBy("id").agg(F.sum("delta").alias("s"))
    return sums, every.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("c").alias("s"))
