"""Communities: modularity by local moves, splitting, stable numbering.

A graph of more than ``HELD`` links is moved in parallel: each round scores, for every node, the
communities of its neighbours (one aggregation by node and community) and moves the nodes of one
hash parity to their best one, so two neighbours rarely swap places. Two rounds give every node its
turn; they are repeated until that raises the modularity by less than ``LEAST_GAIN``, then
communities become nodes and the next level starts. Totals per community and the assignment are
written between rounds. As soon as the links of a level fit, one task takes the level and those
above it to the end, as arrays, a part of the nodes at a time. Both go on until no level gains
``LEAST_GAIN``; results are deterministic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.operators.analyze import cohesion
from nodeloom.operators.build import degrees
from nodeloom.schema import Graph
from nodeloom.session import materialize, numbered


def _both(edges: DataFrame) -> DataFrame:
    """(a, b, w) from (u, v, w): both directions; a loop once, with twice its weight."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b"))))
    return edges.select(ends.alias("x"), "w").groupBy("x.a", "x.b").agg(F.sum("w").alias("w"))


#: Rise of modularity from which another pass or level is made; links that one task may hold; parts
#: of the nodes of such a level that move one after the other.
LEAST_GAIN, HELD, PARTS = 1e-4, 8_000_000, 64


def _merged(key: np.ndarray, w: np.ndarray | None, sums: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Sorted keys with their weights (None: all 1); with ``sums`` each key once, weights added."""
    if w is None:
        key.sort()
    else:
        order = np.argsort(key, kind="stable")
        key, w = key[order], w[order]
    if not sums:
        return key, w
    first = np.flatnonzero(np.diff(key, prepend=-1))
    added = np.diff(first, append=len(key)).astype(float) if w is None else np.add.reduceat(w, first) if len(first) else np.zeros(0)
    return key[first], added


def local_moves(a: np.ndarray, b: np.ndarray, w: np.ndarray | None, n: int, resolution: float = 1.0, least: float = LEAST_GAIN) -> np.ndarray:
    """Community of each node 0 to n - 1 of the links (a, b, w), both directions, a loop once with
    twice its weight; w None: all 1. Nodes, in an order by hash, move to the neighbouring community
    of the highest gain, one in ``PARTS`` of them at a time; after the first pass those with a
    neighbour that left, and all again when these gain less than ``least``; communities become
    nodes; until no pass over all and no level raises the modularity by ``least``."""
    whole, m2 = np.arange(n), float(len(a) if w is None else w.sum()) or 1.0
    while True:
        place = np.argsort(np.random.default_rng(n).random(n), kind="stable").argsort().astype(np.int32)
        pair, w = _merged(np.multiply(place[a], n, dtype=np.int64) + place[b], w, False)
        a, b = (pair // n).astype(np.int32), (pair % n).astype(np.int32)
        del pair
        starts, strength = np.searchsorted(a, np.arange(n + 1, dtype=a.dtype)), np.bincount(a, w, n).astype(float)
        degree = np.diff(starts)
        of, total, marked = np.arange(n, dtype=np.int32), strength.copy(), np.ones(n, bool)

        def score() -> float:
            same = of[a] == of[b]
            inside = np.count_nonzero(same) if w is None else w[same].sum()
            return float(inside / m2 - resolution * (total**2).sum() / m2**2)

        def links(rows: np.ndarray) -> np.ndarray:
            d = degree[rows]
            return np.arange(d.sum()) + np.repeat(starts[rows] - np.cumsum(d) + d, d)

        def move(rows: np.ndarray) -> None:
            at = links(rows)
            at = at[a[at] != b[at]]
            key = np.multiply(a[at], n, dtype=np.int64) + of[b[at]]
            key, kin = _merged(key, None if w is None else w[at])
            node, c = np.divmod(key, n)
            if not len(node):
                return
            k, own = strength[node], of[node] == c
            gain = kin - resolution * k * (total[c] - np.where(own, k, 0.0)) / m2
            each = np.flatnonzero(np.diff(node, prepend=-1))
            top = np.maximum.reduceat(gain, each)
            groups = np.repeat(np.arange(len(each)), np.diff(each, append=len(node)))
            mover = node[each]
            here = -resolution * strength[mover] * (total[of[mover]] - strength[mover]) / m2
            here[groups[own]] = gain[own]
            best = np.flatnonzero(gain == top[groups])
            best = c[best[np.flatnonzero(np.diff(groups[best], prepend=-1))]]  # of equals the first
            go = top > here + 1e-12
            mover, best = mover[go], best[go]
            np.subtract.at(total, of[mover], strength[mover])
            np.add.at(total, best, strength[mover])
            of[mover] = best
            near = links(mover)
            marked[b[near][of[b[near]] != of[a[near]]]] = True

        size = max(1, -(-n // PARTS))
        start = now = score()
        while True:
            full, before = bool(marked.all()), of.copy()
            for lo in range(0, n, size):
                rows = lo + np.flatnonzero(marked[lo : lo + size])
                marked[rows] = False
                move(rows)
            gained = score() - now
            now += gained
            if gained < 0:  # moves of one part may spoil each other
                of, now = before, now - gained
                total = np.bincount(of, strength, n)
            if gained < least:
                if full:
                    break
                marked[:] = True
        names, of = np.unique(of, return_inverse=True)
        whole = of[place[whole]]
        if now - start < least or len(names) == n:
            return whole
        n = len(names)
        pair, w = _merged(np.multiply(of[a], n, dtype=np.int64) + of[b], w)
        a, b = (pair // n).astype(np.int32), (pair % n).astype(np.int32)


def _in_one_task(links: DataFrame, resolution: float) -> DataFrame:
    """(id, c) of links (a, b, w) that one task may hold, sent to it as numbers; a community is
    named by its first node."""
    ids = materialize(numbered(links.select(F.col("a").alias("id")).distinct(), [F.col("id")], "i"), "ids")
    of = lambda end, i: ids.select(F.col("id").alias(end), F.col("i").cast("int").alias(i))
    half = links.where("a <= b").join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y", "w")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, w = (np.concatenate(c) for c in zip(*[[p[k].to_numpy() for k in "xyw"] for p in parts] or [[np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)]]))
        if len(x):
            other, n = x != y, int(max(x.max(), y.max())) + 1
            weights = None if (w == 1).all() else np.concatenate([w, w[other]])
            of = local_moves(np.concatenate([x, y[other]]), np.concatenate([y, x[other]]), weights, n, resolution)
            first = np.full(of.max() + 1, n)
            np.minimum.at(first, of, np.arange(n))
            yield pd.DataFrame({"i": np.arange(n), "k": first[of]})

    moved = materialize(half.repartition(1).mapInPandas(run, "i long, k long"), "moved")
    return ids.join(moved, "i").join(ids.select(F.col("i").alias("k"), F.col("id").alias("c")), "k").select("id", "c")


def modularity(links: DataFrame, here: DataFrame, strength: DataFrame, m2: float, resolution: float = 1.0) -> float:
    """Modularity of the assignment ``here`` (id, c) of (a, b, w), both directions."""
    ca, cb = here.select(F.col("id").alias("a"), F.col("c").alias("ca")), here.select(F.col("id").alias("b"), F.col("c").alias("cb"))
    inside = links.join(ca, "a").join(cb, "b").where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("x")).first()["x"]
    squares = strength.join(here, "id").groupBy("c").agg(F.sum("k").alias("t")).agg(F.coalesce(F.sum(F.col("t") * F.col("t")), F.lit(0.0)).alias("x")).first()["x"]
    return inside / m2 - resolution * squares / m2**2


def partition(edges: DataFrame, rounds: int | None = None, levels: int | None = None, resolution: float = 1.0) -> DataFrame:
    """(id, c): community of every node of (u, v, w), named by one of its nodes. ``rounds`` and
    ``levels``: at most that many, all in parallel; None: until the gain is too small."""
    links = materialize(_both(edges), "links")
    m2 = links.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("m")).first()["m"] or 1.0
    whole = materialize(links.select(F.col("a").alias("id")).distinct().withColumn("c", F.col("id")), "assignment")
    level, start = 0, None
    while levels is None or level < levels:
        if rounds is None and levels is None and links.count() <= 2 * HELD:
            rest = _in_one_task(links, resolution).select(F.col("id").alias("c"), F.col("c").alias("n"))
            return materialize(whole.join(rest, "c").select("id", F.col("n").alias("c")), "assignment")
        strength = materialize(links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")), "strength")
        here = materialize(strength.select("id", F.col("id").alias("c")), "assignment")
        start = modularity(links, here, strength, m2, resolution) if start is None else start
        now, kept, r = start, here, 0
        while rounds is None or r < rounds:
            total = strength.join(here, "id").groupBy("c").agg(F.sum("k").alias("tot"))
            near = links.where("a <> b").join(here.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id"), "c").agg(F.sum("w").alias("kin"))
            own = here.select("id", F.col("c").alias("own")).join(strength, "id")
            rows = near.join(own, "id").join(total, "c")
            left = F.when(F.col("c") == F.col("own"), F.col("tot") - F.col("k")).otherwise(F.col("tot"))
            gain = F.round(F.col("kin") - F.lit(resolution) * F.col("k") * left / F.lit(m2), 9)
            # stay if no other is better: staying alone gains 0, and of equals one's own goes first
            rows = rows.select("id", "own", "c", gain.alias("gain"))
            best = rows.groupBy("id", "own").agg(F.max_by("c", F.struct("gain", (F.col("c") == F.col("own")).alias("same"), "c")).alias("best"), F.max("gain").alias("gain"))
            turn = F.pmod(F.xxhash64("id", F.lit(r // 2)), F.lit(2)) == r % 2
            moved = best.where(turn & (F.col("gain") > 0)).select("id", "best")
            here = materialize(here.join(moved, "id", "left").select("id", F.coalesce("best", "c").alias("c")), "assignment")
            r += 1
            if r % 2 == 0 or r == rounds:
                q = modularity(links, here, strength, m2, resolution)
                kept, gain_of_pass, now = (here, q - now, q) if q > now else (kept, 0.0, now)
                if gain_of_pass < LEAST_GAIN:
                    break
        here = kept
        whole = materialize(whole.join(here.select(F.col("id").alias("c"), F.col("c").alias("n")), "c").select("id", F.col("n").alias("c")), "assignment")
        level += 1
        if now - start < LEAST_GAIN:
            break
        start = now
        if levels is None or level < levels:
            ca, cb = here.select(F.col("id").alias("a"), F.col("c").alias("ca")), here.select(F.col("id").alias("b"), F.col("c").alias("cb"))
            links = materialize(links.join(ca, "a").join(cb, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "links")
    return whole


def reindex(members: DataFrame, name: str = "c") -> DataFrame:
    """(id, community): numbers by falling size, of equal sizes by the smallest member."""
    sizes = members.groupBy(name).agg(F.count("*").alias("size"), F.min("id").alias("first"))
    ranks = numbered(sizes, [F.desc("size"), F.col("first")], "community")
    return members.join(ranks.select(name, F.col("community").cast("int").alias("community")), name).select("id", "community")


def hubs(graph: Graph, percentile: float) -> DataFrame:
    """(id): nodes of a degree over that percentile (nearest rank on the histogram)."""
    degree = degrees(graph)
    counts = degree.groupBy("degree").agg(F.count("*").alias("k"))
    upto = counts.withColumn("upto", F.sum("k").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("k").over(Window.partitionBy()))
    index = F.greatest(F.floor(F.col("n") * percentile / 100) - 1, F.lit(0))
    limit = upto.where(F.col("upto") > index).agg(F.min("degree").alias("t"))
    return degree.join(F.broadcast(limit)).where("degree > t").select("id")


def attach_hubs(graph: Graph, members: DataFrame, hub_ids: DataFrame) -> DataFrame:
    """Adds the hubs to (id, c), in order of id, each to the commonest community among its
    neighbours, of equals the smallest; hubs placed before it count. The votes are aggregated on
    the cluster; the placing, in order by nature, is one task over a row per hub and community
    and per pair of hubs."""
    pairs = _both(graph.edges.select("u", "v", F.lit(1.0).alias("w"))).where("a <> b").join(hub_ids.select(F.col("id").alias("a")), "a", "left_semi")
    votes = pairs.join(members.select(F.col("id").alias("b"), "c"), "b").groupBy("a", "c").agg(F.count("*").alias("n")).select("a", "c", "n", F.lit(None).cast("string").alias("b"))
    between = pairs.join(hub_ids.select(F.col("id").alias("b")), "b", "left_semi").select("a", F.lit(None).cast("string").alias("c"), F.lit(0).cast("long").alias("n"), "b")
    alone = hub_ids.select(F.col("id").alias("a"), F.lit(None).cast("string").alias("c"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("b"))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: dict[str, dict[str, int]] = {}
        near: dict[str, list[str]] = {}
        for a, c, n, b in (r for p in parts for r in p.itertuples(index=False)):
            mine = tally.setdefault(a, {})
            if c is not None:
                mine[c] = n
            elif b is not None:
                near.setdefault(a, []).append(b)
        placed: dict[str, str] = {}
        for hub in sorted(tally):
            mine = tally[hub]
            for b in near.get(hub, ()):
                if b in placed:
                    mine[placed[b]] = mine.get(placed[b], 0) + 1
            placed[hub] = min(mine, key=lambda c: (-mine[c], c)) if mine else hub
        yield pd.DataFrame(list(placed.items()), columns=["id", "c"])

    rows = votes.unionByName(between).unionByName(alone).repartition(1)
    return members.unionByName(rows.mapInPandas(place, "id string, c string"))


def split(graph: Graph, members: DataFrame, chosen: DataFrame, rounds: int | None) -> DataFrame:
    """(id, c): the chosen communities (c) partitioned again on their own, all at once: their
    inner edges are one graph without links between them."""
    part = members.join(chosen, "c", "left_semi")
    if part.isEmpty():
        return members
    a, b = part.select(F.col("id").alias("u"), F.col("c").alias("cu")), part.select(F.col("id").alias("v"), F.col("c").alias("cv"))
    inner = graph.edges.select("u", "v").join(a, "u").join(b, "v").where("cu = cv").select("u", "v", F.lit(1.0).alias("w"))
    again = partition(inner, rounds)
    # nodes without inner edges become communities of their own
    out = part.select("id").join(again, "id", "left").select("id", F.concat(F.lit("+"), F.coalesce("c", "id")).alias("c"))
    return materialize(members.join(chosen, "c", "left_anti").select("id", "c").unionByName(out), "assignment")


def cluster(graph: Graph, rounds: int | None = None, levels: int | None = None, resolution: float = 1.0, hub_percentile: float | None = None, most_share: float = 0.25, least_split: int = 10, loose: float = 0.05, least_loose: int = 50) -> DataFrame:
    """(id, community) of every node of an undirected simple graph.

    Isolated nodes are communities of their own. Communities over ``most_share`` of the graph (and
    ``least_split`` nodes) are split, then those of ``least_loose`` nodes or more with a cohesion
    under ``loose``."""
    edges = graph.edges.where("u <> v").select("u", "v", F.lit(1.0).alias("w"))
    out = None
    if hub_percentile is not None:
        out = materialize(hubs(graph, hub_percentile), "hubs")
        for end in ("u", "v"):
            edges = edges.join(out.select(F.col("id").alias(end)), end, "left_anti")
    members = partition(edges, rounds, levels, resolution)
    ids = graph.nodes.select("id")
    alone = ids.join(members, "id", "left_anti")
    if out is not None:
        alone = alone.join(out, "id", "left_anti")
    members = members.unionByName(alone.select("id", F.col("id").alias("c")))
    if out is not None:
        members = attach_hubs(graph, members, out)
    members = materialize(members, "assignment")
    limit = max(least_split, int(ids.count() * most_share))
    members = split(graph, members, members.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("c"), rounds)
    loose_ones = cohesion(graph, members.withColumnRenamed("c", "community")).where((F.col("members") >= least_loose) & (F.col("cohesion") < loose))
    members = split(graph, members, loose_ones.select(F.col("community").alias("c")), rounds)
    return reindex(members)


def overlaps(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id, overlap) of two assignments (id, community)."""
    rows = old.select("id", F.col("community").alias("old_id")).join(new.select("id", F.col("community").alias("new_id")), "id")
    return rows.groupBy("old_id", "new_id").agg(F.count("*").alias("overlap"))


def remap_to_previous(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with communities renumbered after ``old``: pairs by falling overlap, each number
    once; the others get the smallest free numbers, larger communities first. The greedy matching,
    in order by nature, is one task over a row per pair of overlapping communities and per
    community; nodes only meet its result in a join."""
    pairs = overlaps(old, new).select(F.col("old_id").cast("long"), F.col("new_id").cast("long"), F.col("overlap").alias("n"), F.lit(None).cast("string").alias("first"))
    sizes = new.groupBy(F.col("community").cast("long").alias("new_id")).agg(F.count("*").alias("n"), F.min("id").alias("first")).select(F.lit(None).cast("long").alias("old_id"), "new_id", "n", "first")

    def match(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for p in parts for r in p.itertuples(index=False)]
        final: dict[int, int] = {}
        used: set[int] = set()
        for r in sorted((r for r in rows if r.first is None), key=lambda r: (-r.n, r.old_id, r.new_id)):
            if r.new_id not in final and r.old_id not in used:
                final[r.new_id] = int(r.old_id)
                used.add(int(r.old_id))
        free = 0
        for r in sorted((r for r in rows if r.first is not None), key=lambda r: (-r.n, r.first)):
            if r.new_id not in final:
                while free in used:
                    free += 1
                final[r.new_id] = free
                used.add(free)
        yield pd.DataFrame(list(final.items()), columns=["community", "_final"])

    table = pairs.unionByName(sizes).repartition(1).mapInPandas(match, "community long, _final long")
    return new.join(table, "community").select("id", F.col("_final").alias("community"))
