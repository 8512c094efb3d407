"""Bounded traversal as a driver loop over DataFrames.

Each level joins the frontier with the edges and leaves out what was visited. A level of up to
``SMALL`` nodes (counted) is broadcast, so the edges are scanned but not moved; a larger one is
joined by key. Levels are written to the shared folder, so plans stay short and a lost executor
costs one level. Nothing but a level's size reaches the driver. The graph's edges are read once a
level: they should be a stored table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.functions.text import query_terms
from nodeloom.operators.build import degrees, sanitize_label
from nodeloom.schema import IMPACT_RELATIONS, Graph
from nodeloom.session import materialize


#: Nodes up to which a level, or what was visited, goes to every executor.
SMALL = 100_000


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def hub_threshold(degree: DataFrame, quantile: float = 0.99, least: int = 50) -> DataFrame:
    """(threshold): the degree at 0-based rank int(n * quantile), at least ``least``. From the
    histogram of degrees, so the window sees one row per distinct degree."""
    counts = degree.groupBy("degree").agg(F.count("*").alias("k"))
    upto = counts.withColumn("upto", F.sum("k").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum("k").over(Window.partitionBy())
    rows = upto.withColumn("n", total).where(F.col("upto") > F.floor(F.col("n") * quantile))
    return rows.agg(F.greatest(F.coalesce(F.min("degree"), F.lit(least)), F.lit(least)).alias("threshold"))


def adjacency(graph: Graph) -> DataFrame:
    """(a, b): successors in a directed graph, else neighbours. A simple graph has each pair once,
    so nothing has to be made distinct."""
    if graph.directed:
        return graph.edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    both = F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))
    return graph.edges.select(F.explode(F.array_distinct(both)).alias("x")).select("x.a", "x.b")


def _step(frontier: DataFrame, n: int, pairs: DataFrame, visited: DataFrame, n_visited: int) -> DataFrame:
    """(a, b): pairs from the frontier (id) to nodes that were not visited."""
    step = pairs.join(_sent(frontier.select(F.col("id").alias("a")), n), "a")
    return step.join(_sent(visited.select(F.col("id").alias("b")), n_visited), "b", "left_anti").select("a", "b")


def bfs(graph: Graph, seeds: DataFrame, depth: int, cutoff: bool = True, degree: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, depth) of all nodes within ``depth`` of the seeds, and (a, b, depth) of all edges from
    a level to newly found nodes. Nodes of degree at or above the hub threshold are found but not
    expanded, seeds excepted. ``degree``: stored degrees of the graph, if there are any."""
    pairs, most = adjacency(graph), None
    if cutoff:
        degree = materialize(degrees(graph), "degrees") if degree is None else degree
        most = hub_threshold(degree).first()["threshold"]  # one row
    visited = frontier = materialize(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "level")
    seen, n, n_visited = None, frontier.count(), 0
    for level in range(1, depth + 1):
        n_visited += n
        if cutoff and level > 1:
            frontier = degree.where(F.col("degree") < most).join(_sent(frontier.select("id"), n), "id", "left_semi")
        step = materialize(_step(frontier, n, pairs, visited, n_visited).withColumn("depth", F.lit(level)), "level")
        seen = step if seen is None else seen.unionByName(step)
        frontier = materialize(step.select(F.col("b").alias("id"), "depth").distinct(), "frontier")
        n = frontier.count()
        if not n:
            break
        visited = visited.unionByName(frontier)
    if seen is None:
        seen = pairs.limit(0).withColumn("depth", F.lit(0))
    return visited, seen


def shortest_path(graph: Graph, source: DataFrame, target: DataFrame, most: int = 8) -> list[str] | None:
    """Ids along a shortest path between two single-row (id) frames over the undirected graph, of
    all the one with the smallest ids from the source on; None if there is none of up to ``most``
    hops. Levels are grown from both ends in turn; then those of the source are cut to nodes that
    lead on, and the path is read off level by level, one id each."""
    pairs = adjacency(graph.with_(directed=False))
    levels = [[materialize(x.select("id"), "level")] for x in (source, target)]
    if any(x[0].isEmpty() for x in levels):
        return None
    reached, n, total = [x[0] for x in levels], [1, 1], [1, 1]
    while reached[0].join(_sent(reached[1], total[1]), "id", "left_semi").isEmpty():
        if len(levels[0]) + len(levels[1]) - 2 >= most:
            return None
        k = 0 if n[0] <= n[1] else 1
        nxt = _step(levels[k][-1], n[k], pairs, reached[k], total[k]).select(F.col("b").alias("id")).distinct()
        levels[k].append(materialize(nxt, "level"))
        n[k] = levels[k][-1].count()
        if not n[k]:
            return None
        total[k] += n[k]
        reached[k] = reached[k].unionByName(levels[k][-1])
    ahead, back = levels
    meet = materialize(ahead[-1].join(back[-1], "id", "left_semi"), "level")
    onward = [meet]
    for level in reversed(ahead[:-1]):  # nodes of the level from which the next is reached
        on = onward[0]
        near = pairs.join(_sent(on.select(F.col("id").alias("b")), on.count()), "b", "left_semi").select(F.col("a").alias("id")).distinct()
        onward.insert(0, materialize(level.join(near, "id", "left_semi"), "level"))
    onward += reversed(back[:-1])
    path = [onward[0].first()["id"]]
    for level in onward[1:]:
        found = pairs.where(F.col("a") == path[-1]).join(level.select(F.col("id").alias("b")), "b", "left_semi")
        path.append(found.agg(F.min("b").alias("b")).first()["b"])
    return path


def path_steps(graph: Graph, path: list[str]) -> DataFrame:
    """(step, id, label, relation, confidence, forward): the nodes of a path with the edge to each
    from the one before, and whether that edge points along the path."""
    rows = graph.edges.sparkSession.createDataFrame([(i, x, path[i - 1] if i else None) for i, x in enumerate(path)], "step int, id string, before string")  # a path's nodes
    rows = rows.withColumns({"u": F.least("id", "before"), "v": F.greatest("id", "before")})
    rows = F.broadcast(rows.where("step > 0")).join(graph.edges.select("u", "v", "source", "relation", "confidence"), ["u", "v"]).select("step", "id", "relation", "confidence", (F.col("source") == F.col("before")).alias("forward")).unionByName(
        rows.where("step = 0").select("step", "id", F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("confidence"), F.lit(None).cast("boolean").alias("forward"))
    )
    return graph.nodes.select("id", F.coalesce("label", "id").alias("label")).join(F.broadcast(rows), "id").select("step", "id", "label", "relation", "confidence", "forward")


def path_text(steps: DataFrame, warnings: list[str] = []) -> str:
    """The path on one line, behind warnings about ends that were not clear."""
    rows = steps.orderBy("step").collect()  # a path's nodes
    out = [rows[0]["label"]] if rows else []
    for r in rows[1:]:
        edge = (r["relation"] or "") + (f" [{r['confidence']}]" if r["confidence"] else "")
        out.append(f"--{edge}--> {r['label']}" if r["forward"] else f"<--{edge}-- {r['label']}")
    return "\n".join([*warnings, f"Shortest path ({max(0, len(rows) - 1)} hops):", "  " + " ".join(out)])


def affected(graph: Graph, seed: DataFrame, depth: int = 2, relations: list[str] | None = None) -> DataFrame:
    """(id, depth, via_relation): nodes from which the seed is reached along the given relations;
    the relation is that of the first edge (by seq) into the level before."""
    back = graph.edges.where(F.col("relation").isin(*(relations or IMPACT_RELATIONS))).select("source", "target", "relation", "seq")
    visited = frontier = materialize(seed.select("id"), "level")
    hits, n, n_visited = None, frontier.count(), 0
    for level in range(1, depth + 1):
        n_visited += n
        step = back.join(_sent(frontier.select(F.col("id").alias("target")), n), "target").join(_sent(visited.select(F.col("id").alias("source")), n_visited), "source", "left_anti")
        step = step.groupBy(F.col("source").alias("id")).agg(F.min_by("relation", F.struct("seq", "relation")).alias("via_relation"))
        step = materialize(step.select("id", F.lit(level).alias("depth"), "via_relation"), "level")
        n = step.count()
        if not n:
            break
        hits = step if hits is None else hits.unionByName(step)
        frontier, visited = step.select("id"), visited.unionByName(step.select("id"))
    return hits if hits is not None else visited.limit(0).select("id", F.lit(0).alias("depth"), F.lit("").alias("via_relation"))


def dfs(graph: Graph, seeds: list[str], depth: int, most_edges: int = 2_000_000) -> DataFrame:
    """(id, ord, onward): order of a depth-first walk from the seeds, neighbours in order of edge
    seq, and the neighbours that each node leads on to. Seeds that are no nodes are left out.

    The order of a depth-first walk is sequential by nature: one task walks the ``depth``-hop
    neighbourhood, which must have at most ``most_edges`` edges; hubs are not walked through, so
    the neighbourhood of a few seeds does not grow with the graph."""
    spark = graph.edges.sparkSession
    starts = spark.createDataFrame([(x,) for x in seeds], "id string").join(graph.nodes.select("id"), "id", "left_semi")
    degree = materialize(degrees(graph), "degrees")
    near, _ = bfs(graph, starts, depth, degree=degree)
    near = materialize(near.select("id").distinct(), "near")
    n, most = near.count(), hub_threshold(degree).first()["threshold"]
    hubs = degree.where(F.col("degree") >= most).join(_sent(near, n), "id", "left_semi").select(F.col("id").alias("a"), F.lit(True).alias("hub"))
    both = F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b"))))
    ends = lambda c: _sent(near.withColumnRenamed("id", c), n)
    rows = graph.edges.select("seq", both.alias("x")).select("seq", "x.a", "x.b").join(ends("a"), "a", "left_semi").join(ends("b"), "b", "left_semi")
    rows = rows.join(hubs, "a", "left").select("seq", "a", "b", F.coalesce("hub", F.lit(False)).alias("hub"))
    alone = starts.select(F.lit(-1).cast("long").alias("seq"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(False).alias("hub"))
    rows = materialize(rows.unionByName(alone), "dfs")
    if rows.count() > most_edges:
        raise ValueError(f"the neighbourhood has more than {most_edges} edges")

    def walk(pdf):
        import pandas as pd

        links, hub, known = {}, set(pdf.a[pdf.hub]), set(pdf.a[pdf.seq < 0])
        for a, b in pdf[pdf.seq >= 0].sort_values(["seq", "b"])[["a", "b"]].itertuples(index=False):
            links.setdefault(a, []).append(b)
        out, todo = {}, [(x, 0) for x in reversed(seeds) if x in known]
        while todo:
            node, d = todo.pop()
            if node in out or d > depth:
                continue
            walled = node in hub and node not in known
            out[node] = [] if walled else [b for b in dict.fromkeys(links.get(node, [])) if b not in out and b != node]
            todo += [(b, d + 1) for b in out[node]]
        return pd.DataFrame({"id": list(out), "ord": range(len(out)), "onward": list(out.values())})

    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(walk, "id string, ord long, onward array<string>")


# answers


def _text(c: str):
    return F.coalesce(sanitize_label(F.col(c).cast("string")), F.lit(""))


def node_lines(graph: Graph, nodes: DataFrame, degree: DataFrame | None = None) -> DataFrame:
    """(id, degree, seq, line) of the given nodes (id)."""
    name = F.coalesce(sanitize_label(F.coalesce("label", "id")), F.lit(""))
    line = F.concat(F.lit("NODE "), name, F.lit(" [src="), _text("source_file"), F.lit(" loc="), _text("source_location"), F.lit(" community="), _text("community"), F.lit("]"))
    rows = graph.nodes.join(nodes.select("id"), "id", "left_semi").join(degrees(graph) if degree is None else degree, "id")
    return rows.select("id", "degree", "seq", line.alias("line"))


def edge_lines(graph: Graph, walked: DataFrame) -> DataFrame:
    """(depth, seq, b, line) of walked edges (a, b, depth), seen from a."""
    pairs = walked.select("a", "b", "depth", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    rows = pairs.join(graph.edges.select("u", "v", "seq", "relation", "confidence", "context"), ["u", "v"])
    name = lambda end: graph.nodes.select(F.col("id").alias(end), F.coalesce("label", "id").alias(f"_{end}"))
    rows = rows.join(name("a"), "a").join(name("b"), "b")
    context = F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit(" context="), _text("context"))).otherwise("")
    line = F.concat(F.lit("EDGE "), _text("_a"), F.lit(" --"), _text("relation"), F.lit(" ["), _text("confidence"), context, F.lit("]--> "), _text("_b"))
    return rows.select("depth", "seq", "b", line.alias("line"))


def rendered(nodes: DataFrame, edges: DataFrame, seeds: list[str], tokens: int = 2000) -> DataFrame:
    """(ord, line): seeds first, the other nodes by degree, then the edges as they were walked,
    up to the last whole line within 3 characters a token; a last line tells what was cut.

    Only as many lines as may fit are sorted into one task: none is shorter than 15 characters."""
    chars, first = tokens * 3, F.array_position(F.array(*[F.lit(x) for x in seeds]).cast("array<string>"), F.col("id"))
    rows = nodes.select(F.when(first > 0, 0).otherwise(1).alias("k0"), F.when(first > 0, first).otherwise(-F.col("degree")).cast("long").alias("k1"), F.col("seq").alias("k2"), F.col("id").alias("k3"), "line")
    rows = rows.unionByName(edges.select(F.lit(2).alias("k0"), F.col("depth").cast("long").alias("k1"), F.col("seq").alias("k2"), F.col("b").alias("k3"), "line"))
    rows, keys = materialize(rows, "lines"), ["k0", "k1", "k2", "k3"]
    size = rows.agg(F.coalesce(F.sum(F.length("line") + 1) - 1, F.lit(0)).alias("chars"), F.count_if(F.col("k0") < 2).alias("nodes")).first()  # one row
    by = Window.orderBy(*keys)
    best = rows.orderBy(*keys).limit(chars // 16 + 2)
    best = best.select("k0", "line", F.row_number().over(by).alias("ord"), (F.sum(F.length("line") + 1).over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("upto"))
    if size["chars"] <= chars:
        return best.select("ord", "line")
    kept = best.where((F.col("upto") < chars) | (F.col("ord") == 1)).select("k0", "ord", F.substring("line", 1, chars).alias("line"))
    note = F.concat(F.lit("... (truncated \u2014 "), size["nodes"] - F.count_if(F.col("k0") < 2), F.lit(f" more nodes cut by ~{tokens}-token budget. Narrow with context_filter=['call'] or use get_node for a specific symbol)"))
    return kept.select("ord", "line").unionByName(kept.agg((F.coalesce(F.max("ord"), F.lit(0)) + 1).alias("ord"), note.alias("line")))


def within_budget(lines: DataFrame, tokens: int) -> DataFrame:
    """The first lines by (degree desc, seq) that fit into ``tokens`` at 3 characters each. No
    line is shorter than 28 characters, so only so many can fit and only those are ranked."""
    chars = tokens * 3
    best = lines.orderBy(F.desc("degree"), "seq", "id").limit(chars // 28 + 1)
    upto = F.sum(F.length("line") + 1).over(Window.orderBy(F.desc("degree"), "seq", "id").rowsBetween(Window.unboundedPreceding, 0))
    return best.withColumn("upto", upto - 1).where(F.col("upto") <= chars).select("id", "degree", "line")


# The questions of the token benchmark.
SAMPLE_QUESTIONS = [
    "how does authentication work",
    "what is the main entry point",
    "how are errors handled",
    "what connects the data layer to the api",
    "what are the core abstractions",
]


def question_size(graph: Graph, question: str, depth: int = 3) -> DataFrame:
    """(question, query_tokens): tokens of all nodes and edges within ``depth`` of the three nodes
    whose labels hold most of the question's terms; no row if none does."""
    hits = sum((F.lower(F.coalesce("label", F.lit(""))).contains(t).cast("int") for t in query_terms(question)), F.lit(0))
    seeds = graph.nodes.select("id", hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), F.desc("id")).limit(3)
    found, walked = bfs(graph, seeds, depth, cutoff=False)
    named = graph.nodes.select("id", F.coalesce("label", "id").alias("label"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("source_file", "source_location")])
    lines = named.join(found.select("id"), "id", "left_semi").select((F.length("label") + F.length("source_file") + F.length("source_location") + 15).alias("n"))
    pairs = walked.select("a", "b", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).join(graph.edges.select("u", "v", F.coalesce("relation", F.lit("")).alias("relation")), ["u", "v"])
    size = lambda end: named.select(F.col("id").alias(end), F.length("label").alias(f"n_{end}"))
    pairs = pairs.join(size("a"), "a").join(size("b"), "b").select((F.col("n_a") + F.col("n_b") + F.length("relation") + 12).alias("n"))
    total = lines.unionByName(pairs).agg(F.sum(F.col("n") + 1).alias("n"), F.count("*").alias("k")).where("k > 0")
    return total.select(F.lit(question).alias("question"), F.greatest(F.lit(1), F.floor((F.col("n") - 1) / 4)).cast("long").alias("query_tokens"))


def token_reduction(graph: Graph, corpus_words: DataFrame, questions: list[str] | None = None, depth: int = 3) -> DataFrame:
    """(question, corpus_tokens, query_tokens, reduction) of each question that finds something,
    and with a null question those of their average. ``corpus_words``: one row (words)."""
    rows = reduce(DataFrame.unionByName, [question_size(graph, q, depth) for q in questions or SAMPLE_QUESTIONS])
    mean = rows.agg(F.floor(F.sum("query_tokens") / F.count("*")).cast("long").alias("query_tokens")).where("query_tokens IS NOT NULL")
    rows = rows.unionByName(mean.select(F.lit(None).cast("string").alias("question"), "query_tokens"))
    tokens = corpus_words.select(F.floor(F.col("words") * 100 / 75).cast("long").alias("corpus_tokens"))
    return rows.join(F.broadcast(tokens)).select("question", "corpus_tokens", "query_tokens", F.round(F.col("corpus_tokens") / F.col("query_tokens"), 1).alias("reduction"))
