"""Graph assembly: validation, coercion, deduplication, folding, merging.

Every per-key choice is a ``max_by`` / ``min_by`` aggregate (partial aggregation before the
shuffle), so an id or pair with very many deliveries never gathers in one task. Only the fold per
node pair collects rows, after the pair is down to one row per direction and relation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.functions.ids import normalize_id
from nodeloom.schema import BUILD_FAMILIES, CONFIDENCES, DEFAULT_SCORES, FILE_TYPE_SYNONYMS, FILE_TYPES, Graph, basename, lookup, mapped, suffix
from nodeloom.session import spread

NODE_COLS = ["label", "file_type", "source_file", "source_location", "community", "repo"]
EDGE_COLS = ["confidence", "confidence_score", "context", "source_file", "weight"]


def coerce_file_type(c: Column) -> Column:
    """Null or '' becomes concept; a synonym its type; anything else unknown becomes concept."""
    return F.when(c.isin(*FILE_TYPES), c).otherwise(F.coalesce(mapped(FILE_TYPE_SYNONYMS, c), F.lit("concept")))


def norm_source_file(c: Column, root: str | None = None) -> Column:
    """Slashes forward; a leading ``root`` stripped."""
    c = F.replace(c, F.lit("\\"), F.lit("/"))
    if not root:
        return c
    root = root.rstrip("/") + "/"
    return F.when(c.startswith(root), F.substring(c, F.lit(len(root) + 1), F.length(c))).otherwise(c)


# validation


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, seq, rule, value): one row for each violated rule. Required fields, file types and
    confidences; endpoints that match no node id, judged only if there are node ids at all."""
    rules = [_missing(nodes, "node", f) for f in ("id", "label", "file_type", "source_file")]
    rules += [_missing(edges, "edge", f) for f in ("source", "target", "relation", "confidence", "source_file")]
    rules.append(_bad(nodes, "node", "file_type", FILE_TYPES))
    rules.append(_bad(edges, "edge", "confidence", CONFIDENCES))
    ids = nodes.where("id IS NOT NULL").select(F.col("id").alias("_id")).distinct()
    some = F.broadcast(ids.limit(1).select(F.lit(True).alias("_some")))
    ends = edges.select("seq", F.explode(F.array(*[F.struct(F.lit(e).alias("e"), F.col(e).alias("v")) for e in ("source", "target")])).alias("x"))
    ends = ends.select("seq", "x.e", "x.v").where("v IS NOT NULL").join(ids, F.col("v") == F.col("_id"), "left_anti").join(some)
    rules.append(ends.select(F.lit("edge").alias("kind"), "seq", F.concat(F.lit("unmatched "), "e").alias("rule"), F.col("v").alias("value")))
    return reduce(DataFrame.unionByName, rules)


def _missing(df: DataFrame, kind: str, field: str) -> DataFrame:
    return df.where(F.col(field).isNull()).select(F.lit(kind).alias("kind"), "seq", F.lit(f"missing {field}").alias("rule"), F.lit(None).cast("string").alias("value"))


def _bad(df: DataFrame, kind: str, field: str, allowed: list[str]) -> DataFrame:
    return df.where(~F.col(field).isin(*allowed)).select(F.lit(kind).alias("kind"), "seq", F.lit(f"invalid {field}").alias("rule"), F.col(field).alias("value"))


def assert_valid(nodes: DataFrame, edges: DataFrame, show: int = 20) -> None:
    """Raise ValueError if any rule is violated, with up to ``show`` of the violations."""
    bad = validate(nodes, edges).limit(show).collect()
    if bad:
        raise ValueError("invalid extraction:\n" + "\n".join(f"  {r.kind} {r.seq}: {r.rule} {r.value or ''}" for r in bad))


# deduplication


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id: the last delivery as a whole, at the place of the first."""
    cols = [c for c in nodes.columns if c not in ("seq", "id")]
    kept = nodes.where("id IS NOT NULL").groupBy("id").agg(F.min("seq").alias("seq"), F.max_by(F.struct(*cols), "seq").alias("x"))
    return kept.select("seq", "id", "x.*")


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each (source, target, relation)."""
    cols = [c for c in edges.columns if c not in ("source", "target", "relation")]
    kept = edges.groupBy("source", "target", "relation").agg(F.min_by(F.struct(*cols), "seq").alias("x"))
    return kept.select("source", "target", "relation", "x.*")


def upsert_attrs(rows: DataFrame, key: str = "id", seq: str = "seq", attrs: str = "attrs") -> DataFrame:
    """(key, attr, value): per attribute the last value written, explicit nulls included;
    attributes that later rows lack survive. One row per (key, attribute)."""
    each = rows.select(key, seq, F.explode(F.map_entries(attrs)).alias("e")).select(key, seq, F.col("e.key").alias("attr"), F.struct(F.col("e.value").alias("v")).alias("v"))
    return each.groupBy(key, "attr").agg(F.max_by("v", seq).alias("v")).select(key, "attr", F.col("v.v").alias("value"))


def as_map(entries: DataFrame, key: str = "id") -> DataFrame:
    """(key, attrs): the entries of :func:`upsert_attrs` as one map per key."""
    return entries.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("attr", "value")))).alias("attrs"))


def remap_edges(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Endpoints through (old, new); edges that become loops go."""
    for end in ("source", "target"):
        m = remap.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        edges = edges.join(m, F.col(end) == F.col("_old"), "left").withColumn(end, F.coalesce("_new", end)).drop("_old", "_new")
    return edges.where("source <> target")


def winner_rank(node_id: Column, seq: Column) -> Column:
    """Order of preference among merged nodes: no chunk suffix, shorter id, earlier."""
    return F.struct(node_id.rlike(r"_c\d+$").cast("int").alias("suffixed"), F.length(node_id).alias("len"), seq.alias("seq"))


def merge_by_label(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, remap): nodes of one normal label merged into the preferred one. Nodes
    without a label key are dropped."""
    from nodeloom.operators.dedup import norm_label

    keyed = nodes.withColumn("_k", norm_label(F.coalesce("label", "id"))).where("_k <> ''")
    best = keyed.groupBy("_k").agg(F.min_by("id", winner_rank(F.col("id"), F.col("seq"))).alias("new"))
    remap = keyed.join(best, "_k").where("id <> new").select(F.col("id").alias("old"), "new").distinct()
    kept = keyed.join(best.select(F.col("new").alias("id")), "id", "left_semi").drop("_k")
    return kept, remap_edges(edges, remap), remap


def merge_ghosts(nodes: DataFrame) -> DataFrame:
    """(old, new): nodes to merge into a canonical twin of the same (file name, label).

    Canonical is the only node of ``origin`` 'ast' under the key, else the first node with a
    location if there is no such node; two or more make the key ambiguous and nothing is merged.
    All other nodes without that origin are ghosts."""
    keyed = nodes.withColumn("_l", F.trim("label")).withColumn("_f", basename(F.col("source_file"))).where("_l <> '' AND _f <> ''")
    ast = F.coalesce(F.col("origin") == "ast", F.lit(False))
    located = F.coalesce(F.col("source_location") != "", F.lit(False)) & ~ast
    key = keyed.groupBy("_f", "_l").agg(
        F.count_if(ast).alias("n"), F.min_by("id", F.when(ast, F.col("seq"))).alias("a"), F.min_by("id", F.when(located, F.col("seq"))).alias("b")
    )
    key = key.where("n < 2").select("_f", "_l", F.when(F.col("n") == 1, F.col("a")).otherwise(F.col("b")).alias("new")).where("new IS NOT NULL")
    return keyed.where(~ast).join(key, ["_f", "_l"]).where("id <> new").select(F.col("id").alias("old"), "new").distinct()


# assembly


def from_tables(raw_nodes: DataFrame, raw_edges: DataFrame, keep=lambda df, name: df) -> Graph:
    """Delivered rows to one row per node and all valid edges, ids in normal form.

    ``keep(df, name)`` may store the nodes, which are used three times (``session.materialize``).

    A node's last delivery counts. Edges without both endpoints among the nodes are dropped, an
    empty source_file is filled from the source, then the target, and INFERRED calls across
    language families are dropped."""
    ids = normalize_id("id")
    nodes = spread(raw_nodes.select("node_seq", "id", *NODE_COLS)).select(F.col("node_seq").alias("seq"), ids.alias("id"), *NODE_COLS).where("id <> ''")
    nodes = keep(dedupe_nodes(nodes.withColumn("file_type", coerce_file_type(F.col("file_type")))), "nodes")
    rows = spread(raw_edges.select("edge_seq", "source", "target", "relation", *EDGE_COLS)).select(F.col("edge_seq").alias("seq"), normalize_id("source").alias("source"), normalize_id("target").alias("target"), normalize_id("relation").alias("relation"), *EDGE_COLS)
    return Graph(nodes, attach(rows.where("source <> '' AND target <> ''"), nodes))


def attach(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both endpoints among the nodes, source_file filled, cross-language INFERRED calls out."""
    s = nodes.select(F.col("id").alias("source"), F.col("source_file").alias("_sf"))
    t = nodes.select(F.col("id").alias("target"), F.col("source_file").alias("_tf"))
    rows = edges.join(s, "source").join(t, "target")
    given = F.when(F.col("source_file") != "", F.col("source_file"))
    filled = F.coalesce(given, F.when(F.col("_sf") != "", F.col("_sf")), F.col("_tf"), F.lit(""))
    a, b = suffix(F.col("_sf")), suffix(F.col("_tf"))
    other = (a != "") & (b != "") & ~lookup(BUILD_FAMILIES, a).eqNullSafe(lookup(BUILD_FAMILIES, b))
    phantom = (F.col("relation") == "calls") & (F.col("confidence") == "INFERRED") & other
    return rows.where(~F.coalesce(phantom, F.lit(False))).withColumn("source_file", filled).drop("_sf", "_tf")


def simple(graph: Graph) -> Graph:
    """At most one edge per pair, as an ordered fold over (source, target, relation).

    Undirected: an edge replaces the pair's current one unless that has the same relation and the
    opposite direction; columns source and target keep the true direction, u and v are the pair.
    Directed: the last edge of each direction. First each (source, target, relation) is reduced to
    its last row, which the fold would leave as well; what is folded per pair is then no longer
    than twice the number of relations."""
    cols = [c for c in graph.edges.columns if c not in ("source", "target", "relation")]
    order = F.when(F.col("source") == F.col("target"), -F.col("seq")).otherwise(F.col("seq"))  # a loop is its own reverse: the first stays
    last = graph.edges.groupBy("source", "target", "relation").agg(F.max_by(F.struct(*cols), order).alias("x"))
    if graph.directed:
        one = last.groupBy("source", "target").agg(F.max_by(F.struct("relation", "x.*"), "relation").alias("y"))
        return graph.with_(edges=one.select("source", "target", "y.*").withColumns({"u": F.col("source"), "v": F.col("target")}))
    pair = [F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")]
    rows = last.groupBy(*pair).agg(F.sort_array(F.collect_list(F.struct("source", "target", "relation", "x"))).alias("rows"))

    def step(now: Column, new: Column) -> Column:
        back = (now["relation"] == new["relation"]) & (now["source"] == new["target"]) & (now["target"] == new["source"]) & (new["source"] != new["target"])
        return F.when(back, now).otherwise(new)

    folded = F.reduce(F.slice("rows", 2, F.size("rows")), F.element_at("rows", 1), step)
    return graph.with_(edges=rows.select("u", "v", folded.alias("y")).select("u", "v", "y.source", "y.target", "y.relation", "y.x.*"))


def degrees(graph: Graph) -> DataFrame:
    """(id, degree) of every node of a simple graph; a self-loop counts 2, isolates 0."""
    ends = graph.edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return graph.nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


class ShrinkError(ValueError):
    """A merge would leave fewer nodes than there were, without deduplication as the reason."""


def build(parts: list[tuple[DataFrame, DataFrame]], directed: bool = False, dedup: bool = True, resolver=None, keep=lambda df, name: df) -> Graph:
    """Several extractions (nodes, edges) as one simple graph: joined in their order, ids in normal
    form, the last delivery of a node counting; with ``dedup`` near-identical entities of a repo
    merged (``dedup.resolve``); then attached and folded. ``keep(df, name)`` may store a stage."""
    from nodeloom.operators.dedup import resolve

    late = lambda i: (F.lit(i).cast("long") * 2**40 + F.col("seq")).alias("seq")
    nodes = reduce(DataFrame.unionByName, [n.select(late(i), normalize_id("id").alias("id"), *NODE_COLS) for i, (n, _) in enumerate(parts)])
    edges = reduce(DataFrame.unionByName, [e.select(late(i), normalize_id("source").alias("source"), normalize_id("target").alias("target"), normalize_id("relation").alias("relation"), *EDGE_COLS) for i, (_, e) in enumerate(parts)])
    nodes = keep(dedupe_nodes(nodes.where("id <> ''").withColumn("file_type", coerce_file_type(F.col("file_type")))), "nodes")
    edges = edges.where("source <> '' AND target <> ''")
    if dedup:
        nodes, edges, _ = resolve(nodes, edges, resolver)
    return simple(Graph(nodes, attach(edges, nodes), directed))


def build_merge(old: Graph, parts: list[tuple[DataFrame, DataFrame]], pruned: DataFrame | None = None, dedup: bool = True, resolver=None, keep=lambda df, name: df) -> Graph:
    """``old`` with new extractions in place of all it had from the same source files, without the
    sources in ``pruned`` (source_file). Without ``dedup`` a result of fewer nodes than before is
    refused unless sources were pruned: it means that an extraction lost something."""
    new_nodes, new_edges = (reduce(DataFrame.unionByName, [p[i].select("seq", *(["id"] if i == 0 else ["source", "target", "relation"]), *(NODE_COLS if i == 0 else EDGE_COLS)) for p in parts]) for i in (0, 1))
    nodes = merge_by_source(old.nodes.select(new_nodes.columns), new_nodes, pruned)
    edges = merge_by_source(old.edges.select(new_edges.columns), new_edges, pruned)
    out = build([(nodes, edges)], old.directed, dedup, resolver, keep)
    if not dedup and pruned is None:
        before, after = old.nodes.count(), out.nodes.count()
        if after < before:
            raise ShrinkError(f"{after} nodes would replace {before}")
    return out


# merging graphs


def merge_by_source(old: DataFrame, new: DataFrame, pruned: DataFrame | None = None) -> DataFrame:
    """Rows of ``new`` replace all of ``old`` from the same source_file; sources in ``pruned`` go."""
    gone = new.select("source_file").where("source_file <> ''").distinct()
    kept = old.join(gone, "source_file", "left_anti").select(old.columns)
    out = kept.unionByName(new.select(old.columns))
    return out.join(pruned.select("source_file").distinct(), "source_file", "left_anti").select(old.columns) if pruned is not None else out


def prefixed(graph: Graph) -> Graph:
    """Ids as ``repo::id`` for a graph of several repositories; ``local_id`` keeps the old one."""
    nodes = graph.nodes.withColumn("local_id", F.col("id")).withColumn("id", F.concat(F.col("repo"), F.lit("::"), F.col("id")))
    repo = graph.nodes.select(F.col("id").alias("_id"), F.col("repo").alias("_repo"))
    edges = graph.edges
    for end in ("source", "target"):
        edges = edges.join(repo, F.col(end) == F.col("_id")).withColumn(end, F.concat(F.col("_repo"), F.lit("::"), F.col(end))).drop("_id", "_repo")
    return graph.with_(nodes=nodes, edges=edges)


def prune_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both endpoints among the nodes."""
    ids = nodes.select("id").distinct()
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return edges


def without_repo(graph: Graph, repo: str) -> Graph:
    nodes = graph.nodes.where(~F.col("repo").eqNullSafe(F.lit(repo)))
    return graph.with_(nodes=nodes, edges=prune_dangling(nodes, graph.edges))


def merge_external(base: Graph, new: Graph) -> Graph:
    """Add a prefixed graph to a global one: new nodes without a source_file whose label the base
    already has (among its nodes without one) are merged into those; loops that arise go."""
    external = "coalesce(source_file, '') = ''"
    there = base.nodes.where(external).where("label IS NOT NULL").groupBy("label").agg(F.min_by("id", "seq").alias("new"))
    remap = new.nodes.where(external).join(there, "label").select(F.col("id").alias("old"), "new")
    nodes = new.nodes.join(remap.select(F.col("old").alias("id")), "id", "left_anti").select(new.nodes.columns)
    return base.with_(nodes=base.nodes.unionByName(nodes.select(base.nodes.columns)), edges=base.edges.unionByName(remap_edges(new.edges, remap).select(base.edges.columns)))


def first_wins(parts: list[DataFrame], key: str = "id") -> DataFrame:
    """Union in order of priority; of each key the first row, by part, then seq."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("_p", F.lit(i)) for i, p in enumerate(parts)])
    cols = [c for c in parts[0].columns if c != key]
    return rows.where(F.col(key) != "").groupBy(key).agg(F.min_by(F.struct(*cols), F.struct("_p", "seq")).alias("x")).select(key, "x.*")


# hyperedges and semantic clean-up


def attach_hyperedges(hyper: DataFrame) -> DataFrame:
    """The first hyperedge of each id; those without an id go."""
    return first_wins([hyper])


def filter_hyperedges(hyper: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """(id, nodes): members that are nodes, in their order; fewer than ``least`` and it goes."""
    each = hyper.select("id", F.posexplode("nodes").alias("pos", "node"))
    kept = each.join(nodes.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    kept = kept.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("m"))
    return kept.where(F.size("m") >= least).select("id", F.col("m.node").alias("nodes"))


def sentence_like(label: Column, min_chars: int = 80, min_words: int = 12) -> Column:
    """Prose rather than a name: long in characters or words, and with a sentence mark or colon."""
    t = F.trim(label)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return F.coalesce((t != "") & ((F.length(t) >= min_chars) | (words >= min_words)) & t.rlike(r"[.!?:]"), F.lit(False))


def sanitize_semantic(nodes: DataFrame, edges: DataFrame, **limits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, rationale): without rationale and concept nodes and without prose nodes that
    source a rationale_for edge; ``rationale`` (id, texts) is the text these gave to their targets."""
    why = edges.where("relation = 'rationale_for'")
    sources = why.select(F.col("source").alias("id")).distinct().withColumn("_r", F.lit(True))
    prose, typed = sentence_like(F.col("label"), **limits), F.col("file_type").isin("rationale", "concept")
    marked = nodes.where("id <> ''").join(sources, "id", "left").withColumn("_gone", F.coalesce(typed, F.lit(False)) | (F.coalesce("_r", F.lit(False)) & prose))
    kept, gone = marked.where("NOT _gone").select(nodes.columns), marked.where("_gone")
    texts = gone.where(prose).select(F.col("id").alias("source"), F.trim("label").alias("text"), F.col("seq").alias("n"))
    texts = why.select("source", "target", "seq").join(texts, "source").join(kept.select(F.col("id").alias("target")), "target", "left_semi")
    rationale = texts.groupBy(F.col("target").alias("id")).agg(F.sort_array(F.collect_list(F.struct("n", "seq", "text"))).alias("m")).select("id", F.col("m.text").alias("texts"))
    ids = gone.select("id").distinct()
    out = edges
    for end in ("source", "target"):
        out = out.join(ids.withColumnRenamed("id", end), end, "left_anti")
    return kept, out.select(edges.columns), rationale


# Limits of one extraction that a model returned.
FRAGMENT_BYTES, FRAGMENT_NODES, FRAGMENT_EDGES, FRAGMENT_HYPEREDGES, HYPEREDGE_NODES, ID_LENGTH = 25 << 20, 10_000, 100_000, 10_000, 256, 256
FRAGMENT_ID = r"^[A-Za-z0-9._:-]+$"


def fragment_errors(fragments: DataFrame, key: str = "fragment_id", payload: str = "payload") -> DataFrame:
    """(key, error): what is wrong with extractions (JSON objects of nodes, edges, hyperedges) that
    are not trusted: too large, not lists of objects, ids or file types that are not allowed. A
    fragment without a row is valid."""
    kinds = "nodes array<struct<id:string,file_type:string>>, edges array<struct<source:string,target:string>>, hyperedges array<struct<id:string,nodes:array<string>>>"
    is_object = F.ltrim(F.coalesce(F.col(payload), F.lit(""))).startswith("{") & F.try_parse_json(F.col(payload)).isNotNull()
    rows = fragments.select(key, F.octet_length(payload).alias("n"), is_object.alias("ok"), F.from_json(payload, kinds).alias("d"), F.from_json(payload, "nodes string, edges string, hyperedges string").alias("raw"))
    none = F.array().cast("array<string>")
    listed = lambda c: F.when(F.col(f"raw.{c}").isNotNull() & ~F.col(f"raw.{c}").startswith("["), F.array(F.lit(f"{c} must be a list"))).otherwise(none)
    many = lambda c, most: F.when(F.size(f"d.{c}") > most, F.array(F.concat(F.lit(f"{c} has "), F.size(f"d.{c}"), F.lit(f" entries; max is {most}")))).otherwise(none)

    def bad_id(c: Column, where: Column) -> Column:
        wrong = F.coalesce(c, F.lit("")).rlike(FRAGMENT_ID) & (F.length(c) <= ID_LENGTH)
        return F.when(~F.coalesce(wrong, F.lit(False)), F.concat(where, F.lit(" is not a valid id")))

    def each(c: str, check) -> Column:
        found = F.flatten(F.transform(F.coalesce(f"d.{c}", F.array().cast(rows.schema["d"].dataType[c].dataType)), lambda x, i: F.when(x.isNull(), F.array(F.concat(F.lit(f"{c}["), i, F.lit("] must be an object")))).otherwise(F.array(*check(x, F.concat(F.lit(f"{c}["), i, F.lit("]")))))))
        return F.filter(found, lambda e: e.isNotNull())

    kind = lambda x, at: F.when(x["file_type"].isNotNull() & ~x["file_type"].isin(*FILE_TYPES), F.concat(at, F.lit(".file_type is not one of "), F.lit(", ".join(sorted(FILE_TYPES)))))
    members = lambda x, at: F.when(F.size(x["nodes"]) > HYPEREDGE_NODES, F.concat(at, F.lit(".nodes has "), F.size(x["nodes"]), F.lit(f" entries; max is {HYPEREDGE_NODES}"))).when(x["nodes"].isNull(), F.concat(at, F.lit(".nodes must be a list")))
    errors = F.concat(
        F.when(F.col("n") > FRAGMENT_BYTES, F.array(F.concat(F.lit("payload is "), "n", F.lit(f" bytes; max is {FRAGMENT_BYTES}")))).otherwise(none),
        *[x for c, most in (("nodes", FRAGMENT_NODES), ("edges", FRAGMENT_EDGES), ("hyperedges", FRAGMENT_HYPEREDGES)) for x in (listed(c), many(c, most))],
        each("nodes", lambda x, at: [bad_id(x["id"], F.concat(at, F.lit(".id"))), kind(x, at)]),
        each("edges", lambda x, at: [bad_id(x["source"], F.concat(at, F.lit(".source"))), bad_id(x["target"], F.concat(at, F.lit(".target")))]),
        each("hyperedges", lambda x, at: [bad_id(x["id"], F.concat(at, F.lit(".id"))), members(x, at), F.when(F.exists(x["nodes"], lambda m: ~F.coalesce(m.rlike(FRAGMENT_ID), F.lit(False))), F.concat(at, F.lit(".nodes holds an id that is not valid")))]),
    )
    return rows.select(key, F.explode(F.when(F.col("ok"), errors).otherwise(F.array(F.lit("fragment must be a JSON object")))).alias("error"))


def sanitize_label(c: Column, most: int = 256) -> Column:
    return F.substring(F.regexp_replace(c, r"[\x00-\x1f\x7f]", ""), 1, most)


def default_score(confidence: Column, score: Column) -> Column:
    return F.coalesce(score, mapped(DEFAULT_SCORES, confidence), F.lit(1.0))


def compose(graphs: list[Graph]) -> tuple[DataFrame, DataFrame]:
    """Attribute maps of several graphs (nodes with ``attrs``), later ones winning per attribute."""
    rows = reduce(DataFrame.unionByName, [g.nodes.withColumn("_p", F.lit(i)) for i, g in enumerate(graphs)])
    entries = upsert_attrs(rows.withColumn("_o", F.struct("_p", "seq")), seq="_o")
    return as_map(entries), dedupe_edges(reduce(DataFrame.unionByName, [g.edges for g in graphs]))


def diagnose(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: what would collapse if the raw edges became a simple graph."""
    ids = nodes.where("id IS NOT NULL").select("id").distinct()
    s, t = ids.select(F.col("id").alias("source"), F.lit(True).alias("_s")), ids.select(F.col("id").alias("target"), F.lit(True).alias("_t"))
    rows = edges.join(s, "source", "left").join(t, "target", "left")
    has = (F.coalesce("source", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != "")
    there = has & F.col("_s").isNotNull() & F.col("_t").isNotNull()
    counts = rows.agg(
        F.count("*").alias("raw_edges"), F.count_if(~has).alias("missing_endpoint"), F.count_if(has & ~there).alias("dangling"), F.count_if(there & (F.col("source") == F.col("target"))).alias("self_loops"), F.count_if(there).alias("valid")
    )
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    valid = rows.where(there).select("source", "target", text("relation").alias("relation"), text("source_file").alias("source_file"), text("context").alias("context"))
    # distinct values first: a hot pair shrinks to its variants before it is grouped
    triples = valid.groupBy("source", "target", "relation").agg(F.count("*").alias("n"), F.count_distinct("source_file").alias("files"), F.count_distinct("context").alias("contexts"))
    pairs = triples.groupBy("source", "target").agg(F.sum("n").alias("n"), F.count("*").alias("relations"), F.count_if(F.col("files") > 1).alias("files"), F.count_if(F.col("contexts") > 1).alias("contexts"))
    directed = pairs.agg(
        F.count("*").alias("directed_pairs"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("directed_collapsed"), F.count_if(F.col("n") > 1).alias("same_endpoint_groups"), F.count_if(F.col("relations") > 1).alias("relation_variants"), F.coalesce(F.sum("files"), F.lit(0)).alias("source_file_variants"), F.coalesce(F.sum("contexts"), F.lit(0)).alias("context_variants")
    )
    both = pairs.groupBy(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).agg(F.sum("n").alias("n"))
    undirected = both.agg(F.count("*").alias("undirected_pairs"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("undirected_collapsed"))
    return counts.join(directed).join(undirected)  # one row each


def exact_signature(row: list[str]) -> Column:
    """Canonical JSON of the given columns: keys in order, nulls left out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(row)]))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
