"""Graph analysis: degrees, surprise, cycles, cohesion, bridges, diffs, lessons."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.operators.build import degrees
from nodeloom.schema import ANALYSIS_FAMILIES, STRUCTURAL_RELATIONS, Graph, basename, lookup, mapped, suffix
from nodeloom.session import materialize

# Labels that are no abstractions of a project.
BUILTIN_LABELS = (
    "str int float bool bytes bytearray complex object True False MagicMock Mock AsyncMock NonCallableMock NonCallableMagicMock PropertyMock patch sentinel Path Any Optional List Dict Set Tuple Union "
    "Callable Type ClassVar Final Literal Protocol Counter defaultdict OrderedDict datetime Enum os sys re json io abc typing"
).split()
JSON_KEYS = "start end name id type properties value key data items title description version dependencies devdependencies peerdependencies optionaldependencies bundleddependencies bundledependencies".split()
CODE_SUFFIXES = (
    ".py .ts .tsx .js .jsx .mjs .ejs .ets .go .rs .java .groovy .gradle .cpp .cc .cxx .c .h .hpp .cu .cuh .rb .swift .kt .kts .cs .scala .php .lua .luau .toc .zig .ps1 .psm1 .psd1 .ex .exs .m .mm .jl .vue .svelte "
    ".astro .dart .v .sv .svh .sql .r .f .f90 .f95 .f03 .f08 .pas .pp .dpr .dpk .lpr .inc .dfm .lfm .lpk .sh .bash .json .tf .tfvars .hcl .dm .dme .dmi .dmm .dmf .sln .slnx .csproj .fsproj .vbproj .razor .cshtml .cls .trigger"
).split()
DOC_SUFFIXES = ".md .mdx .qmd .txt .rst .html .yaml .yml".split()
IMAGE_SUFFIXES = ".png .jpg .jpeg .gif .webp .svg".split()
STOPWORDS = "the and for with from this that class function method file src lib core index main init py ts tsx js jsx go rs java html css".split()


def is_file_node(label: Column, source_file: Column, degree: Column) -> Column:
    """A file's own node, a method stub ``.x()``, or a function ``x()`` of degree 1 at most."""
    label, source_file = F.coalesce(label, F.lit("")), F.coalesce(source_file, F.lit(""))
    return (label != "") & (((source_file != "") & (label == basename(source_file))) | (label.startswith(".") & label.endswith("()")) | (label.endswith("()") & (degree <= 1)))


def is_concept_node(source_file: Column) -> Column:
    """No source file, or one whose name has no dot."""
    return (F.coalesce(source_file, F.lit("")) == "") | ~basename(source_file).contains(".")


def is_json_key(label: Column, source_file: Column) -> Column:
    return F.coalesce(F.lower(source_file).endswith(".json") & F.lower(F.trim(label)).isin(*JSON_KEYS), F.lit(False))


def category(path: Column) -> Column:
    ext = F.when(path.contains("."), F.concat(F.lit("."), F.lower(F.substring_index(path, ".", -1)))).otherwise("")
    return F.when(ext.isin(*CODE_SUFFIXES), "code").when(ext == ".pdf", "paper").when(ext.isin(*IMAGE_SUFFIXES), "image").otherwise("doc")


def top_directory(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def described(graph: Graph) -> DataFrame:
    """Nodes with degree and the flags file_node, concept_node, json_key."""
    rows = graph.nodes.join(degrees(graph), "id")
    label, source = F.col("label"), F.col("source_file")
    return rows.withColumns({"file_node": is_file_node(label, source, F.col("degree")), "concept_node": is_concept_node(source), "json_key": is_json_key(label, source)})


def god_nodes(graph: Graph, n: int = 10) -> DataFrame:
    """(id, label, degree) of the most connected real entities, by (degree desc, seq)."""
    rows = described(graph).where("NOT file_node AND NOT concept_node AND NOT json_key").where(~F.coalesce(F.col("label").isin(*BUILTIN_LABELS), F.lit(False)))
    return rows.orderBy(F.desc("degree"), "seq").limit(n).select("id", "label", "degree")


def with_ends(graph: Graph, nodes: DataFrame, cols: list[str]) -> DataFrame:
    """Edges with the given columns of both ends, prefixed u_ and v_."""
    rows = graph.edges
    for end in ("u", "v"):
        rows = rows.join(nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in cols]), end)
    return rows


def surprise_score(rows: DataFrame) -> Column:
    """Score of an edge with the columns of :func:`with_ends` (source_file, community, degree)."""
    conf, relation = F.coalesce("confidence", F.lit("EXTRACTED")), F.col("relation")
    cu, cv = category(F.col("u_source_file")), category(F.col("v_source_file"))
    fu, fv = (lookup(ANALYSIS_FAMILIES, suffix(F.col(c))) for c in ("u_source_file", "v_source_file"))
    code_doc = ((cu == "code") & (cv == "doc")) | ((cu == "doc") & (cv == "code"))
    quiet = (conf == "INFERRED") & relation.isin("calls", "uses") & (F.coalesce(fu != fv, F.lit(False)) | code_doc)
    quiet = F.coalesce(quiet, F.lit(False))
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)) & ~quiet, n).otherwise(0)
    base = F.when(quiet, 0).when(conf == "AMBIGUOUS", 3).when(conf == "INFERRED", 2).otherwise(1)
    base = base + points(cu != cv, 2) + points(top_directory(F.col("u_source_file")) != top_directory(F.col("v_source_file")), 2) + points(F.col("u_community") != F.col("v_community"), 1)
    base = F.when(relation == "semantically_similar_to", F.floor(base * 1.5)).otherwise(base)
    edge = (F.least("u_degree", "v_degree") <= 2) & (F.greatest("u_degree", "v_degree") >= 5)
    return (base + F.when(edge, 1).otherwise(0)).cast("int")


def _real(rows: DataFrame, concepts: bool) -> DataFrame:
    rows = rows.where(~F.col("relation").isin(*STRUCTURAL_RELATIONS)).where("NOT u_file_node AND NOT v_file_node")
    return rows.where("NOT u_concept_node AND NOT v_concept_node") if concepts else rows


def cross_file_surprises(graph: Graph, n: int | None = 5) -> DataFrame:
    """(seq, source, target, relation, confidence, score), highest score first, then by seq."""
    rows = with_ends(graph, described(graph), ["source_file", "community", "degree", "file_node", "concept_node"])
    rows = _real(rows, True).where("u_source_file <> v_source_file")
    rows = rows.withColumn("score", surprise_score(rows)).select("seq", "source", "target", "relation", "confidence", "score")
    return rows.orderBy(F.desc("score"), "seq").limit(n) if n else rows


def confidence_rank(c: Column) -> Column:
    return F.coalesce(mapped({"AMBIGUOUS": 0, "INFERRED": 1, "EXTRACTED": 2}, F.coalesce(c, F.lit("EXTRACTED"))), F.lit(3))


def cross_community_surprises(graph: Graph) -> DataFrame:
    """(low, high, seq, source, target, confidence): the least certain edge of each pair of
    communities, then the first."""
    rows = _real(with_ends(graph, described(graph), ["community", "file_node", "concept_node"]), False).where("u_community <> v_community")
    key = [F.least("u_community", "v_community").alias("low"), F.greatest("u_community", "v_community").alias("high")]
    best = rows.groupBy(*key).agg(F.min_by(F.struct("seq", "source", "target", "confidence"), F.struct(confidence_rank(F.col("confidence")), "seq")).alias("x"))
    return best.select("low", "high", "x.*")


def structural_surprises(graph: Graph, n: int = 5, most_nodes: int = 5000) -> DataFrame:
    """(seq, source, target, relation, confidence, betweenness): the edges on most shortest paths,
    for a graph without communities. Exact up to ``most_nodes`` nodes, above from 100 pivots."""
    from nodeloom.operators import centrality

    _, held = centrality.betweenness(graph, centrality.pivots_for(graph.nodes.count(), most_nodes))
    rows = graph.edges.join(held, ["u", "v"]).where("source <> target").orderBy(F.desc("betweenness"), "seq").limit(n)
    return rows.select("seq", "source", "target", "relation", "confidence", "betweenness")


def surprising(graph: Graph, n: int = 5) -> DataFrame:
    """The highest cross-file surprises; over a single source file, or without any, one edge per
    pair of communities, or without communities the edges on most shortest paths."""
    several = graph.nodes.where("source_file <> ''").select("source_file").distinct().limit(2).count() > 1
    if several:
        rows = cross_file_surprises(graph, n)
        if not rows.isEmpty():
            return rows.select("source", "target", "relation", "confidence")
    if graph.nodes.where("community IS NOT NULL").isEmpty():
        return structural_surprises(graph, n).select("source", "target", "relation", "confidence")
    rows = cross_community_surprises(graph).orderBy(confidence_rank(F.col("confidence")), "seq").limit(n).select("seq")
    return graph.edges.join(F.broadcast(rows), "seq").select("source", "target", "relation", "confidence")  # n rows


def suggested_questions(graph: Graph, bridges: DataFrame | Callable[[], DataFrame] | None = None, n: int = 7) -> DataFrame:
    """(kind, subject, detail): what the graph could be asked, by family in order, at most ``n``.

    ``bridges`` (id, betweenness) as of :func:`nodeloom.operators.centrality.betweenness`, or what
    gives it: only called if the family before leaves a row, as its rows come after. Without any
    signal one row of kind no_signal."""
    nodes = described(graph)
    parts = [graph.edges.where("confidence = 'AMBIGUOUS'").orderBy("seq").limit(n).select(F.lit(1).alias("f"), "seq", F.lit("ambiguous_edge").alias("kind"), F.concat_ws(" -- ", "source", "target").alias("subject"), F.col("relation").alias("detail"))]
    if parts[0].count() == n:  # the families come in order: no other has a row among the first n
        return parts[0].orderBy("seq").select("kind", "subject", "detail")
    if callable(bridges):
        bridges = bridges()
    if bridges is not None:
        real = bridges.where("betweenness > 0").join(nodes.where("NOT file_node AND NOT concept_node"), "id").orderBy(F.desc("betweenness"), "seq").limit(3)
        other = node_reach(graph).where("reach > 0")
        parts.append(real.join(other, "id").select(F.lit(2).alias("f"), "seq", F.lit("bridge_node").alias("kind"), F.col("id").alias("subject"), F.format_number("betweenness", 3).alias("detail")))
    top = nodes.where("NOT file_node").orderBy(F.desc("degree"), "seq").limit(5).select("id", "seq")
    inferred = graph.edges.where("confidence = 'INFERRED'").select(F.explode(F.array_distinct(F.array("u", "v"))).alias("id")).join(F.broadcast(top), "id").groupBy("id", "seq").agg(F.count("*").alias("k")).where("k >= 2")
    parts.append(inferred.select(F.lit(3).alias("f"), "seq", F.lit("verify_inferred").alias("kind"), F.col("id").alias("subject"), F.col("k").cast("string").alias("detail")))
    lonely = nodes.where("degree <= 1 AND NOT file_node AND NOT concept_node")
    lonely = lonely.agg(F.count("*").alias("k"), F.min_by("id", "seq").alias("id")).where("k > 0")
    parts.append(lonely.select(F.lit(4).alias("f"), F.lit(0).cast("long").alias("seq"), F.lit("isolated_nodes").alias("kind"), F.col("id").alias("subject"), F.col("k").cast("string").alias("detail")))
    loose = cohesion(graph).where("cohesion < 0.15 AND members >= 5").orderBy("community").limit(n)
    parts.append(loose.select(F.lit(5).alias("f"), F.col("community").cast("long").alias("seq"), F.lit("low_cohesion").alias("kind"), F.col("community").cast("string").alias("subject"), F.format_number("cohesion", 3).alias("detail")))
    rows = reduce(DataFrame.unionByName, parts).orderBy("f", "seq").limit(n)
    if rows.isEmpty():
        return graph.edges.sparkSession.createDataFrame([("no_signal", None, None)], "kind string, subject string, detail string")
    return rows.select("kind", "subject", "detail")


# cycles


def import_edges(graph: Graph) -> DataFrame:
    """(a, b): distinct file-level imports; an edge starts at the file it is written in."""
    rows = graph.edges.where(F.col("relation").isin("imports_from", "re_exports")).where("source_file <> ''")
    for end in ("u", "v"):
        rows = rows.join(graph.nodes.select(F.col("id").alias(end), F.coalesce("source_file", F.lit("")).alias(f"{end}f")), end)
    target = F.when(F.col("uf") == F.col("source_file"), F.col("vf")).when(F.col("vf") == F.col("source_file"), F.col("uf"))
    target = F.coalesce(target, F.when((F.col("vf") != "") & (F.col("vf") != F.col("source_file")), F.col("vf")).otherwise(F.col("uf")))
    return rows.select(F.col("source_file").alias("a"), target.alias("b")).where("b <> ''").distinct()


def cycles(edges: DataFrame, longest: int = 5) -> DataFrame:
    """(cycle, length): simple cycles of up to ``longest`` files, each once, from its smallest file.

    Paths start at their smallest file and only visit larger ones, so every cycle is found once:
    a way out of half its length meets a way back of the other half at their common end, so paths
    of three imports are the longest that are enumerated. Files without an import in or out can't
    be on a cycle and are taken away first, twice."""
    core = edges.where("a <> b")
    for _ in range(2):
        core = core.join(core.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(core.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
    core = materialize(core, "core")
    step, back = core.select(F.col("a").alias("last"), F.col("b").alias("next")), core.select(F.col("b").alias("last"), F.col("a").alias("next"))
    ahead = [core.where("a < b").select(F.col("a").alias("start"), F.col("b").alias("last"), F.array("b").alias("path"))]
    home = [core.where("b < a").select(F.col("b").alias("start"), F.col("a").alias("last"), F.array("a").alias("way"))]
    for ways, name, links in ((ahead, "path", step), (home, "way", back)):
        while len(ways) < (longest + (name == "path")) // 2:
            longer = ways[-1].join(links, "last").where(f"next > start AND NOT array_contains({name}, next)")
            more = F.array_append(name, F.col("next")) if name == "path" else F.array_prepend(name, F.col("next"))
            ways.append(materialize(longer.select("start", F.col("next").alias("last"), more.alias(name)), "paths"))
    found = [edges.where("a = b").select(F.array("a").alias("cycle"))]
    for length in range(2, longest + 1):
        out, rest = (length + 1) // 2, length // 2
        meet = ahead[out - 1].join(home[rest - 1], ["start", "last"]).withColumn("rest", F.slice("way", 2, F.size("way")))
        found.append(meet.where("NOT arrays_overlap(path, rest)").select(F.concat(F.array("start"), "path", "rest").alias("cycle")))
    return reduce(DataFrame.unionByName, found).select("cycle", F.size("cycle").alias("length"))


# communities


def cohesion(graph: Graph, members: DataFrame | None = None) -> DataFrame:
    """(community, members, edges, cohesion): share of possible edges inside; 1 for up to one node."""
    members = members if members is not None else graph.nodes.where("community IS NOT NULL").select("id", "community")
    sizes = members.groupBy("community").agg(F.count("*").alias("members"))
    rows = graph.edges.join(members.select(F.col("id").alias("u"), F.col("community").alias("cu")), "u").join(members.select(F.col("id").alias("v"), F.col("community").alias("cv")), "v")
    inside = rows.where("cu = cv").groupBy(F.col("cu").alias("community")).agg(F.count("*").alias("edges"))
    out = sizes.join(inside, "community", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    possible = F.col("members") * (F.col("members") - 1) / 2
    return out.withColumn("cohesion", F.when(F.col("members") <= 1, 1.0).otherwise(F.col("edges") / possible))


def community_pairs(graph: Graph) -> DataFrame:
    """(low, high, edges): edges between each two communities."""
    rows = with_ends(graph, graph.nodes, ["community"]).where("u_community <> v_community")
    return rows.groupBy(F.least("u_community", "v_community").alias("low"), F.greatest("u_community", "v_community").alias("high")).agg(F.count("*").alias("edges"))


def neighbours(graph: Graph) -> DataFrame:
    """(id, other, relation, confidence, seq): each edge from both ends; a loop once."""
    both = F.explode(F.array_distinct(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("other")), F.struct(F.col("v").alias("id"), F.col("u").alias("other")))))
    return graph.edges.select(both.alias("x"), "relation", "confidence", "seq").select("x.id", "x.other", "relation", "confidence", "seq")


def node_reach(graph: Graph) -> DataFrame:
    """(id, reach): other communities among a node's neighbours."""
    of = graph.nodes.select("id", "community")
    rows = neighbours(graph).join(of, "id").join(of.select(F.col("id").alias("other"), F.col("community").alias("oc")), "other")
    other = F.when(~F.col("oc").eqNullSafe(F.col("community")), F.col("oc"))
    return rows.groupBy("id").agg(F.count_distinct(other).alias("reach"))


def bridges(graph: Graph, n: int = 5) -> DataFrame:
    """(id, degree, reach): the nodes that reach most other communities, then the best connected."""
    from nodeloom.operators.build import degrees

    rows = node_reach(graph).where("reach > 0").join(degrees(graph), "id").join(graph.nodes.select("id", "seq"), "id")
    return rows.orderBy(F.desc("reach"), F.desc("degree"), "seq").limit(n).select("id", "degree", "reach")


def community_hyperedges(hyper: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, communities): hyperedges (id, nodes) between the communities of their members; those
    within one community go."""
    of = nodes.where("community IS NOT NULL").select(F.col("id").alias("node"), "community")
    rows = hyper.select("id", F.explode("nodes").alias("node")).join(of, "node").groupBy("id").agg(F.sort_array(F.collect_set("community")).alias("communities"))
    return rows.where(F.size("communities") > 1)


def dominant_confidence(graph: Graph) -> DataFrame:
    """(id, confidence): the most frequent among a node's edges, of equals the one seen first."""
    rows = neighbours(graph).groupBy("id", F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence")).agg(F.count("*").alias("k"), F.min("seq").alias("first"))
    return rows.groupBy("id").agg(F.max_by("confidence", F.struct(F.col("k"), -F.col("first"))).alias("confidence"))


def community_confidence(graph: Graph) -> DataFrame:
    """(community, confidence, edges): edges seen from each member."""
    rows = neighbours(graph).join(graph.nodes.where("community IS NOT NULL").select("id", "community"), "id")
    return rows.groupBy("community", F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence")).agg(F.count("*").alias("edges"))


# sections and diagrams


def includable(confidence: Column, score: Column) -> Column:
    conf = F.upper(F.coalesce(confidence, F.lit("EXTRACTED")))
    return (conf == "EXTRACTED") | ((conf == "INFERRED") & (F.coalesce(score, F.lit(1.0)) >= 0.85))


def edge_value(edges: DataFrame) -> Column:
    """Rank of an edge for diagrams: its score, more if extracted or a call, less if structural."""
    by = {"calls": 1.0, "uses": 1.0, "method": 1.0, "imports": 0.6, "imports_from": 0.6, "contains": -0.2, "rationale_for": -0.6}
    return F.coalesce("confidence_score", F.lit(1.0)) + F.when(F.upper("confidence") == "EXTRACTED", 2.0).otherwise(0.0) + F.coalesce(mapped(by, F.col("relation")), F.lit(0.0))


def weighted_degrees(edges: DataFrame) -> DataFrame:
    """(id, score): summed value of a node's edges, a loop's twice."""
    rows = edges.select(F.explode(F.array("source", "target")).alias("id"), edge_value(edges).alias("w"))
    return rows.groupBy("id").agg(F.round(F.sum("w"), 6).alias("score"))


# Kinds of sections of an architecture page and their keywords, in order of preference.
ARCHETYPES = {
    "extract-pipeline": ["extract", "extractor", "tree", "sitter", "parser", "language", "python", "javascript", "typescript", "rust", "java", "go", "ast", "calls", "imports", "multilang"],
    "build-graph": ["build", "graph", "merge", "dedup", "node", "edge", "hyperedge", "json", "schema", "normalize", "confidence"],
    "analysis-clustering": ["cluster", "community", "leiden", "cohesion", "analyze", "god", "surprise", "question", "query", "path", "explain", "benchmark"],
    "outputs-docs": ["export", "html", "wiki", "obsidian", "canvas", "svg", "graphml", "report", "callflow", "mermaid", "tree", "documentation"],
    "cli-skills": ["main", "install", "uninstall", "skill", "agent", "claude", "codex", "opencode", "aider", "copilot", "kiro", "vscode", "hook", "command"],
    "ingest-cache-update": ["ingest", "fetch", "download", "url", "html", "markdown", "cache", "manifest", "watch", "update", "incremental", "transcribe", "video", "audio", "google"],
    "serve-api": ["serve", "api", "request", "response", "endpoint", "router", "handle", "upload", "search", "delete", "enrich"],
    "security-global": ["security", "safe", "ssrf", "xss", "path", "traversal", "global", "prefix", "prune", "repo", "clone"],
    "tests-fixtures": ["test", "tests", "fixture", "fixtures", "sample", "assert", "pytest", "mock"],
}


def sections(nodes: DataFrame, archetypes: dict[str, list[str]] = ARCHETYPES, least: int = 2) -> DataFrame:
    """(community, section, score): the archetype whose keywords occur most often as whole words in
    a community's labels and files, of equals the first; null under ``least``."""
    text = F.lower(F.concat_ws(" ", "label", "source_file", "file_type"))
    sums = [F.sum(F.size(F.regexp_extract_all(text, F.lit(f"(?<![a-z0-9])({'|'.join(words)})(?![a-z0-9])"), 0))).alias(f"s{i}") for i, words in enumerate(archetypes.values())]
    rows = nodes.where("community IS NOT NULL").groupBy("community").agg(*sums)
    each = F.array(*[F.struct(F.col(f"s{i}").alias("score"), F.lit(-i).alias("k"), F.lit(name).alias("section")) for i, name in enumerate(archetypes)])
    rows = rows.select("community", F.array_max(each).alias("x"))
    return rows.select("community", F.when(F.col("x.score") >= least, F.col("x.section")).alias("section"), F.col("x.score").alias("score"))


def classify_edges(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Adds kind: intra or inter section, orphan if an end has none; ``member`` is (id, section)."""
    rows = edges.join(member.select(F.col("id").alias("source"), F.col("section").alias("s_section")), "source", "left")
    rows = rows.join(member.select(F.col("id").alias("target"), F.col("section").alias("t_section")), "target", "left")
    orphan = F.col("s_section").isNull() | F.col("t_section").isNull()
    return rows.withColumn("kind", F.when(orphan, "orphan").when(F.col("s_section") == F.col("t_section"), "intra").otherwise("inter"))


def keywords(nodes: DataFrame, n: int = 5) -> DataFrame:
    """(community, word, n): the commonest words of labels and file names."""
    text = F.regexp_replace(F.lower(F.concat_ws(" ", "label", "source_file")), r"[/_\-]", " ")
    words = nodes.where("community IS NOT NULL").select("community", F.explode(F.split(text, r"\s+")).alias("raw"))
    words = words.select("community", F.regexp_replace("raw", r"[^\p{L}\p{N}]", "").alias("word")).where(F.length("word") >= 3).where(~F.col("word").isin(*STOPWORDS))
    counts = words.groupBy("community", "word").agg(F.count("*").alias("n"))
    return counts.withColumn("_r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "word"))).where(F.col("_r") <= n).drop("_r")


def flow_chain(pairs: list[tuple[str, str, int]], order: list[str], longest: int = 7) -> list[str]:
    """Walk through sections (few, collected): from the one least pointed at, always along the
    strongest link to a section not yet seen, else to the next in order."""
    incoming = {s: sum(n for _, t, n in pairs if t == s) for s in order}
    chain = [min(order, key=lambda s: (incoming[s], order.index(s)))] if order else []
    while chain and len(chain) < min(longest, len(order)):
        ahead = [(n, t) for a, t, n in pairs if a == chain[-1] and t not in chain and t in order]
        chain.append(max(ahead)[1] if ahead else next(s for s in order if s not in chain))
    return chain


def select_nodes(graph: Graph, n: int = 24) -> DataFrame:
    """(id, rank): nodes for a diagram: a third by calls out over in, then the ends of the most
    valuable edges, then the best connected. Each list is cut to ``n`` before they are merged."""
    usable = graph.edges.where(includable(F.col("confidence"), F.col("confidence_score"))).where(F.col("relation").isin("calls", "uses", "method", "imports", "imports_from"))
    flow = usable.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    flow = flow.groupBy("x.id").agg(F.sum("x.o").alias("o"), F.sum("x.i").alias("i")).where("o > 0").orderBy(F.desc(F.col("o") - F.col("i")), F.desc("o"), "id").limit(max(3, n // 3))
    first = flow.select("id", F.lit(0).alias("p"), (-(F.col("o") - F.col("i"))).cast("double").alias("k"), (-F.col("o")).cast("double").alias("k2"))
    best = usable.withColumn("w", edge_value(usable)).orderBy(F.desc("w"), "seq").limit(n)
    second = best.select(F.explode(F.array("source", "target")).alias("id"), F.lit(1).alias("p"), (-F.col("w")).alias("k"), F.col("seq").cast("double").alias("k2"))
    third = weighted_degrees(usable).orderBy(F.desc("score"), "id").limit(n).select("id", F.lit(2).alias("p"), (-F.col("score")).alias("k"), F.lit(0.0).alias("k2"))
    rows = first.unionByName(second).unionByName(third).groupBy("id").agg(F.min(F.struct("p", "k", "k2")).alias("x"))
    rows = rows.orderBy("x.p", "x.k", "x.k2", "id").limit(n)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("x.p", "x.k", "x.k2", "id"))).select("id", "rank")  # n rows


# trees


def path_tree(nodes: DataFrame, most: int = 200) -> DataFrame:
    """(path, depth, leaves): roll-up of symbols to every directory above their file. A file with
    more than ``most`` symbols counts ``most`` and one placeholder; its own node doesn't count, a
    file without symbols counts 1."""
    own = F.coalesce((F.col("label") == basename(F.col("source_file"))) & (F.col("file_type") == "code"), F.lit(False))
    files = nodes.where("source_file <> ''").groupBy("source_file").agg(F.count_if(~own).alias("n"))
    files = files.withColumn("leaves", F.when(F.col("n") > most, most + 1).otherwise(F.greatest("n", F.lit(1))))
    parts = F.split("source_file", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), i.alias("depth")))
    return files.select("leaves", F.explode(prefixes).alias("x")).groupBy("x.path", "x.depth").agg(F.sum("leaves").cast("long").alias("leaves"))


def common_root(nodes: DataFrame) -> DataFrame:
    """(root): the longest common directory prefix of all source files, '' if there is none."""
    paths = nodes.where("source_file <> ''")
    both = paths.agg(F.min("source_file").alias("a"), F.max("source_file").alias("b"))  # the extremes share what all share
    a, b = F.split("a", "/"), F.split("b", "/")
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), lambda i: F.array_join(F.slice(a, 1, i), "/") == F.array_join(F.slice(b, 1, i), "/"))
    return both.select(F.coalesce(F.array_join(F.slice(a, 1, F.coalesce(F.array_max(same), F.lit(0))), "/"), F.lit("")).alias("root"))


# diffs and lessons


def diff(old: Graph, new: Graph) -> DataFrame:
    """(change, a, b, relation): nodes and edges that came or went; edges of undirected graphs by
    unordered pair."""

    def nodes(x: DataFrame, y: DataFrame, what: str) -> DataFrame:
        return x.select("id").join(y.select("id"), "id", "left_anti").select(F.lit(what).alias("change"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("relation"))

    def keys(g: Graph) -> DataFrame:
        ends = (F.col("source"), F.col("target")) if g.directed else (F.least("source", "target"), F.greatest("source", "target"))
        return g.edges.select(ends[0].alias("a"), ends[1].alias("b"), F.coalesce("relation", F.lit("")).alias("relation")).distinct()

    def edges(x: DataFrame, y: DataFrame, what: str) -> DataFrame:
        return x.join(y, ["a", "b", "relation"], "left_anti").select(F.lit(what).alias("change"), "a", "b", "relation")

    ko, kn = keys(old), keys(new)
    return reduce(DataFrame.unionByName, [nodes(new.nodes, old.nodes, "new_node"), nodes(old.nodes, new.nodes, "removed_node"), edges(kn, ko, "new_edge"), edges(ko, kn, "removed_edge")])


def decay(at: Column, now: Column, half_life: float = 30.0) -> Column:
    """Weight that halves every ``half_life`` days; undated or future events have 1."""
    days = (F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400e6)
    return F.when(at.isNull() | F.lit(half_life <= 0), 1.0).otherwise(F.pow(F.lit(0.5), F.greatest(days, F.lit(0.0)) / half_life))


def lessons(docs: DataFrame, now: Column, half_life: float = 30.0, corroboration: int = 2) -> DataFrame:
    """(node, pos, neg, score, last, verdict): what answers taught about their source nodes.

    ``docs``: outcome, at, source_nodes. A node counts once per document. Positive only: preferred
    from ``corroboration`` documents on, else tentative; with both signs contested; negative only
    nodes are left out."""
    sign = F.when(F.col("outcome") == "useful", 1).when(F.col("outcome").isin("dead_end", "corrected"), -1).otherwise(0)
    rows = docs.select(sign.alias("sign"), "at", F.explode(F.array_distinct("source_nodes")).alias("node")).where("sign <> 0 AND node IS NOT NULL")
    score = F.round(F.sum(F.col("sign") * decay(F.col("at"), now, half_life)), 9)
    out = rows.groupBy("node").agg(F.count_if(F.col("sign") > 0).alias("pos"), F.count_if(F.col("sign") < 0).alias("neg"), score.alias("score"), F.max("at").alias("last"))
    verdict = F.when(F.col("neg") > 0, "contested").when(F.col("pos") >= corroboration, "preferred").otherwise("tentative")
    return out.where("pos > 0").withColumn("verdict", verdict)


def plurality(docs: DataFrame, membership: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, community): the commonest community among a document's source nodes, of equals the
    smallest; 'Uncategorized' without any. ``membership`` is (node, community)."""
    each = docs.select(key, F.explode(F.array_distinct("source_nodes")).alias("node")).join(membership, "node").groupBy(key, "community").agg(F.count("*").alias("n"))
    best = each.groupBy(key).agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("community"))
    return docs.select(key).join(best, key, "left").select(key, F.coalesce("community", F.lit("Uncategorized")).alias("community"))


def latest_per_question(docs: DataFrame) -> DataFrame:
    """The last document (by at, doc_id) of each question."""
    cols = [c for c in docs.columns if c != "question"]
    return docs.groupBy(F.coalesce("question", F.lit("")).alias("question")).agg(F.max_by(F.struct(*cols), F.struct("at", "doc_id")).alias("x")).select("question", "x.*")
