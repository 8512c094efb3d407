"""Queries over graph analysis, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from nodeloom.operators import analyze, centrality, community
from nodeloom.operators.build import degrees
from nodeloom.plans.view import analysis_family, graph, simple, sql
from nodeloom.schema import STRUCTURAL_RELATIONS
from nodeloom.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_BASE = "regexp_extract(coalesce(source_file, ''), '[^/]*$', 0)"
_X = f"""x AS (SELECT n.*, degree,
  coalesce(label, '') <> '' AND ((coalesce(source_file, '') <> '' AND label = {_BASE}) OR (starts_with(label, '.') AND ends_with(label, '()')) OR (ends_with(label, '()') AND degree <= 1)) AS file_node,
  coalesce(source_file, '') = '' OR NOT contains({_BASE}, '.') AS concept_node,
  coalesce(ends_with(lower(source_file), '.json') AND lower(trim(label)) IN ({_in(analyze.JSON_KEYS)}), false) AS json_key FROM n JOIN deg ON deg.id = n.id)"""
_ENDS = f"{_X}, y AS (SELECT g.*, a.source_file AS uf, b.source_file AS vf, a.community AS uc, b.community AS vc, a.degree AS ud, b.degree AS vd, a.file_node OR b.file_node AS fn, a.concept_node OR b.concept_node AS cn FROM g JOIN x a ON a.id = g.u JOIN x b ON b.id = g.v)"
_STRUCT = f"relation NOT IN ({_in(STRUCTURAL_RELATIONS)})"


@query("g00_degree", sql("SELECT id, degree FROM deg", "deg"))
def _(s, d):
    return degrees(simple(s, d))


@query("g01_god_nodes", sql(f"{_X} SELECT id, label, degree FROM x WHERE NOT file_node AND NOT concept_node AND NOT json_key AND coalesce(label, '') NOT IN ({_in(analyze.BUILTIN_LABELS)}) ORDER BY degree DESC, seq LIMIT 10", "deg"))
def _(s, d):
    return analyze.god_nodes(simple(s, d))


@query("g02_node_flags", sql(f"{_X} SELECT id, file_node, concept_node, json_key FROM x", "deg"))
def _(s, d):
    return analyze.described(simple(s, d)).select("id", "file_node", "concept_node", "json_key")


def _cat(c: str) -> str:
    e = f"CASE WHEN contains({c}, '.') THEN '.' || lower(regexp_extract({c}, '[^.]*$', 0)) ELSE '' END"
    return f"CASE WHEN {e} IN ({_in(analyze.CODE_SUFFIXES)}) THEN 'code' WHEN {e} = '.pdf' THEN 'paper' WHEN {e} IN ({_in(analyze.IMAGE_SUFFIXES)}) THEN 'image' ELSE 'doc' END"


@query("g06_categories", sql(f"SELECT id, {_cat('source_file')} AS category, split_part(source_file, '/', 1) AS top FROM n", "n"))
def _(s, d):
    return graph(s, d).nodes.select("id", analyze.category(F.col("source_file")).alias("category"), analyze.top_directory(F.col("source_file")).alias("top"))


_FAM = {c: analysis_family(f"lower(regexp_extract(coalesce({c}, ''), '[^/](\\.[^./]+)$', 1))") for c in ("uf", "vf")}
_SURPRISE = f"""{_ENDS}, z AS (SELECT *, {_cat("uf")} AS cu, {_cat("vf")} AS cv, coalesce(confidence, 'EXTRACTED') AS cf, ({_FAM["uf"]}) AS fu, ({_FAM["vf"]}) AS fv FROM y WHERE {_STRUCT} AND NOT fn AND NOT cn AND uf <> vf),
q AS (SELECT *, coalesce(cf = 'INFERRED' AND relation IN ('calls', 'uses') AND (coalesce(fu <> fv, false) OR (cu = 'code' AND cv = 'doc') OR (cu = 'doc' AND cv = 'code')), false) AS quiet FROM z),
p AS (SELECT *, CASE WHEN quiet THEN 0 WHEN cf = 'AMBIGUOUS' THEN 3 WHEN cf = 'INFERRED' THEN 2 ELSE 1 END
  + CASE WHEN quiet THEN 0 ELSE CASE WHEN cu <> cv THEN 2 ELSE 0 END + CASE WHEN split_part(uf, '/', 1) <> split_part(vf, '/', 1) THEN 2 ELSE 0 END + CASE WHEN uc <> vc THEN 1 ELSE 0 END END AS base FROM q),
sc AS (SELECT *, ((CASE WHEN relation = 'semantically_similar_to' THEN floor(base * 1.5) ELSE base END) + CASE WHEN least(ud, vd) <= 2 AND greatest(ud, vd) >= 5 THEN 1 ELSE 0 END)::INT AS score FROM p)"""


@query("g07_surprise_scores", sql(f"{_SURPRISE} SELECT seq, source, target, relation, confidence, score FROM sc", "deg"))
def _(s, d):
    return analyze.cross_file_surprises(simple(s, d), None)


@query("g08_cross_file_surprises", sql(f"{_SURPRISE} SELECT seq, source, target, relation, confidence, score FROM sc ORDER BY score DESC, seq LIMIT 5", "deg"))
def _(s, d):
    return analyze.cross_file_surprises(simple(s, d), 5)


@query(
    "g09_cross_community_surprises",
    sql(f"{_ENDS}, r AS (SELECT *, row_number() OVER (PARTITION BY least(uc, vc), greatest(uc, vc) ORDER BY CASE coalesce(confidence, 'EXTRACTED') WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 WHEN 'EXTRACTED' THEN 2 ELSE 3 END, seq) AS rn FROM y WHERE {_STRUCT} AND NOT fn AND uc <> vc) SELECT least(uc, vc) AS low, greatest(uc, vc) AS high, seq, source, target, confidence FROM r WHERE rn = 1", "deg"),
)
def _(s, d):
    return analyze.cross_community_surprises(simple(s, d))


@query("g10_surprising", sql(f"{_SURPRISE} SELECT source, target, relation, confidence FROM sc ORDER BY score DESC, seq LIMIT 5", "deg"))
def _(s, d):
    return analyze.surprising(simple(s, d))


@query("g11_questions")
def _(s, d):
    g = simple(s, d)
    return analyze.suggested_questions(g, lambda: centrality.betweenness(g)[0])


@query("g12_betweenness")
def _(s, d):
    return centrality.betweenness(simple(s, d))[0]


@query("g13_edge_betweenness")
def _(s, d):
    return centrality.betweenness(simple(s, d))[1]


_OLDNEW = "ko AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b, relation FROM e WHERE seq % 10 < 8), kn AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b, relation FROM e WHERE seq % 10 >= 2)"


@query(
    "g14_graph_diff",
    sql(f"""{_OLDNEW} SELECT 'new_node' AS change, id AS a, NULL::VARCHAR AS b, NULL::VARCHAR AS relation FROM n WHERE seq % 10 >= 2 AND NOT seq % 10 < 8 UNION ALL SELECT 'removed_node', id, NULL, NULL FROM n WHERE seq % 10 < 8 AND NOT seq % 10 >= 2
UNION ALL SELECT 'new_edge', * FROM (SELECT * FROM kn EXCEPT SELECT * FROM ko) UNION ALL SELECT 'removed_edge', * FROM (SELECT * FROM ko EXCEPT SELECT * FROM kn)""", "e"),
)
def _(s, d):
    """Two overlapping snapshots of the graph, eight tenths each."""
    g = graph(s, d)
    old = g.with_(nodes=g.nodes.where("seq % 10 < 8"), edges=g.edges.where("seq % 10 < 8"))
    return analyze.diff(old, g.with_(nodes=g.nodes.where("seq % 10 >= 2"), edges=g.edges.where("seq % 10 >= 2")))


_FILES = """fe AS (SELECT g.source_file AS a, a.source_file AS uf, b.source_file AS vf FROM g JOIN n a ON a.id = g.u JOIN n b ON b.id = g.v WHERE relation IN ('imports_from', 're_exports') AND g.source_file <> ''),
ie AS (SELECT DISTINCT a, CASE WHEN uf = a THEN vf WHEN vf = a THEN uf WHEN coalesce(vf, '') NOT IN ('', a) THEN vf ELSE uf END AS b FROM fe),
i2 AS (SELECT * FROM ie WHERE b <> '')"""


@query("g15_import_edges", sql(f"{_FILES} SELECT a, b FROM i2", "g"))
def _(s, d):
    return analyze.import_edges(simple(s, d))


@query(
    "g15_import_cycles",
    sql(
        f"""{_FILES},
p(s, l, path) AS (SELECT a, b, [a, b] FROM i2 WHERE a < b UNION ALL SELECT s, b, list_append(path, b) FROM p JOIN i2 ON i2.a = l WHERE b > s AND NOT list_contains(path, b) AND len(path) < 5)
SELECT array_to_string([a], ' > ') AS cycle, 1 AS length FROM i2 WHERE a = b UNION ALL SELECT array_to_string(path, ' > '), len(path)::INT FROM p JOIN i2 ON i2.a = l AND i2.b = s""",
        "g",
        recursive=True,
    ),
)
def _(s, d):
    return analyze.cycles(analyze.import_edges(simple(s, d))).select(F.array_join("cycle", " > ").alias("cycle"), "length")


@query("g16_clusters")
def _(s, d):
    return community.cluster(simple(s, d))


@query("g20_reindexed", sql("c AS (SELECT community AS old, count(*) AS size, min(id) AS first FROM n WHERE community IS NOT NULL GROUP BY community) SELECT old, size, (row_number() OVER (ORDER BY size DESC, first) - 1)::INT AS community FROM c", "n"))
def _(s, d):
    m = graph(s, d).nodes.where("community IS NOT NULL").select("id", F.col("community").cast("string").alias("c"))
    out = community.reindex(m).join(m, "id").groupBy(F.col("c").cast("int").alias("old"), "community").agg(F.count("*").alias("size"))
    return out.select("old", "size", "community")


@query("g21_isolates", sql("SELECT id FROM deg WHERE degree = 0", "deg"))
def _(s, d):
    return degrees(simple(s, d)).where("degree = 0").select("id")


@query("g22_cohesion", sql("s AS (SELECT community, count(*) AS members FROM n WHERE community IS NOT NULL GROUP BY 1), i AS (SELECT a.community, count(*) AS edges FROM g JOIN n a ON a.id = g.u JOIN n b ON b.id = g.v WHERE a.community = b.community GROUP BY 1) SELECT s.community, members, coalesce(edges, 0) AS edges, round(CASE WHEN members <= 1 THEN 1.0::DOUBLE ELSE coalesce(edges, 0) / (members * (members - 1) / 2) END, 9) AS cohesion FROM s LEFT JOIN i ON i.community = s.community", "g"))
def _(s, d):
    return analyze.cohesion(simple(s, d)).withColumn("cohesion", F.round("cohesion", 9))


@query("g24_overlaps", sql("SELECT community AS old_id, (seq % 7)::BIGINT AS new_id, count(*) AS overlap FROM n WHERE community IS NOT NULL GROUP BY 1, 2", "n"))
def _(s, d):
    n = graph(s, d).nodes.where("community IS NOT NULL")
    return community.overlaps(n.select("id", "community"), n.select("id", (F.col("seq") % 7).alias("community")))


@query("g24_remapped")
def _(s, d):
    n = graph(s, d).nodes.where("community IS NOT NULL")
    return community.remap_to_previous(n.select("id", "community"), n.select("id", ((F.col("community") + F.col("seq") % 2) % 50).alias("community")))


@query("g36_report", sql("SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM g) AS edges, (SELECT count(*) FROM deg WHERE degree <= 1) AS isolated, (SELECT count(*) FROM (SELECT community FROM n WHERE community IS NOT NULL GROUP BY 1 HAVING count(*) < 3)) AS thin_communities, (SELECT count(*) FROM g WHERE confidence = 'AMBIGUOUS') AS ambiguous", "deg"))
def _(s, d):
    g = simple(s, d)
    thin = g.nodes.where("community IS NOT NULL").groupBy("community").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") < 3).alias("thin_communities"))
    e = g.edges.agg(F.count("*").alias("edges"), F.count_if(F.col("confidence") == "AMBIGUOUS").alias("ambiguous"))
    return degrees(g).agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") <= 1).alias("isolated")).join(e).join(thin)


_NB = "nb AS (SELECT u AS id, v AS other, relation, confidence, seq FROM g UNION ALL SELECT v, u, relation, confidence, seq FROM g WHERE u <> v)"


@query("g37_cross_links", sql(f"{_NB} SELECT a.community, b.community AS other, count(*) AS edges FROM nb JOIN n a ON a.id = nb.id JOIN n b ON b.id = nb.other WHERE a.community <> b.community GROUP BY 1, 2", "g"))
def _(s, d):
    g = simple(s, d)
    of = g.nodes.select("id", "community")
    rows = analyze.neighbours(g).join(of, "id").join(of.select(F.col("id").alias("other"), F.col("community").alias("oc")), "other").where("community <> oc")
    return rows.groupBy("community", F.col("oc").alias("other")).agg(F.count("*").alias("edges"))


@query("g38_community_top", sql("SELECT community, id, degree, rn::INT AS rank FROM (SELECT n.community, n.id, degree, row_number() OVER (PARTITION BY n.community ORDER BY degree DESC, n.seq, n.id) AS rn FROM n JOIN deg ON deg.id = n.id WHERE n.community IS NOT NULL) WHERE rn <= 25", "deg"))
def _(s, d):
    from pyspark.sql import Window

    g = simple(s, d)
    rows = g.nodes.where("community IS NOT NULL").join(degrees(g), "id")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "seq", "id"))).where("rank <= 25").select("community", "id", "degree", "rank")


@query("g38_community_confidence", sql(f"{_NB} SELECT n.community, coalesce(confidence, 'EXTRACTED') AS confidence, count(*) AS edges FROM nb JOIN n ON n.id = nb.id WHERE n.community IS NOT NULL GROUP BY 1, 2", "g"))
def _(s, d):
    return analyze.community_confidence(simple(s, d))


@query("g39_god_neighbours", sql(f"{_NB}, me AS (SELECT id FROM deg JOIN n USING (id) ORDER BY degree DESC, n.seq LIMIT 1) SELECT relation, other, rn::INT AS rank FROM (SELECT nb.relation, nb.other, row_number() OVER (PARTITION BY nb.relation ORDER BY degree DESC, n.seq, nb.other) AS rn FROM nb JOIN me ON me.id = nb.id JOIN deg ON deg.id = nb.other JOIN n ON n.id = nb.other) WHERE rn <= 20", "deg"))
def _(s, d):
    from pyspark.sql import Window

    g = simple(s, d)
    deg = degrees(g).join(g.nodes.select("id", "seq"), "id")
    me = deg.orderBy(F.desc("degree"), "seq").limit(1).select("id")
    rows = analyze.neighbours(g).select("id", "other", "relation").join(F.broadcast(me), "id", "left_semi").join(deg.withColumnRenamed("id", "other"), "other")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("relation").orderBy(F.desc("degree"), "seq", "other"))).where("rank <= 20").select("relation", "other", "rank")


@query("g40_node_reach", sql(f"{_NB} SELECT nb.id, count(DISTINCT CASE WHEN b.community IS DISTINCT FROM a.community THEN b.community END) AS reach FROM nb JOIN n a ON a.id = nb.id JOIN n b ON b.id = nb.other GROUP BY 1", "g"))
def _(s, d):
    return analyze.node_reach(simple(s, d))


@query("g41_dominant_confidence", sql(f"{_NB}, c AS (SELECT id, coalesce(confidence, 'EXTRACTED') AS confidence, count(*) AS k, min(seq) AS f FROM nb GROUP BY 1, 2) SELECT id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC, f) AS rn FROM c) WHERE rn = 1", "g"))
def _(s, d):
    return analyze.dominant_confidence(simple(s, d))


@query("g42_meta_graph", sql("SELECT least(a.community, b.community) AS low, greatest(a.community, b.community) AS high, count(*) AS edges FROM g JOIN n a ON a.id = g.u JOIN n b ON b.id = g.v WHERE a.community <> b.community GROUP BY 1, 2", "g"))
def _(s, d):
    return analyze.community_pairs(simple(s, d))


@query("g43_path_tree", sql(f"f AS (SELECT source_file, count(*) FILTER (NOT coalesce(label = {_BASE} AND file_type = 'code', false)) AS k FROM n WHERE source_file <> '' GROUP BY 1), l AS (SELECT string_split(source_file, '/') AS p, CASE WHEN k > 200 THEN 201 ELSE greatest(k, 1) END AS leaves FROM f), x AS (SELECT p, leaves, unnest(range(1, len(p) + 1)) AS depth FROM l) SELECT array_to_string(p[1:depth], '/') AS path, depth::INT AS depth, sum(leaves)::BIGINT AS leaves FROM x GROUP BY 1, 2", "n"))
def _(s, d):
    return analyze.path_tree(graph(s, d).nodes)


@query("g44_common_root", sql("x AS (SELECT string_split(min(source_file), '/') AS a, string_split(max(source_file), '/') AS b FROM n WHERE source_file <> ''), i AS (SELECT a, b, unnest(range(1, least(len(a), len(b)) + 1)) AS i FROM x), m AS (SELECT max(i) AS m FROM i WHERE a[1:i] = b[1:i]) SELECT coalesce(array_to_string(a[1:m], '/'), '') AS root FROM x, m", "n"))
def _(s, d):
    return analyze.common_root(graph(s, d).nodes)


@query(
    "g45_sections",
    sql(
        "t AS (SELECT community, ' ' || regexp_replace(lower(concat_ws(' ', label, source_file, file_type)), '[^a-z0-9]', '  ', 'g') || ' ' AS t FROM n WHERE community IS NOT NULL), c AS (SELECT community, "
        + ", ".join(f"sum(len(regexp_extract_all(t, ' ({'|'.join(w)}) ')))::BIGINT AS s{i}" for i, w in enumerate(analyze.ARCHETYPES.values()))
        + " FROM t GROUP BY 1), x AS (SELECT *, greatest("
        + ", ".join(f"s{i}" for i in range(len(analyze.ARCHETYPES)))
        + ") AS score FROM c) SELECT community, score, CASE WHEN score < 2 THEN NULL "
        + " ".join(f"WHEN s{i} = score THEN '{name}'" for i, name in enumerate(analyze.ARCHETYPES))
        + " END AS section FROM x",
        "n",
    ),
)
def _(s, d):
    return analyze.sections(graph(s, d).nodes)


_SECTION = "m AS (SELECT id, CASE WHEN community % 5 < 4 THEN 's' || (community % 5) END AS section FROM n WHERE community IS NOT NULL), k AS (SELECT g.*, a.section AS sa, b.section AS sb, CASE WHEN a.section IS NULL OR b.section IS NULL THEN 'orphan' WHEN a.section = b.section THEN 'intra' ELSE 'inter' END AS kind FROM g LEFT JOIN m a ON a.id = g.source LEFT JOIN m b ON b.id = g.target)"


def _classified(s, d):
    g = simple(s, d)
    m = g.nodes.where("community IS NOT NULL").select("id", F.when(F.col("community") % 5 < 4, F.concat(F.lit("s"), F.col("community") % 5)).alias("section"))
    return analyze.classify_edges(g.edges, m)


@query("g46_edge_kinds", sql(f"{_SECTION} SELECT seq, source, target, kind FROM k", "g"))
def _(s, d):
    return _classified(s, d).select("seq", "source", "target", "kind")


_INC = "(upper(coalesce(confidence, 'EXTRACTED')) = 'EXTRACTED' OR (upper(confidence) = 'INFERRED' AND coalesce(confidence_score, 1.0) >= 0.85))"
_VAL = "coalesce(confidence_score, 1.0) + CASE WHEN upper(confidence) = 'EXTRACTED' THEN 2.0 ELSE 0.0 END + CASE WHEN relation IN ('calls', 'uses', 'method') THEN 1.0 WHEN relation IN ('imports', 'imports_from') THEN 0.6 WHEN relation = 'contains' THEN -0.2 WHEN relation = 'rationale_for' THEN -0.6 ELSE 0.0 END"


@query("g47_includable_edges", sql(f"SELECT u, v, seq FROM g WHERE {_INC}", "g"))
def _(s, d):
    return simple(s, d).edges.where(analyze.includable(F.col("confidence"), F.col("confidence_score"))).select("u", "v", "seq")


@query("g48_edge_values", sql(f"SELECT u, v, round(({_VAL})::DOUBLE, 6) AS value FROM g", "g"))
def _(s, d):
    e = simple(s, d).edges
    return e.select("u", "v", F.round(analyze.edge_value(e), 6).alias("value"))


@query("g49_weighted_degrees", sql(f"w AS (SELECT source AS id, ({_VAL})::DOUBLE AS w FROM g UNION ALL SELECT target, ({_VAL})::DOUBLE FROM g) SELECT id, round(sum(w), 6) AS score FROM w GROUP BY id", "g"))
def _(s, d):
    return analyze.weighted_degrees(simple(s, d).edges)


@query("g50_diagram_nodes")
def _(s, d):
    return analyze.select_nodes(simple(s, d))


@query("g51_section_links", sql(f"{_SECTION} SELECT sa AS source_section, sb AS target_section, relation, count(*) AS edges FROM k WHERE kind = 'inter' AND {_INC} GROUP BY 1, 2, 3", "g"))
def _(s, d):
    rows = _classified(s, d).where("kind = 'inter'").where(analyze.includable(F.col("confidence"), F.col("confidence_score")))
    return rows.groupBy(F.col("s_section").alias("source_section"), F.col("t_section").alias("target_section"), "relation").agg(F.count("*").alias("edges"))


@query("g52_flow_chain")
def _(s, d):
    links = QUERIES["g51_section_links"](s, d).groupBy("source_section", "target_section").agg(F.sum("edges").alias("n")).collect()  # a row per pair of sections
    order = sorted({r.source_section for r in links} | {r.target_section for r in links})
    chain = analyze.flow_chain([tuple(r) for r in links], order)
    return s.createDataFrame(list(enumerate(chain)), "step int, section string")


@query(
    "g53_keywords",
    sql(f"t AS (SELECT community, unnest(regexp_split_to_array(regexp_replace(lower(concat_ws(' ', label, source_file)), '[/_-]', ' ', 'g'), '[ \\t\\n\\v\\f\\r]+')) AS raw FROM n WHERE community IS NOT NULL), w AS (SELECT community, regexp_replace(raw, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS word FROM t), c AS (SELECT community, word, count(*) AS k FROM w WHERE length(word) >= 3 AND word NOT IN ({_in(analyze.STOPWORDS)}) GROUP BY 1, 2) SELECT community, word, k AS n FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY k DESC, word) AS rn FROM c) WHERE rn <= 5", "n"),
)
def _(s, d):
    return analyze.keywords(graph(s, d).nodes)


@query("g54_nodes_by_file", sql("SELECT CASE WHEN coalesce(source_file, '') = '' THEN 'External / generated' ELSE source_file END AS file, count(*) AS nodes FROM n GROUP BY 1", "n"))
def _(s, d):
    f = F.when(F.coalesce("source_file", F.lit("")) == "", "External / generated").otherwise(F.col("source_file"))
    return graph(s, d).nodes.groupBy(f.alias("file")).agg(F.count("*").alias("nodes"))


# lessons


def _memory(s, d):
    from nodeloom.functions.text import parse_time

    rows = files.front_matter(s.read.parquet(f"{d}/documents.parquet"))
    return rows.withColumn("at", parse_time(F.col("date")))


_FM = r"""h AS (SELECT doc_id, regexp_extract(text, '(?s)\A---[ \t]*\r?\n(.*?)(?:\r?\n---[ \t]*\r?(?:\n|\z)|\z)', 1) AS h FROM documents WHERE regexp_matches(text, '\A---[ \t]*\r?\n')),
fm AS (SELECT doc_id, CASE WHEN regexp_matches(h, '(?m)^type: *"') THEN replace(replace(regexp_extract(h, '(?m)^type: *"((?:[^"\\]|\\.)*)"', 1), '\"', '"'), '\\', '\') END AS type,
 CASE WHEN regexp_matches(h, '(?m)^date: *"') THEN replace(replace(regexp_extract(h, '(?m)^date: *"((?:[^"\\]|\\.)*)"', 1), '\"', '"'), '\\', '\') END AS date,
 CASE WHEN regexp_matches(h, '(?m)^question: *"') THEN replace(replace(regexp_extract(h, '(?m)^question: *"((?:[^"\\]|\\.)*)"', 1), '\"', '"'), '\\', '\') END AS question,
 CASE WHEN regexp_matches(h, '(?m)^outcome: *"') THEN replace(replace(regexp_extract(h, '(?m)^outcome: *"((?:[^"\\]|\\.)*)"', 1), '\"', '"'), '\\', '\') END AS outcome,
 list_transform(regexp_extract_all(regexp_extract(h, '(?m)^source_nodes: *\[([^\n]*)\]', 1), '"((?:[^"\\]|\\.)*)"', 1), lambda x: replace(replace(x, '\"', '"'), '\\', '\')) AS source_nodes FROM h),
md AS (SELECT *, try_cast(replace(date, '+00:00', '') AS TIMESTAMP) AS ts FROM fm)"""


@query("s40_memory_docs", f"WITH {_FM} SELECT doc_id, type, date, question, outcome, array_to_string(source_nodes, '|') AS nodes FROM md")
def _(s, d):
    return _memory(s, d).select("doc_id", "type", "date", "question", "outcome", F.array_join("source_nodes", "|").alias("nodes"))


@query(
    "g29_lessons",
    f"""WITH {_FM}, ev AS (SELECT DISTINCT doc_id, CASE WHEN outcome = 'useful' THEN 1 WHEN outcome IN ('dead_end', 'corrected') THEN -1 ELSE 0 END AS sg, ts, unnest(source_nodes) AS node FROM md),
sc AS (SELECT node, count(*) FILTER (sg > 0) AS pos, count(*) FILTER (sg < 0) AS neg, round(sum(sg * CASE WHEN ts IS NULL THEN 1.0::DOUBLE ELSE power(0.5::DOUBLE, greatest((epoch_us(TIMESTAMP '2026-01-01') - epoch_us(ts)) / 86400e6::DOUBLE, 0) / 30.0) END), 9) AS score FROM ev WHERE sg <> 0 AND node IS NOT NULL GROUP BY node)
SELECT node, pos, neg, score, CASE WHEN neg > 0 THEN 'contested' WHEN pos >= 2 THEN 'preferred' ELSE 'tentative' END AS verdict FROM sc WHERE pos > 0""",
)
def _(s, d):
    return analyze.lessons(_memory(s, d), F.lit("2026-01-01 00:00:00").cast("timestamp")).select("node", "pos", "neg", "score", "verdict")


@query(
    "g31_doc_community",
    f"WITH {_FM}, mem AS (SELECT replace(label, '()', '') AS node, 'c' || min(community) AS community FROM graph_nodes WHERE label IS NOT NULL AND community IS NOT NULL GROUP BY 1), ev AS (SELECT DISTINCT doc_id, unnest(source_nodes) AS node FROM md), k AS (SELECT doc_id, community, count(*) AS n FROM ev JOIN mem USING (node) GROUP BY 1, 2), b AS (SELECT doc_id, community FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, community) AS rn FROM k) WHERE rn = 1) SELECT md.doc_id, coalesce(community, 'Uncategorized') AS community FROM md LEFT JOIN b ON b.doc_id = md.doc_id",
)
def _(s, d):
    n = s.read.parquet(f"{d}/graph_nodes.parquet").where("label IS NOT NULL AND community IS NOT NULL")
    m = n.groupBy(F.replace("label", F.lit("()"), F.lit("")).alias("node")).agg(F.concat(F.lit("c"), F.min("community")).alias("community"))
    return analyze.plurality(_memory(s, d), m)


@query("g32_latest_per_question", f"WITH {_FM} SELECT question, doc_id, outcome FROM (SELECT coalesce(question, '') AS question, doc_id, outcome, row_number() OVER (PARTITION BY coalesce(question, '') ORDER BY ts DESC NULLS LAST, doc_id DESC) AS rn FROM md) WHERE rn = 1")
def _(s, d):
    return analyze.latest_per_question(_memory(s, d)).select("question", "doc_id", "outcome")
