"""Queries over search and traversal, with their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from nodeloom.functions.text import callable_key, query_terms, word_count
from nodeloom.operators import search, traverse
from nodeloom.operators.build import degrees
from nodeloom.plans.view import graph, simple, sql
from nodeloom.schema import IMPACT_RELATIONS
from nodeloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
QUESTION = "Which calls reach the registry hub lookup decoder?"
TERMS = query_terms(QUESTION)


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "".join(chr(c) for c in (0x3000, 0xA0, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x202F, 0x212A))
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F)) + " " * 12 + "K"
_WIDE += "\u2011" + "".join(chr(c) for c in range(0xFF66, 0xFFA0))
_PLAIN += "\u2010" + "".join(unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF66, 0xFF9E))  # the voicing marks have no counterpart and go


def form(c: str) -> str:
    """SQL of functions.text.search_form."""
    x = f"translate(coalesce({c}, ''), '{_WIDE}', '{_PLAIN.replace(chr(39), chr(39) * 2)}')"
    for lig, plain in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ϲ", "ς"), ("Ϲ", "Σ")):
        x = f"replace({x}, '{lig}', '{plain}')"
    return f"lower(strip_accents({x}))"


_S = f"""s AS (SELECT *, rtrim(norm_label, '()') AS bare_label, array_to_string(regexp_extract_all(norm_label, '[\\p{{L}}\\p{{N}}_]+'), ' ') AS label_tokens,
  lower(id) AS id_lower, lower(coalesce(source_file, '')) AS source_lower FROM (SELECT *, {form("label")} AS norm_label FROM n))"""
_IDF = "t AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in TERMS) + "]) AS term), iw AS (SELECT term, (SELECT count(*) FROM s WHERE contains(norm_label, term)) AS df, ln(1 + (SELECT count(*) FROM n) / (1 + (SELECT count(*) FROM s WHERE contains(norm_label, term)))) AS idf FROM t)"
_J = " ".join(TERMS)
_SCORE = f"""{_S}, {_IDF}, j AS (SELECT max(idf) AS top FROM iw),
p AS (SELECT s.id, sum(idf * (CASE WHEN norm_label = term OR bare_label = term THEN 1000.0::DOUBLE WHEN starts_with(norm_label, term) OR starts_with(bare_label, term) THEN 100.0 WHEN contains(norm_label, term) THEN 1.0 ELSE 0.0 END
  + CASE WHEN contains(source_lower, term) THEN 0.5 ELSE 0.0 END)) AS part FROM s, iw GROUP BY s.id),
sc AS (SELECT s.id, s.seq, s.label, round(p.part + CASE WHEN '{_J}' IN (norm_label, bare_label, label_tokens, id_lower) THEN 10000.0 * top WHEN starts_with(norm_label, '{_J}') OR starts_with(bare_label, '{_J}') OR starts_with(label_tokens, '{_J}') THEN 1000.0 * top ELSE 0.0 END, 6) AS score,
  length(CASE WHEN coalesce(s.label, '') <> '' THEN s.label ELSE s.id END) AS label_length FROM s JOIN p ON p.id = s.id, j)"""
_SEEDS = "b AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, label_length, id) - 1 AS rank FROM sc WHERE score > 0), seeds AS (SELECT id, score, rank FROM b WHERE rank < 3 AND score >= 0.2 * (SELECT max(score) FROM b))"


def _nodes(s, d):
    return search.searchable(graph(s, d).nodes)


@query("q02_search_tokens", sql(_S + " SELECT id, norm_label, bare_label, label_tokens FROM s", "n"))
def _(s, d):
    return _nodes(s, d).select("id", "norm_label", "bare_label", "label_tokens")


@query("q03_idf", sql(f"{_S}, {_IDF} SELECT term, df, round(idf, 9) AS idf FROM iw", "n"))
def _(s, d):
    return search.frequencies(_nodes(s, d), TERMS).withColumn("idf", F.round("idf", 9))


_GRAMS = f"{_S}, x AS (SELECT id, norm_label || chr(1) || label_tokens || chr(1) || id_lower || chr(1) || source_lower AS t FROM s), gr AS (SELECT DISTINCT id, substr(t, i, 3) AS gram FROM (SELECT id, t, unnest(range(1, length(t) - 1)) AS i FROM x))"


@query("q05_trigram_postings", sql(_GRAMS + " SELECT gram, count(*) AS df FROM gr WHERE NOT contains(gram, chr(1)) GROUP BY gram", "n"))
def _(s, d):
    index = search.gram_index(_nodes(s, d)).where(~F.col("gram").contains("\u0000"))
    return index.groupBy("gram").agg(F.count("*").alias("df"))


_NEEDLES = {"registry": ["reg", "egi", "gis", "ist", "str", "try"], "glac": ["gla", "lac"]}
_RAREST = " UNION ALL ".join(f"SELECT min(k) AS k FROM (SELECT count(*) AS k FROM gr WHERE gram IN ({', '.join(repr(g) for g in gs)}) GROUP BY gram)" for gs in _NEEDLES.values())
_HITS = " UNION ".join(f"SELECT id FROM gr WHERE gram IN ({', '.join(repr(g) for g in gs)}) GROUP BY id HAVING count(*) = {len(gs)}" for gs in _NEEDLES.values())


@query("q06_trigram_candidates", sql(f"{_GRAMS}, often AS (SELECT coalesce(bool_or(k > floor((SELECT count(*) FROM n) * 0.1)), false) AS x FROM ({_RAREST})), hit AS ({_HITS}) SELECT id FROM hit, often WHERE NOT x UNION ALL SELECT id FROM n, often WHERE x", "n"))
def _(s, d):
    n = _nodes(s, d)
    got = search.gram_candidates(search.gram_index(n), n.count(), list(_NEEDLES))
    return got if got is not None else n.select("id")


@query("q06_common_needle", sql("SELECT id FROM n", "n"))
def _(s, d):
    """A needle whose rarest trigram is in too many nodes: the index is passed over."""
    n = _nodes(s, d)
    got = search.gram_candidates(search.gram_index(n), n.count(), [".py"])
    return got if got is not None else n.select("id")


@query("q07_scores", sql(_SCORE + " SELECT id, score, label_length FROM sc WHERE score > 0", "n"))
def _(s, d):
    return search.scores(_nodes(s, d), TERMS).select("id", "score", F.col("label_length").cast("long").alias("label_length"))


@query("q08_seeds", sql(f"{_SCORE}, {_SEEDS} SELECT id, score, rank::INT AS rank FROM seeds", "n"))
def _(s, d):
    return search.pick_seeds(search.scores(_nodes(s, d), TERMS))


@query(
    "q09_find_node",
    sql(
        f"""{_S} SELECT id, seq, CASE WHEN 'decode' IN (norm_label, bare_label, label_tokens, id_lower) THEN 1 WHEN starts_with(norm_label, 'decode') OR starts_with(bare_label, 'decode') OR starts_with(label_tokens, 'decode') OR starts_with(id_lower, 'decode') THEN 2 ELSE 3 END AS tier
FROM s WHERE contains(norm_label, 'decode') OR contains(label_tokens, 'decode') OR id_lower = 'decode' OR starts_with(id_lower, 'decode')""",
        "n",
    ),
)
def _(s, d):
    return search.find_nodes(_nodes(s, d), "Decode")


@query("q12_context_filter", sql("SELECT u, v, context FROM g WHERE context IN ('call', 'parameter_type')", "g"))
def _(s, d):
    return search.filter_context(simple(s, d).edges, search.normalize_filters(["calls", "args"])).select("u", "v", "context")


_ADJ = "adj AS (SELECT u AS a, v AS b FROM g UNION SELECT v, u FROM g)"
_HUB = "hub AS (SELECT greatest(50, (SELECT degree FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS k, count(*) OVER () AS c FROM deg) WHERE k = floor(c * 0.99)::BIGINT)) AS t)"
_FIRST = "seed AS (SELECT id FROM n ORDER BY seq, id LIMIT 3)"


def _first(g):
    return g.nodes.orderBy("seq", "id").limit(3).select("id")


def _walk(adj: str, depth: int, hub: bool = True) -> str:
    stop = " AND (w.depth = 0 OR (SELECT degree FROM deg WHERE deg.id = w.id) < (SELECT t FROM hub))" if hub else ""
    return f"w(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT {adj}.b, w.depth + 1 FROM w JOIN {adj} ON {adj}.a = w.id WHERE w.depth < {depth}{stop})"


@query("q13_bfs", sql(f"{_ADJ}, {_HUB}, {_FIRST}, {_walk('adj', 2)} SELECT id, min(depth)::INT AS depth FROM w GROUP BY id", "deg", recursive=True))
def _(s, d):
    g = simple(s, d)
    return traverse.bfs(g, _first(g), 2)[0]


@query("q13_bfs_directed", sql(f"dadj AS (SELECT DISTINCT source AS a, target AS b FROM dg), ends2 AS (SELECT source AS id FROM dg UNION ALL SELECT target FROM dg), deg2 AS (SELECT n.id, coalesce(k, 0) AS degree FROM n LEFT JOIN (SELECT id, count(*) AS k FROM ends2 GROUP BY id) c ON c.id = n.id), hub AS (SELECT greatest(50, (SELECT degree FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS k, count(*) OVER () AS c FROM deg2) WHERE k = floor(c * 0.99)::BIGINT)) AS t), {_FIRST}, {_walk('dadj', 3).replace('FROM deg WHERE deg.id', 'FROM deg2 WHERE deg2.id')} SELECT id, min(depth)::INT AS depth FROM w GROUP BY id", "dg", recursive=True))
def _(s, d):
    g = simple(s, d, True)
    return traverse.bfs(g, _first(g), 3)[0]


@query("q14_hub_threshold", sql(f"{_HUB} SELECT t AS threshold FROM hub", "deg"))
def _(s, d):
    return traverse.hub_threshold(degrees(simple(s, d)))


@query("q15_dfs")
def _(s, d):
    g = simple(s, d)
    seeds = [r.id for r in g.nodes.orderBy("seq", "id").limit(5).collect()][1:3]
    return traverse.dfs(g, seeds, 2)


def _clean(c: str) -> str:
    return f"coalesce(substr(regexp_replace({c}::VARCHAR, '[\\x00-\\x1f\\x7f]', '', 'g'), 1, 256), '')"


_NAME = _clean("coalesce(n.label, n.id)")


def _answer(g: str, deg: str, depth: int, hub: str, tokens: int) -> str:
    """Lines of an answer from ``w`` (id, depth), edges ``g`` and degrees ``deg``; seeds: seed (id, k1)."""
    return f"""far AS (SELECT id, min(depth) AS depth FROM w GROUP BY id),
lines AS (SELECT CASE WHEN s.id IS NULL THEN 1 ELSE 0 END AS k0, coalesce(s.k1, -{deg}.degree) AS k1, n.seq AS k2, n.id AS k3, 'NODE ' || {_NAME} || ' [src=' || {_clean("n.source_file")} || ' loc=' || {_clean("n.source_location")} || ' community=' || {_clean("n.community")} || ']' AS line
  FROM far JOIN n ON n.id = far.id JOIN {deg} ON {deg}.id = n.id LEFT JOIN seed s ON s.id = n.id
  UNION ALL SELECT 2, z.depth, {g}.seq, z.id, 'EDGE ' || {_clean("coalesce(na.label, na.id)")} || ' --' || {_clean(g + ".relation")} || ' [' || {_clean(g + ".confidence")} || CASE WHEN {g}.context <> '' THEN ' context=' || {_clean(g + ".context")} ELSE '' END || ']--> ' || {_clean("coalesce(nz.label, nz.id)")}
  FROM far a JOIN adj ON adj.a = a.id JOIN far z ON z.id = adj.b AND z.depth = a.depth + 1 JOIN {g} ON {g}.u = least(a.id, z.id) AND {g}.v = greatest(a.id, z.id) JOIN n na ON na.id = a.id JOIN n nz ON nz.id = z.id
  WHERE a.depth < {depth} AND (a.depth = 0 OR (SELECT degree FROM {deg} WHERE {deg}.id = a.id) < ({hub}))),
upto AS (SELECT *, row_number() OVER o AS ord, sum(length(line) + 1) OVER o - 1 AS upto, sum(length(line) + 1) OVER () - 1 AS total FROM lines WINDOW o AS (ORDER BY k0, k1, k2, k3)),
kept AS (SELECT k0, ord, line, total FROM upto WHERE CASE WHEN total <= {tokens * 3} THEN true ELSE upto < {tokens * 3} END),
shown AS (SELECT ord, line FROM kept UNION ALL SELECT max(ord) + 1, '... (truncated — ' || ((SELECT count(*) FROM lines WHERE k0 < 2) - count(*) FILTER (WHERE k0 < 2)) || ' more nodes cut by ~{tokens}-token budget. Narrow with context_filter=[''call''] or use get_node for a specific symbol)' FROM kept HAVING max(total) > {tokens * 3})"""


@query("q16_text_budget", sql(f"{_ADJ}, {_HUB}, seed AS (SELECT id, row_number() OVER (ORDER BY seq, id) AS k1 FROM n ORDER BY seq, id LIMIT 3), {_walk('adj', 2)}, {_answer('g', 'deg', 2, 'SELECT t FROM hub', 2000)} SELECT ord::INT AS ord, line FROM shown", "deg", recursive=True))
def _(s, d):
    g, degree = simple(s, d), degrees(simple(s, d))
    seeds = [r.id for r in g.nodes.orderBy("seq", "id").limit(3).collect()]
    found, walked = traverse.bfs(g, _first(g), 2)
    return traverse.rendered(traverse.node_lines(g, found, degree), traverse.edge_lines(g, walked), seeds)


@query(
    "q17_query_graph",
    sql(
        f"""{_SCORE}, {_SEEDS}, fg AS (SELECT * FROM g WHERE context IN ('call')), fe AS (SELECT u AS id FROM fg UNION ALL SELECT v FROM fg), fdeg AS (SELECT n.id, coalesce(k, 0) AS degree FROM n LEFT JOIN (SELECT id, count(*) AS k FROM fe GROUP BY id) c ON c.id = n.id),
seed AS (SELECT id, rank + 1 AS k1 FROM seeds), adj AS (SELECT u AS a, v AS b FROM fg UNION SELECT v, u FROM fg), {_HUB.replace('FROM deg)', 'FROM fdeg)')}, {_walk('adj', 3).replace('FROM deg WHERE deg.id', 'FROM fdeg WHERE fdeg.id')}, {_answer('fg', 'fdeg', 3, 'SELECT t FROM hub', 2000)}
SELECT 0 AS ord, 'Traversal: BFS depth=3 | Start: [' || (SELECT string_agg(CASE WHEN contains(x, chr(39)) AND NOT contains(x, '"') THEN '"' || x || '"' ELSE chr(39) || replace(x, chr(39), '\' || chr(39)) || chr(39) END, ', ' ORDER BY rank) FROM (SELECT rank, coalesce(n.label, n.id) AS x FROM seeds JOIN n ON n.id = seeds.id)) || '] | Context: call (heuristic) | ' || (SELECT count(*) FROM far) || ' nodes found' AS line
UNION ALL SELECT ord::INT, line FROM shown""",
        "g",
        recursive=True,
    ),
)
def _(s, d):
    """Question to seeds (scored on the whole graph), expansion over its kind of edges, text."""
    return search.answer(simple(s, d), QUESTION)


@query("q18_query_tool")
def _(s, d):
    asked = {"question": QUESTION, "mode": "dfs", "depth": 9, "token_budget": 500, "context_filter": ["calls", "imports"]}
    return s.createDataFrame([(search.query_tool(simple(s, d), asked),)], "answer string")


@query("q19_get_node", sql("SELECT id, label, source_file, community FROM n WHERE contains(lower(coalesce(label, '')), 'loader') OR lower(id) = 'loader' ORDER BY seq, id LIMIT 1", "n"))
def _(s, d):
    return search.get_node(graph(s, d).nodes, "Loader").select("id", "label", "source_file", "community")


@query(
    "q20_neighbors",
    sql(f"{_FIRST}, me AS (SELECT id FROM n ORDER BY seq, id LIMIT 1) SELECT 'out' AS direction, target AS id, relation FROM dg WHERE source IN (SELECT id FROM me) AND contains(relation, 'import') UNION ALL SELECT 'in', source, relation FROM dg WHERE target IN (SELECT id FROM me) AND contains(relation, 'import')", "dg"),
)
def _(s, d):
    g = simple(s, d, True)
    me = g.nodes.orderBy("seq", "id").limit(1).select(F.col("id").alias("me"))
    e = g.edges.where(F.col("relation").contains("import"))
    out = e.join(F.broadcast(me), F.col("source") == F.col("me")).select(F.lit("out").alias("direction"), F.col("target").alias("id"), "relation")
    return out.unionByName(e.join(F.broadcast(me), F.col("target") == F.col("me")).select(F.lit("in").alias("direction"), F.col("source").alias("id"), "relation"))


@query("q21_community", sql("SELECT id, label, source_file FROM n WHERE community = 28", "n"))
def _(s, d):
    return graph(s, d).nodes.where("community = 28").select("id", "label", "source_file")


@query(
    "q22_graph_stats",
    sql("c AS (SELECT coalesce(confidence, 'EXTRACTED') AS c FROM g) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM c) AS edges, (SELECT count(DISTINCT community) FROM n) AS communities, round_even(100.0::DOUBLE * (SELECT count(*) FROM c WHERE c = 'EXTRACTED') / (SELECT greatest(count(*), 1) FROM c), 0)::BIGINT AS extracted_pct, round_even(100.0::DOUBLE * (SELECT count(*) FROM c WHERE c = 'INFERRED') / (SELECT greatest(count(*), 1) FROM c), 0)::BIGINT AS inferred_pct, round_even(100.0::DOUBLE * (SELECT count(*) FROM c WHERE c = 'AMBIGUOUS') / (SELECT greatest(count(*), 1) FROM c), 0)::BIGINT AS ambiguous_pct", "g"),
)
def _(s, d):
    g = simple(s, d)
    c = F.coalesce("confidence", F.lit("EXTRACTED"))
    pct = lambda x: F.bround(100.0 * F.count_if(c == x) / F.greatest(F.count("*"), F.lit(1)), 0).cast("long").alias(f"{x.lower()}_pct")
    e = g.edges.agg(F.count("*").alias("edges"), *[pct(x) for x in ("EXTRACTED", "INFERRED", "AMBIGUOUS")])
    return g.nodes.agg(F.count("*").alias("nodes"), F.count_distinct("community").alias("communities")).join(e)


_PAIR = "a AS (SELECT id FROM n ORDER BY seq, id LIMIT 1 OFFSET 20), z AS (SELECT max_by(id, seq) AS id FROM n WHERE id IN (SELECT u FROM g UNION SELECT v FROM g))"


def _next(k: int) -> str:
    """The k-th node of the path: of all nodes that are one nearer to the end the smallest."""
    return f"p{k} AS (SELECT min(adj.b) AS id FROM p{k - 1} JOIN adj ON adj.a = p{k - 1}.id JOIN far f ON f.id = adj.b AND f.depth = (SELECT hops FROM len) - {k})"


@query(
    "q23_shortest_path",
    sql(
        f"""{_ADJ}, {_PAIR}, seed AS (SELECT id FROM z), {_walk('adj', 8, False)}, far AS (SELECT id, min(depth) AS depth FROM w GROUP BY id), len AS (SELECT f.depth AS hops FROM far f JOIN a ON a.id = f.id), p0 AS (SELECT a.id FROM a, len), {", ".join(map(_next, range(1, 9)))},
p AS ({" UNION ALL ".join(f"SELECT {k} AS step, id, {f'(SELECT id FROM p{k - 1})' if k else 'NULL'} AS before FROM p{k} WHERE id IS NOT NULL" for k in range(9))})
SELECT p.step::INT AS step, p.id, coalesce(n.label, n.id) AS label, g.relation, g.confidence, g.source = p.before AS forward FROM p JOIN n ON n.id = p.id LEFT JOIN g ON g.u = least(p.id, p.before) AND g.v = greatest(p.id, p.before)""",
        "deg",
        recursive=True,
    ),
)
def _(s, d):
    g = simple(s, d)
    a = g.nodes.orderBy("seq", "id").limit(21).orderBy(F.desc("seq"), F.desc("id")).limit(1).select("id")
    ends = g.edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    z = g.nodes.join(ends, "id", "left_semi").agg(F.max_by("id", "seq").alias("id"))
    return traverse.path_steps(g, traverse.shortest_path(g, a, z) or [])


@query("q25_explain", sql("me AS (SELECT id FROM n ORDER BY seq, id LIMIT 1), x AS (SELECT CASE WHEN u = me.id THEN v ELSE u END AS id, relation, confidence FROM g, me WHERE u = me.id OR v = me.id) SELECT x.id, n.label, x.relation, deg.degree FROM x JOIN deg ON deg.id = x.id JOIN n ON n.id = x.id ORDER BY deg.degree DESC, n.seq LIMIT 20", "deg"))
def _(s, d):
    g = simple(s, d)
    me = g.nodes.orderBy("seq", "id").limit(1).select(F.col("id").alias("me"))
    x = g.edges.join(F.broadcast(me), (F.col("u") == F.col("me")) | (F.col("v") == F.col("me"))).select(F.when(F.col("u") == F.col("me"), F.col("v")).otherwise(F.col("u")).alias("id"), "relation")
    return x.join(degrees(g), "id").join(g.nodes.select("id", "label", "seq"), "id").orderBy(F.desc("degree"), "seq").limit(20).select("id", "label", "relation", "degree")


@query(
    "q26_resolve_seed",
    sql("q AS (SELECT lower(label) AS q FROM n WHERE label IS NOT NULL AND regexp_full_match(label, '[a-z_]+\\(\\)') GROUP BY lower(label) HAVING count(*) = 1 ORDER BY 1 LIMIT 1) SELECT id FROM n, q WHERE lower(label) = q", "n"),
)
def _(s, d):
    n = graph(s, d).nodes
    one = n.where(r"label RLIKE '^[a-z_]+\\(\\)$'").groupBy(F.lower("label").alias("q")).agg(F.count("*").alias("k")).where("k = 1").orderBy("q").limit(1).collect()
    return search.resolve_seed(n, one[0].q if one else "none")


_REL = ", ".join(f"'{r}'" for r in IMPACT_RELATIONS)


@query(
    "q27_affected",
    sql(
        f"""seed AS (SELECT id FROM n ORDER BY seq, id LIMIT 1), b AS (SELECT source, target, relation, seq FROM dg WHERE relation IN ({_REL})),
w1 AS (SELECT source AS id, min_by(relation, seq) AS r FROM b WHERE target IN (SELECT id FROM seed) AND source NOT IN (SELECT id FROM seed) GROUP BY source),
w2 AS (SELECT source AS id, min_by(relation, seq) AS r FROM b WHERE target IN (SELECT id FROM w1) AND source NOT IN (SELECT id FROM seed) AND source NOT IN (SELECT id FROM w1) GROUP BY source)
SELECT id, 1 AS depth, r AS via_relation FROM w1 UNION ALL SELECT id, 2, r FROM w2""",
        "dg",
    ),
)
def _(s, d):
    g = simple(s, d, True)
    return traverse.affected(g, g.nodes.orderBy("seq", "id").limit(1).select("id"))


@query("q28_format_affected", SQL["q27_affected"].replace("SELECT id, 1 AS depth, r AS via_relation FROM w1 UNION ALL SELECT id, 2, r FROM w2", "SELECT x.id, '- ' || coalesce(n.label, n.id) || ' [' || x.r || '] ' || CASE WHEN coalesce(n.source_file, '') = '' THEN '-' ELSE n.source_file END || CASE WHEN coalesce(n.source_location, '') = '' THEN '' ELSE ':' || n.source_location END AS line FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2) x JOIN n ON n.id = x.id"))
def _(s, d):
    g = simple(s, d, True)
    hits = traverse.affected(g, g.nodes.orderBy("seq", "id").limit(1).select("id")).join(g.nodes, "id")
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    place = F.concat(F.when(has("source_file"), F.col("source_file")).otherwise("-"), F.when(has("source_location"), F.concat(F.lit(":"), "source_location")).otherwise(""))
    return hits.select("id", F.concat(F.lit("- "), F.coalesce("label", "id"), F.lit(" ["), "via_relation", F.lit("] "), place).alias("line"))


_PR = "pr AS (SELECT DISTINCT node_seq % 40 AS pr, CASE WHEN node_seq % 2 = 0 THEN 'repo/' || source_file ELSE regexp_extract(source_file, '[^/]*$', 0) END AS file FROM graph_nodes WHERE node_seq % 7 = 0 AND source_file <> '')"
_PRM = f"{_PR}, m AS (SELECT DISTINCT pr.pr, src FROM pr JOIN (SELECT DISTINCT source_file AS src FROM n WHERE source_file <> '') f ON src = file OR ends_with(src, '/' || file) OR ends_with(file, '/' || src))"


def _pr_nodes(s, d):
    """(pr, id, community): nodes of the files that a change touches. Paths match if one ends with
    the other; both then end in the same name, which makes it an equi-join with a remainder."""
    rows = s.read.parquet(f"{d}/graph_nodes.parquet").where("node_seq % 7 = 0 AND source_file <> ''")
    name = lambda c: F.regexp_extract(c, "[^/]*$", 0)
    pr = rows.select((F.col("node_seq") % 40).alias("pr"), F.when(F.col("node_seq") % 2 == 0, F.concat(F.lit("repo/"), "source_file")).otherwise(name("source_file")).alias("file")).distinct()
    nodes = graph(s, d).nodes.where("source_file <> ''")
    src = nodes.select(F.col("source_file").alias("src")).distinct().withColumn("k", name("src"))
    tail = lambda a, b: F.col(a).endswith(F.concat(F.lit("/"), F.col(b)))
    hit = pr.withColumn("k", name("file")).join(src, "k").where((F.col("src") == F.col("file")) | tail("src", "file") | tail("file", "src")).select("pr", "src").distinct()
    return hit.join(nodes.select(F.col("source_file").alias("src"), "id", "community"), "src")


@query("q29_pr_impact", sql(f"{_PRM} SELECT pr, count(*) AS nodes_affected, count(DISTINCT community) AS communities FROM m JOIN n ON n.source_file = m.src GROUP BY pr", "n"))
def _(s, d):
    return _pr_nodes(s, d).groupBy("pr").agg(F.count("*").alias("nodes_affected"), F.count_distinct("community").alias("communities"))


@query("q32_community_conflicts", sql(f"{_PRM} SELECT community, count(DISTINCT pr) AS prs FROM m JOIN n ON n.source_file = m.src WHERE community IS NOT NULL GROUP BY community HAVING count(DISTINCT pr) > 1", "n"))
def _(s, d):
    return _pr_nodes(s, d).where("community IS NOT NULL").groupBy("community").agg(F.count_distinct("pr").alias("prs")).where("prs > 1")


@query("q33_community_labels", sql("SELECT community, id, label, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY seq, id) AS rn FROM n WHERE community IS NOT NULL AND coalesce(label, id) <> '') WHERE rn <= 4", "n"))
def _(s, d):
    from pyspark.sql import Window

    n = graph(s, d).nodes.where("community IS NOT NULL AND coalesce(label, id) <> ''")
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("community").orderBy("seq", "id"))).where("rank <= 4").select("community", "id", "label", "rank")


QUESTIONS = ["how does the registry decode a queue", "what renders the beacon sketcher", "how are traces flushed and merged", "what connects the sampler to the tracker", "where is the glossary of the prairie", "zzz nothing"]


def _size(q: str) -> str:
    """One question's tokens, see traverse.question_size."""
    hits = " + ".join(f"contains(lower(coalesce(label, '')), '{t}')::INT" for t in query_terms(q))
    return f"""SELECT '{q}' AS question, greatest(1, (sum(k + 1) - 1) // 4)::BIGINT AS query_tokens FROM (WITH RECURSIVE seed AS (SELECT id FROM n WHERE {hits} > 0 ORDER BY {hits} DESC, id DESC LIMIT 3), {_walk('adj', 3, False)}, far AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)
SELECT length(coalesce(label, n.id)) + length(coalesce(source_file, '')) + length(coalesce(source_location, '')) + 15 AS k FROM far JOIN n ON n.id = far.id
UNION ALL SELECT length(coalesce(na.label, na.id)) + length(coalesce(nz.label, nz.id)) + length(coalesce(g.relation, '')) + 12 FROM far a JOIN adj ON adj.a = a.id JOIN far z ON z.id = adj.b AND z.depth = a.depth + 1 JOIN g ON g.u = least(a.id, z.id) AND g.v = greatest(a.id, z.id) JOIN n na ON na.id = a.id JOIN n nz ON nz.id = z.id) HAVING count(*) > 0"""


_CORPUS_WORDS = "CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+'), lambda w: w <> '')) END"


@query(
    "g34_token_reduction",
    sql(
        f"""{_ADJ}, q AS MATERIALIZED ({" UNION ALL ".join(map(_size, QUESTIONS))}), c AS (SELECT (sum({_CORPUS_WORDS}) * 100 // 75)::BIGINT AS t FROM source_files), x AS (SELECT * FROM q UNION ALL SELECT NULL, (sum(query_tokens) // count(*))::BIGINT FROM q HAVING count(*) > 0)
SELECT question, t AS corpus_tokens, query_tokens, round(t::DOUBLE / query_tokens, 1) AS reduction FROM x, c""",
        "g",
        recursive=True,
    ),
)
def _(s, d):
    words = table(s, d, "source_files").agg(F.coalesce(F.sum(word_count(F.col("text"))), F.lit(0)).alias("words"))
    return traverse.token_reduction(simple(s, d), words, QUESTIONS)


@query("g35_bfs_no_cutoff", sql(f"{_ADJ}, {_FIRST}, {_walk('adj', 2, False)} SELECT id, min(depth)::INT AS depth FROM w GROUP BY id", "deg", recursive=True))
def _(s, d):
    g = simple(s, d)
    return traverse.bfs(g, _first(g), 2, cutoff=False)[0]


@query("x01_callable_labels", sql("SELECT id, lower(ltrim(rtrim(ltrim(trim(label), '()'), '()'), '.')) AS key FROM n WHERE label IS NOT NULL", "n"))
def _(s, d):
    return graph(s, d).nodes.where("label IS NOT NULL").select("id", callable_key(F.col("label")).alias("key"))
