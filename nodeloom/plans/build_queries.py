"""Queries over graph assembly, with their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from nodeloom.operators import build
from nodeloom.plans.view import file_type, graph, norm, raw_edges, raw_nodes, records, simple, sql
from nodeloom.schema import CONFIDENCES, FILE_TYPES

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


_types, _confs = ", ".join(f"'{x}'" for x in FILE_TYPES), ", ".join(f"'{x}'" for x in CONFIDENCES)


@query(
    "b01_validate",
    f"""WITH ids AS (SELECT DISTINCT id FROM graph_nodes WHERE id IS NOT NULL),
ends AS (SELECT edge_seq AS seq, 'source' AS e, source AS v FROM graph_edges UNION ALL SELECT edge_seq, 'target', target FROM graph_edges)
SELECT 'node' AS kind, node_seq AS seq, 'missing id' AS rule, NULL::VARCHAR AS value FROM graph_nodes WHERE id IS NULL
UNION ALL SELECT 'node', node_seq, 'missing label', NULL FROM graph_nodes WHERE label IS NULL
UNION ALL SELECT 'node', node_seq, 'missing file_type', NULL FROM graph_nodes WHERE file_type IS NULL
UNION ALL SELECT 'node', node_seq, 'missing source_file', NULL FROM graph_nodes WHERE source_file IS NULL
UNION ALL SELECT 'edge', edge_seq, 'missing source', NULL FROM graph_edges WHERE source IS NULL
UNION ALL SELECT 'edge', edge_seq, 'missing target', NULL FROM graph_edges WHERE target IS NULL
UNION ALL SELECT 'edge', edge_seq, 'missing relation', NULL FROM graph_edges WHERE relation IS NULL
UNION ALL SELECT 'edge', edge_seq, 'missing confidence', NULL FROM graph_edges WHERE confidence IS NULL
UNION ALL SELECT 'edge', edge_seq, 'missing source_file', NULL FROM graph_edges WHERE source_file IS NULL
UNION ALL SELECT 'node', node_seq, 'invalid file_type', file_type FROM graph_nodes WHERE file_type NOT IN ({_types})
UNION ALL SELECT 'edge', edge_seq, 'invalid confidence', confidence FROM graph_edges WHERE confidence NOT IN ({_confs})
UNION ALL SELECT 'edge', seq, 'unmatched ' || e, v FROM ends WHERE v IS NOT NULL AND v NOT IN (SELECT id FROM ids) AND EXISTS (SELECT 1 FROM ids)""",
)
def _(s, d):
    return build.validate(raw_nodes(s, d), raw_edges(s, d))


@query("b03_file_type", f"SELECT path, {file_type('file_type')} AS file_type FROM source_files")
def _(s, d):
    return s.read.parquet(f"{d}/source_files.parquet").select("path", build.coerce_file_type(F.col("file_type")).alias("file_type"))


@query(
    "b04_upsert_attrs",
    sql(
        """kv AS (SELECT seq, json_extract_string(p, '$.id') AS id, unnest(json_keys(p)) AS attr, p FROM r WHERE json_extract_string(p, '$.id') IS NOT NULL),
x AS (SELECT seq, id, attr, json_extract_string(p, '$."' || attr || '"') AS value FROM kv)
SELECT id, attr, value FROM (SELECT *, row_number() OVER (PARTITION BY id, attr ORDER BY seq DESC) AS rn FROM x) WHERE rn = 1""",
        "r",
    ),
)
def _(s, d):
    return build.upsert_attrs(records(s, d).withColumn("id", F.col("attrs")["id"]).where("id IS NOT NULL"))


_GHOST = """x AS (SELECT seq, id, trim(label) AS l, regexp_extract(source_file, '[^/]*$', 0) AS f, coalesce(file_type = 'code', false) AS ast, coalesce(source_location <> '', false) AND NOT coalesce(file_type = 'code', false) AS loc FROM n),
k AS (SELECT f, l, count(*) FILTER (ast) AS c, min_by(id, seq) FILTER (ast) AS a, min_by(id, seq) FILTER (loc) AS b FROM x WHERE l <> '' AND f <> '' GROUP BY f, l),
w AS (SELECT f, l, CASE WHEN c = 1 THEN a ELSE b END AS new FROM k WHERE c < 2)
SELECT DISTINCT x.id AS old, w.new FROM x JOIN w USING (f, l) WHERE NOT x.ast AND w.new IS NOT NULL AND x.id <> w.new"""


@query("b05_ghosts", sql(_GHOST, "n"))
def _(s, d):
    g = graph(s, d)
    return build.merge_ghosts(g.nodes.withColumn("origin", F.when(F.col("file_type") == "code", "ast")))


@query("b06_valid_edges", sql("SELECT seq, source, target, relation, source_file FROM e", "e"))
def _(s, d):
    return graph(s, d).edges.select("seq", "source", "target", "relation", "source_file")


@query("b06_simple_graph", sql("SELECT u, v, seq, source, target, relation, confidence, context, source_file, weight FROM g", "g"))
def _(s, d):
    return simple(s, d).edges.select("u", "v", "seq", "source", "target", "relation", "confidence", "context", "source_file", "weight")


@query("b06_simple_digraph", sql("SELECT seq, source, target, relation, confidence FROM dg", "dg"))
def _(s, d):
    return simple(s, d, True).edges.select("seq", "source", "target", "relation", "confidence")


@query(
    "b08_merge_by_source",
    sql(
        """old AS (SELECT * FROM n WHERE seq % 2 = 0), new AS (SELECT seq + 1000000000 AS seq, id, label || '!' AS label, file_type, source_file, source_location, community, repo FROM n WHERE seq % 3 = 0),
gone AS (SELECT source_file FROM n WHERE seq % 50 = 1)
SELECT seq, id, label, source_file FROM (SELECT * FROM old WHERE source_file NOT IN (SELECT source_file FROM new WHERE source_file <> '') OR source_file IS NULL UNION ALL SELECT * FROM new)
WHERE source_file IS NULL OR source_file NOT IN (SELECT source_file FROM gone WHERE source_file IS NOT NULL)""",
        "n",
    ),
)
def _(s, d):
    n = graph(s, d).nodes
    new = n.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 1000000000).withColumn("label", F.concat("label", F.lit("!")))
    return build.merge_by_source(n.where("seq % 2 = 0"), new, n.where("seq % 50 = 1")).select("seq", "id", "label", "source_file")


@query("b09_dedupe_nodes", "SELECT id, first_seq AS seq, label, file_type, source_file FROM (SELECT *, min(node_seq) OVER (PARTITION BY id) AS first_seq, row_number() OVER (PARTITION BY id ORDER BY node_seq DESC) AS rn FROM graph_nodes WHERE id IS NOT NULL) WHERE rn = 1")
def _(s, d):
    return build.dedupe_nodes(raw_nodes(s, d)).select("id", "seq", "label", "file_type", "source_file")


@query("b10_dedupe_edges", "SELECT seq, source, target, relation, confidence, context FROM (SELECT edge_seq AS seq, *, row_number() OVER (PARTITION BY source, target, relation ORDER BY edge_seq) AS rn FROM graph_edges) WHERE rn = 1")
def _(s, d):
    return build.dedupe_edges(raw_edges(s, d)).select("seq", "source", "target", "relation", "confidence", "context")


_COMPAT = [c for c in map(chr, [*range(0xA0, 0x100), *range(0x2000, 0x2070), 0x212A, 0x3000, *range(0xFF01, 0xFFA0)]) if len(unicodedata.normalize("NFKC", c)) == 1 and unicodedata.normalize("NFKC", c) != c]
_PLAIN = "".join(unicodedata.normalize("NFKC", c) for c in _COMPAT).replace("'", "''")
_LABEL = f"translate(coalesce(label, id), '{''.join(_COMPAT)}', '{_PLAIN}')"
for _a, _b in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("…", "..."), ("ß", "ss")):
    _LABEL = f"replace({_LABEL}, '{_a}', '{_b}')"
_LABEL = rf"trim(regexp_replace(replace(lower(nfc_normalize({_LABEL})), 'ς', 'σ'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(
    "b11_merge_by_label",
    sql(
        rf"""k AS (SELECT *, {_LABEL} AS k FROM n), w AS (SELECT k, arg_min(id, (regexp_matches(id, '_c[0-9]+$')::INT * 1000000000000::HUGEINT + length(id) * 1000000000 + seq)) AS new FROM k WHERE k <> '' GROUP BY k)
SELECT k.id AS old, w.new FROM k JOIN w ON w.k = k.k WHERE k.id <> w.new""",
        "n",
    ),
)
def _(s, d):
    g = graph(s, d)
    return build.merge_by_label(g.nodes, g.edges)[2]


@query("b12_norm_source_file", "SELECT path, CASE WHEN starts_with(replace(path, chr(92), '/'), 'docs/') THEN substr(replace(path, chr(92), '/'), 6) ELSE replace(path, chr(92), '/') END AS rel FROM source_files")
def _(s, d):
    return s.read.parquet(f"{d}/source_files.parquet").select("path", build.norm_source_file(F.col("path"), "docs").alias("rel"))


@query(
    "b13_edge_variants",
    "SELECT source, target, count(*) AS edges, min_by(relation, edge_seq) AS first_relation FROM graph_edges WHERE source <> '' AND target <> '' GROUP BY source, target HAVING count(*) > 1",
)
def _(s, d):
    e = raw_edges(s, d).where("source <> '' AND target <> ''").groupBy("source", "target").agg(F.count("*").alias("edges"), F.min_by("relation", "seq").alias("first_relation"))
    return e.where("edges > 1")


@query("b14_prefixed_edges", sql("SELECT e.seq, s.repo || '::' || e.source AS source, t.repo || '::' || e.target AS target FROM e JOIN n s ON s.id = e.source JOIN n t ON t.id = e.target", "e"))
def _(s, d):
    return build.prefixed(graph(s, d)).edges.select("seq", "source", "target")


@query("b14_prefixed_nodes", sql("SELECT repo || '::' || id AS id, id AS local_id, repo FROM n", "n"))
def _(s, d):
    return build.prefixed(graph(s, d)).nodes.select("id", "local_id", "repo")


@query("b15_without_repo", sql("SELECT e.seq FROM e JOIN n s ON s.id = e.source JOIN n t ON t.id = e.target WHERE s.repo IS DISTINCT FROM 'amber-graph' AND t.repo IS DISTINCT FROM 'amber-graph'", "e"))
def _(s, d):
    return build.without_repo(graph(s, d), "amber-graph").edges.select("seq")


@query(
    "b16_merge_external",
    sql(
        """a AS (SELECT seq, 'A::' || id AS id, label, CASE WHEN file_type IN ('concept', 'image') THEN NULL ELSE source_file END AS source_file FROM n WHERE repo = 'amber-graph'),
b AS (SELECT seq, 'B::' || id AS id, label, CASE WHEN file_type IN ('concept', 'image') THEN NULL ELSE source_file END AS source_file FROM n WHERE repo <> 'amber-graph'),
there AS (SELECT label, arg_min(id, seq) AS new FROM a WHERE source_file IS NULL AND label IS NOT NULL GROUP BY label),
m AS (SELECT b.id AS old, new FROM b JOIN there USING (label) WHERE b.source_file IS NULL),
nodes AS (SELECT id FROM a UNION ALL SELECT id FROM b WHERE id NOT IN (SELECT old FROM m)),
eb AS (SELECT seq, 'B::' || source AS source, 'B::' || target AS target FROM e WHERE seq % 2 = 0),
er2 AS (SELECT seq, coalesce(ms.new, source) AS source, coalesce(mt.new, target) AS target FROM eb LEFT JOIN m ms ON ms.old = source LEFT JOIN m mt ON mt.old = target)
SELECT 'node' AS kind, id AS a, NULL::VARCHAR AS b FROM nodes UNION ALL SELECT 'edge', source, target FROM er2 WHERE source <> target UNION ALL SELECT 'edge', 'A::' || source, 'A::' || target FROM e WHERE seq % 2 = 1""",
        "e",
    ),
)
def _(s, d):
    g = graph(s, d)
    n = g.nodes.withColumn("source_file", F.when(~F.col("file_type").isin("concept", "image"), F.col("source_file")))
    pre = lambda df, p, *cols: df.withColumns({c: F.concat(F.lit(p), F.col(c)) for c in cols})
    base = g.with_(nodes=pre(n.where("repo = 'amber-graph'"), "A::", "id"), edges=pre(g.edges.where("seq % 2 = 1"), "A::", "source", "target"))
    new = g.with_(nodes=pre(n.where("repo <> 'amber-graph'"), "B::", "id"), edges=pre(g.edges.where("seq % 2 = 0"), "B::", "source", "target"))
    out = build.merge_external(base, new)
    nodes = out.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"))
    return nodes.unionByName(out.edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b")))


@query("b17_repos", sql("SELECT repo, count(*) AS nodes FROM n GROUP BY repo", "n"))
def _(s, d):
    return graph(s, d).nodes.groupBy("repo").agg(F.count("*").alias("nodes"))


_KV = """kv AS (SELECT seq, chunk_no % 2 AS part, json_extract_string(p, '$.id') AS id, unnest(json_keys(p)) AS attr, p FROM r WHERE json_extract_string(p, '$.id') IS NOT NULL),
x AS (SELECT seq, part, id, attr, json_extract_string(p, '$."' || attr || '"') AS value FROM kv),
l AS (SELECT id, attr, value FROM (SELECT *, row_number() OVER (PARTITION BY id, attr ORDER BY part DESC, seq DESC) AS rn FROM x) WHERE rn = 1)"""


def _composed(s, d):
    from nodeloom.schema import Graph

    rows, edges = records(s, d).withColumn("id", F.col("attrs")["id"]).where("id IS NOT NULL").select("seq", "id", "attrs", "chunk_no"), raw_edges(s, d)
    return build.compose([Graph(rows.where(f"chunk_no % 2 = {i}").drop("chunk_no"), edges.where(f"seq % 2 = {i}")) for i in (0, 1)])


@query("b18_compose", sql(_KV + " SELECT id, count(*) AS attrs, max(value) FILTER (attr = 'label') AS label, max(value) FILTER (attr = 'source_file') AS source_file FROM l GROUP BY id", "r"))
def _(s, d):
    return _composed(s, d)[0].select("id", F.size("attrs").alias("attrs"), F.col("attrs")["label"].alias("label"), F.col("attrs")["source_file"].alias("source_file"))


@query("b18_composed_edges", SQL["b10_dedupe_edges"])
def _(s, d):
    return _composed(s, d)[1].select("seq", "source", "target", "relation", "confidence", "context")


@query("b19_merge_graphs", sql("SELECT 'node' AS kind, repo || '::' || id AS a, label AS b FROM n UNION ALL SELECT 'edge', s.repo || '::' || source, t.repo || '::' || target FROM e JOIN n s ON s.id = source JOIN n t ON t.id = target", "e"))
def _(s, d):
    """Several repositories as one graph: every node and edge under its repo's prefix."""
    g = build.prefixed(graph(s, d))
    return g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b")).unionByName(g.edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b")))


@query(
    "b20_merge_chunks",
    sql("f AS (SELECT json_extract_string(p, '$.id') AS id, json_extract_string(p, '$.label') AS label, chunk_no, seq FROM r WHERE json_extract_string(p, '$.id') <> '') SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY chunk_no, seq) AS rn FROM f) WHERE rn = 1", "r"),
)
def _(s, d):
    rows = records(s, d).select(F.col("attrs")["id"].alias("id"), F.col("attrs")["label"].alias("label"), F.struct("chunk_no", "seq").alias("seq"))
    return build.first_wins([rows]).select("id", "label")


@query("b20_chunk_tokens", "SELECT chunk_no, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM fragments GROUP BY chunk_no")
def _(s, d):
    return s.read.parquet(f"{d}/fragments.parquet").groupBy("chunk_no").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


@query(
    "b21_cached_before_new",
    sql("SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, seq) AS rn FROM (SELECT *, CASE WHEN file_type = 'code' THEN 1 ELSE 0 END AS p FROM nd)) WHERE rn = 1", "n"),
)
def _(s, d):
    from nodeloom.functions.ids import normalize_id

    rows = raw_nodes(s, d).select("seq", normalize_id("id").alias("id"), "label", F.coalesce(F.col("file_type") == "code", F.lit(False)).alias("c")).where("id <> ''")
    return build.first_wins([rows.where("NOT c"), rows.where("c")]).select("id", "label")


_HYPER = """h AS (SELECT 'h' || (node_seq % 500) AS id, list(id ORDER BY node_seq) AS nodes, min(node_seq) AS seq FROM graph_nodes WHERE id IS NOT NULL AND node_seq % 3 = 0 GROUP BY 1)"""


def _hyper(s, d):
    rows = raw_nodes(s, d).where("id IS NOT NULL AND seq % 3 = 0").groupBy(F.concat(F.lit("h"), F.col("seq") % 500).alias("id"))
    rows = rows.agg(F.sort_array(F.collect_list(F.struct("seq", F.col("id").alias("n")))).alias("m"), F.min("seq").alias("seq"))
    return rows.select("id", F.col("m.n").alias("nodes"), "seq")


@query("b22_hyperedges", f"WITH {_HYPER} SELECT id, min(seq) AS seq FROM (SELECT id, seq FROM h UNION ALL SELECT id, seq + 1 FROM h WHERE seq % 2 = 0 UNION ALL SELECT NULL, seq FROM h) WHERE id <> '' GROUP BY id")
def _(s, d):
    h = _hyper(s, d).select("id", "seq")
    none = h.select(F.lit(None).cast("string").alias("id"), "seq")
    return build.attach_hyperedges(h.unionByName(h.where("seq % 2 = 0").withColumn("seq", F.col("seq") + 1)).unionByName(none)).select("id", "seq")


@query("b23_prune_dangling", "SELECT edge_seq AS seq FROM graph_edges WHERE source IN (SELECT id FROM graph_nodes WHERE id IS NOT NULL) AND target IN (SELECT id FROM graph_nodes WHERE id IS NOT NULL)")
def _(s, d):
    return build.prune_dangling(raw_nodes(s, d), raw_edges(s, d)).select("seq")


_PROSE = r"(l <> '' AND (length(l) >= 20 OR len(list_filter(regexp_split_to_array(l, '\s+'), lambda w: w <> '')) >= 3) AND regexp_matches(l, '[.!?:(]'))"
_SEM = f"""src AS (SELECT DISTINCT source AS id FROM e WHERE relation = 'rationale_for'),
m AS (SELECT n.*, trim(n.label) AS l, coalesce(n.file_type IN ('rationale', 'concept'), false) OR (src.id IS NOT NULL AND coalesce({_PROSE.replace(":(", ":")}, false)) AS gone FROM (SELECT *, trim(label) AS l FROM n) n LEFT JOIN src ON src.id = n.id)"""


@query("b25_sanitized_nodes", sql(_SEM.replace("n.*, trim(n.label) AS l", "n.*") + " SELECT id FROM m WHERE NOT gone", "e"))
def _(s, d):
    g = graph(s, d)
    return build.sanitize_semantic(g.nodes, g.edges, min_chars=20, min_words=3)[0].select("id")


@query("b25_sanitized_edges", sql(_SEM.replace("n.*, trim(n.label) AS l", "n.*") + " SELECT seq FROM e WHERE source NOT IN (SELECT id FROM m WHERE gone) AND target NOT IN (SELECT id FROM m WHERE gone)", "e"))
def _(s, d):
    g = graph(s, d)
    return build.sanitize_semantic(g.nodes, g.edges, min_chars=20, min_words=3)[1].select("seq")


@query(
    "b25_filtered_hyperedges",
    sql(f"{_HYPER}, x AS (SELECT h.id, unnest(nodes) AS node, unnest(range(len(nodes))) AS pos FROM h) SELECT id, array_to_string(list(node ORDER BY pos), ',') AS nodes FROM x WHERE node IN (SELECT id FROM n WHERE file_type = 'code') GROUP BY id HAVING count(*) >= 2", "n"),
)
def _(s, d):
    return build.filter_hyperedges(_hyper(s, d), graph(s, d).nodes.where("file_type = 'code'")).select("id", F.array_join("nodes", ",").alias("nodes"))


@query("b26_sentence_like", sql(f"SELECT id, coalesce({_PROSE.replace(':(', ':').replace('20', '30').replace('>= 3', '>= 4')}, false) AS prose FROM (SELECT *, trim(label) AS l FROM n)", "n"))
def _(s, d):
    return graph(s, d).nodes.select("id", build.sentence_like(F.col("label"), 30, 4).alias("prose"))


@query("b27_sanitize_label", "SELECT doc_id, substr(regexp_replace(text, '[\\x00-\\x1f\\x7f]', '', 'g'), 1, 256) AS label FROM documents")
def _(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", build.sanitize_label(F.col("text")).alias("label"))


@query(
    "g25_diagnose",
    """WITH ids AS (SELECT DISTINCT id FROM graph_nodes WHERE id IS NOT NULL),
x AS (SELECT *, coalesce(source, '') <> '' AND coalesce(target, '') <> '' AS has, source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids) AS there FROM graph_edges),
v AS (SELECT source, target, coalesce(relation, '') AS relation, coalesce(source_file, '') AS sf, coalesce(context, '') AS cx FROM x WHERE has AND there),
t AS (SELECT source, target, relation, count(*) AS k, count(DISTINCT sf) AS files, count(DISTINCT cx) AS contexts FROM v GROUP BY ALL),
p AS (SELECT source, target, sum(k) AS k, count(*) AS relations, count(*) FILTER (files > 1) AS files, count(*) FILTER (contexts > 1) AS contexts FROM t GROUP BY ALL),
u AS (SELECT least(source, target) AS a, greatest(source, target) AS b, sum(k) AS k FROM p GROUP BY ALL)
SELECT (SELECT count(*) FROM x) AS raw_edges, (SELECT count(*) FROM x WHERE NOT has) AS missing_endpoint, (SELECT count(*) FROM x WHERE has AND NOT there) AS dangling,
 (SELECT count(*) FROM v WHERE source = target) AS self_loops, (SELECT count(*) FROM v) AS valid, (SELECT count(*) FROM p) AS directed_pairs,
 (SELECT coalesce(sum(k - 1), 0)::BIGINT FROM p) AS directed_collapsed, (SELECT count(*) FROM p WHERE k > 1) AS same_endpoint_groups, (SELECT count(*) FROM p WHERE relations > 1) AS relation_variants,
 (SELECT coalesce(sum(files), 0)::BIGINT FROM p) AS source_file_variants, (SELECT coalesce(sum(contexts), 0)::BIGINT FROM p) AS context_variants,
 (SELECT count(*) FROM u) AS undirected_pairs, (SELECT coalesce(sum(k - 1), 0)::BIGINT FROM u) AS undirected_collapsed""",
)
def _(s, d):
    return build.diagnose(raw_nodes(s, d), raw_edges(s, d))


@query("g27_exact_duplicates", "SELECT count(*) AS groups, coalesce(sum(k - 1), 0)::BIGINT AS extra FROM (SELECT count(*) AS k FROM graph_edges GROUP BY source, target, relation, confidence, context, source_file HAVING count(*) > 1)")
def _(s, d):
    sig = build.exact_signature(["source", "target", "relation", "confidence", "context", "source_file"])
    k = raw_edges(s, d).groupBy(sig.alias("sig")).agg(F.count("*").alias("k")).where("k > 1")
    return k.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("extra"))
