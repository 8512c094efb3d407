"""Queries over scans, resolution, incremental work and sinks, with their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from nodeloom.functions import text as tx
from nodeloom.functions.similarity import jaro, jaro_winkler
from nodeloom.operators import dedup, incremental, symbols
from nodeloom.operators.analyze import CODE_SUFFIXES, DOC_SUFFIXES, IMAGE_SUFFIXES
from nodeloom.plans.search_queries import form
from nodeloom.plans.view import graph, raw_nodes, sql
from nodeloom.session import materialize, table
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
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _src(s, d):
    return table(s, d, "source_files")


_NAME = "regexp_extract(path, '[^/]*$', 0)"
_SUF = "lower(regexp_extract(coalesce(path, ''), '[^/](\\.[^./]+)$', 1))"
_HEAD = "substr(coalesce(text, ''), 1, 3000)"
_SIGNALS = " + ".join("regexp_matches({h}, '{p}')::INT".format(h=_HEAD, p=p.replace("'", "''")) for p in files.PAPER_SIGNALS)
_TYPE = f"CASE WHEN {_NAME} IN ({_in(files.MANIFESTS)}) OR ends_with(lower({_NAME}), '.blade.php') THEN 'code' WHEN {_SUF} IN ({_in(CODE_SUFFIXES)}) THEN 'code' WHEN {_SUF} = '.pdf' THEN 'paper' WHEN {_SUF} IN ({_in(IMAGE_SUFFIXES)}) THEN 'image' WHEN {_SUF} IN ({_in(DOC_SUFFIXES)}) THEN CASE WHEN {_SIGNALS} >= 3 THEN 'paper' ELSE 'document' END WHEN {_SUF} IN ({_in(files.OFFICE_SUFFIXES)}) THEN 'document' WHEN {_SUF} IN ({_in(files.VIDEO_SUFFIXES)}) THEN 'video' END"
_WORDS = "CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+'), lambda w: w <> '')) END"


@query("s01_detect", f"SELECT path, {_TYPE} AS file_type, ({_WORDS})::INT AS words FROM source_files WHERE path IS NOT NULL AND ({_TYPE}) IS NOT NULL AND NOT regexp_matches(path, '(^|/)(secrets|credentials|build|dist|out|target|env)/') AND NOT regexp_matches({_NAME}, '(?i)(token|secret|password|credential)')")
def _(s, d):
    return files.detect(_src(s, d))


@query("s01_corpus_size", f"SELECT count(*) AS files, coalesce(sum(words), 0)::BIGINT AS words, CASE WHEN sum(words) > 500000 OR count(*) > 500 THEN 'large' WHEN coalesce(sum(words), 0) < 50000 THEN 'small' END AS advice FROM (SELECT ({_WORDS}) AS words FROM source_files)")
def _(s, d):
    return files.corpus_size(_src(s, d).select(tx.word_count(F.col("text")).alias("words")))


@query("s02_classify", f"SELECT k AS path, CASE WHEN {_SUF} = '' AND {_NAME} NOT IN ({_in(files.MANIFESTS)}) THEN CASE WHEN text LIKE '#!/usr/bin/env python3%' THEN 'code' END ELSE {_TYPE} END AS file_type FROM (SELECT path AS k, CASE WHEN n_chars % 3 = 0 THEN regexp_replace(path, '\\.[^./]*$', '') ELSE path END AS path, CASE WHEN n_chars % 6 = 0 THEN '#!/usr/bin/env python3' || chr(10) || text ELSE text END AS text FROM source_files WHERE path IS NOT NULL)")
def _(s, d):
    bare, script = F.regexp_replace("path", r"\.[^./]*$", ""), F.concat(F.lit("#!/usr/bin/env python3\n"), "text")
    rows = _src(s, d).where("path IS NOT NULL").select("path", F.when(F.col("n_chars") % 3 == 0, bare).otherwise(F.col("path")).alias("p"), F.when(F.col("n_chars") % 6 == 0, script).otherwise(F.col("text")).alias("t"))
    return rows.select("path", files.file_type(F.col("p"), F.col("t")).alias("file_type"))


@query("s03_paper_signals", f"SELECT doc_id, ({_SIGNALS}) AS signals FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", files.paper_signals(F.col("text")).alias("signals"))


@query("s04_shebang")
def _(s, d):
    return _src(s, d).select("path", files.shebang(F.col("text")).alias("interpreter"))


_STEM = "split_part(regexp_replace(regexp_extract(p, '[^/]*$', 0), '^\\.+', ''), '.', 1)"
_KW = "(regexp_matches(st, '(?i)(^|[^a-zA-Z0-9])((credential|secret|passwd|password|private_key)s?|tokens?)$') OR (regexp_matches(st, '(?i)(^|[^a-zA-Z0-9])((credential|secret|passwd|password|private_key)s?|tokens?)([^a-zA-Z]|$)') AND len(list_filter(regexp_split_to_array(st, '[-_\\s]+'), lambda w: w <> '')) <= 2))"
_PATHS = "w AS (SELECT node_seq, replace(lower(label), ' ', '_') || '/' || label || '.txt' AS p FROM graph_nodes WHERE label IS NOT NULL AND regexp_full_match(label, '[A-Za-z0-9_ .-]+')), v AS (SELECT *, " + _STEM + " AS st FROM w)"


def _paths(s, d):
    n = table(s, d, "graph_nodes").where(r"label RLIKE '^[A-Za-z0-9_ .\\-]+\\z'")
    return n.select("node_seq", F.concat(F.replace(F.lower("label"), F.lit(" "), F.lit("_")), F.lit("/"), "label", F.lit(".txt")).alias("p"))


@query("s05_sensitive", f"WITH {_PATHS} SELECT node_seq, list_bool_or(list_transform(string_split(p, '/')[1:-2], lambda x: x IN ({_in(files.SECRET_DIRS)}))) OR regexp_matches(regexp_extract(p, '[^/]*$', 0), '(?i)(service.account|aws_credentials|gcloud_credentials)') OR {_KW} AS sensitive FROM v")
def _(s, d):
    return _paths(s, d).select("node_seq", files.sensitive(F.col("p")).alias("sensitive"))


@query("s06_keyword_hit", f"WITH {_PATHS} SELECT node_seq, {_KW} AS hit FROM v")
def _(s, d):
    return _paths(s, d).select("node_seq", files.keyword_hit(F.regexp_extract("p", "[^/]*$", 0)).alias("hit"))


@query("s05_sensitive_files")
def _(s, d):
    return _src(s, d).where("path IS NOT NULL").select("path", files.sensitive(F.col("path")).alias("sensitive"))


@query("s06_keyword_hit_files")
def _(s, d):
    return _src(s, d).where("path IS NOT NULL").select("path", files.keyword_hit(F.regexp_extract("path", "[^/]*$", 0)).alias("hit"))


PATTERNS = [("", "attic/"), ("", "docs/**/reader_*"), ("", "!docs/notes/reader_*"), ("docs", "/reports/*.md"), ("", "*.rst"), ("", "*.RST")]


@query("s07_ignored")
def _(s, d):
    return files.with_match(_src(s, d).select("path"), PATTERNS)


@query("s09_included")
def _(s, d):
    return files.with_match(_src(s, d).select("path"), [("", "docs/*"), ("", "/attic/*.txt")], "included", include=True)


@query("s10_noise", f"WITH v AS (SELECT node_seq, repo || '/' || split_part(replace(id, '_', '/'), '/', 2) || '/' || coalesce(source_file, '') AS p FROM graph_nodes WHERE id IS NOT NULL) SELECT node_seq, coalesce(len(list_filter(string_split(p, '/')[1:-2], lambda x: x IN ({_in(files.NOISE_DIRS)}) OR regexp_matches(x, '(_venv|_env|\\.egg-info)$'))) > 0, false) OR regexp_extract(p, '[^/]*$', 0) IN ({_in(files.LOCK_FILES)}) AS noise FROM v")
def _(s, d):
    n = table(s, d, "graph_nodes").where("id IS NOT NULL")
    p = F.concat("repo", F.lit("/"), F.get(F.split(F.replace("id", F.lit("_"), F.lit("/")), "/"), F.lit(1)), F.lit("/"), F.coalesce("source_file", F.lit("")))
    return n.withColumn("p", F.coalesce(p, F.concat("repo", F.lit("//"), F.coalesce("source_file", F.lit(""))))).select("node_seq", files.noise(F.col("p")).alias("noise"))


@query("s11_count_words", f"SELECT doc_id, ({_WORDS})::INT AS words FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", tx.word_count(F.col("text")).alias("words"))


_URL = "CASE WHEN contains(lower(url), 'twitter.com') OR contains(lower(url), 'x.com') THEN 'tweet' WHEN contains(lower(url), 'arxiv.org') THEN 'arxiv' WHEN contains(lower(url), 'github.com') THEN 'github' WHEN contains(lower(url), 'youtube.com') OR contains(lower(url), 'youtu.be') THEN 'youtube' WHEN ends_with(pp, '.pdf') THEN 'pdf' WHEN regexp_matches(pp, '\\.(png|jpg|jpeg|webp|gif)$') THEN 'image' ELSE 'webpage' END"


@query("s32_url_type", f"WITH u AS (SELECT doc_id, 'https://' || CASE doc_id % 4 WHEN 0 THEN 'arxiv.org' WHEN 1 THEN 'github.com' WHEN 2 THEN 'example.org' ELSE 'graph.dev' END || '/' || coalesce(path, '') || CASE doc_id % 3 WHEN 0 THEN '.PDF?x=1' WHEN 1 THEN '.png#a' ELSE '' END AS url FROM documents), v AS (SELECT *, lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)) AS pp FROM u) SELECT doc_id, {_URL} AS url_type FROM v")
def _(s, d):
    host = F.get(F.array(*[F.lit(h) for h in ("arxiv.org", "github.com", "example.org", "graph.dev")]), (F.col("doc_id") % 4).cast("int"))
    end = F.get(F.array(F.lit(".PDF?x=1"), F.lit(".png#a"), F.lit("")), (F.col("doc_id") % 3).cast("int"))
    return table(s, d, "documents").select("doc_id", files.url_type(F.concat(F.lit("https://"), host, F.lit("/"), F.coalesce("path", F.lit("")), end)).alias("url_type"))


@query("s33_html_text", "WITH h AS (SELECT doc_id, '<html><style>p {}</style><p class=a>' || text || '</p><script>x < 1;</script></html>' AS h FROM documents) SELECT doc_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\v\\f\\r]+', ' ', 'g')), 1, 8000) AS text FROM h")
def _(s, d):
    h = F.concat(F.lit("<html><style>p {}</style><p class=a>"), "text", F.lit("</p><script>x < 1;</script></html>"))
    return table(s, d, "documents").select("doc_id", files.html_text(h).alias("text"))


@query("s42_slices")
def _(s, d):
    return files.slices(_src(s, d), 2000)


@query("s44_packed_chunks")
def _(s, d):
    return files.pack_chunks(_src(s, d).select("path", tx.file_tokens(F.coalesce("n_chars", F.lit(0))).alias("tokens")), 20_000)


@query("s41_expanded_units")
def _(s, d):
    return files.expand_oversized(_src(s, d), 20_000)


@query("s45_file_tokens", "SELECT path, ((least(coalesce(n_chars, 0), 20000) + 160) // 4)::BIGINT AS tokens FROM source_files")
def _(s, d):
    return _src(s, d).select("path", tx.file_tokens(F.coalesce("n_chars", F.lit(0))).alias("tokens"))


# dedup


_KEY = f"trim(regexp_replace({form('coalesce(label, id)')}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_ASC = "regexp_replace(lower(coalesce(label, id)), '[^\\x00-\\x7f]', '?', 'g')"
_CAND = f"c AS (SELECT id, seq, trim(regexp_replace({_ASC}, '[^a-z0-9]+', ' ', 'g')) AS key, source_file AS f, file_type AS ty, community AS cm FROM n WHERE file_type IS DISTINCT FROM 'code')"
_PAIRS = f"{_CAND}, p AS (SELECT a.id AS a, b.id AS b, a.key AS ak, b.key AS bk, coalesce(a.f, '') AS af, coalesce(b.f, '') AS bf, a.ty AS at, b.ty AS bt FROM c a JOIN c b ON a.cm = b.cm AND a.seq < b.seq AND a.key <> '' AND substr(a.key, 1, 3) = substr(b.key, 1, 3))"
_SCORED = f"{_PAIRS}, q AS (SELECT *, 100 * CASE WHEN af <> bf AND greatest(length(ak), length(bk)) >= 12 THEN jaro_similarity(ak, bk) ELSE jaro_winkler_similarity(ak, bk) END AS score FROM p)"


def _pairs(s, d):
    """Given candidates: non-code nodes of one community whose labels begin alike, compared in an
    ASCII rendering (the other engine compares bytes)."""
    n = graph(s, d).nodes.where("file_type <> 'code'")
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("label", "id")), r"[^\x00-\x7f]", "?"), "[^a-z0-9]+", " "))
    n = n.select("id", "seq", key.alias("key"), "source_file", "file_type", "community").where("key <> ''").withColumn("k", F.substring("key", 1, 3))
    side = lambda x: n.select("community", "k", F.col("id").alias(x), F.col("seq").alias(f"{x}_seq"), F.col("key").alias(f"{x}_key"), F.col("source_file").alias(f"{x}_file"), F.col("file_type").alias(f"{x}_type"))
    return side("a").join(side("b"), ["community", "k"]).where("a_seq < b_seq").withColumn("same_community", F.lit(True))


def _resolved(s, d):
    """The pairs that entity resolution scores: of all nodes, by shared bands."""
    cands = materialize(dedup.candidates(graph(s, d).nodes), "candidates")
    return dedup.described_pairs(dedup.band_pairs(cands), cands)


@query("d02_norm_label")
def _(s, d):
    return graph(s, d).nodes.select("id", dedup.norm_label(F.coalesce("label", "id")).alias("key"))


@query("d03_entropy", sql(f"{_CAND}, ch AS (SELECT id, key, unnest(string_split(key, '')) AS ch FROM c WHERE key <> ''), k AS (SELECT id, ch, count(*) AS k, any_value(length(key)) AS len FROM ch WHERE ch <> '' GROUP BY 1, 2), en AS (SELECT id, -sum(k / len * log2(k / len)) AS en FROM k GROUP BY 1) SELECT c.id, round(coalesce(en, 0.0), 9) AS entropy FROM c LEFT JOIN en ON en.id = c.id", "n"))
def _(s, d):
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("label", "id")), r"[^\x00-\x7f]", "?"), "[^a-z0-9]+", " "))
    return graph(s, d).nodes.where("file_type <> 'code'").select("id", F.round(tx.entropy(key), 9).alias("entropy"))


@query("d04_shingles", sql(f"{_CAND}, t AS (SELECT id, replace(key, ' ', '') AS t FROM c), x AS (SELECT id, t, unnest(range(1, greatest(length(t) - 1, 2))) AS i FROM t WHERE t <> '') SELECT id, count(DISTINCT substr(t, i, 3)) AS shingles FROM x GROUP BY id", "n"))
def _(s, d):
    key = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("label", "id")), r"[^\x00-\x7f]", "?"), "[^a-z0-9]+", "")
    return graph(s, d).nodes.where("file_type <> 'code'").where(key != "").select("id", F.size(tx.trigrams(key)).cast("long").alias("shingles"))


@query("d07_band_pairs")
def _(s, d):
    return dedup.band_pairs(dedup.candidates(graph(s, d).nodes))


@query("d08_scores", sql(f"{_SCORED} SELECT a, b, round(jaro_similarity(ak, bk), 6) AS jaro, round(jaro_winkler_similarity(ak, bk), 6) AS jaro_winkler, round(score, 6) AS score FROM q", "n"))
def _(s, d):
    return _scores(_pairs(s, d))


@query("d08_resolved_scores")
def _(s, d):
    return _scores(_resolved(s, d))


def _scores(pairs):
    rows = dedup.scored(pairs)
    return rows.select("a", "b", F.round(jaro(F.col("a_key"), F.col("b_key")), 6).alias("jaro"), F.round(jaro_winkler(F.col("a_key"), F.col("b_key")), 6).alias("jaro_winkler"), F.round("score", 6).alias("score"))


_VAR = "'^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$'"
_VARIANT = f"(ak <> bk AND greatest(length(ak), length(bk)) < 12 AND regexp_matches(ak, {_VAR}) AND regexp_matches(bk, {_VAR}) AND regexp_extract(ak, {_VAR}, 1) = regexp_extract(bk, {_VAR}, 1) AND regexp_extract(ak, {_VAR}, 2) <> regexp_extract(bk, {_VAR}, 2))"
_RUNS = "list_sort(list_transform(regexp_extract_all({x}, '[0-9]+'), lambda t: CASE WHEN ltrim(t, '0') = '' THEN '0' ELSE ltrim(t, '0') END))"
_NUMS = f"(ak <> bk AND {_RUNS.format(x='ak')} <> {_RUNS.format(x='bk')})"
_EXT = "(ak <> bk AND (starts_with(ak, bk) OR starts_with(bk, ak)))"
_ANCH = "((coalesce(at IN ('rationale', 'document'), false) OR coalesce(bt IN ('rationale', 'document'), false)) AND af <> bf)"


@query("d09_guards", sql(f"{_SCORED.replace('AS at', 'AS aty').replace('AS bt', 'AS bty')} SELECT a, b, {_VARIANT} AS variant, {_NUMS} AS numbers, {_EXT} AS extension, {_ANCH.replace('at IN', 'aty IN').replace('bt IN', 'bty IN')} AS anchored FROM q", "n"))
def _(s, d):
    return _guards(_pairs(s, d))


@query("d09_resolved_guards")
def _(s, d):
    return _guards(_resolved(s, d))


def _guards(p):
    a, b = F.col("a_key"), F.col("b_key")
    return p.select("a", "b", dedup.variant(a, b).alias("variant"), dedup.numbers_differ(a, b).alias("numbers"), dedup.extension(a, b).alias("extension"), dedup.anchored(p).alias("anchored"))


_VERIFIED = f"{_SCORED}, vf AS (SELECT a, b FROM q WHERE NOT {_VARIANT} AND NOT {_NUMS} AND NOT {_EXT} AND NOT {_ANCH} AND (greatest(length(ak), length(bk)) >= 12 OR (score >= 97 AND length(ak) = length(bk) AND damerau_levenshtein(ak, bk) <= 1)) AND score + CASE WHEN least(length(ak), length(bk)) >= 12 THEN 5 ELSE 0 END >= 92 AND (ak <> bk OR af = bf))".replace("AS at", "AS aty").replace("AS bt", "AS bty").replace("at IN", "aty IN").replace("bt IN", "bty IN")


@query("d12_verified_pairs", sql(f"{_VERIFIED} SELECT a, b FROM vf", "n"))
def _(s, d):
    return dedup.verified(_pairs(s, d)).select("a", "b")


@query("d12_resolved_pairs")
def _(s, d):
    return dedup.verified(_resolved(s, d)).select("a", "b")


_COMP = "pr AS (SELECT DISTINCT source AS a, target AS b FROM e WHERE relation IN ('semantically_similar_to', 'rationale_for')), ad AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), cw(id, r) AS (SELECT a, a FROM ad UNION SELECT ad.b, r FROM cw JOIN ad ON ad.a = cw.id WHERE r < ad.b)"


@query("d13_components", sql(f"{_COMP} SELECT id, min(r) AS root FROM cw GROUP BY id HAVING (SELECT count(*) FROM pr WHERE a <> b AND (a = id OR b = id)) > 0", "e", recursive=True))
def _(s, d):
    e = graph(s, d).edges.where("relation IN ('semantically_similar_to', 'rationale_for')")
    return dedup.components(e.select(F.col("source").alias("a"), F.col("target").alias("b")))


@query("d14_winners", sql(f"{_COMP}, m AS (SELECT id, min(r) AS root FROM cw GROUP BY id), w AS (SELECT m.root, arg_min(m.id, regexp_matches(m.id, '_c[0-9]+$')::INT * 1000000000000::HUGEINT + length(m.id) * 1000000000 + n.seq) AS new FROM m JOIN n ON n.id = m.id GROUP BY 1) SELECT m.id AS old, w.new FROM m JOIN w ON w.root = m.root WHERE m.id <> w.new", "e", recursive=True))
def _(s, d):
    g = graph(s, d)
    e = g.edges.where("relation IN ('semantically_similar_to', 'rationale_for')")
    return dedup.winners(dedup.components(e.select(F.col("source").alias("a"), F.col("target").alias("b"))), g.nodes)


@query("d01_resolved")
def _(s, d):
    g = graph(s, d)
    return dedup.resolve(g.nodes, g.edges)[2]


# incremental


_NOW = "now AS (SELECT path, mtime, text, md5(coalesce(text, '')) AS h FROM source_files WHERE n_chars % 11 <> 3 OR n_chars IS NULL)"
_MAN = "man AS (SELECT path, CASE WHEN n_chars % 2 = 0 THEN mtime ELSE mtime - 10 END AS mtime, CASE WHEN n_chars % 5 = 0 THEN md5('old') ELSE md5(coalesce(text, '')) END AS ast_hash, CASE WHEN n_chars % 7 = 0 THEN '' WHEN n_chars % 5 = 0 THEN md5('old') ELSE md5(coalesce(text, '')) END AS semantic_hash FROM source_files WHERE n_chars % 13 <> 4 OR n_chars IS NULL)"


def _now(s, d):
    return _src(s, d).where("n_chars % 11 <> 3 OR n_chars IS NULL")


def _manifest(s, d):
    h, old = incremental.content_hash(F.col("text")), F.md5(F.lit("old").cast("binary"))
    n = F.col("n_chars")
    return _src(s, d).where("n_chars % 13 <> 4 OR n_chars IS NULL").select(
        "path", F.when(n % 2 == 0, F.col("mtime")).otherwise(F.col("mtime") - 10).alias("mtime"), F.when(n % 5 == 0, old).otherwise(h).alias("ast_hash"), F.when(n % 7 == 0, "").when(n % 5 == 0, old).otherwise(h).alias("semantic_hash")
    )


@query("i01_changes", f"WITH {_NOW}, {_MAN} SELECT coalesce(now.path, man.path) AS path, CASE WHEN now.path IS NULL THEN 'deleted' WHEN man.path IS NULL OR semantic_hash = '' OR (now.mtime IS DISTINCT FROM man.mtime AND h <> semantic_hash) THEN 'new' ELSE 'unchanged' END AS status FROM now FULL JOIN man ON now.path = man.path")
def _(s, d):
    return incremental.changes(_now(s, d), _manifest(s, d))


@query("i02_manifest", f"WITH {_NOW}, {_MAN} SELECT coalesce(now.path, man.path) AS path, CASE WHEN now.path IS NULL THEN man.mtime ELSE now.mtime END AS mtime, CASE WHEN now.path IS NULL THEN ast_hash ELSE h END AS ast_hash, CASE WHEN now.path IS NULL THEN semantic_hash WHEN h = coalesce(ast_hash, '') THEN coalesce(semantic_hash, '') ELSE '' END AS semantic_hash FROM now FULL JOIN man ON now.path = man.path")
def _(s, d):
    return incremental.save_manifest(_now(s, d), _manifest(s, d), "ast")


_BODY = r"regexp_replace(text, '(?s)\A---[ \t]*\r?\n(?:.*?\n)??---([ \t]*\r?(?:\n|\z))', '\1')"


@query("i04_file_hash", f"SELECT path, sha256(encode(CASE WHEN {_SUF} = '.md' THEN {_BODY.replace('text', 't')} ELSE t END) || '\\x00'::BLOB || encode(lower(path))) AS hash FROM (SELECT path, coalesce(text, '') AS t FROM source_files)")
def _(s, d):
    return _src(s, d).select("path", incremental.file_hash(F.col("path"), F.col("text")).alias("hash"))


@query("i05_body", f"SELECT doc_id, md5({_BODY}) AS body FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(files.body(F.col("text")).cast("binary")).alias("body"))


@query("i07_cache_check", f"WITH x AS (SELECT path, n_chars, {SQL['i04_file_hash'].split(' AS hash')[0].split('SELECT path, ')[1]} AS h FROM (SELECT path, n_chars, coalesce(text, '') AS t FROM source_files)), k AS (SELECT DISTINCT h FROM x WHERE n_chars % 3 = 0) SELECT path, h IN (SELECT h FROM k) AS hit FROM x")
def _(s, d):
    f = _src(s, d)
    cache = f.where("n_chars % 3 = 0").select(incremental.file_hash(F.col("path"), F.col("text")).alias("file_hash"))
    hits, misses = incremental.check_cache(f.select("path", "text"), cache)
    return hits.select("path", F.lit(True).alias("hit")).unionByName(misses.select("path", F.lit(False).alias("hit")))


_RB = """ch AS (SELECT DISTINCT source_file AS path FROM n WHERE seq % 4 = 0 AND source_file <> ''), dl AS (SELECT DISTINCT source_file AS path FROM n WHERE seq % 17 = 1 AND source_file <> ''),
gone AS (SELECT path FROM ch UNION SELECT path FROM dl), nw AS (SELECT * FROM n WHERE source_file IN (SELECT path FROM ch) AND seq % 3 <> 0),
nn AS (SELECT * FROM n WHERE source_file IS NULL OR source_file NOT IN (SELECT path FROM gone) UNION SELECT * FROM nw)"""


def _rebuilt(s, d):
    g = graph(s, d)
    n = g.nodes
    ch = n.where("seq % 4 = 0 AND source_file <> ''").select(F.col("source_file").alias("path")).distinct()
    dl = n.where("seq % 17 = 1 AND source_file <> ''").select(F.col("source_file").alias("path")).distinct()
    new = n.join(ch.withColumnRenamed("path", "source_file"), "source_file", "left_semi").where("seq % 3 <> 0").select(n.columns)
    again = g.edges.join(ch.withColumnRenamed("path", "source_file"), "source_file", "left_semi").where("seq % 5 <> 0").select(g.edges.columns)
    return g, incremental.rebuild(g, g.with_(nodes=new, edges=again), ch, dl), ch.unionByName(dl)


@query("i10_rebuilt_nodes", sql(f"{_RB} SELECT id, source_file FROM nn", "n"))
def _(s, d):
    return _rebuilt(s, d)[1].nodes.select("id", "source_file")


@query("i10_rebuilt_edges", sql(f"{_RB} SELECT seq FROM e WHERE (source_file IS NULL OR source_file NOT IN (SELECT path FROM gone) OR (source_file IN (SELECT path FROM ch) AND seq % 5 <> 0)) AND source IN (SELECT id FROM nn) AND target IN (SELECT id FROM nn)", "e"))
def _(s, d):
    return _rebuilt(s, d)[1].edges.select("seq")


@query("i11_lost_nodes", sql(f"{_RB} SELECT id, coalesce(source_file, '') = '' OR source_file IN (SELECT path FROM gone) AS explained FROM n WHERE id NOT IN (SELECT id FROM nn)", "n"))
def _(s, d):
    old, new, touched = _rebuilt(s, d)
    return incremental.lost_nodes(old.nodes, new.nodes, touched)


@query("i12_topology")
def _(s, d):
    return incremental.topology(graph(s, d))


@query("i14_merged_paths", "WITH a AS (SELECT path, 0 AS p, slice_id AS o FROM file_slices WHERE slice_id % 2 = 0 UNION ALL SELECT path, 1, slice_id FROM file_slices WHERE slice_id % 2 = 1), f AS (SELECT path, min(p * 1000000000000 + o) AS k FROM a WHERE path <> '' GROUP BY path) SELECT path, row_number() OVER (ORDER BY k, path) - 1 AS ord FROM f")
def _(s, d):
    f = table(s, d, "file_slices").withColumnRenamed("slice_id", "ord")
    return incremental.merge_paths([f.where("ord % 2 = 0"), f.where("ord % 2 = 1")])


# symbols

_CALLS = "cl AS (SELECT er.seq, er.source AS caller, regexp_replace(t.label, '[()]+$', '') AS callee, er.seq % 5 = 0 AS member, er.source_file FROM er JOIN n t ON t.id = er.target WHERE er.relation = 'calls' AND t.label IS NOT NULL)"
_CK = "lower(ltrim(rtrim(ltrim(trim(label), '()'), '()'), '.'))"
_SYM = f"rs AS (SELECT *, {_CK} AS key FROM n WHERE file_type = 'code' AND trim(label) <> '' AND NOT regexp_matches(trim(label), '\\.(py|js|ts|tsx|java|go|rs)$') AND {_CK} <> ''), known AS (SELECT DISTINCT source, target FROM e WHERE relation = 'calls' AND confidence = 'EXTRACTED' AND seq % 2 = 0)"


def _raw_calls(s, d, g):
    from nodeloom.functions.ids import normalize_id

    e = table(s, d, "graph_edges").select(F.col("edge_seq").alias("seq"), normalize_id("source").alias("caller"), normalize_id("target").alias("target"), normalize_id("relation").alias("relation"), "source_file").where("relation = 'calls' AND caller <> '' AND target <> ''")
    t = g.nodes.where("label IS NOT NULL").select(F.col("id").alias("target"), F.regexp_replace("label", r"[()]+$", "").alias("callee"))
    return e.join(t, "target").select("seq", "caller", "callee", (F.col("seq") % 5 == 0).alias("is_member"), "source_file")


@query("x03_label_index", sql(f"{_SYM} SELECT key, count(*) AS ids FROM rs GROUP BY key", "e"))
def _(s, d):
    return symbols.resolvable(graph(s, d).nodes).groupBy("key").agg(F.count("*").alias("ids"))


@query("x04_known_pairs", sql("SELECT DISTINCT source, target FROM e WHERE relation = 'calls'", "e"))
def _(s, d):
    return symbols.call_pairs(graph(s, d).edges)


_STEM2 = "regexp_replace(regexp_extract(source_file, '[^/]*$', 0), '^(.+)\\.[^.]*$', '\\1')"
_UNIQ = f"us AS (SELECT {_STEM2} AS module, key, min(id) AS id FROM rs WHERE source_file LIKE '%.py' GROUP BY 1, 2 HAVING count(DISTINCT id) = 1)"


@query("x08_unique_symbols", sql(f"{_SYM}, {_UNIQ} SELECT module, key, id FROM us", "e"))
def _(s, d):
    return symbols.unique_symbols(graph(s, d).nodes)


@query("x09_imported_calls", sql(f"{_CALLS}, {_SYM}, {_UNIQ}, al AS (SELECT DISTINCT cl.source_file, trim(callee) AS local_name, us.module, us.key AS imported FROM cl JOIN us ON us.key = lower(trim(callee)) WHERE us.module <> 'none'), h AS (SELECT cl.caller AS source, us.id AS target, cl.seq, cl.source_file FROM cl JOIN al ON al.source_file = cl.source_file AND al.local_name = trim(cl.callee) JOIN us ON us.module = al.module AND us.key = al.imported WHERE NOT member AND callee <> '' AND cl.caller <> us.id AND NOT EXISTS (SELECT 1 FROM known k WHERE k.source = cl.caller AND k.target = us.id)) SELECT source, target, min(seq) AS seq, arg_min(source_file, seq) AS source_file FROM h GROUP BY 1, 2", "e"))
def _(s, d):
    g = graph(s, d)
    calls, unique = _raw_calls(s, d, g), symbols.unique_symbols(g.nodes)
    aliases = calls.select("source_file", F.trim("callee").alias("local_name"), F.lower(F.trim("callee")).alias("key")).join(unique, "key").select("source_file", "local_name", "module", F.col("key").alias("imported_name")).distinct()
    known = g.edges.where("confidence = 'EXTRACTED' AND seq % 2 = 0")
    return symbols.resolve_imported_calls(calls, aliases, g.nodes, known)


@query("x10_unique_calls", sql(f"{_CALLS}, {_SYM}, un AS (SELECT key, min(id) AS id FROM rs GROUP BY key HAVING count(DISTINCT id) = 1), h AS (SELECT caller AS source, un.id AS target, seq, source_file FROM cl JOIN un ON un.key = lower(trim(callee)) WHERE NOT member AND callee <> '' AND caller <> un.id AND NOT EXISTS (SELECT 1 FROM known k WHERE k.source = caller AND k.target = un.id)) SELECT source, target, min(seq) AS seq, arg_min(source_file, seq) AS source_file FROM h GROUP BY 1, 2", "e"))
def _(s, d):
    g = graph(s, d)
    return symbols.resolve_calls(_raw_calls(s, d, g), g.nodes, g.edges.where("confidence = 'EXTRACTED' AND seq % 2 = 0"))


_SCIP = "rf AS (SELECT node_seq AS ref, repo AS doc, label AS symbol FROM graph_nodes WHERE label IS NOT NULL AND repo IS NOT NULL), sy AS (SELECT CASE WHEN symbol_id % 2 = 0 THEN 'amber-graph' ELSE 'basalt-docs' END AS doc, display_name AS symbol, 'sym_' || symbol_id AS id FROM symbols), ow AS (SELECT doc, symbol, min(id) AS own FROM sy GROUP BY 1, 2), uo AS (SELECT symbol, min(id) AS only_id FROM sy GROUP BY 1 HAVING count(DISTINCT id) = 1)"


@query("s29_resolved_targets", f"WITH {_SCIP} SELECT ref, coalesce(own, only_id, 'stub_' || substr(sha1(rf.symbol), 1, 12)) AS target, CASE WHEN own IS NOT NULL THEN 'same document' WHEN only_id IS NOT NULL THEN 'unique' ELSE 'stub' END AS how FROM rf LEFT JOIN ow ON ow.doc = rf.doc AND ow.symbol = rf.symbol LEFT JOIN uo ON uo.symbol = rf.symbol")
def _(s, d):
    refs = table(s, d, "graph_nodes").where("label IS NOT NULL AND repo IS NOT NULL").select(F.col("node_seq").alias("ref"), F.col("repo").alias("doc"), F.col("label").alias("symbol"))
    sy = table(s, d, "symbols").select(F.when(F.col("symbol_id") % 2 == 0, "amber-graph").otherwise("basalt-docs").alias("doc"), F.col("display_name").alias("symbol"), F.concat(F.lit("sym_"), "symbol_id").alias("id"))
    return symbols.resolve_targets(refs, sy)


# events


@query("t01_debounced", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, count(*) AS events, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM g GROUP BY user_id, k")
def _(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.groupBy("user_id", F.session_window("ts", "1800 seconds")).agg(F.count("*").alias("events"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))
    return rows.select("user_id", "events", "first_us", "last_us")


@query("t02_distinct_changes", "SELECT user_id, event_type, time_bucket(INTERVAL '1 hour', ts) AS hour, min(event_id) AS first_event, count(*) AS changes FROM events GROUP BY 1, 2, 3")
def _(s, d):
    e = table(s, d, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return e.groupBy("user_id", "event_type", "hour").agg(F.min("event_id").alias("first_event"), F.count("*").alias("changes"))


@query("l06_community_samples", sql("k AS (SELECT n.*, row_number() OVER (PARTITION BY community, label ORDER BY seq, id) AS d FROM n WHERE community IS NOT NULL AND label <> ''), r AS (SELECT k.community, k.label, row_number() OVER (PARTITION BY k.community ORDER BY deg.degree DESC, k.seq, k.id) AS rank FROM k JOIN deg ON deg.id = k.id WHERE d = 1) SELECT community, label, rank::INT AS rank FROM r WHERE rank <= 12", "deg"))
def _(s, d):
    from pyspark.sql import Window

    from nodeloom.operators.build import degrees, simple

    g = simple(graph(s, d))
    one = g.nodes.where("community IS NOT NULL AND label <> ''").groupBy("community", "label").agg(F.min_by(F.struct("id", "seq"), F.struct("seq", "id")).alias("x")).select("community", "label", "x.*")
    return one.join(degrees(g), "id").withColumn("rank", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "seq", "id"))).where("rank <= 12").select("community", "label", "rank")


@query("l07_cost", "SELECT chunk_no, round(sum(coalesce(input_tokens, 0)) * 3.0::DOUBLE / 1e6 + sum(coalesce(output_tokens, 0)) * 15.0::DOUBLE / 1e6, 9) AS cost FROM fragments GROUP BY chunk_no")
def _(s, d):
    f = table(s, d, "fragments").groupBy("chunk_no").agg(F.sum(F.coalesce("input_tokens", F.lit(0))).alias("i"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("o"))
    return f.select("chunk_no", F.round(F.col("i") * 3.0 / 1e6 + F.col("o") * 15.0 / 1e6, 9).alias("cost"))


# sources and sinks


@query("a16_markdown_headings")
def _(s, d):
    from nodeloom.sources.extractors import extract

    rows = extract(_src(s, d))
    return rows.where("kind = 'node'").select("path", "id", "label", "line")


@query(
    "s38_normalized_nodes",
    sql("SELECT seq, json_extract_string(p, '$.id') AS id, coalesce(nullif(json_extract_string(p, '$.label'), ''), json_extract_string(p, '$.id')) AS label, 'unknown' AS community, coalesce(json_extract_string(p, '$.source_file'), '') AS source_file, coalesce(nullif(json_extract_string(p, '$.file_type'), ''), 'code') AS file_type FROM r WHERE json_extract_string(p, '$.id') <> ''", "r"),
)
def _(s, d):
    from nodeloom.plans.view import records
    from nodeloom.sources.graph_json import normalize_nodes

    return normalize_nodes(records(s, d).where("attrs['id'] <> ''").select("seq", "attrs")).select("seq", "id", "label", "community", "source_file", "file_type")


@query(
    "s39_normalized_edges",
    sql("SELECT seq, json_extract_string(p, '$.source') AS source, json_extract_string(p, '$.target') AS target, lower(coalesce(nullif(json_extract_string(p, '$.relation'), ''), 'relates')) AS relation, upper(coalesce(nullif(json_extract_string(p, '$.confidence'), ''), 'EXTRACTED')) AS confidence, coalesce(try_cast(json_extract_string(p, '$.weight') AS DOUBLE), 1.0::DOUBLE) AS confidence_score FROM r WHERE json_extract_string(p, '$.source') <> '' AND json_extract_string(p, '$.target') <> ''", "r"),
)
def _(s, d):
    from nodeloom.plans.view import records
    from nodeloom.sources.graph_json import normalize_edges

    return normalize_edges(records(s, d).select("seq", "attrs"))


def _cy(c: str) -> str:
    return f"replace(replace(regexp_replace({c}, '[\\x00-\\x08\\x0a-\\x1f]', '', 'g'), chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39))"


@query(
    "k02_cypher",
    sql(
        f"""SELECT 0 AS part, seq, 'MERGE (n:' || upper(substr(file_type, 1, 1)) || lower(substr(file_type, 2)) || ' {{id: ''' || {_cy('id')} || ''', label: ''' || {_cy('coalesce(label, id)')} || '''}});' AS line FROM n
UNION ALL SELECT 1, seq, 'MATCH (a {{id: ''' || {_cy('source')} || '''}}), (b {{id: ''' || {_cy('target')} || '''}}) MERGE (a)-[:' || CASE WHEN regexp_matches(upper(relation), '^[A-Z]') THEN upper(relation) ELSE 'RELATES_TO' END || ' {{confidence: ''' || coalesce(confidence, 'EXTRACTED') || '''}}]->(b);' FROM g""",
        "g",
    ),
)
def _(s, d):
    from nodeloom import sinks
    from nodeloom.operators.build import simple

    return sinks.cypher(simple(graph(s, d)))


@query("k05_graphml")
def _(s, d):
    from nodeloom import sinks
    from nodeloom.operators.build import simple

    return sinks.graphml(simple(graph(s, d)))


@query("k01_json_edges")
def _(s, d):
    from nodeloom.operators.build import simple
    from nodeloom.sources.graph_json import edge_rows

    return edge_rows(simple(graph(s, d)))


@query("k07_notes")
def _(s, d):
    from nodeloom import sinks
    from nodeloom.operators.build import simple

    return sinks.notes(simple(graph(s, d)))


@query("k10_articles")
def _(s, d):
    from nodeloom import sinks
    from nodeloom.operators.build import simple

    return sinks.articles(simple(graph(s, d)))


# more SQL

_WIDE_ASCII = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u212a\u03f2\u03f9"
_PLAIN_ASCII = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''") + "K\u03c2\u03a3"
_HALF = "".join(chr(c) for c in range(0xFF66, 0xFFA0))
_FULL = "".join({0xFF9E: "゙", 0xFF9F: "゚"}.get(c) or unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF66, 0xFFA0))
_WIDTH = f"translate(translate(coalesce(label, id), '{_HALF}', '{_FULL}'), '{_WIDE_ASCII}', '{_PLAIN_ASCII}')"
for _lig, _as in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl")):
    _WIDTH = f"replace({_WIDTH}, '{_lig}', '{_as}')"
SQL["d02_norm_label"] = sql(f"SELECT id, trim(regexp_replace(replace(replace(lower(nfc_normalize({_WIDTH})), 'ς', 'σ'), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS key FROM n", "n")


def _xml_sql(c: str) -> str:
    return f"replace(replace(replace(replace(regexp_replace(coalesce({c}, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _data_sql(key: str, c: str) -> str:
    return f"'<data key=\"{key}\">' || {_xml_sql(c)} || '</data>'"


SQL["k05_graphml"] = sql(
    f"SELECT 0 AS part, seq, '<node id=\"' || {_xml_sql('id')} || '\">' || {_data_sql('label', 'label')} || {_data_sql('file_type', 'file_type')} || {_data_sql('source_file', 'source_file')} || {_data_sql('community', 'coalesce(community, -1)::VARCHAR')} || '</node>' AS line FROM n "
    f"UNION ALL SELECT 1, seq, '<edge source=\"' || {_xml_sql('source')} || '\" target=\"' || {_xml_sql('target')} || '\">' || {_data_sql('relation', 'relation')} || {_data_sql('confidence', 'confidence')} || '</edge>' FROM g",
    "g",
)
SQL["s04_shebang"] = "SELECT path, CASE WHEN text LIKE '#!%' THEN regexp_extract(split_part(trim(split_part(substr(text, 3), chr(10), 1)), ' ', 1), '[^/]*$', 0) END AS interpreter FROM source_files"
_FILE = f"v AS (SELECT path, path AS p, {_STEM.replace('(p,', '(path,')} AS st FROM source_files WHERE path IS NOT NULL)"
_SECRET = " OR ".join(f"regexp_matches(regexp_extract(p, '[^/]*$', 0), '{p}')" for p in files.SECRET_NAMES)
SQL["s05_sensitive_files"] = f"WITH {_FILE} SELECT path, list_bool_or(list_transform(string_split(p, '/')[1:-2], lambda x: x IN ({_in(files.SECRET_DIRS)}))) OR {_SECRET} OR {_KW} AS sensitive FROM v"
SQL["s06_keyword_hit_files"] = f"WITH {_FILE} SELECT path, {_KW} AS hit FROM v"
_VERDICT = (
    "CASE WHEN regexp_full_match({x}, '.*\\.(rst|RST)(/.*)?') OR regexp_full_match({x}, 'docs/reports/.*\\.md') THEN true WHEN regexp_full_match({x}, 'docs/notes/reader_.*(/.*)?') THEN false "
    "WHEN regexp_full_match({x}, 'docs/.*/reader_.*(/.*)?') THEN true ELSE regexp_full_match({x}, '(.*/)?attic(/.*)?') END"
)
_LEADS = "list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))"
SQL["s07_ignored"] = f"SELECT path, list_bool_or(list_transform({_LEADS}, lambda x: {_VERDICT.format(x='x')})) AS ignored FROM source_files"
SQL["s09_included"] = "SELECT path, regexp_full_match(path, 'docs/.*') OR regexp_full_match(path, 'attic/.*\\.txt') AS included FROM source_files"


def _field(name: str, c: str, text: bool = True) -> str:
    return f"'\"{name}\":' || {f'to_json({c})::VARCHAR' if text else f'{c}::VARCHAR'}"


_SCORE_SQL = "coalesce(confidence_score, CASE confidence WHEN 'EXTRACTED' THEN 1.0::DOUBLE WHEN 'INFERRED' THEN 0.5 WHEN 'AMBIGUOUS' THEN 0.2 ELSE 1.0 END)"
SQL["k01_json_edges"] = sql(
    "SELECT seq, '{' || concat_ws(',', " + ", ".join([_field("source", "source"), _field("target", "target"), _field("relation", "relation"), _field("confidence", "confidence"), _field("confidence_score", _SCORE_SQL, False), _field("context", "context"), _field("source_file", "source_file"), _field("weight", "weight", False)]) + ") || '}' AS json FROM g", "g"
)


def _cut(text: str, start: str, most: int = 2000) -> str:
    """SQL of where files.slice_points ends the slice that begins at ``start``."""
    w = f"substr({text}, ({start}) + 1, {most})"
    led = lambda p: f"length(regexp_extract({w}, '(?s)^(.*{p})', 1))"
    heading = f"length(regexp_extract({w}, '(?s)^(.*\\n)#', 1))"
    return f"CASE WHEN length({text}) - ({start}) <= {most} THEN length({text}) WHEN {heading} >= 2 THEN ({start}) + {heading} WHEN {led(chr(92) + 'n' + chr(92) + 'n')} >= 3 THEN ({start}) + {led(chr(92) + 'n' + chr(92) + 'n')} WHEN {led(chr(92) + 'n')} >= 2 THEN ({start}) + {led(chr(92) + 'n')} ELSE ({start}) + {most} END"


SQL["s42_slices"] = f"""WITH RECURSIVE p(path, text, a, z, k) AS (SELECT path, text, 0::BIGINT, ({_cut('text', '0')})::BIGINT, 0 FROM source_files WHERE text IS NOT NULL
UNION ALL SELECT path, text, z, ({_cut('text', 'z')})::BIGINT, k + 1 FROM p WHERE z < length(text))
SELECT path, a AS start_pos, z AS end_pos, k::INT AS slice_no, (count(*) OVER (PARTITION BY path))::INT AS slice_total FROM p"""
SQL["s41_expanded_units"] = f"""WITH RECURSIVE l AS (SELECT path, text, coalesce(length(text) > 20000 AND {_SUF} IN ({_in(files.SPLITTABLE_SUFFIXES)}), false) AS large FROM source_files),
p(path, text, a, z, k) AS (SELECT path, text, 0::BIGINT, ({_cut('text', '0', 20_000)})::BIGINT, 0 FROM l WHERE large UNION ALL SELECT path, text, z, ({_cut('text', 'z', 20_000)})::BIGINT, k + 1 FROM p WHERE z < length(text))
SELECT path, a AS start_pos, z AS end_pos, k::INT AS slice_no, (count(*) OVER (PARTITION BY path))::INT AS slice_total FROM p UNION ALL SELECT path, NULL, NULL, NULL, NULL FROM l WHERE NOT large"""
SQL["s44_packed_chunks"] = f"""WITH RECURSIVE t AS (SELECT path, ((least(coalesce(n_chars, 0), 20000) + 160) // 4)::BIGINT AS tokens, ({_SUF} IN ({_in(IMAGE_SUFFIXES)}))::INT AS image FROM source_files WHERE path IS NOT NULL),
o AS (SELECT *, row_number() OVER (ORDER BY regexp_extract(path, '^(.*)/[^/]*$', 1), path) - 1 AS n FROM t),
p(n, path, chunk, used, seen) AS (SELECT n, path, 0::BIGINT, tokens, image FROM o WHERE n = 0 UNION ALL SELECT o.n, o.path, CASE WHEN used + tokens > 20000 OR (image = 1 AND seen >= 20) THEN chunk + 1 ELSE chunk END, CASE WHEN used + tokens > 20000 OR (image = 1 AND seen >= 20) THEN tokens ELSE used + tokens END, CASE WHEN used + tokens > 20000 OR (image = 1 AND seen >= 20) THEN image ELSE seen + image END FROM p JOIN o ON o.n = p.n + 1)
SELECT path, chunk FROM p"""
