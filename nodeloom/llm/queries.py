"""Queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

import unicodedata

from nodeloom.llm import copies, encode, lookalikes, packing, repetition, slicing
from nodeloom.session import table


def _records(spark, d):
    return {name: table(spark, d, name) for name in copies.RECORDS}


def _counts(spark, d):
    return encode.token_counts(table(spark, d, "documents"))


QUERIES = {
    "p1_found": lambda s, d: lookalikes.same_reading(table(s, d, "graph_nodes"), table(s, d, "symbols")),
    "p1_canonical": lambda s, d: lookalikes.canonical_labels(table(s, d, "graph_nodes"), table(s, d, "symbols")),
    "p2_found": lambda s, d: slicing.split_units(table(s, d, "file_slices"), table(s, d, "source_files")),
    "p4_found": lambda s, d: copies.found_copies(_records(s, d)),
    "p4_records": lambda s, d: copies.collapsed(_records(s, d)),
    "p5_ids": lambda s, d: encode.encode_texts(table(s, d, "documents")),
    "p6_containers": lambda s, d: packing.pack_budgets(_counts(s, d), table(s, d, "token_budgets")),
    "p7_found": lambda s, d: repetition.scored(table(s, d, "documents"), every=False).where("flagged").select("doc_id"),
    "p7_shares": lambda s, d: repetition.scored(table(s, d, "documents")),
}



def _reading(c: str) -> str:
    """SQL of what lookalikes.classes makes of a label, composed again."""
    one, more = {}, {}
    for ch in map(chr, sorted({*range(0xA0, 0x3100), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFF0), *map(ord, lookalikes._CLASS)})):
        read = unicodedata.normalize("NFC", lookalikes.classes(ch))
        if read != ch and read:
            (one if len(read) == 1 else more)[ch] = read
    q = lambda x: x.replace("'", "''")
    hidden = r"[\p{Cf}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{180B}-\x{180F}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{3164}\x{FFA0}\x00-\x08\x0E-\x1F\x7F-\x84\x86-\x9F]"
    x = f"translate(regexp_replace({c}, '{hidden}', '', 'g'), '{q(''.join(one))}' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133), '{q(''.join(one.values()))}      ')"
    for a, b in more.items():
        if a in "".join(map(chr, range(0xFB00, 0xFB07))):
            x = f"replace({x}, '{a}', '{q(b)}')"
    return f"nfc_normalize({x})"


_P1 = f"""WITH l AS MATERIALIZED (SELECT node_seq, label, {_reading("label")} AS k FROM graph_nodes WHERE label IS NOT NULL), s AS MATERIALIZED (SELECT symbol_id, display_name, {_reading("display_name")} AS k FROM symbols WHERE display_name IS NOT NULL)
SELECT node_seq, symbol_id FROM l JOIN s ON s.k = l.k WHERE label <> display_name"""
_P2 = r"""WITH RECURSIVE ln AS (SELECT path, n, line, (coalesce(sum(length(line)) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS pos,
    coalesce(sum(starts_with(line, '```')::INT) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS fenced, lag(line) OVER (PARTITION BY path ORDER BY n) AS above
  FROM (SELECT path, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM (SELECT path, regexp_extract_all(text, '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$') AS lines FROM source_files WHERE text <> ''))),
b AS MATERIALIZED (SELECT path, pos, CASE WHEN fenced = 0 AND regexp_matches(line, '^#{1,6}[ \t]') THEN 3 WHEN regexp_full_match(above, '[ \t]*(\r\n|\r|\n)') THEN 2 ELSE 1 END AS strength FROM ln),
u AS MATERIALIZED (SELECT slice_id, s.path, coalesce(start_pos, 0) AS a, least(coalesce(end_pos, length(text)), length(text)) AS z, max_chars AS m, overlap_chars AS o FROM file_slices s JOIN source_files f ON f.path = s.path WHERE text <> '' AND least(coalesce(end_pos, length(text)), length(text)) - coalesce(start_pos, 0) > max_chars),
p(slice_id, path, z, m, o, piece_start, piece_end) AS (
  SELECT slice_id, path, z, m, o, a, CASE WHEN z - a <= m THEN z ELSE coalesce((SELECT arg_max(b.pos, b.strength * 1000000000::BIGINT + b.pos) FROM b WHERE b.path = u.path AND b.pos > u.a + u.o AND b.pos <= u.a + u.m), u.a + u.m) END FROM u
  UNION ALL SELECT slice_id, path, z, m, o, s, CASE WHEN z - s <= m THEN z ELSE coalesce((SELECT arg_max(b.pos, b.strength * 1000000000::BIGINT + b.pos) FROM b WHERE b.path = q.path AND b.pos > q.s + q.o AND b.pos <= q.s + q.m), q.s + q.m) END
  FROM (SELECT *, piece_end - o AS s FROM p WHERE piece_end < z) q)
SELECT slice_id, piece_start, piece_end FROM p"""


def _letters(c: str) -> str:
    return f"regexp_replace(lower(nfc_normalize({c})), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def _copies(name: str) -> str:
    key, fields = copies.RECORDS[name]
    numbers = ("community", "confidence_score", "weight")
    by = ", ".join(f if f in numbers else _letters(f) for f in fields)
    return f"SELECT '{name}' AS table_name, min({key}) OVER (PARTITION BY {by}) AS first_key, {key} AS copy_key FROM {name}"


_VALUE = "json_extract_string(p, '$.\"' || k || '\"')"
_FRAGMENTS = f"""f AS (SELECT fragment_id, payload AS p FROM fragments WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
kv AS (SELECT fragment_id, p, unnest(json_keys(p)) AS k FROM f),
c AS (SELECT fragment_id, list(k || CASE json_type(p, '$."' || k || '"') WHEN 'VARCHAR' THEN ':s' || {_letters(_VALUE)} WHEN 'NULL' THEN ':z' WHEN 'DOUBLE' THEN ':n' || {_VALUE}::DOUBLE WHEN 'BIGINT' THEN ':n' || {_VALUE}::DOUBLE WHEN 'UBIGINT' THEN ':n' || {_VALUE}::DOUBLE ELSE ':o' || {_VALUE} END ORDER BY k) AS r FROM kv GROUP BY 1)"""
_CJK = r"[\x{2E80}-\x{2FDF}\x{3005}-\x{3007}\x{3021}-\x{3029}\x{3040}-\x{309A}\x{309D}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{20000}-\x{3FFFF}]"
SQL: dict[str, str] = {
    "p1_found": _P1,
    "p2_found": _P2,
    "p4_found": f"WITH {_FRAGMENTS}, x AS ({_copies('graph_nodes')} UNION ALL {_copies('graph_edges')} UNION ALL SELECT 'fragments', min(fragment_id) OVER (PARTITION BY r), fragment_id FROM c) SELECT * FROM x WHERE first_key <> copy_key",
    "p4_records": f"WITH {_FRAGMENTS}, x AS ({_copies('graph_nodes')} UNION ALL {_copies('graph_edges')} UNION ALL SELECT 'fragments', min(fragment_id) OVER (PARTITION BY r), fragment_id FROM c) SELECT table_name, first_key, count(*) AS copies FROM x GROUP BY 1, 2",
    "p7_found": rf"""WITH w AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(nfc_normalize(text)), '({_CJK})', ' \1 ', 'g'), '[\p{{L}}\p{{Nl}}\p{{No}}]+') AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, len(ws) AS k, i, array_to_string(ws[i:i+7], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - 6)) AS i FROM w)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) AS rn FROM g),
c AS (SELECT DISTINCT doc_id, k, p FROM (SELECT doc_id, k, unnest(range(i, i + 8)) AS p FROM r WHERE rn > 1))
SELECT doc_id FROM c GROUP BY doc_id, k HAVING count(*) * 5 >= k * 2""",
}
