import random
import unicodedata

import pytest

from nodeloom.llm import lookalikes as la

SYMBOLS = "symbol_id long, display_name string, kind string"
NODES = "node_seq long, label string, symbol_id string"


def wide(s):
    return "".join("　" if c == " " else chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in s)


CASES = [
    ("Raven Piper", "Rаven Piper", True), ("Raven Piper", "Raven Piper", True), ("Raven Piper", wide("Raven Piper"), True), ("Raven Piper", "Ra​ven Pip­er", True),
    ("Raven Piper", "raven Piper", False), ("Raven Piper", "Raven  Piper", False), ("Raven Piper", "Raven-Piper", False), ("Raven Piper", "RavenPiper", False),
    ("búsqueda", unicodedata.normalize("NFD", "búsqueda"), True), ("búsqueda", "busqueda", False), ("búsqueda", "bùsqueda", False),
    ("ノードデバッグ", unicodedata.normalize("NFD", "ノードデバッグ"), True), ("ノードデバッグ", "ﾉｰﾄﾞﾃﾞﾊﾞｯｸﾞ", True), ("ノードデバッグ", "ノートデバッグ", False),
    ("Разборщик", "Paзбopщик", True), ("reflex_1", "reﬂex_1", True), ("reflex_1", "reflex_l", False), ("a-b", "a‑b", True), ("a-b", "a_b", False), ("v2", "v²", False), ("Kelp", "Kelp", True),
]


@pytest.mark.parametrize("name,label,same", CASES)
def test_cases(name, label, same):
    assert bool(la.Trie([(1, name)]).search(label)) is same
    assert (la.classes(name) == la.classes(label)) is same


def damage(r, s):
    out = []
    for c in s:
        k = r.random()
        options = la.LOOKALIKES["latin"].get(c, "")
        if k < 0.3 and options:
            c = r.choice(options)
        elif k < 0.4:
            c = wide(c)
        elif k < 0.5:
            c = unicodedata.normalize("NFD", c)
        out.append(c + r.choice(["", "", "", "​", "⁠"]))
    return "".join(out)


def test_found_equals_brute_force_on_the_small_tables(spark, sf):
    from nodeloom.session import table

    nodes, symbols = table(spark, sf, "graph_nodes"), table(spark, sf, "symbols")
    got = {tuple(r) for r in la.same_reading(nodes, symbols).collect()}
    names = [(r.symbol_id, r.display_name, la.classes(r.display_name)) for r in symbols.collect()]
    want = {(n.node_seq, k) for n in nodes.collect() if n.label for k, name, c in names if name != n.label and la.classes(n.label) == c}
    assert got == want
    joined = {tuple(r) for r in la.same_reading(nodes, symbols, names_per_trie=10, labels_per_task=20).collect()}
    assert joined == want


def test_damaged_names_are_found_and_canonical(spark):
    r = random.Random(5)
    names = ["Lagoon Pocket Beacon", "granite.PocketKeeper", "búsqueda_Übersicht", "kelp_prairie_piper", "Onyx Echo 4"]
    labels = [(i * 10 + j, damage(r, n), "clash") for i, n in enumerate(names) for j in range(10)]
    symbols = spark.createDataFrame([(i, n, "k") for i, n in enumerate(names)], SYMBOLS)
    nodes = spark.createDataFrame(labels, NODES)
    got = {tuple(x) for x in la.same_reading(nodes, symbols).collect()}
    assert got == {(k, k // 10) for k, label, _ in labels if label != names[k // 10]}
    assert {(x.node_seq, x.canonical) for x in la.canonical_labels(nodes, symbols).collect()} == {(k, names[k // 10]) for k, *_ in labels}


def test_unmatched_labels_get_one_spelling():
    assert la.spell("Paзбopщик") == la.spell("Разборщик") == "Разборщик"
    assert la.spell("Rаven") == "Raven" and la.spell(wide("ab c")) == "ab c"


def test_rows_come_through_the_automaton(spark, monkeypatch):
    """With no free edges in the automaton only exact spellings (and ignorables) are reached."""
    trie = la.Trie([(1, "abc"), (2, "аbс"), (3, "xyz")])  # 2 has Cyrillic letters: a path of its own
    assert [k for _, k, _ in trie.search("abс")] == [1, 2] and len(trie.children) > 7
    monkeypatch.setattr(la, "_CLASS", {})
    strict = la.Trie([(1, "abc"), (2, "аbс")])
    assert [k for _, k, _ in strict.search("ab\u200bc")] == [1] and strict.search("abс") == []
    assert [(c, k) for c, k, _ in strict.search("abс", 1)] == [(1, 1), (1, 2)]


def test_canonical_is_the_same_with_many_tries(spark, sf):
    from nodeloom.session import table

    nodes, symbols = table(spark, sf, "graph_nodes"), table(spark, sf, "symbols")
    rows = [sorted(map(tuple, la.canonical_labels(nodes, symbols, **k).collect())) for k in ({}, {"names_per_trie": 100, "labels_per_task": 30})]
    assert rows[0] == rows[1] and len(rows[0]) == nodes.count()


def test_accents_in_any_order():
    trie = la.Trie([(1, "a\u0323\u0301b")])
    assert trie.search("a\u0301\u0323b") and trie.search("\u1ea1\u0301b") and not trie.search("a\u0301b\u0323")


def test_weighted_edits():
    trie = la.Trie([(1, "abc"), (2, "abd"), (3, "xyz")])
    assert [x[:2] for x in trie.search("аbс", 1)] == [(0, 1), (1, 2)]
    assert {x[1] for x in trie.search("ab", 1)} == {1, 2} and {x[1] for x in trie.search("abcd", 1)} == {1, 2}


def test_nulls_empty_and_clashing_columns(spark):
    symbols = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "a", "k"), (4, "а", "k")], SYMBOLS)
    nodes = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "​", "s"), (4, "a", "s"), (4, "a", "s")], NODES)
    got = sorted(tuple(r) for r in la.same_reading(nodes, symbols).collect())
    assert got == [(3, 2), (4, 4), (4, 4)]
    assert la.same_reading(nodes.limit(0), symbols).collect() == [] and la.same_reading(nodes, symbols.limit(0)).collect() == []
    assert [r.canonical for r in la.canonical_labels(nodes.where("label IS NULL"), symbols).collect()] == [None]
