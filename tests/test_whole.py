"""Jobs that must not be cut short: each result against brute force on a fixture."""

import re
import shutil
import time
import tracemalloc
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom import session
from nodeloom.functions.similarity import jaro_py, jaro_winkler_py, minhash_py
from nodeloom.operators import build, centrality, community, dedup
from nodeloom.plans import analyze_queries, build_queries, catalog, data_queries
from nodeloom.plans.view import simple
from nodeloom.schema import Graph
from nodeloom.session import written
from tests.test_graph import EDGE, NODE, adjacency, brandes, graph, random_pairs


@pytest.mark.parametrize("block", [16, 500])
def test_band_pairs_meet_all_of_a_large_bucket(spark, block):
    # repeated stems have the same shingles, so all labels share every bucket
    rows = [(f"n{i:03}", "abc" * i, repo) for i in range(2, 122) for repo in ("r", "s")]
    rows = [(f"{repo}{i}", key, repo) for i, key, repo in rows]
    got = [tuple(r) for r in dedup.band_pairs(spark.createDataFrame(rows, "id string, key string, repo string"), block).collect()]
    want = {p for repo in "rs" for p in combinations(sorted(i for i, _, r in rows if r == repo), 2)}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("held", [centrality.HELD, 0])
def test_betweenness_held_and_joined(spark, monkeypatch, held):
    monkeypatch.setattr(centrality, "HELD", held)
    monkeypatch.setattr(centrality, "CELLS", 100)
    pairs = [p for p in random_pairs(5, 10, 14) if p[0] != p[1]]
    nodes, edges = brandes(adjacency(pairs), sorted(adjacency(pairs)))
    a, b = centrality.betweenness(build.simple(graph(spark, pairs, isolated=["z"])))
    n = len(nodes)
    assert {r.id: pytest.approx(r.betweenness * n * (n - 1)) for r in a.collect() if r.id != "z"} == {k: v * (n - 1) * (n - 2) for k, v in nodes.items()}
    assert {(r.u, r.v): pytest.approx(r.betweenness * (n + 1) * n) for r in b.collect()} == {k: v * n * (n - 1) for k, v in edges.items()}


def test_registered_betweenness_is_exact_on_a_small_graph(spark, sf):
    g = simple(spark, sf)
    ids = sorted(r.id for r in g.nodes.select("id").collect())
    assert len(ids) <= 1000
    near = adjacency([(r.u, r.v) for r in g.edges.where("u <> v").collect()])
    nodes, edges = brandes(near, ids)
    got = {r.id: r.betweenness for r in catalog.QUERIES["g12_betweenness"](spark, sf).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in nodes.items()}
    got = {(r.u, r.v): r.betweenness for r in catalog.QUERIES["g13_edge_betweenness"](spark, sf).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in edges.items()}


def test_registered_questions_name_bridges(spark, sf, monkeypatch):
    pairs = [(f"{p}{i}", f"{p}{j}") for p in "ab" for i in range(4) for j in range(i)] + [("a0", "b0")]
    labels = {f"{p}{i}": f"{p}{i} label" for p in "ab" for i in range(4)}
    g = build.simple(graph(spark, pairs, labels=labels, communities={k: "ab".index(k[0]) for k in labels}))
    monkeypatch.setattr(analyze_queries, "simple", lambda s, d: g)
    got = [(r.kind, r.subject) for r in catalog.QUERIES["g11_questions"](spark, sf).collect()]
    assert got == [("bridge_node", "a0"), ("bridge_node", "b0")]


def test_registered_cycles_reach_five_files(spark, sf, monkeypatch):
    ring = [(f"f{i}", f"f{(i + 1) % 5}") for i in range(5)]
    g = build.simple(graph(spark, ring, relations=dict.fromkeys(ring, "imports_from")))
    monkeypatch.setattr(analyze_queries, "simple", lambda s, d: g)
    got = [tuple(r) for r in catalog.QUERIES["g15_import_cycles"](spark, sf).collect()]
    assert got == [(" > ".join(f"src/f{i}.py" for i in range(5)), 5)]


def test_labels_merge_in_all_scripts(spark, sf, monkeypatch):
    labels = {"a": "Caf\u00e9 Map", "ab": "cafe\u0301_map", "b": "Parser", "bb": "\uff30\uff41\uff52\uff53\uff45\uff52", "c": "\u0413\u0440\u0430\u0444", "cc": "\u0433\u0440\u0430\u0444!", "d": "\u56f3 \u8868", "dd": "\u56f3_\u8868", "e": "Stra\u00dfe", "ee": "STRASSE", "f": "cafe map"}
    g = graph(spark, [("a", "b")], labels=labels, isolated=labels)
    monkeypatch.setattr(build_queries, "graph", lambda s, d: g)
    got = {(r.old, r.new) for r in catalog.QUERIES["b11_merge_by_label"](spark, sf).collect()}
    assert got == {("ab", "a"), ("bb", "b"), ("cc", "c"), ("dd", "d"), ("ee", "e")}


def test_registered_pairs_equal_brute_force(spark, sf, monkeypatch):
    labels = ["knowledge graph extraction pipeline", "knowledge graph extraction pipelinee", "xknowledge graph extraction pipeline", "\u043f\u043e\u0441\u0442\u0440\u043e\u0435\u043d\u0438\u0435 \u0433\u0440\u0430\u0444\u0430 \u0437\u043d\u0430\u043d\u0438\u0439", "\u043f\u043e\u0441\u0442\u0440\u043e\u0435\u043d\u0438\u0435 \u0433\u0440\u0430\u0444\u0430 \u0437\u043d\u0430\u043d\u0438\u0438", "r\u00e9solution des entit\u00e9s nomm\u00e9es", "r\u00e9solution des entit\u00e9s nomm\u00e9\u00e9s", "unrelated words here"]
    rows = [(i, f"n{i}", x, "concept", f"f{i}.md", None, None if i % 3 == 0 else i % 3, "r") for i, x in enumerate(labels)]
    g = Graph(spark.createDataFrame(rows, NODE), spark.createDataFrame([], EDGE))
    monkeypatch.setattr(data_queries, "graph", lambda s, d: g)
    keys = {f"n{i}": dedup.norm_label_py(x) for i, x in enumerate(labels)}
    cut = lambda k: {(i, minhash_py(k)[9 * i : 9 * i + 9].tobytes()) for i in range(14)}
    want = {(a, b): (round(jaro_py(keys[a], keys[b]), 6), round(jaro_winkler_py(keys[a], keys[b]), 6)) for a, b in combinations(sorted(keys), 2) if cut(keys[a]) & cut(keys[b])}
    assert {("n0", "n1"), ("n3", "n4"), ("n5", "n6")} <= set(want)
    got = {q: catalog.QUERIES[q](spark, sf).collect() for q in ("d08_resolved_scores", "d09_resolved_guards", "d12_resolved_pairs")}
    assert {(r.a, r.b): (r.jaro, r.jaro_winkler) for r in got["d08_resolved_scores"]} == want
    assert {(r.a, r.b): r.extension for r in got["d09_resolved_guards"]} == {(a, b): keys[a].startswith(keys[b]) or keys[b].startswith(keys[a]) for a, b in want}
    together = lambda a, b: int(a[1:]) % 3 and int(a[1:]) % 3 == int(b[1:]) % 3
    same = {(a, b) for (a, b), (j, _) in want.items() if 100 * j + 5 * bool(together(a, b)) >= 92 and not keys[b].startswith(keys[a])}
    assert {(r.a, r.b) for r in got["d12_resolved_pairs"]} == same


def test_notes_hold_all_links_of_a_hub(spark):
    from nodeloom import sinks

    g = build.simple(graph(spark, [("hub", f"x{i:04}") for i in range(1201)]))
    rows = [r for r in sinks.notes(g).collect() if r.id == "hub"]
    links = [x for r in sorted(rows, key=lambda r: (len(r.file), r.file)) for x in r.text.splitlines() if x.startswith("- ")]
    assert links == [f"- [[x{i:04}]] calls" for i in range(1201)]
    assert len({r.file for r in rows}) == 3 and max(r.text.count("- [[") for r in rows) == 500


def test_registered_clusters_run_until_settled(spark, sf, monkeypatch):
    # a ring of cliques, its communities known: two rounds leave fragments
    pairs = [(f"{c:02}_{i}", f"{c:02}_{j}") for c in range(12) for i in range(8) for j in range(i)] + [(f"{c:02}_0", f"{(c + 1) % 12:02}_1") for c in range(12)]
    g = build.simple(graph(spark, pairs))
    monkeypatch.setattr(analyze_queries, "simple", lambda s, d: g)
    of = {r.id: r.community for r in catalog.QUERIES["g16_clusters"](spark, sf).collect()}
    assert len({frozenset(x for x in of if of[x] == c) for c in of.values()}) == 12
    assert all(of[f"{c:02}_{i}"] == of[f"{c:02}_0"] for c in range(12) for i in range(8))


def test_real_paths_are_classified(spark, sf, monkeypatch):
    paths = ["docs/\u0437\u0430\u043c\u0435\u0442\u043a\u0430.md", ".ssh/caf\u00e9.txt", "a/api_token.txt", "a/\u00e9t\u00e9+plan (1).md", None]
    monkeypatch.setattr(data_queries, "_src", lambda s, d: spark.createDataFrame([(p,) for p in paths], "path string"))
    got = {r.path: r.sensitive for r in catalog.QUERIES["s05_sensitive_files"](spark, sf).collect()}
    assert got == {paths[0]: False, paths[1]: True, paths[2]: True, paths[3]: False}
    got = {r.path: r.hit for r in catalog.QUERIES["s06_keyword_hit_files"](spark, sf).collect()}
    assert got == {paths[0]: False, paths[1]: False, paths[2]: True, paths[3]: False}


def test_registered_node_betweenness_is_exact_above_a_thousand_nodes(spark, sf, monkeypatch):
    # a path of 1,202 nodes: node i is between i * (n - 1 - i) pairs
    n = 1202
    g = build.simple(graph(spark, [(f"{i:04}", f"{i + 1:04}") for i in range(n - 1)]))
    monkeypatch.setattr(analyze_queries, "simple", lambda s, d: g)
    got = {r.id: r.betweenness for r in catalog.QUERIES["g12_betweenness"](spark, sf).collect()}
    assert got == {f"{i:04}": pytest.approx(2 * i * (n - 1 - i) / ((n - 1) * (n - 2))) for i in range(n)}


def test_betweenness_joined_in_batches(spark, monkeypatch):
    monkeypatch.setattr(centrality, "HELD", 0)
    monkeypatch.setattr(centrality, "ROWS", 40)  # four pivots at a time
    pairs = [p for p in random_pairs(5, 10, 14) if p[0] != p[1]]
    nodes, edges = brandes(adjacency(pairs), sorted(adjacency(pairs)))
    mark = written()
    a, b = centrality.betweenness(build.simple(graph(spark, pairs)))
    assert written() - mark <= 6  # the tables of the batches are gone
    assert {r.id: pytest.approx(r.betweenness) for r in a.collect()} == nodes
    assert {(r.u, r.v): pytest.approx(r.betweenness) for r in b.collect()} == edges


def test_registered_edge_betweenness_is_exact_above_five_thousand_nodes(spark, sf, monkeypatch):
    # stars of 1,300 leaves in a row of four hubs: a leaf's link is on all paths of its leaf
    hubs, leaves = 4, 1300
    n = hubs * (leaves + 1)
    pairs = [(f"h{h}", f"l{h}{i:04}") for h in range(hubs) for i in range(leaves)] + [(f"h{h}", f"h{h + 1}") for h in range(hubs - 1)]
    g = build.simple(graph(spark, pairs))
    monkeypatch.setattr(analyze_queries, "simple", lambda s, d: g)
    got = {(r.u, r.v): r.betweenness * n * (n - 1) / 2 for r in catalog.QUERIES["g13_edge_betweenness"](spark, sf).collect()}
    side = leaves + 1
    want = {(u, v): (int(v[1]) * side * (n - int(v[1]) * side) if v[0] == "h" else n - 1) for u, v in pairs}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_registered_questions_skip_bridges_only_if_they_have_no_row(spark, sf, monkeypatch):
    n = 1202
    pairs = [(f"{i:04}", f"{i + 1:04}") for i in range(n - 1)]
    g = build.simple(graph(spark, pairs, communities={f"{i:04}": i % 2 for i in range(n)}))
    monkeypatch.setattr(analyze_queries, "simple", lambda s, d: g)
    got = {r.subject: r.detail for r in catalog.QUERIES["g11_questions"](spark, sf).collect() if r.kind == "bridge_node"}
    assert len(got) == 3 and {"0600", "0601"} < set(got) and got["0600"] == got["0601"] == "0.500"
    doubt = g.with_(edges=g.edges.withColumn("confidence", F.when(F.col("seq") >= 20, "AMBIGUOUS").otherwise(F.col("confidence"))))
    monkeypatch.setattr(analyze_queries, "simple", lambda s, d: doubt)
    monkeypatch.setattr(centrality, "betweenness", None)
    got = [tuple(r) for r in catalog.QUERIES["g11_questions"](spark, sf).collect()]
    assert got == [("ambiguous_edge", f"{a} -- {b}", "calls") for a, b in pairs[20:27]]


def test_clustering_of_a_level_ends_in_time():
    # a hub and loose communities: moved one by one in Python this took many passes of seconds each
    n, m = 40_000, 160_000
    rng = np.random.default_rng(7)
    x, y, kind = rng.integers(0, n, m), rng.integers(0, n, m), rng.random(m)
    y = np.where(kind < 0.1, 0, np.where(kind < 0.4, x // 400 * 400 + rng.integers(0, 400, m), y))
    x, y = np.unique(np.sort(np.stack([x, y])[:, x != y], axis=0), axis=1).astype(np.int32)
    began = time.process_time()
    of = community.local_moves(np.concatenate([x, y]), np.concatenate([y, x]), np.ones(2 * len(x)), n)
    assert time.process_time() - began < 6
    total = np.bincount(of, np.bincount(np.concatenate([x, y]), minlength=n))
    q = (of[x] == of[y]).mean() - (total**2).sum() / (2 * len(x)) ** 2
    assert q > 0.3
    again = community.local_moves(np.concatenate([x, y]), np.concatenate([y, x]), None, n)
    assert (again == of).all()


def test_registered_betweenness_stores_no_more_than_links(spark, sf, tmp_path):
    for name in ("graph_nodes", "graph_edges"):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path)
    mark = written()
    got = catalog.QUERIES["g12_betweenness"](spark, str(tmp_path)).count()
    tables = {re.search(r"nodeloom-(\w+)-", path)[1] for path in session._written[mark:]}
    assert "links" in tables and not {"edges", "simple", "adjacency"} & tables
    g = simple(spark, str(tmp_path))
    assert got == g.nodes.count()
    links = {(r.u, r.v) for r in g.links().collect()}
    assert links == {(r.u, r.v) for r in g.edges.collect()} == {(r.u, r.v) for r in g.links().collect()}


def test_betweenness_tasks_hold_a_graph_in_few_copies():
    # bytes by the link: 33 at most, 48 when keys were made from copies of both directions
    n, m = 50_000, 1_000_000
    ends = np.unique(np.sort(np.random.default_rng(3).integers(0, n, (m, 2), np.int32), axis=1), axis=0)
    tracemalloc.start()
    held = centrality.Held(n, ends)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 * len(ends)
    low, high = held.once()
    assert (np.stack([low, high], axis=1) == ends[ends[:, 0] < ends[:, 1]]).all()


def test_betweenness_tasks_sum_a_link_once():
    # in both directions, whatever the pivots that go together
    pairs = [p for p in random_pairs(9, 40, 70) if p[0] != p[1]]
    ids = sorted(adjacency(pairs))
    place = {x: i for i, x in enumerate(ids)}
    nodes, edges = brandes(adjacency(pairs), ids)
    ends = np.array(sorted({tuple(sorted((place[a], place[b]))) for a, b in pairs}), np.int32)
    got, links = centrality.accumulate(centrality.Held(len(ids), ends), np.arange(len(ids)))
    n = len(ids)
    assert got / ((n - 1) * (n - 2)) == pytest.approx([nodes[x] for x in ids])
    assert len(links) == len(ends) and links / (n * (n - 1)) == pytest.approx([edges[ids[a], ids[b]] for a, b in ends])
