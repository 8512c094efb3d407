import random

import pytest

from nodeloom.functions.ids import normalize_id_py
from nodeloom.operators import orphans

NODES = "node_seq long, id string, arrived_at timestamp_ntz, removed_at timestamp_ntz, extra string"
EDGES = "edge_seq long, source string, target string, arrived_at timestamp_ntz, extra string"


def brute(nodes, edges):
    there = {}
    for _, i, a, r, _ in nodes:
        if i and a:
            there.setdefault(normalize_id_py(i), []).append((a, r))
    out = set()
    for seq, s, t, at, _ in edges:
        for name, ref in (("source", s), ("target", t)):
            if ref and at and normalize_id_py(ref):
                if not any(a <= at and (r is None or r > at) for a, r in there.get(normalize_id_py(ref), [])):
                    out.add((seq, name))
    return out


def random_tables(at, seed, n=400):
    r = random.Random(seed)
    ids = [None, "", "--", "Hub", "hub ", "ｈｕｂ", "a.b", "A-B", "ß", "SS"] + [f"n{i}" for i in range(20)]
    nodes = []
    for k in range(n // 4):
        a = r.choice([None] + [at(r.randrange(60)) for _ in range(9)])
        nodes.append((k, r.choice(ids), a, r.choice([None, at(r.randrange(90))]), "x"))
    weighted = ids + ["hub"] * 15
    edges = [(k, r.choice(weighted), r.choice(weighted), r.choice([None] + [at(r.randrange(90)) for _ in range(20)]), "y") for k in range(n)]
    return nodes, edges


def frames(spark, nodes, edges):
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def waiting_at_end(nodes, edges):
    there = {normalize_id_py(i) for _, i, a, r, _ in nodes if i and a and r is None}
    return {(seq, name, at) for seq, s, t, at, _ in edges for name, ref in (("source", s), ("target", t)) if ref and at and normalize_id_py(ref) and normalize_id_py(ref) not in there}


@pytest.mark.parametrize("seed,share", [(1, 0.125), (2, 1.0)])
def test_found_and_waiting_equal_brute_force(spark, at, seed, share):
    nodes, edges = random_tables(at, seed)
    n, e = frames(spark, nodes, edges)
    fold = orphans.fold_history(e, n, share)
    rows = fold.found().collect()
    assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == brute(nodes, edges)
    late = fold.waiting().collect()
    assert len(late) == len(set(late)) and {tuple(r) for r in late} == waiting_at_end(nodes, edges)


def test_rows_come_through_the_stored_state(spark, at, monkeypatch):
    """The parent arrives in one step and is referred to in a later one: only the state knows it."""
    n, e = frames(spark, [(1, "p", at(3), None, None)], [(k, "p", None, at(40 + 30 * k), None) for k in range(3)])
    fold = orphans.fold_history(e, n, 0.1)
    assert len(fold.steps) > 2 and fold.found().collect() == []
    monkeypatch.setattr(orphans.Folded, "state", lambda self: None)
    assert orphans.fold_history(e, n, 0.1).found().count() == 3


def test_salted_hot_key_gives_the_same(spark, at):
    nodes, edges = random_tables(at, 3)
    n, e = frames(spark, nodes, edges)
    refs, parents = orphans.references(e), orphans.parent_events(n)
    from nodeloom.session import hot_buckets

    salts = hot_buckets(refs, ["k1", "k2"], factor=0.0, least=50)
    assert salts and max(salts.values()) > 1
    plain, salted = orphans.advance(None, refs, parents, {}), orphans.advance(None, refs, parents, salts)
    assert {tuple(r) for r in salted.found().collect()} == brute(nodes, edges)
    assert sorted(map(tuple, salted.state().collect())) == sorted(map(tuple, plain.state().collect()))
    steps = [orphans.fold_history(e, n, 0.2, s) for s in ({}, salts)]
    for rows in (lambda f: f.found(), lambda f: f.changes(), lambda f: f.state(), lambda f: f.waiting()):
        assert sorted(map(tuple, rows(steps[0]).collect())) == sorted(map(tuple, rows(steps[1]).collect()))
    assert {tuple(r) for r in steps[1].found().collect()} == brute(nodes, edges)


def test_steps_equal_all_at_once_and_snapshots_the_state(spark, at):
    nodes, edges = random_tables(at, 4)
    n, e = frames(spark, nodes, edges)
    fold, whole = orphans.fold_history(e, n, 0.2), orphans.fold_history(e, n, 1.0)
    assert len(fold.steps) > 1 and len(whole.steps) == 1
    assert {tuple(r) for s in fold.steps for r in s.found().collect()} == brute(nodes, edges)
    for rows in (lambda f: f.changes(), lambda f: f.state(), lambda f: f.waiting()):
        assert sorted(map(tuple, rows(fold).collect())) == sorted(map(tuple, rows(whole).collect()))
    last = {(r.endpoint, r.period): r.pending for r in whole.changes().collect()}
    for s in fold.steps:
        months = {(r.endpoint, r.period): r.pending for r in s.changes().collect()}
        assert all(last[k] == v for k, v in months.items())
        month = max(p for _, p in months)
        for x in ("source", "target"):
            waits = sum(r[f"n_{x}"] for r in s.state().where("present = 0").collect())
            assert last[x, month] == waits


def test_report_counts_resolved_and_reopened(spark, at):
    nodes = [(1, "p", at(40), at(70), None), (2, "p", at(75), None, None)]
    edges = [(1, "p", None, at(10), None), (2, "p", "", at(45), None), (3, "P", None, at(72), None)]
    n, e = frames(spark, nodes, edges)
    rows = {r.period: r for r in orphans.fold_history(e, n).changes().collect() if r.endpoint == "source"}
    assert (rows["2025-01"].new_orphans, rows["2025-01"].pending) == (1, 1)
    assert (rows["2025-02"].resolved, rows["2025-02"].pending) == (1, 0)
    march = rows["2025-03"]  # the parent goes: two wait again, a third joins them, all are resolved
    assert (march.reopened, march.new_orphans, march.resolved, march.pending) == (2, 1, 3, 0)


def test_empty_tables(spark):
    n, e = frames(spark, [], [])
    f = orphans.fold_history(e, n)
    assert f.found().collect() == [] and f.changes().collect() == [] and f.state().collect() == [] and f.waiting().collect() == []


def test_spans():
    assert orphans._spans([], 0.1) == []
    assert orphans._spans([("c", 1), ("a", 5), ("b", 5), ("d", 1)], 0.3) == [("a", "a"), ("b", "b"), ("c", "d")]
