import random
import time
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from nodeloom.llm import packing


def one_by_one(sizes, capacity):
    """Best fit decreasing, item by item: number of containers."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
            rooms[i] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def contents(patterns):
    return Counter({}) + sum((Counter({s: q * n}) for p, n in patterns for s, q in p), Counter())


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_equals_item_by_item(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 100, 512])
    counts = Counter(r.choice([r.randrange(1, capacity + 1), 1 + capacity // 3, 2]) for _ in range(300))
    got = packing.best_fit(counts, capacity)
    rooms = sorted(capacity - sum(s * q for s, q in p) for p, n in got for _ in range(n))
    assert rooms == one_by_one(counts.elements(), capacity) and contents(got) == counts


def optimum(sizes, capacity):
    best = [len(sizes)]

    def go(rest, rooms):
        if len(rooms) >= best[0]:
            return
        if not rest:
            best[0] = len(rooms)
            return
        s, rest = rest[0], rest[1:]
        for i in {r: i for i, r in enumerate(rooms) if r >= s}.values():
            go(rest, rooms[:i] + [rooms[i] - s] + rooms[i + 1 :])
        go(rest, rooms + [capacity - s])

    go(sorted(sizes, reverse=True), [])
    return best[0]


def test_reduction_keeps_the_optimum():
    r = random.Random(9)
    fixed_any = 0
    for _ in range(400):
        capacity = r.choice([10, 13, 20])
        sizes = [r.randrange(1, capacity + 1) for _ in range(r.randrange(1, 10))]
        fixed, rest = packing.reduce_instance(Counter(sizes), capacity)
        assert all(sum(s * q for s, q in p) <= capacity for p, _ in fixed)
        assert contents(fixed) + Counter(rest) == Counter(sizes)
        n = sum(n for _, n in fixed)
        fixed_any += n
        assert n + optimum(list(Counter(rest).elements()), capacity) == optimum(sizes, capacity)
    assert fixed_any > 400


@pytest.mark.parametrize("sizes", [(600, 390, 190, 195), (501, 499, 251, 249, 120), (700, 150, 149, 90), (334, 333, 332, 331)])
def test_runs_do_not_grow_with_the_items(sizes):
    runs = []
    for items in (2_000, 1_000_000):
        counts = {s: items // len(sizes) for s in sizes}
        began = time.process_time()
        got, _ = packing.plan(counts, 1000)
        assert time.process_time() - began < 1
        assert sum(high - low for _, low, high, *_ in got) == items // len(sizes) * len(sizes)
        runs.append(len(got))
    assert runs[1] <= runs[0] + 8 <= 60


def test_largest_pair():
    r = random.Random(2)
    for _ in range(300):
        counts = Counter(r.randrange(1, 15) for _ in range(r.randrange(2, 8)))
        room, without = r.randrange(2, 20), r.choice(list(counts))
        items = list((counts - Counter([without])).elements())
        want = max((a + b for a, b in combinations(items, 2) if a + b <= room), default=0)
        assert packing._largest_pair(packing._Sizes(counts), room, without) == want


def check(rows, sizes, capacity, key="doc_id"):
    load, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        load[r.container_id] += r.size
        pieces[r[key]].append((r.piece_no, r.size))
    assert max(load.values(), default=0) <= capacity
    assert set(pieces) == set(sizes)
    for k, n in sizes.items():
        got = sorted(pieces[k])
        assert [p for p, _ in got] == list(range(len(got))) and sum(s for _, s in got) == n
        assert len(got) == max(1, -(-n // capacity))
    used = sum(1 for v in load.values() if v)
    assert set(load) == set(range(max(1, len(load)))) or not load
    return used


@pytest.mark.parametrize("per_block", [7, 500_000])
def test_pack(spark, per_block):
    r = random.Random(1)
    sizes = {k: r.choice([0, 5, 5, 5, r.randrange(1, 100), r.randrange(100, 450)]) for k in range(400)}
    df = spark.createDataFrame([(k, n, "x") for k, n in sizes.items()], "doc_id long, n_tokens long, size string")
    used = check(packing.pack(df, 100, rows_per_block=per_block).collect(), sizes, 100)
    assert used <= 1.05 * -(-sum(sizes.values()) // 100) + 1


def test_documents(spark, sf):
    from nodeloom.llm.encode import token_counts
    from nodeloom.session import table

    counts = token_counts(table(spark, sf, "documents"))
    sizes = {r.doc_id: r.n_tokens for r in counts.collect()}
    rows = packing.pack_budgets(counts, table(spark, sf, "token_budgets")).collect()
    for b in table(spark, sf, "token_budgets").collect():
        check([r for r in rows if r.budget_id == b.budget_id], sizes, b.capacity_tokens)


def test_odd_inputs(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, -4), (4, 10), (4, 10), (5, 25), (5, 25), (6, 30)], "doc_id long, n_tokens long")
    rows = packing.pack(df, 10).collect()
    load = Counter()
    for r in rows:
        load[r.container_id] += r.size
    assert max(load.values()) <= 10 and sum(load.values()) == 100 and len(rows) == 3 + 2 + 6 + 3
    none = packing.pack(df.limit(0), 10)
    assert none.collect() == []
    assert [r.container_id for r in packing.pack(df.where("doc_id < 4"), 10).collect()] == [0, 0, 0]
    budgets = spark.createDataFrame([(1, 0), (2, None)], "budget_id int, capacity_tokens int")
    assert packing.pack_budgets(df, budgets).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, 0)
