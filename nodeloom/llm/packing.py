"""Filling containers of fixed capacity with documents.

What can be packed depends only on how many items there are of each size, and there are at most
``capacity`` sizes: that histogram (bounded by the capacity, whatever the corpus) is all the
driver sees. On it the Martello-Toth reduction fixes containers that dominate every alternative,
and best fit takes the rest, largest first, many equal containers at a time. The plan is a table
of runs: items of a size with ranks low..high go to containers first, first + 1, ... Documents get
their rank within their size in parallel (blocks of rows, then offsets) and look up their run.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.session import materialize

#: Ranks within a size are below 2 ** 43, capacities below 2 ** 20.
_RANK_BITS = 43


class _Sizes:
    """Counts by size with the sizes in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            self.order.pop(bisect_left(self.order, size))

    def largest_to(self, room: int) -> int | None:
        i = bisect_left(self.order, room + 1)
        return self.order[i - 1] if i else None

    def smallest(self, k: int, without: int) -> list[int]:
        """The k smallest items, one of size ``without`` left out."""
        out, left = [], 1
        for s in self.order:
            n = self.n[s]
            if s == without:
                n, left = n - left, 0
            out += [s] * min(n, k - len(out))
            if len(out) == k:
                break
        return out


Pattern = list[tuple[int, int]]  # (size, how many) of one container


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Containers fixed by dominance, and the counts that remain.

    For the largest item j, a feasible set {j}, {j, k} dominates all others that hold j if
    nothing else fits beside j, if k fills the container exactly, or if k is the largest that fits
    and no two others fit together that would not go in k's place. An exact fill dominates for any
    j, so those are fixed for every size; the other rules are tried from the largest size down
    until the first size that they don't settle. Every step uses up a size (or its pairs), so the
    steps are bounded by the number of sizes, however many items there are."""
    left, fixed = _Sizes(counts), []

    def fix(pattern: Pattern, k: int) -> None:
        fixed.append((pattern, k))
        for s, q in pattern:
            left.take(s, q * k)

    for s in reversed(list(left.order)):  # exact fills
        other = capacity - s
        if s == capacity and s in left.n:
            fix([(s, 1)], left.n[s])
        elif s > other and s in left.n and other in left.n:
            fix([(s, 1), (other, 1)], min(left.n[s], left.n[other]))
        elif s == other and left.n.get(s, 0) > 1:
            fix([(s, 2)], left.n[s] // 2)
    while left.order:
        j = left.order[-1]
        room = capacity - j
        least = left.smallest(3, j)
        if not least or least[0] > room:  # j stays alone
            fix([(j, 1)], left.n[j])
            continue
        k = left.largest_to(room)
        if k == j and left.n[j] == 1:
            i = bisect_left(left.order, j)
            k = left.order[i - 1] if i else None
        alone = len(least) < 2 or least[0] + least[1] > room  # one item at most fits beside j
        # two may fit, not three: k dominates the pairs if none is larger than k
        pairs_in_k = not alone and (len(least) < 3 or sum(least) > room) and _largest_pair(left, room, j) <= k
        if not (alone or pairs_in_k):
            break
        # taking j and k away leaves fewer sets to dominate, so the rule holds until one runs out
        times = max(1, left.n[j] // 2) if k == j else min(left.n[j], left.n[k])
        fix([(j, 2)] if k == j else [(j, 1), (k, 1)], times)
    return fixed, dict(left.n)


def _largest_pair(left: _Sizes, room: int, without: int) -> int:
    """Largest sum within ``room`` of two items other than one of size ``without``."""
    has = lambda s, k: left.n[s] - (s == without) >= k
    order = [s for s in left.order[: bisect_left(left.order, room + 1)] if has(s, 1)]
    best, lo, hi = max((2 * s for s in order if 2 * s <= room and has(s, 2)), default=0), 0, len(order) - 1
    while lo < hi:
        both = order[lo] + order[hi]
        if both > room:
            hi -= 1
        else:
            best, lo = max(best, both), lo + 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing on a histogram: as item by item, but equal containers move together.

    An item goes to the open container with the least room that holds it, so a container of room r
    takes r // s items of size s in succession."""
    rooms: list[int] = []  # rooms with open groups, in order
    groups: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # room: [(containers, pattern)]

    def put(room: int, n: int, pattern: tuple) -> None:
        if room not in groups or not groups[room]:
            insort(rooms, room)
        groups[room].append((n, pattern))

    done: list[tuple[Pattern, int]] = []
    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                q = capacity // s
                full, rest = divmod(n, q)
                if full:
                    put(capacity - q * s, full, ((s, q),))
                if rest:
                    put(capacity - rest * s, 1, ((s, rest),))
                break
            room = rooms[i]
            have, pattern = groups[room].pop()
            if not groups[room]:
                rooms.pop(i)
                del groups[room]
            q = room // s
            full = min(have, n // q)
            if full:
                put(room - q * s, full, (*pattern, (s, q)))
            n -= full * q
            have -= full
            if have and n:  # fewer than q are left
                put(room - n * s, 1, (*pattern, (s, n)))
                n, have = 0, have - 1
            if have:
                put(room, have, pattern)
    for lists in groups.values():
        done += [(list(p), n) for n, p in lists]
    return done


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (size, low, high, first, per) and the number of containers: the items of ``size``
    with ranks low <= r < high go to container first + (r - low) // per."""
    fixed, rest = reduce_instance({s: c for s, c in counts.items() if 0 < s <= capacity}, capacity)
    runs, container, used = [], 0, defaultdict(int)
    for pattern, n in [*fixed, *best_fit(rest, capacity)]:
        for s, q in pattern:
            runs.append((s, used[s], used[s] + q * n, container, q))
            used[s] += q * n
        container += n
    return runs, container


def pack(sizes: DataFrame, capacity: int, key: str = "doc_id", rows_per_block: int = 500_000) -> DataFrame:
    """(container_id, key, piece_no, size): each item in a container of ``capacity``.

    ``sizes`` is (key, n_tokens). An item larger than the capacity is split into full pieces, each
    a container of its own, and a last piece that is packed with the others; no other item is
    split. Items of size 0 take no room and are dealt over the containers in turn (all to
    container 0 if there are no others). Negative or null sizes count as 0. Repeated keys are
    items of their own. Deterministic in (key, size)."""
    if not 0 < capacity < 1 << 20:
        raise ValueError("the capacity must be positive and below 2 ** 20")
    spark = sizes.sparkSession
    n = F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0)).cast("long")
    sizes = sizes.select(key, n.alias("n_tokens"))
    whole = F.when(F.col("n_tokens") > capacity, F.expr(f"(n_tokens - 1) div {capacity}")).otherwise(F.lit(0)).cast("int")
    items = sizes.select(key, whole.alias("piece_no"), (F.col("n_tokens") - whole * capacity).alias("size"))
    counted = items.groupBy("size").agg(F.count("*").alias("n"), F.count_if(F.col("piece_no") > 0).alias("over")).collect()  # at most capacity + 1 rows
    histogram, oversized = {r["size"]: r["n"] for r in counted}, sum(r["over"] for r in counted)
    runs, containers = plan(histogram, capacity)
    zeros, total = histogram.get(0, 0), sum(histogram.values())

    # rank within the size: rows fall into blocks by hash, so that no size is one task's work
    blocks = max(1, -(-total // rows_per_block))
    items = items.withColumn("block", F.pmod(F.xxhash64(key, "piece_no"), F.lit(blocks)).cast("int"))
    inside = Window.partitionBy("block", "size").orderBy(key, "piece_no")
    if blocks == 1:
        ranked = items.withColumn("rank", F.row_number().over(inside).cast("long") - 1)
    else:
        before = Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = items.groupBy("size", "block").agg(F.count("*").alias("n")).select("size", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        ranked = items.withColumn("rank", F.row_number().over(inside).cast("long") - 1).join(offsets, ["size", "block"])
        ranked = ranked.withColumn("rank", F.col("rank") + F.col("offset"))

    placed = ranked.where("size > 0").mapInArrow(_lookup(spark.sparkContext.broadcast(runs), key), f"container_id long, {key} long, piece_no int, size long")
    out = placed
    if zeros:
        out = out.unionByName(ranked.where("size = 0").select((F.col("rank") % max(containers, 1)).alias("container_id"), key, "piece_no", "size"))
    if oversized:
        out = out.unionByName(_full_pieces(sizes.where(F.col("n_tokens") > capacity), oversized, containers, capacity, key, rows_per_block))
    return out


def _lookup(runs, key: str):
    """mapInArrow function: the run of each item by binary search in (size, low)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(sorted(runs.value), np.int64).reshape(-1, 5)
        at = table[:, 0] << _RANK_BITS | table[:, 1]
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("size", "rank"))
            mine = table[np.searchsorted(at, size.astype(np.int64) << _RANK_BITS | rank, "right") - 1]
            container = pa.array(mine[:, 3] + (rank - mine[:, 1]) // mine[:, 4], pa.int64())
            yield pa.RecordBatch.from_arrays([container, batch.column(key), batch.column("piece_no"), batch.column("size")], ["container_id", key, "piece_no", "size"])

    return run


def _full_pieces(big: DataFrame, n: int, containers: int, capacity: int, key: str, rows_per_block: int) -> DataFrame:
    """The full pieces of oversized items, each in a container numbered after all others."""
    blocks = max(1, -(-n // rows_per_block))
    rows = big.select(key, F.expr(f"cast((n_tokens - 1) div {capacity} as long)").alias("full"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    inside = Window.partitionBy("block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over one row per block
    offsets = rows.groupBy("block").agg(F.sum("full").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rows = rows.withColumn("inside", F.coalesce(F.sum("full").over(inside), F.lit(0))).join(offsets, "block")
    rows = rows.select((F.lit(containers) + F.col("start") + F.col("inside")).alias("first"), key, F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)).alias("piece_no"))
    return rows.select((F.col("first") + F.col("piece_no")).alias("container_id"), key, "piece_no", F.lit(capacity).cast("long").alias("size"))


def pack_budgets(counts: DataFrame, budgets: DataFrame, key: str = "doc_id", max_budgets: int = 1000) -> DataFrame:
    """(budget_id, container_id, key, piece_no, size) for every row of ``budgets`` with a positive
    capacity; ``counts`` is (key, n_tokens), written once and read for each. The budgets are a
    list of settings: more than ``max_budgets`` are refused."""
    counts = materialize(counts, "sizes")
    rows = budgets.where("capacity_tokens > 0").orderBy("budget_id", "capacity_tokens").limit(max_budgets + 1).collect()
    if len(rows) > max_budgets:
        raise ValueError(f"more than {max_budgets} budgets")
    out = None
    for r in rows:
        part = pack(counts, r["capacity_tokens"], key).select(F.lit(r["budget_id"]).alias("budget_id"), "container_id", key, "piece_no", "size")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return counts.limit(0).select(F.lit(0).alias("budget_id"), F.lit(0).cast("long").alias("container_id"), key, F.lit(0).alias("piece_no"), F.col("n_tokens").alias("size"))
    return out
