"""References to records that do not exist, kept as incremental keyed state.

State, one row per key ``(k1, k2)`` (128 bits of the id in normal form): ``present``, the number
of parent rows there now; ``refs``, the number of references seen per endpoint. From them follows
what waits: all references of a key whose ``present`` is 0 are pending orphans; :func:`waiting`
lists them from the log of references.

:func:`advance` folds one batch of events into the state in time order. A new reference probes
``present``: at 0 it is an orphan and starts to wait. An arriving parent that takes ``present``
from 0 resolves all that waits under the key, a removal that takes it to 0 reopens all references
of the key. Only counts are kept as state, so a key with a third of all references costs one row.

:func:`fold_history` goes through whole tables step by step: references and parents' events are
keyed once and written by month; each step reads its months and the state that the step before
has written, probes and updates it, and writes what was found and the new state. A step is a run
of months with an eighth of all events at least, so that the state is read and written a bounded
number of times; the monthly counts come out of the steps.

The fold of a step is a running sum over (key, salt) sorted by time: one shuffle of the narrow
events, no join. Hot keys are found through counts of hash buckets (bounded) and their references
are salted; the parents' events of those buckets are repeated for each salt.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodeloom.functions.ids import normalize_id
from nodeloom.session import hot_buckets, materialize, spread, with_salts

STATE = "k1 long, k2 long, present long, n_source long, n_target long"
_ENDPOINTS = ("source", "target")


def _keyed(df: DataFrame, c: str) -> DataFrame:
    df = df.withColumn("_id", normalize_id(c)).where(F.col("_id") != "")
    return df.withColumn("k1", F.xxhash64("_id")).withColumn("k2", F.xxhash64(F.lit(1), "_id")).drop("_id")


def references(edges: DataFrame, endpoints: tuple[str, ...] = _ENDPOINTS) -> DataFrame:
    """(edge_seq, e, t, k1, k2): one row per non-empty endpoint; ``e`` is its position in
    ``endpoints``. Null, empty or letterless endpoints and rows without arrived_at (no time to
    judge them at) are no references."""
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("e"), F.col(x).alias("ref")) for i, x in enumerate(endpoints)]))
    edges = spread(edges.select("edge_seq", *endpoints, "arrived_at"))
    rows = edges.where("arrived_at IS NOT NULL").select("edge_seq", F.col("arrived_at").alias("t"), each.alias("x"))
    return _keyed(rows.select("edge_seq", "t", "x.e", "x.ref").where("ref <> ''"), "ref").drop("ref")


def parent_events(nodes: DataFrame) -> DataFrame:
    """(k1, k2, t, d): net change of the number of parent rows present, one row per key and time.

    A row is present from arrived_at until removed_at (not any more at removed_at itself; null:
    for good). A row removed at or before its arrival never was. Null ids match nothing."""
    rows = nodes.where("id <> '' AND arrived_at IS NOT NULL AND (removed_at IS NULL OR removed_at > arrived_at)").select("id", "arrived_at", "removed_at")
    ups_downs = F.array(F.struct(F.col("arrived_at").alias("t"), F.lit(1).alias("d")), F.struct(F.col("removed_at").alias("t"), F.lit(-1).alias("d")))
    rows = _keyed(rows, "id").select("k1", "k2", F.explode(ups_downs).alias("x")).select("k1", "k2", "x.t", "x.d").where("t IS NOT NULL")
    return rows.groupBy("k1", "k2", "t").agg(F.sum("d").alias("d"))


def _endpoint() -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in _ENDPOINTS]), F.col("e").cast("int") + 1).alias("endpoint")


def _monthly(events: DataFrame, table_name: str, months: list[str] = []) -> DataFrame:
    """Counts per endpoint and month, those of ``months`` in any case; ``pending`` runs on from
    what was carried over."""
    month, parts = F.date_format("t", "yyyy-MM"), []
    for i, name in enumerate(_ENDPOINTS):
        seen = F.col(f"n_{name}")
        parts.append(
            F.struct(
                F.lit(name).alias("endpoint"),
                F.when((F.col("kind") == 2) & (F.col("e") == i) & (F.col("present") == 0), 1).otherwise(0).alias("new"),
                F.when((F.col("kind") == 1) & (F.col("before") == 0) & (F.col("present") > 0), seen).otherwise(0).alias("resolved"),
                F.when((F.col("kind") == 1) & (F.col("before") > 0) & (F.col("present") == 0), seen).otherwise(0).alias("reopened"),
                F.when((F.col("kind") == 0) & (F.col("present") == 0), seen).otherwise(0).alias("carried"),
            )
        )
    rows = events.select(month.alias("period"), F.explode(F.array(*parts)).alias("x")).groupBy("x.endpoint", "period")
    rows = rows.agg(*[F.sum(f"x.{c}").cast("long").alias(c) for c in ("new", "resolved", "reopened", "carried")])
    if months:
        every = [(x, m, 0, 0, 0, 0) for x in _ENDPOINTS for m in months]
        rows = rows.union(events.sparkSession.createDataFrame(every, rows.schema)).groupBy("endpoint", "period").agg(*[F.sum(c).alias(c) for c in ("new", "resolved", "reopened", "carried")])
    run = Window.partitionBy("endpoint").orderBy(F.col("period").asc_nulls_first())  # one row per month
    rows = rows.withColumn("pending", F.sum(F.col("carried") + F.col("new") - F.col("resolved") + F.col("reopened")).over(run))
    return rows.where("period IS NOT NULL").select(F.lit(table_name).alias("table_name"), "endpoint", "period", F.col("new").alias("new_orphans"), "resolved", "reopened", "pending")


@dataclass
class Folded:
    """A folded batch. ``rows``: orphans found, parents' events that resolved or reopened
    references, what waited before, and the last event of each key (``last``)."""

    rows: DataFrame
    salts: dict[int, int]

    def stored(self, name: str = "fold") -> Folded:
        """Written to the shared folder: for several uses, and to cut the lineage."""
        return Folded(materialize(self.rows, name), self.salts)

    def found(self) -> DataFrame:
        """(edge_seq, endpoint) of references that were orphans when they arrived."""
        return self.rows.where("kind = 2 AND present = 0").select("edge_seq", _endpoint())

    def changes(self, table_name: str = "graph_edges") -> DataFrame:
        """(table_name, endpoint, period, new_orphans, resolved, reopened, pending): per month of
        the events, with the number pending at the end of each. References are resolved or
        reopened in the month in which their parent arrives or goes."""
        return _monthly(self.rows, table_name)

    def state(self) -> DataFrame:
        """The state after the batch. Salted parts of a key are added up: parents' counts are the
        same in each salt, references are counted in one."""
        last = self.rows.where("last").select("k1", "k2", "present", "n_source", "n_target")
        if not self.salts:
            return last
        return last.groupBy("k1", "k2").agg(F.max("present").alias("present"), F.sum("n_source").alias("n_source"), F.sum("n_target").alias("n_target"))


def advance(state: DataFrame | None, refs: DataFrame, parents: DataFrame, salts: dict[int, int] | None = None) -> Folded:
    """Fold a batch of references and parent events into ``state`` (None: nothing yet).

    All events of the batch must be no earlier than those folded before. At equal times parents
    come first. Without ``salts`` hot keys are looked for in the batch."""
    if salts is None:
        salts = hot_buckets(refs.select("k1", "k2"), ["k1", "k2"])
    zero = lambda kind: F.lit(kind).cast("tinyint").alias("kind")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    nought = [F.lit(0).cast("long").alias("o_source"), F.lit(0).cast("long").alias("o_target")]
    deltas = with_salts(parents, ["k1", "k2"], salts, None)
    deltas = deltas.select("k1", "k2", "salt", "t", zero(1), none("long", "edge_seq"), none("tinyint", "e"), F.col("d").cast("long").alias("d"), *nought)
    asked = with_salts(refs, ["k1", "k2"], salts, ["edge_seq", "e"])
    asked = asked.select("k1", "k2", "salt", "t", zero(2), "edge_seq", "e", F.lit(0).cast("long").alias("d"), *nought)
    events = deltas.unionByName(asked)
    if state is not None:
        opening = with_salts(state, ["k1", "k2"], salts, None)
        first = F.col("salt") == 0  # references waiting from before are counted in one salt only
        opening = opening.select(
            "k1", "k2", "salt", none("timestamp_ntz", "t"), zero(0), none("long", "edge_seq"), none("tinyint", "e"), F.col("present").cast("long").alias("d"),
            *[F.when(first, F.col(f"n_{n}")).otherwise(0).cast("long").alias(f"o_{n}") for n in _ENDPOINTS],
        )
        events = opening.unionByName(events)
    by_time = Window.partitionBy("k1", "k2", "salt").orderBy(F.col("t").asc_nulls_first(), "kind", "edge_seq", "e")
    run = by_time.rowsBetween(Window.unboundedPreceding, 0)
    counted = lambda i, n: F.sum(F.when(F.col("e") == i, 1).otherwise(0) + F.col(f"o_{n}")).over(run).alias(f"n_{n}")
    events = events.select("*", F.sum("d").over(run).alias("present"), *[counted(i, n) for i, n in enumerate(_ENDPOINTS)], F.lead("kind").over(by_time).isNull().alias("last"))
    events = events.select("k1", "k2", "t", "kind", "edge_seq", "e", "present", (F.col("present") - F.col("d")).alias("before"), "n_source", "n_target", "last")
    kept = "last OR (kind = 1 AND (before = 0) <> (present = 0)) OR (kind <> 1 AND present = 0)"
    return Folded(events.where(kept), salts)


@dataclass
class History:
    """Steps of a fold over whole tables, all stored, the log of references, the months."""

    refs: DataFrame
    steps: list[Folded]
    months: list[str]

    def found(self) -> DataFrame:
        """(edge_seq, endpoint) of references that were orphans when they arrived."""
        return reduce(DataFrame.unionByName, [s.found() for s in self.steps])

    def changes(self, table_name: str = "graph_edges") -> DataFrame:
        """Monthly counts over all steps, see :meth:`Folded.changes`."""
        return _monthly(reduce(DataFrame.unionByName, [s.rows for s in self.steps]).where("kind > 0"), table_name, self.months)

    def state(self) -> DataFrame:
        return self.steps[-1].state()

    def waiting(self) -> DataFrame:
        return waiting(self.refs, self.state(), self.steps[-1].salts)


def waiting(refs: DataFrame, state: DataFrame, salts: dict[int, int]) -> DataFrame:
    """(edge_seq, endpoint, since) of all references whose key has no parent row in ``state``."""
    missing = with_salts(state.where("present = 0").select("k1", "k2"), ["k1", "k2"], salts, None)
    rows = with_salts(refs, ["k1", "k2"], salts, ["edge_seq", "e"])
    return rows.join(missing, ["k1", "k2", "salt"], "left_semi").select("edge_seq", _endpoint(), F.col("t").alias("since"))


def _spans(counts: list[tuple[str, int]], share: float) -> list[tuple[str, str]]:
    """Runs of consecutive periods with at least ``share`` of all events each."""
    total, out, low, n = sum(c for _, c in counts), [], None, 0
    for period, c in sorted(counts):
        low, n = low or period, n + c
        if n >= share * total:
            out.append((low, period))
            low, n = None, 0
    return [*out, (low, max(p for p, _ in counts))] if low else out


def fold_history(edges: DataFrame, nodes: DataFrame, share: float = 0.125, salts: dict[int, int] | None = None) -> History:
    """Fold both whole tables through the stored state, at most ``1 / share`` + 1 steps.

    Empty tables fold in one step of nothing."""
    keep = lambda df, name: materialize(df.withColumn("period", F.date_format("t", "yyyy-MM")), name, ["period"])
    refs, parents = keep(references(edges), "references"), keep(parent_events(nodes), "parents")
    counts = refs.select("period").union(parents.select("period")).groupBy("period").count().collect()  # a row per month
    if salts is None:
        salts = hot_buckets(refs, ["k1", "k2"])
    spans = _spans([tuple(r) for r in counts], share) or [("", "")]
    state, steps = None, []
    for low, high in spans:
        cut = lambda df: df.where(F.col("period").between(low, high)).drop("period")  # noqa: B023, E731
        steps.append(advance(state, cut(refs), cut(parents), salts).stored("fold"))
        state = steps[-1].state()
    return History(refs.drop("period"), steps, sorted(r["period"] for r in counts))
