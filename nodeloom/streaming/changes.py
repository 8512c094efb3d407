"""Change events as streams: debounced batches, rebuilds, incremental orphan references.

The source is checkpointed, so no pending queue is needed; a batch that fails runs again from the
same events and the sinks below overwrite what it left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from nodeloom.operators import orphans
from nodeloom.session import materialize


def debounced(events: DataFrame, gap: str = "3 seconds", late: str = "1 minute", time: str = "ts", key: str = "user_id") -> DataFrame:
    """Bursts of changes: events of a key with less than ``gap`` between them, emitted once the
    watermark has passed. A TIMESTAMP_NTZ column is read as UTC."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("events"), F.min(time).alias("first"), F.max(time).alias("last")).drop("session_window")


def distinct_changes(events: DataFrame, cols: list[str], time: str = "ts", within: str = "10 minutes") -> DataFrame:
    """Each change once within the watermark's delay."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, within)
    return rows.dropDuplicatesWithinWatermark(cols)


def counted(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts", by: str = "event_type") -> DataFrame:
    """An extension: tumbling event-time counts with a watermark."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def on_batch(changes: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, path: str = "path") -> DataStreamWriter:
    """A writer that calls ``rebuild(distinct changed paths, batch id)`` for each micro-batch."""
    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: rebuild(df.select(path).where(f"{path} <> ''").distinct(), i))


class OrphanStream:
    """Orphan references over a stream: references and parent events of each micro-batch are
    folded into the keyed state of ``operators.orphans``.

    The state after each batch is a table under ``folder``; batch i reads that of i - 1, so a
    batch that is run again starts from the same state. Batches must come in event-time order."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def state(self, spark, batch: int) -> DataFrame | None:
        return None if batch < 0 else spark.read.schema(orphans.STATE).parquet(f"{self.folder}/state-{batch}")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        """``rows``: kind ('node' or 'edge') with the columns of both tables."""
        spark = rows.sparkSession
        edges = rows.where("kind = 'edge'").select("edge_seq", "source", "target", "arrived_at")
        events = rows.where("kind = 'parent'").select("id", "at", "d")
        refs = orphans.references(edges)
        parents = orphans._keyed(events.where("id <> ''"), "id").groupBy("k1", "k2", F.col("at").alias("t")).agg(F.sum("d").alias("d"))
        fold = orphans.advance(self.state(spark, batch - 1), materialize(refs, "refs"), materialize(parents, "parents")).stored("step")
        fold.found().write.mode("overwrite").parquet(f"{self.folder}/found-{batch}")
        fold.state().write.mode("overwrite").parquet(f"{self.folder}/state-{batch}")
