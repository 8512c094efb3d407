"""Functions outside Spark, such as a model that extracts records: one chunk a call, with retries.

The callback is given by the user; nothing here talks to a network. Partitions are the unit of
parallelism and of recovery, so results should be written (``incremental.save_cache``) and chunks
already in the cache left out beforehand (``incremental.check_cache``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.jsontext import read_object_py
from nodeloom.sources.files import bisect

RESULT = "chunk_id long, part string, payload string, error string"


def call_chunks(chunks: DataFrame, call: Callable[[str], str], depth: int = 3) -> DataFrame:
    """(chunk_id, part, payload, error) of (chunk_id, text): what ``call`` returned as a JSON object.

    A chunk whose answer can't be read, or whose call raises, is cut in two at a line end and tried
    again, to ``depth`` cuts; ``part`` is the path of cuts. What still fails has its error."""
    import json

    def attempt(text: str, part: str, left: int) -> Iterator[tuple]:
        try:
            got = read_object_py(call(text))
            problem = None if got is not None else "unreadable answer"
        except Exception as e:
            got, problem = None, f"{type(e).__name__}: {e}"[:500]
        if got is not None:
            yield part, json.dumps(got, ensure_ascii=False), None
            return
        halves = bisect(text, 0, len(text)) if left else []
        if not halves:
            yield part, None, problem
        for i, (a, b) in enumerate(halves):
            yield from attempt(text[a:b], part + str(i), left - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *r) for k, t in zip(b.chunk_id, b.text) for r in attempt(t or "", "", depth)]
            yield pd.DataFrame(rows, columns=["chunk_id", "part", "payload", "error"])

    return chunks.select("chunk_id", "text").mapInPandas(run, RESULT)


def label_communities(samples: DataFrame, call: Callable[[list[tuple[int, list[str]]]], dict[int, str]], per_call: int = 100, most: int = 12) -> DataFrame:
    """(community, label, error) of (community, rank, label): names for communities from their
    first ``most`` labels, ``per_call`` communities a call. A community without an answer, or whose
    call raises, is called by its number."""
    lists = samples.where(F.col("rank") <= most).groupBy("community").agg(F.sort_array(F.collect_list(F.struct("rank", "label"))).alias("x")).select("community", F.col("x.label").alias("labels"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), per_call):
                asked = [(int(c), list(x)) for c, x in zip(b.community[i : i + per_call], b.labels[i : i + per_call])]
                try:
                    got, problem = call(asked), None
                except Exception as e:
                    got, problem = {}, f"{type(e).__name__}: {e}"[:500]
                yield pd.DataFrame([(c, str(got.get(c) or f"Community {c}"), problem) for c, _ in asked], columns=["community", "label", "error"])

    return lists.mapInPandas(run, "community int, label string, error string")
