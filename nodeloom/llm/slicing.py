"""Splitting oversized units of text at natural boundaries.

Each file's text is read once, where it lies, and reduced to its boundary index: the positions of
line starts and their strengths (heading 3, line after a blank line 2, other line 1). Only these
indexes are shuffled, never the texts. A unit is cut by range-maximum queries over a sparse table
of the strengths: the strongest boundary in the permissible window, the rightmost of equals.

Indexes and units meet by path in one sorted stream; a path with very many units gets several
salts, each with its own copy of the index, so no group has to fit into memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.session import spread

HEADING, PARAGRAPH, LINE = 3, 2, 1


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions (code points, after 0) and strengths of the line starts of a text.

    Lines end with LF, CR LF or CR. A blank line holds at most spaces and tabs. A heading is one
    to six ``#`` and a space or tab, outside fenced blocks; each line that starts with three
    backticks opens or closes one."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lf = a == 10
    ends = lf.copy()
    cr = np.flatnonzero(a == 13)
    if len(cr):
        alone = cr[(cr + 1 >= len(a)) | (a[np.minimum(cr + 1, len(a) - 1)] != 10)]
        ends[alone] = True
    starts = np.flatnonzero(ends) + 1
    starts = starts[starts < len(a)]
    if not len(starts):
        return starts.astype(np.int64), starts.astype(np.uint8)
    strength = np.full(len(starts), LINE, np.uint8)
    # a line is blank if it has no other characters than blanks and its own line end
    seen = np.concatenate([[0], np.cumsum(~np.isin(a, (9, 10, 13, 32)))])
    begins = np.concatenate([[0], starts[:-1]])
    strength[seen[starts] == seen[begins]] = PARAGRAPH
    fenced, first = False, a[starts]
    marked = [0] * (a[0] in (35, 96)) + starts[(first == 35) | (first == 96)].tolist()
    for s in marked:
        if text.startswith("```", s):
            fenced = not fenced
        elif text[s] == "#" and not fenced and s:
            k = s
            while k < len(text) and k - s < 7 and text[k] == "#":
                k += 1
            if k - s <= 6 and k < len(text) and text[k] in " \t":
                strength[np.searchsorted(starts, s)] = HEADING
    return starts.astype(np.int64), strength


class Strongest:
    """Sparse table: in O(1), the rightmost of the largest strengths in a range of boundaries."""

    def __init__(self, positions: np.ndarray, strengths: np.ndarray):
        self.positions = positions
        n = len(positions)
        # strength and rank in one number: the maximum is the strongest, of equals the rightmost
        level = strengths.astype(np.int64) * (n + 1) + np.arange(n)
        self.n, self.levels = n + 1, [level]
        width = 1
        while 2 * width <= n:
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def cut(self, low: int, high: int) -> int | None:
        """Position of the cut in (low, high], None if no line starts there."""
        i, j = (int(x) for x in np.searchsorted(self.positions, (low, high), "right"))
        if i >= j:
            return None
        k = (j - i).bit_length() - 1
        table = self.levels[k]
        return int(self.positions[max(table[i], table[j - (1 << k)]) % self.n])


def pieces(index: Strongest, start: int, end: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of [start, end). ``overlap`` is held within 0 .. limit - 1, so each piece advances."""
    overlap = min(max(overlap, 0), limit - 1)
    out = []
    while end - start > limit:
        at = index.cut(start + overlap, start + limit)
        at = start + limit if at is None else at
        out.append((start, at))
        start = at - overlap
    out.append((start, end))
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for path, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py()
            positions, strengths = boundaries(text)
            for into, v in zip(out, (path.as_py(), len(text), positions.tobytes(), strengths.tobytes())):
                into.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["path", "n_chars", "positions", "strengths"])


def boundary_index(files: DataFrame) -> DataFrame:
    """(path, n_chars, positions, strengths) of each file with a text; null texts have none."""
    rows = spread(files.select("path", "text")).where("path IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(_index, "path string, n_chars long, positions binary, strengths binary")


_PIECES = pa.schema([("slice_id", pa.int64()), ("piece_start", pa.int64()), ("piece_end", pa.int64())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, index, length = None, None, 0
    for batch in batches:
        ids, begins, ends = [], [], []
        cols = {name: batch.column(name) for name in batch.schema.names}
        for k, (path, salt) in enumerate(zip(cols["path"].to_pylist(), cols["salt"].to_pylist())):
            if cols["kind"][k].as_py() == 0:
                if at != (path, salt):  # of several texts of one path the longest comes first
                    at, length = (path, salt), cols["n_chars"][k].as_py()
                    index = Strongest(np.frombuffer(cols["positions"][k].as_buffer(), np.int64), np.frombuffer(cols["strengths"][k].as_buffer(), np.uint8))
                continue
            if at != (path, salt):
                continue
            start = max(cols["start_pos"][k].as_py() or 0, 0)
            end = cols["end_pos"][k].as_py()
            end = length if end is None or end > length else end
            limit = cols["max_chars"][k].as_py()
            if limit is None or limit < 1 or end - start <= limit:
                continue
            for b, e in pieces(index, start, end, limit, cols["overlap_chars"][k].as_py() or 0):
                ids.append(cols["slice_id"][k].as_py())
                begins.append(b)
                ends.append(e)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, begins, ends)], schema=_PIECES)


def split_units(slices: DataFrame, files: DataFrame, units_per_salt: int = 200_000) -> DataFrame:
    """(slice_id, piece_start, piece_end): all pieces of each unit longer than its max_chars.

    A null or negative start_pos is 0, a null end_pos or one past the text its end. Units whose
    path is null or has no text, and limits that are null or below 1, give nothing; an overlap is
    held below the limit; repeated units are cut each on their own. Of several texts under one
    path the longest counts.
    """
    counts = slices.where("path IS NOT NULL").groupBy("path").agg(F.ceil(F.count("*") / units_per_salt).cast("int").alias("salts"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    index = boundary_index(files).join(counts, "path").select(
        "path", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), none("long", "slice_id"), none("long", "start_pos"), none("long", "end_pos"), none("int", "max_chars"), none("int", "overlap_chars"), "n_chars", "positions", "strengths"
    )
    units = slices.join(counts.where("salts > 1"), "path", "left").where("path IS NOT NULL")
    salt = F.pmod(F.xxhash64("slice_id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    units = units.select(
        "path", salt, F.lit(1).alias("kind"), "slice_id", F.col("start_pos").cast("long"), F.col("end_pos").cast("long"), F.col("max_chars").cast("int"), F.col("overlap_chars").cast("int"), none("long", "n_chars"), none("binary", "positions"), none("binary", "strengths")
    )
    stream = index.unionByName(units).repartition("path", "salt").sortWithinPartitions("path", "salt", "kind", F.desc("n_chars"), "positions", "slice_id")
    return stream.mapInArrow(_cut, "slice_id long, piece_start long, piece_end long")
