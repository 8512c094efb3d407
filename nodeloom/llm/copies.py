"""Records that differ only in whitespace, letter case, punctuation or field order.

Dictionary encoding. Each task brings every distinct value of a column to canonical form once and
gives it an integer identifier; the rows are rewritten as tuples of identifiers, sorted by field
name. Beside the tuples a task puts out its dictionary: (field, canonical value, identifier). An
identifier is proposed by a 63-bit hash of field and canonical value, so that tasks agree without
a join of the rows with dictionaries as large as the table; :func:`dictionary` then proves over
all values that no two of them share one. Values that do are numbered -1, -2, ... instead and the
rows are rewritten, so equal tuples are equal records, without exception. Only (table, tuple, key)
is shuffled for the grouping.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.session import bucket, hot_buckets, materialize, spread, with_salts

#: Tables of the project: key and compared fields; a JSON column is compared by its fields.
RECORDS = {
    "graph_nodes": ("node_seq", ["id", "label", "file_type", "source_file", "source_location", "community", "repo"]),
    "graph_edges": ("edge_seq", ["source", "target", "relation", "confidence", "confidence_score", "context", "source_file", "weight"]),
    "fragments": ("fragment_id", "payload"),
}
CODED = "t byte, k long, ids array<long>, f string, c string, id long"
_SCHEMA = pa.schema([("t", pa.int8()), ("k", pa.int64()), ("ids", pa.list_(pa.int64())), ("f", pa.string()), ("c", pa.string()), ("id", pa.int64())])
Assigned = dict[tuple[str, str], int]


def canonical_text(value: str) -> str:
    """Letters and digits in their order, letter case aside (composed form first)."""
    if value.isascii():
        return "".join(filter(str.isalnum, value)).lower()
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", value).casefold())
    return "".join(filter(str.isalnum, folded))


def canonical(value) -> str:
    """Canonical form of any value, with its kind: numbers equal as numbers, null only to null."""
    if value is None:
        return "z"
    if isinstance(value, bool):
        return f"b{int(value)}"
    if isinstance(value, (int, float, Decimal)):
        number = Decimal(repr(value)) if isinstance(value, float) else Decimal(value)
        if not number.is_finite():
            return f"n{number}"
        return "n0" if number == 0 else f"n{_plain(number)}"
    if isinstance(value, dict):
        return "o" + json.dumps(sorted((k, canonical(v)) for k, v in value.items()))
    if isinstance(value, list):
        return "l" + json.dumps([canonical(v) for v in value])
    return "s" + canonical_text(value)


def _plain(number: Decimal) -> str:
    sign, digits, exponent = number.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    kept = text.rstrip("0")
    return f"{'-' * sign}{kept}e{exponent + len(text) - len(kept)}"


def proposed(field: str, value: str) -> int:
    """Identifier of a canonical value, from 0 up."""
    h = blake2b(f"{len(field)}:{field}{value}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(h, "little") >> 1


class _Dictionary:
    """A task's dictionary: identifiers by field and value; ``new`` has the entries not yet put out."""

    def __init__(self, assigned: Assigned, bound: int = 1 << 17):
        self.assigned, self.bound = assigned, bound
        self.values: dict[str, dict] = {}
        self.known: dict[str, dict[str, int]] = {}
        self.new: list[tuple[str, str, int]] = []

    def id(self, field: str, value) -> int:
        """Identifier of a value; a str, number or None met before is not looked at again."""
        if isinstance(value, (dict, list, bool)):  # not hashable, or equal to a number
            return self._entry(field, canonical(value))
        kept = self.values.setdefault(field, {})
        got = kept.get(value)
        if got is None:
            if len(kept) >= self.bound:
                kept.clear()
            got = kept[value] = self._entry(field, canonical(value))
        return got

    def _entry(self, field: str, form: str) -> int:
        known = self.known.setdefault(field, {})
        got = known.get(form)
        if got is None:
            if len(known) >= self.bound:
                known.clear()
            got = self.assigned.get((field, form)) if self.assigned else None
            got = known[form] = proposed(field, form) if got is None else got
            self.new.append((field, form, got))
        return got

    def batch(self) -> pa.RecordBatch:
        f, c, ids = zip(*self.new) if self.new else ((), (), ())
        n, self.new = len(f), []
        return pa.RecordBatch.from_arrays([pa.nulls(n, _SCHEMA[i].type) for i in range(3)] + [pa.array(f, pa.string()), pa.array(c, pa.string()), pa.array(ids, pa.int64())], schema=_SCHEMA)


def _distinct(column: pa.Array) -> tuple[list, np.ndarray]:
    """Dictionary of a column, a null (if any) last, and each row's index into it."""
    encoded = column.dictionary_encode()
    values = encoded.dictionary.to_pylist()
    return [*values, *[None] * bool(column.null_count)], encoded.indices.fill_null(len(values)).to_numpy(zero_copy_only=False)


def _columns(table: int, key: str, fields: list[str], assigned):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = _Dictionary(assigned.value)
        for batch in batches:
            columns = []
            for f in sorted(fields):
                values, index = _distinct(batch.column(f))
                columns.append(np.array([entries.id(f, v) for v in values], np.int64)[index])
            flat = np.stack(columns, 1).reshape(-1)
            offsets = np.arange(0, len(flat) + 1, len(fields), dtype=np.int32)
            yield _coded(table, batch.column(key), flat, offsets)
            yield entries.batch()

    return run


def read_record(payload: str | None) -> dict | None:
    """Fields of a JSON object (of a repeated name the last counts); None if it can't be read."""

    def refuse(name: str):
        raise ValueError(name)

    try:
        got = json.loads(payload, parse_float=Decimal, parse_constant=refuse)
    except (ValueError, TypeError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def _payloads(table: int, key: str, column: str, assigned):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = _Dictionary(assigned.value)

        def tuple_of(payload: str | None) -> list[int] | None:
            record = read_record(payload)
            try:
                return None if record is None else [entries.id(f, record[f]) for f in sorted(record)]
            except (ValueError, ArithmeticError, RecursionError):  # e.g. a number of millions of digits
                return None

        for batch in batches:
            values, index = _distinct(batch.column(column))
            got = [tuple_of(v) for v in values]
            there = np.array([g is not None for g in got])[index]
            rows = [got[i] for i in index[there]]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            yield _coded(table, batch.column(key).filter(pa.array(there)), np.array([x for r in rows for x in r], np.int64), offsets)
            yield entries.batch()

    return run


def _coded(table: int, keys: pa.Array, flat: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    ids, n = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64())), len(keys)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, table, np.int8)), keys.cast(pa.int64()), ids, *[pa.nulls(n, _SCHEMA[i].type) for i in (3, 4, 5)]], schema=_SCHEMA)


def _rewritten(tables: dict[str, DataFrame], records: dict, assigned: Assigned) -> DataFrame:
    """Tuples of all records (t, k, ids; f is null) and the tasks' dictionaries (f, c, id; k is
    null), written in one pass over the tables."""
    parts, sent = [], None
    for i, (name, (key, compared)) in enumerate(records.items()):
        if name not in tables:
            continue
        sent = sent or tables[name].sparkSession.sparkContext.broadcast(assigned)
        fields = [compared] if isinstance(compared, str) else compared
        run = _payloads(i, key, compared, sent) if isinstance(compared, str) else _columns(i, key, fields, sent)
        parts.append(spread(tables[name].select(key, *fields)).mapInArrow(run, CODED))
    return materialize(reduce(DataFrame.union, parts), "records")


def dictionary(coded: DataFrame) -> DataFrame:
    """(field, canonical, id): the dictionaries of all tasks as one."""
    return coded.where("f IS NOT NULL").select(F.col("f").alias("field"), F.col("c").alias("canonical"), "id").distinct()


def clashes(coded: DataFrame, most: int = 1_000_000) -> Assigned:
    """Own identifiers for the values whose proposed one belongs to another value as well.

    Among n values of all columns n * n / 2 ** 64 are to be expected: none up to billions of
    values. More than ``most`` mean that the hash is broken and are refused."""
    entries = coded.where("f IS NOT NULL").select("id", F.struct("f", "c").alias("v"))
    shared = entries.groupBy("id").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low <> high").select("id").limit(most + 1).collect()
    if not shared:
        return {}
    ids = coded.sparkSession.createDataFrame(shared, "id long")
    rows = dictionary(coded).join(F.broadcast(ids), "id").select("field", "canonical").limit(most + 1).collect()
    if len(shared) > most or len(rows) > most:
        raise RuntimeError(f"more than {most} values share identifiers")
    return {v: -1 - i for i, v in enumerate(sorted(map(tuple, rows)))}


def encode_records(tables: dict[str, DataFrame], records: dict | None = None) -> DataFrame:
    """(t, k, ids): one row per readable record; t is the table's position in ``records``, ids
    its tuple, equal for equal records of a table and for no others."""
    records = records or RECORDS
    coded = _rewritten(tables, records, {})
    if assigned := clashes(coded):
        coded = _rewritten(tables, records, assigned)
    return coded.where("k IS NOT NULL").select("t", "k", "ids")


def _name(records: dict):
    return F.element_at(F.array(*[F.lit(n) for n in records]), F.col("t").cast("int") + 1).alias("table_name")


def found_copies(tables: dict[str, DataFrame], records: dict | None = None) -> DataFrame:
    """(table_name, first_key, copy_key): one row for every row of a record but its first.

    Fields that are all punctuation equal an empty text, not null; null equals only null; a
    fragment's missing field differs from a null one. Unreadable payloads are no records. Records
    whose copies fill a hash bucket (see ``session.hot_buckets``) are spread over salts and get
    their first key from a pre-aggregated table repeated for each salt; all others are numbered
    in one window pass."""
    records = records or RECORDS
    rows = encode_records(tables, records)
    salts, key = hot_buckets(rows, ["t", "ids"]), ["t", "ids"]
    cold, parts = rows, []
    if salts:
        at = bucket("t", "ids")
        hot = F.array_contains(F.array(*[F.lit(b).cast("long") for b in salts]), at)
        cold, rows = rows.where(~hot), rows.where(hot)
        firsts = rows.groupBy(*key).agg(F.min("k").alias("first_key"), F.count("*").alias("n")).where("n > 1").drop("n")
        firsts = with_salts(firsts, key, salts, None)
        parts = [with_salts(rows, key, salts, ["k"]).join(firsts, [*key, "salt"]).select("t", "k", "first_key")]
    parts.append(cold.withColumn("first_key", F.min("k").over(Window.partitionBy(*key))).select("t", "k", "first_key"))
    return reduce(DataFrame.union, parts).where("k <> first_key").select(_name(records), "first_key", F.col("k").alias("copy_key"))


def collapsed(tables: dict[str, DataFrame], records: dict | None = None) -> DataFrame:
    """(table_name, first_key, copies): each record once, with the number of its rows."""
    records = records or RECORDS
    groups = encode_records(tables, records).groupBy("t", "ids").agg(F.min("k").alias("first_key"), F.count("*").alias("copies"))
    return groups.select(_name(records), "first_key", "copies")
