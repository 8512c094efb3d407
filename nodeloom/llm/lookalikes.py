"""Labels that look the same but differ in characters.

A character stands for *units*: full-width, half-width and ligature forms for what they show,
blanks for a space, the rest for their canonical decomposition, so that a letter and its accents
are units of their own. A weighted edit automaton reads the characters of a label over the trie of
the vocabulary's names: a look-alike unit and an ignorable character cost nothing, any other
substitution, insertion or deletion costs 1; at cost 0 the names that read the same are reached.

:func:`canonical_labels` gives the matched name's own spelling, or, for labels outside the
vocabulary, each token respelled by table: the letters of a look-alike class come out in the one
script that the token's unmistakable letters name (Latin if there are none), so two tokens that
look the same come out the same.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters and signs that are drawn alike (Cyrillic, Greek, Armenian, Coptic, Cherokee, Lisu,
# Roman numerals; kana and Han), first the one that names the class.
LOOKALIKES = {
    "latin": {
        "a": "аɑαⲁ", "c": "сϲⅽⲥ", "d": "ԁⅾ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іⅰιⲓ", "j": "јϳ", "l": "ӏⅼ",
        "m": "ⅿ", "n": "ո", "o": "оοօⲟ", "p": "рρⲣ", "q": "ԛզ", "s": "ѕ", "u": "սυ", "v": "νѵⅴ", "w": "ԝ",
        "x": "хⅹ", "y": "уүγ", "A": "АΑᎪꓮⲀ", "B": "ВΒᏴꓐⲂ", "C": "СϹⅭᏟꓚⲤ", "D": "ⅮᎠꓓ", "E": "ЕΕᎬꓰⲈ", "F": "ꓝ", "G": "Ꮐꓖ",
        "H": "НΗᎻꓧⲎ", "I": "ІΙӀⅠꓲⲒ", "J": "ЈᎫꓙ", "K": "КΚᏦꓗⲔ", "L": "ⅬᏞꓡ", "M": "МΜⅯᎷꓟⲘ", "N": "ΝꓠⲚ", "O": "ОΟՕꓳⲞ", "P": "РΡᏢꓑⲢ",
        "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔⲦ", "U": "Սꓴ", "V": "ⅤᏙꓦ", "W": "ԜᎳꓪ", "X": "ХΧⅩꓫⲬ", "Y": "ҮΥꓬⲨ",
        "Z": "ΖᏃꓜ",
    },
    "cyrillic": {"к": "κ", "п": "π", "ф": "ɸ", "Г": "Γ", "П": "Π", "Ф": "Φ", "Л": "Λ"},
    "kana": {"カ": "力", "ロ": "口", "ト": "卜", "ニ": "二", "ハ": "八", "エ": "工", "タ": "夕", "ヘ": "へ", "リ": "り", "ー": "一"},
    "sign": {"-": "‐‑‒", ".": "․"},
}
#: Compatibility forms that read the same as what they stand for.
_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<font>"}
_COMPAT = ((0xFB00, 0xFB06), (0x2160, 0x217F), (0x0132, 0x0133), (0x01C7, 0x01CC), (0x2F00, 0x2FD5), (0x2024, 0x2024))
#: Format characters that are drawn.
_DRAWN = ((0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x08E2, 0x08E2), (0x110BD, 0x110BD))
_FILLERS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0}

_CLASS = {c: rep for group in LOOKALIKES.values() for rep, others in group.items() for c in others}


def _inside(cp: int, ranges) -> bool:
    return any(a <= cp <= b for a, b in ranges)


@lru_cache(1 << 16)
def _units_of(ch: str) -> str:
    """The units of one character, '' if it is invisible."""
    cp, kind = ord(ch), unicodedata.category(ch)
    if kind in ("Zs", "Zl", "Zp") or ch in "\t\n\r\v\f\x85":
        return " "
    if cp in _FILLERS or kind == "Cc" or (kind == "Cf" and not _inside(cp, _DRAWN)) or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x180B <= cp <= 0x180F:
        return ""
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0] in _TAGS or _inside(cp, _COMPAT):
        return "".join(_units_of(chr(int(x, 16))) for x in parts[1:])
    return unicodedata.normalize("NFD", ch)


def units(text: str) -> str:
    """Unit sequence of a label (accents in canonical order)."""
    if text.isascii() and text.isprintable():
        return text
    return unicodedata.normalize("NFD", "".join(map(_units_of, text)))


def classes(text: str) -> str:
    """Unit sequence with each unit replaced by its class: equal for labels that read the same."""
    return "".join(_CLASS.get(u, u) for u in units(text))


class Trie:
    """Vocabulary trie over the names' units, run through by a weighted edit automaton.

    The automaton reads a label character by character; a state is a trie node with the cost of
    reaching it. An ignorable character stays in its state at no cost. Each unit of any other
    character moves at no cost along the edges of its look-alike class; a substitution, an
    insertion and a deletion cost 1 each. Accents are put in canonical order on the way."""

    def __init__(self, names: list[tuple[int, str]]):
        self.children: list[dict[str, int]] = [{}]
        self.alike: list[dict[str, list[int]]] = [{}]  # child nodes by look-alike class
        self.ends: dict[int, list[tuple[int, str]]] = {}
        for key, name in names:
            at = 0
            for u in units(name):
                nxt = self.children[at].get(u)
                if nxt is None:
                    nxt = self.children[at][u] = len(self.children)
                    self.alike[at].setdefault(_CLASS.get(u, u), []).append(nxt)
                    self.children.append({})
                    self.alike.append({})
                at = nxt
            self.ends.setdefault(at, []).append((key, name))

    def search(self, label: str, max_cost: int = 0) -> list[tuple[int, int, str]]:
        """[(cost, key, name)] of all names within ``max_cost`` of the label, cheapest first."""
        states, accents = self._without({0: 0}, max_cost), ""
        for ch in label:
            for u in _units_of(ch):  # none for an ignorable one
                if unicodedata.combining(u):
                    accents += u
                    continue
                if accents:
                    states, accents = self._read(states, accents, max_cost), ""
                states = self._step(states, u, max_cost)
                if not states:
                    return []
        states = self._read(states, accents, max_cost)
        return sorted((c, k, n) for node, c in states.items() for k, n in self.ends.get(node, ()))

    def _read(self, states: dict[int, int], accents: str, max_cost: int) -> dict[int, int]:
        for u in sorted(accents, key=unicodedata.combining):
            states = self._step(states, u, max_cost)
        return states

    def _step(self, states: dict[int, int], unit: str, max_cost: int) -> dict[int, int]:
        nxt: dict[int, int] = {}
        kind = _CLASS.get(unit, unit)
        for node, cost in states.items():
            for child in self.alike[node].get(kind, ()):
                if cost < nxt.get(child, max_cost + 1):
                    nxt[child] = cost
            if cost < max_cost:
                for to in (node, *self.children[node].values()):
                    if cost + 1 < nxt.get(to, max_cost + 1):
                        nxt[to] = cost + 1
        return self._without(nxt, max_cost)

    def _without(self, states: dict[int, int], max_cost: int) -> dict[int, int]:
        """States with those that leave out units of a name added."""
        todo = [n for n, c in states.items() if c < max_cost]
        while todo:
            node = todo.pop()
            c = states[node] + 1
            for child in self.children[node].values():
                if c <= max_cost and c < states.get(child, max_cost + 1):
                    states[child] = c
                    todo.append(child)
        return states


_TOKEN = re.compile(r"(\W+)")
_TO_CYRILLIC = {rep: next((c for c in others if "Ѐ" <= c <= "ӿ"), rep) for rep, others in LOOKALIKES["latin"].items()}
_TO_GREEK = {rep: next((c for c in others if "Ͱ" <= c <= "Ͽ"), rep) for rep, others in LOOKALIKES["latin"].items()}


def _script(token: str) -> dict[str, str]:
    """Respelling of class letters for a token of unit classes, by its unmistakable letters."""
    own = {unicodedata.name(c, "").split()[0] for c in token if c.isalpha() and c not in LOOKALIKES["latin"]}
    if "CYRILLIC" in own and not own & {"LATIN", "GREEK"}:
        return _TO_CYRILLIC
    if "GREEK" in own and not own & {"LATIN", "CYRILLIC"}:
        return _TO_GREEK
    return {}


def spell(label: str) -> str:
    """Consistent spelling by table, token by token, for labels outside the vocabulary."""
    out = []
    for token in _TOKEN.split(classes(label)):
        table = _script(token) if not token.isascii() else {}
        out.append("".join(table.get(c, c) for c in token))
    return unicodedata.normalize("NFC", "".join(out))


#: Units of a name or label by which both are sent to the same trie of a large vocabulary.
_ROUTE = 6


def _emitter(key: str, emit, schema: pa.Schema):
    """Function of (trie, batches of key and label): remembers repeated labels."""

    def run(trie: Trie, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for k, label in zip(batch.column(key).to_pylist(), batch.column("label").to_pylist()):
                got = memo.get(label)
                if got is None:
                    if len(memo) >= 1 << 17:
                        memo.clear()
                    got = memo[label] = emit(trie, label)
                for values in got:
                    rows[0].append(k)
                    for into, v in zip(rows[1:], values):
                        into.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, schema)], schema=schema)

    return run


def _searched(nodes: DataFrame, symbols: DataFrame, key: str, emit, schema: pa.Schema, ddl: str, names_per_trie: int, labels_per_task: int) -> DataFrame:
    """Runs ``emit`` over all labels with the tries of all names.

    Up to ``names_per_trie`` names (checked) are one trie on every executor. More are split by
    the class of their first units into tries of about that size, and labels go to the trie of
    their own first units: at no cost the automaton can't reach a name of another. A trie that
    gets more than ``labels_per_task`` labels is repeated for several parts of them."""
    spark, rows = nodes.sparkSession, nodes.select(key, F.col("label"))
    names, run = symbols.where("display_name IS NOT NULL").select("symbol_id", "display_name"), _emitter(key, emit, schema)
    few = names.limit(names_per_trie + 1).collect()
    if len(few) <= names_per_trie:
        sent = spark.sparkContext.broadcast([tuple(r) for r in few])
        return rows.mapInArrow(lambda batches: run(Trie(sent.value), batches), ddl)
    tries = -(-names.count() // names_per_trie)

    @F.pandas_udf("int")
    def route(values: pd.Series) -> pd.Series:
        return values.map(lambda x: crc32(classes(x)[:_ROUTE].encode("utf-8", "surrogatepass")) % tries if isinstance(x, str) else 0)

    rows, names = rows.withColumn("_t", route("label")), names.withColumn("_t", route("display_name"))
    parts = [(r["_t"], -(-r["n"] // labels_per_task)) for r in rows.groupBy("_t").agg(F.count("*").alias("n")).collect()]  # a row per trie
    table = spark.createDataFrame(parts, "_t int, _n int")
    rows = rows.join(F.broadcast(table), "_t").withColumn("_p", F.pmod(F.xxhash64(key), F.col("_n")).cast("int")).select("_t", "_p", key, "label")
    names = names.join(F.broadcast(table), "_t").withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select("_t", "_p", "symbol_id", "display_name")

    def both(labels: pa.Table, mine: pa.Table) -> pa.Table:
        trie = Trie(list(zip(mine.column("symbol_id").to_pylist(), mine.column("display_name").to_pylist())))
        return pa.Table.from_batches(run(trie, labels.select([key, "label"]).to_batches()), schema)

    return rows.groupBy("_t", "_p").cogroup(names.groupBy("_t", "_p")).applyInArrow(both, ddl)


def same_reading(nodes: DataFrame, symbols: DataFrame, key: str = "node_seq", names_per_trie: int = 200_000, labels_per_task: int = 1_000_000) -> DataFrame:
    """(key, symbol_id): rows whose label reads the same as a symbol's name without being it.

    One row per (node row, symbol). Null labels and null names match nothing; a label of
    invisible characters only reads as ''."""

    def emit(trie: Trie, label: str | None):
        return [] if label is None else [(k,) for _, k, name in trie.search(label) if name != label]

    schema = pa.schema([(key, pa.int64()), ("symbol_id", pa.int64())])
    return _searched(nodes, symbols, key, emit, schema, f"{key} long, symbol_id long", names_per_trie, labels_per_task)


def canonical_labels(nodes: DataFrame, symbols: DataFrame, key: str = "node_seq", names_per_trie: int = 200_000, labels_per_task: int = 1_000_000) -> DataFrame:
    """(key, canonical, matched): every row's label in one consistent form.

    The smallest name (by id) that reads the same, else the label respelled by table; null stays
    null. Labels that read the same come out equal."""

    def emit(trie: Trie, label: str | None):
        if label is None:
            return [(None, False)]
        found = trie.search(label)
        return [(min(found, key=lambda x: x[1])[2], True)] if found else [(spell(label), False)]

    schema = pa.schema([(key, pa.int64()), ("canonical", pa.string()), ("matched", pa.bool_())])
    return _searched(nodes, symbols, key, emit, schema, f"{key} long, canonical string, matched boolean", names_per_trie, labels_per_task)
