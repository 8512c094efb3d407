import json
import random
import unicodedata
from collections import defaultdict
from decimal import Decimal

from nodeloom.llm import copies

NODES = "node_seq long, id string, label string, file_type string, source_file string, source_location string, community int, repo string, k long, a string"
EDGES = "edge_seq long, source string, target string, relation string, confidence string, confidence_score double, context string, source_file string, weight double"
FRAGMENTS = "fragment_id long, payload string"


def plain(v):
    if v is None or isinstance(v, bool):
        return (type(v).__name__, v)
    if isinstance(v, (int, float, Decimal)):
        return ("num", Decimal(str(v)))
    if isinstance(v, (dict, list)):
        return ("nested", json.dumps(v, default=str))
    s = unicodedata.normalize("NFC", unicodedata.normalize("NFC", v).casefold())
    return ("str", "".join(c for c in s if c.isalnum()))


def brute(tables):
    out = set()
    for name, (key, fields) in copies.RECORDS.items():
        groups = defaultdict(list)
        for row in tables[name]:
            if isinstance(fields, str):
                try:
                    record = json.loads(row[fields], parse_float=Decimal)
                except (ValueError, TypeError):
                    continue
                if not isinstance(record, dict):
                    continue
                groups[frozenset((k, plain(v)) for k, v in record.items())].append(row[key])
            else:
                groups[tuple(plain(row[f]) for f in fields)].append(row[key])
        for keys in groups.values():
            out |= {(name, min(keys), k) for k in keys if k != min(keys)}
    return out


def noisy(r, s):
    if s is None:
        return None
    s = "".join(r.choice([c, c, c.upper(), c.lower(), c + r.choice(" .,-\t​")]) for c in s)
    return r.choice(["", '"', " "]) + s


def tables(seed, n=300):
    r = random.Random(seed)
    word = lambda: r.choice([None, "", "alpha beta", "Straße", "é", "é", "x1", "１", "日本"])
    nodes = [dict(node_seq=k, id=noisy(r, r.choice(["hot", "hot", "a_1", "b"])), label=noisy(r, word()), file_type="code", source_file="s", source_location=noisy(r, word()), community=r.choice([None, 1, 2]), repo="r", k=5, a="clash") for k in range(n)]
    edges = [dict(edge_seq=k, source=noisy(r, "s"), target="t", relation=noisy(r, "calls"), confidence="E", confidence_score=r.choice([None, 0.5, 0.0, -0.0, 1.0]), context=word(), source_file="f", weight=r.choice([1.0, 0.1])) for k in range(n)]
    fragments = []
    for k in range(n):
        record = {"id": noisy(r, r.choice(["x y", "z"])), "n": r.choice([1, 1.0, 2, None, True, "1"]), "deep": r.choice([[1, 2], {"a": 1}, 3])}
        items = list(record.items())[: r.randrange(1, 4)]
        r.shuffle(items)
        text = json.dumps(dict(items), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))
        fragments.append(dict(fragment_id=k, payload=r.choice([text, text, text, text[:-2], None, "", "[1]", "NaN"])))
    return {"graph_nodes": nodes, "graph_edges": edges, "fragments": fragments}


def frames(spark, t):
    return {"graph_nodes": spark.createDataFrame([tuple(x.values()) for x in t["graph_nodes"]], NODES), "graph_edges": spark.createDataFrame([tuple(x.values()) for x in t["graph_edges"]], EDGES), "fragments": spark.createDataFrame([tuple(x.values()) for x in t["fragments"]], FRAGMENTS)}


def test_found_equals_brute_force(spark):
    t = tables(1)
    rows = [tuple(r) for r in copies.found_copies(frames(spark, t)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(t)
    assert {"graph_nodes", "graph_edges", "fragments"} == {r[0] for r in rows}


def test_hot_records_give_the_same(spark, monkeypatch):
    t = tables(2)
    whole = copies.hot_buckets
    monkeypatch.setattr(copies, "hot_buckets", lambda df, cols: whole(df, cols, factor=0.0, least=5))
    assert {tuple(r) for r in copies.found_copies(frames(spark, t)).collect()} == brute(t)


def test_values_that_share_an_identifier_are_told_apart(spark, monkeypatch):
    """Identifiers decide: with all values proposed the same few ones the dictionary must renumber
    them, and if it doesn't, the rows are wrong."""
    t = tables(5)
    # by value, so that the workers get it as well
    code = copies._Dictionary._entry
    def few(self, field, form):
        got = self.assigned.get((field, form))
        got = len(form) % 3 if got is None else got
        self.new.append((field, form, got))
        return got
    for name in ("_columns", "_payloads"):
        whole = getattr(copies, name)
        monkeypatch.setattr(copies, name, lambda *a, whole=whole: _with_entry(whole(*a), few))
    assert {tuple(r) for r in copies.found_copies(frames(spark, t)).collect()} == brute(t)
    assert copies._Dictionary._entry is code
    monkeypatch.setattr(copies, "clashes", lambda coded: {})
    assert {tuple(r) for r in copies.found_copies(frames(spark, t)).collect()} != brute(t)


def _with_entry(run, entry):
    def patched(batches):
        from nodeloom.llm import copies as there

        kept, there._Dictionary._entry = there._Dictionary._entry, entry
        try:
            yield from run(batches)
        finally:
            there._Dictionary._entry = kept

    return patched


def test_dictionary(spark):
    t = tables(6)
    coded = copies._rewritten(frames(spark, t), copies.RECORDS, {})
    words = [r for r in copies.dictionary(coded).collect()]
    assert len({r.id for r in words}) == len({(r.field, r.canonical) for r in words}) == len(words)
    assert {r.canonical for r in words if r.field == "weight"} == {"n1e0", "n1e-1"} and copies.clashes(coded) == {}
    by_id = {r.id: r.field for r in words}
    for r in coded.where("k IS NOT NULL").collect():
        assert [by_id[i] for i in r.ids] == sorted(by_id[i] for i in r.ids)


def test_collapsed_counts_every_row(spark):
    t = tables(3)
    f = frames(spark, t)
    rows = copies.collapsed(f).collect()
    extra = brute(t)
    assert sum(r.copies - 1 for r in rows) == len(extra)
    assert sum(r.copies for r in rows if r.table_name != "fragments") == 600


def test_numbers():
    same = [1, 1.0, Decimal("1.00"), Decimal("1E0"), 10**0]
    assert len({copies.canonical(x) for x in same}) == 1
    assert copies.canonical(0.1) == copies.canonical(Decimal("0.10")) != copies.canonical(Decimal("0.1000000001"))
    assert len({copies.canonical(x) for x in (None, "", 0, False, "0", [], {})}) == 7


def test_small_tables(spark, sf):
    from nodeloom.session import table

    f = {n: table(spark, sf, n) for n in copies.RECORDS}
    assert {tuple(r) for r in copies.found_copies(f).collect()} == brute({n: [r.asDict() for r in df.collect()] for n, df in f.items()})


def test_empty_tables(spark):
    f = {n: df.limit(0) for n, df in frames(spark, tables(4, 3)).items()}
    assert copies.found_copies(f).collect() == [] and copies.collapsed(f).collect() == []
