import json

from nodeloom.functions.jsontext import clean_py, read_object_py
from nodeloom.operators.external import call_chunks
from nodeloom.sources import files


def test_tolerant_json():
    assert read_object_py('{"a": 1}') == read_object_py('Sure!\n```json\n{"a": 1}\n```') == read_object_py('x {"a": 1} y') == {"a": 1}
    assert read_object_py('[{"id": 1}]') == {"nodes": [{"id": 1}]} and read_object_py("nothing") is None and read_object_py(None) is None


def test_metadata_is_bounded():
    got = clean_py({"a\x00": "<b>" + "x" * 600, "": 1, "l": list(range(99)), "n": {"t": True, "f": 1.5, "z": None}})
    assert set(got) == {"a", "l", "n"} and len(got["a"]) == 512 and got["a"].startswith("&lt;b&gt;") and len(got["l"]) == 50 and got["n"] == {"t": True, "f": 1.5, "z": None}


def test_chunks_are_bisected_until_they_succeed(spark):
    def call(text):
        if len(text) > 8:
            raise ValueError("too long")
        return "no json" if "bad" in text else json.dumps({"text": text})

    chunks = spark.createDataFrame([(1, "short"), (2, "line one\nline 2\n"), (3, "bad"), (4, None)], "chunk_id long, text string")
    rows = sorted(call_chunks(chunks, call, depth=1).collect())
    ok = {(r.chunk_id, r.part): json.loads(r.payload)["text"] for r in rows if r.payload}
    assert ok[(1, "")] == "short" and ok[(4, "")] == "" and "line 2\n" in ok.values()
    assert ok[(3, "0")] == "b" and {r.error for r in rows if r.error} == {"ValueError: too long"}


def test_suppression_sites(spark):
    rows = spark.createDataFrame([("a.py", "x\n  seen_ids: set[str] = set()\nseen_pairs: set[tuple[str, str]] = set()\n"), ("b", None)], "path string, text string")
    assert [tuple(r) for r in files.suppression_sites(rows).orderBy("line").collect()] == [("a.py", 2, "seen_ids", 0), ("a.py", 3, "seen_pairs", 2)]
