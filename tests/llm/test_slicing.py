import random
import re

from nodeloom.llm import slicing

SLICES = "slice_id long, path string, start_pos long, end_pos long, max_chars int, overlap_chars int, text string"
FILES = "path string, text string, slice_id long"


def brute_lines(text):
    """[(start, kind)] of all lines after the first, the slow way."""
    out, fenced, pos, previous = [], False, 0, None
    for line in re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", text):
        body = line.rstrip("\r\n")
        kind = 1
        if previous is not None and not previous.strip(" \t"):
            kind = 2
        if body.startswith("```"):
            fenced = not fenced
        elif not fenced and re.match(r"#{1,6}[ \t]", body):
            kind = 3
        if pos:
            out.append((pos, kind))
        pos, previous = pos + len(line), body
    return out


def brute(text, start, end, limit, overlap):
    lines, out = brute_lines(text), []
    start, end = start or 0, min(len(text) if end is None else end, len(text))
    if end - start <= limit:
        return []
    while end - start > limit:
        for kinds in ((3,), (2,), (1, 2, 3)):
            at = [p for p, k in lines if k in kinds and start + overlap < p <= start + limit]
            if at:
                break
        cut = max(at) if at else start + limit
        out.append((start, cut))
        start = cut - overlap
    return [*out, (start, end)]


def random_text(r, lines):
    kinds = ["# h", "## h\t", "####### no", "#no", "```", "``` py", "", "  ", "\t", "text here", "x" * 40, "длинно", " # no", "# "]
    return "".join(r.choice(kinds) + r.choice(["\n", "\n", "\r\n", "\r"]) for _ in range(lines)) + r.choice(["", "end"])


def test_boundaries_equal_brute_force():
    r = random.Random(1)
    for _ in range(300):
        text = random_text(r, r.randrange(0, 30))
        if not text:
            continue
        p, s = slicing.boundaries(text)
        assert list(zip(p.tolist(), s.tolist())) == brute_lines(text), text


def test_random_units(spark):
    r = random.Random(2)
    files = [(f"f{i}", random_text(r, r.randrange(1, 80)), 7) for i in range(20)] + [("null", None, 7), ("empty", "", 7)]
    texts = {p: t for p, t, _ in files}
    rows = []
    for k in range(300):
        path = r.choice([*texts, "f0", "f0", "missing", None])
        limit = r.randrange(5, 200)
        rows.append((k, path, r.choice([None, 0, 3, 50]), r.choice([None, 100, 400, 10**9]), limit, r.randrange(0, limit), "clash"))
    got = {}
    for x in slicing.split_units(spark.createDataFrame(rows, SLICES), spark.createDataFrame(files, FILES), units_per_salt=20).collect():
        got.setdefault(x.slice_id, []).append((x.piece_start, x.piece_end))
    want = {k: brute(texts[p], s, e, m, o) for k, p, s, e, m, o, _ in rows if texts.get(p)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_small_tables(spark, sf):
    from nodeloom.session import table

    files, slices = table(spark, sf, "source_files"), table(spark, sf, "file_slices")
    texts = {f.path: f.text for f in files.collect()}
    want = {(u.slice_id, b, e) for u in slices.collect() if texts.get(u.path) for b, e in brute(texts[u.path], u.start_pos, u.end_pos, u.max_chars, u.overlap_chars)}
    assert {tuple(r) for r in slicing.split_units(slices, files).collect()} == want


def test_odd_limits_and_empty_tables(spark):
    files = spark.createDataFrame([("a", "x" * 10, 1), ("a", "short", 1)], FILES)
    rows = [(1, "a", 0, None, 4, 9, ""), (2, "a", 0, None, 0, 0, ""), (3, "a", 0, None, None, 0, ""), (4, "a", -5, 8, 4, None, ""), (5, "a", 9, 2, 4, 0, ""), (5, "a", 0, 5, 4, 0, "")]
    slices = spark.createDataFrame(rows, SLICES)
    got = sorted(tuple(r) for r in slicing.split_units(slices, files).collect())
    assert got == [(1, i, i + 4) for i in range(7)] + [(4, 0, 4), (4, 4, 8), (5, 0, 4), (5, 4, 5)]
    assert slicing.split_units(slices.limit(0), files).collect() == [] and slicing.split_units(slices, files.limit(0)).collect() == []
