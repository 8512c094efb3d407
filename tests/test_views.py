import datetime as dt
import io
import json
import xml.etree.ElementTree as ET
import zipfile
import zlib

import pytest

from nodeloom import sinks, views
from nodeloom.operators import analyze, build, external
from nodeloom.sources import documents, graph_json
from tests.test_graph import graph, simple

W, X = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def docx():
    p = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    table = "<w:tbl>" + "".join(f"<w:tr>{''.join(f'<w:tc>{p(c)}</w:tc>' for c in row)}</w:tr>" for row in (["a", "b"], ["1", "2"])) + "</w:tbl>"
    body = f'<w:document xmlns:w="{W}"><w:body>{p("Title", "H1")}{p("x &amp; y")}{table}{p("item", "ListBullet")}<w:p/></w:body></w:document>'
    styles = f'<w:styles xmlns:w="{W}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    return archive(**{"word/document.xml": body, "word/styles.xml": styles})


def xlsx():
    rel = lambda *r: f'<Relationships xmlns="x">{"".join(f"<Relationship Id={chr(34)}{i}{chr(34)} Target={chr(34)}{t}{chr(34)}/>" for i, t in r)}</Relationships>'
    sheet = f'<worksheet xmlns="{X}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Qty</t></is></c></row><row r="3"><c r="B3"><v>7</v></c></row></sheetData></worksheet>'
    return archive(**{
        "xl/workbook.xml": f'<workbook xmlns="{X}" xmlns:r="{R}"><sheets><sheet name="S1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rel(("r1", "worksheets/s1.xml")), "xl/worksheets/s1.xml": sheet,
        "xl/worksheets/_rels/s1.xml.rels": rel(("t1", "../tables/t1.xml")), "xl/tables/t1.xml": f'<table xmlns="{X}" displayName="Stock" ref="A1:B3"/>', "xl/sharedStrings.xml": f'<sst xmlns="{X}"><si><t>Name</t></si></sst>',
    })


def pdf():
    plain, packed = b"BT /F1 12 Tf (Hello \\(you\\)) Tj T* [(Wor) -20 (ld) -300 (again)] TJ ET", zlib.compress(b"BT <48 69> Tj ET")
    return b"%PDF-1.4\n1 0 obj << /Length 9 >> stream\n" + plain + b"\nendstream endobj\n2 0 obj << /Filter /FlateDecode >> stream\n" + packed + b"\nendstream endobj\n"


def test_documents(spark):
    files = {"d/a.docx": docx(), "d/b.xlsx": xlsx(), "d/c.pdf": pdf(), "d/broken.docx": b"PK no", "d/e.pdf": b"", "d/x.txt": b"no"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()] + [("d/null.pdf", None)], "path string, content binary")
    got = {r.path: r.text for r in documents.document_text(df).collect()}
    assert got == {
        "d/a.docx": "# Title\nx & y\n- item\n\n| a | b |\n| --- | --- |\n| 1 | 2 |", "d/b.xlsx": "## Sheet: S1\n| Name | Qty |\n| --- | --- |\n|  | 7 |",
        "d/c.pdf": "Hello (you)\nWorld again\nHi", "d/broken.docx": "", "d/e.pdf": "",
    }
    side = {r.path: r for r in documents.sidecars(df).collect()}
    assert set(side) == {"d/a.docx", "d/b.xlsx"} and side["d/a.docx"].sidecar.startswith("a_") and side["d/a.docx"].text.startswith("<!-- converted from a.docx -->\n\n# Title")
    rows = documents.workbook_structure(df).collect()
    assert [(r.label, r.id) for r in rows if r.kind == "node"] == [("b.xlsx", "d_b_xlsx"), ("S1 (sheet)", "b_s1"), ("Stock", "b_s1_stock"), ("Name", "b_stock_name"), ("Qty", "b_stock_qty")]
    assert {(r.source, r.id) for r in rows if r.kind == "edge"} == {("d_b_xlsx", "b_s1"), ("b_s1", "b_s1_stock"), ("b_s1_stock", "b_stock_name"), ("b_s1_stock", "b_stock_qty")}


def test_archives_that_unpack_too_far(monkeypatch):
    assert documents.safe_archive(docx()) and not documents.safe_archive(b"PK")
    assert not documents.safe_archive(archive(a="0" * 3_000_000))  # a ratio no document has
    monkeypatch.setattr(documents, "MOST_UNPACKED", 100)
    assert not documents.safe_archive(docx()) and documents.docx_markdown(docx()) == ""


def test_drawings(spark):
    labels = {"a": 'A <"x">', "b": "b[1]"}
    g = simple(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], labels=labels, communities={"a": 1, "b": 1, "c": 2})
    d = views.drawn(g)
    assert [n["id"] for n in d.nodes] == ["a", "b", "c", "d"] and len(d.edges) == 4 and list(d.communities()) == [-1, 1, 2]
    picture = ET.fromstring(views.svg(d))
    assert len(picture.findall("{*}circle")) == 4 and len(picture.findall("{*}line")) == 4
    assert all(0 <= x <= 1 and 0 <= y <= 1 for x, y in views.layout(d).values())
    assert "A &lt;&quot;x&quot;&gt;" in views.graph_html(d) and "left out" not in views.graph_html(d)
    few = views.drawn(g, 2)
    assert [n["id"] for n in few.nodes] == ["a", "b"] and len(few.edges) == 1 and "2 less connected nodes left out" in views.graph_html(few)
    board = json.loads(views.canvas(d))
    groups = [n for n in board["nodes"] if n["type"] == "group"]
    assert [x["label"] for x in groups] == ["No community", "Community 1", "Community 2"] and len(board["nodes"]) == 7 and len(board["edges"]) == 4
    assert len({(x["x"], x["y"]) for x in groups}) == 3
    tree = views.tree_html(g.nodes)
    assert "<summary>src (4)</summary>" in tree and "a.py (1)" in tree
    flow = views.callflow_html(g)
    assert "flowchart LR" in flow and "community-1" in flow
    empty = views.drawn(simple(spark, []))
    assert empty.nodes == [] and "<svg" in views.svg(empty) and json.loads(views.canvas(empty)) == {"nodes": [], "edges": []}


def test_resources(spark):
    g = simple(spark, [("a", "b"), ("b", "c"), ("c", "a")], communities={"a": 1, "b": 1, "c": 2})
    got = views.resources(g)
    assert set(got) == {"report", "stats", "god-nodes", "surprises", "audit", "questions"}
    assert got["stats"] == "Nodes: 3\nEdges: 3\nCommunities: 2\nEXTRACTED: 100%\nINFERRED: 0%\nAMBIGUOUS: 0%\n" and "EXTRACTED: 3 (100%)" in got["audit"]
    assert "1. " in got["god-nodes"] and got["questions"].startswith("Suggested questions:")


def test_surprises_without_communities(spark):
    pairs = [(f"{s}{i}", f"{s}{j}") for s in "xy" for i in range(4) for j in range(i)] + [("x0", "y0")]
    g = simple(spark, pairs)
    assert analyze.structural_surprises(g, 1).first().asDict()["seq"] == len(pairs) - 1


def test_bridges_and_hyperedges(spark):
    g = simple(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d")], communities={"a": 1, "b": 2, "c": 3, "d": 3})
    assert [(r.id, r.degree, r.reach) for r in analyze.bridges(g).collect()] == [("c", 3, 2), ("a", 2, 2), ("b", 2, 2)]
    hyper = spark.createDataFrame([("h", ["a", "b", "d"]), ("i", ["c", "d"]), ("j", ["a", "none"])], "id string, nodes array<string>")
    assert [(r.id, r.communities) for r in analyze.community_hyperedges(hyper, g.nodes).collect()] == [("h", [1, 2, 3])]


def test_build_and_merge(spark):
    a, b = graph(spark, [("A-1", "b"), ("b", "c")]), graph(spark, [("c", "a_1"), ("c", "none")], labels={"c": "new"})
    g = build.build([(a.nodes, a.edges), (b.nodes.where("id <> 'none'"), b.edges)], dedup=False)
    assert {r.id: r.label for r in g.nodes.collect()} == {"a_1": "a_1", "b": "b", "c": "new"}
    assert {(r.u, r.v) for r in g.edges.collect()} == {("a_1", "b"), ("b", "c"), ("a_1", "c")}
    again = graph(spark, [("b", "x")])
    merged = build.build_merge(g, [(again.nodes, again.edges)], dedup=False)
    assert {r.id for r in merged.nodes.collect()} >= {"a_1", "b", "c", "x"} and ("b", "x") in {(r.u, r.v) for r in merged.edges.collect()}
    small = graph(spark, [], isolated=["b"])
    lost = spark.createDataFrame([("src/A-1.py",)], "source_file string")
    with pytest.raises(build.ShrinkError):
        broken = small.nodes.selectExpr("seq", "id", "label", "file_type", "'src/c.py' AS source_file", "source_location", "community", "repo")
        build.build_merge(g, [(broken, small.edges)], dedup=False)
    assert build.build_merge(g, [(small.nodes, small.edges)], pruned=lost, dedup=False).nodes.count() <= 3


def test_fragment_errors(spark):
    good = {"nodes": [{"id": "a:b", "file_type": "code"}, {"id": "c"}], "edges": [{"source": "a:b", "target": "c"}], "hyperedges": [{"id": "h", "nodes": ["a:b", "c"]}]}
    bad = {"nodes": [{"id": "../x", "file_type": "weird"}, {"id": ""}, {}], "edges": [{"source": "a"}], "hyperedges": [{"id": "h", "nodes": ["a"] * 300}, {"id": "h", "nodes": ["a b"]}]}
    rows = [(1, json.dumps(good)), (2, json.dumps(bad)), (3, "[1]"), (4, None), (5, "{"), (6, json.dumps({"nodes": [{"id": "n"}] * 10_001})), (7, "{}"), (8, json.dumps({"nodes": {"id": "x"}}))]
    got = {}
    for r in build.fragment_errors(spark.createDataFrame(rows, "fragment_id long, payload string")).collect():
        got.setdefault(r.fragment_id, []).append(r.error)
    assert set(got) == {2, 3, 4, 5, 6, 8}
    assert got[2] == [
        "nodes[0].id is not a valid id", "nodes[0].file_type is not one of code, concept, document, image, paper, rationale", "nodes[1].id is not a valid id", "nodes[2].id is not a valid id",
        "edges[0].target is not a valid id", "hyperedges[0].nodes has 300 entries; max is 256", "hyperedges[1].nodes holds an id that is not valid",
    ]
    assert got[3] == got[4] == got[5] == ["fragment must be a JSON object"] and got[6] == ["nodes has 10001 entries; max is 10000"] and got[8] == ["nodes must be a list"]


def test_labels_from_a_callback(spark):
    samples = spark.createDataFrame([(c, r, f"l{c}{r}") for c in range(3) for r in range(1, 20)], "community int, rank int, label string")

    def call(asked):
        return {c: f"{len(x)} {x[0]}" for c, x in asked if c != 2}

    assert {r.community: r.label for r in external.label_communities(samples, call).collect()} == {0: "12 l01", 1: "12 l11", 2: "Community 2"}
    assert {r.error for r in external.label_communities(samples, lambda asked: 1 / 0).collect()} == {"ZeroDivisionError: division by zero"}


def test_freshness_backup_and_size(spark, tmp_path):
    out, memory = tmp_path / "L.md", tmp_path / "memory"
    memory.mkdir()
    (memory / "a.md").write_text("x")
    at = lambda p: f"file://{p}"
    assert not sinks.lessons_fresh(spark, at(out), [at(memory), at(tmp_path / "none")])
    out.write_text("y")
    assert sinks.lessons_fresh(spark, at(out), [at(memory)])
    assert sinks.backup(spark, at(memory), dt.date(2025, 1, 2)) == f"{at(memory)}-2025-01-02" and (tmp_path / "memory-2025-01-02" / "a.md").read_text() == "x"
    assert sinks.backup(spark, at(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        graph_json.check_size(spark, at(memory), 0)
