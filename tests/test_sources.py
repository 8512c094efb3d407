import json

import pytest

from nodeloom import sinks
from nodeloom.operators import orphans
from nodeloom.sources import extractors, files, graph_json, manifests
from tests.test_graph import graph, simple

FILES = "path string, text string"


def frame(spark, d):
    return spark.createDataFrame(list(d.items()), FILES)


def test_scan_and_detect(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name, text in {"src/a.py": "x = 1", "notes.md": "hello world", "api_token.txt": "s", "run": "#!/usr/bin/env -S python3 -u\n", "x.bin": "", "package-lock.json": "{}"}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/b.js").write_text("y")
    got = {r.path.rsplit("/", 1)[-1]: (r.file_type, r.words) for r in files.detect(files.scan(spark, str(tmp_path))).collect()}
    assert got == {"a.py": ("code", 3), "notes.md": ("document", 2), "run": ("code", 4)}


@pytest.mark.parametrize("line,name", [("#!/bin/bash", "bash"), ("#!/usr/bin/env python3", "python3"), ("#!/usr/bin/env -i FOO=1 ruby -w", "ruby"), ("#!/usr/bin/env -u HOME node", "node"), ("print", None), ("", None)])
def test_shebang(spark, line, name):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(line,)], "t string").select(files.shebang(F.col("t")).alias("x")).first().x == name


@pytest.mark.parametrize("name,hit", [("api_token.txt", True), ("token-economics-of-recall.md", False), ("secret_store.txt", True), ("tokenizer.py", False), (".token", True), ("password-policy-discussion.md", False)])
def test_secret_names(spark, name, hit):
    from pyspark.sql import functions as F

    assert spark.range(1).select(files.keyword_hit(F.lit(name)).alias("x")).first().x is hit


def test_ignore_patterns(spark):
    rows = frame(spark, {"build/x.py": "", "src/a.log": "", "src/keep.log": "", "docs/reports/a.md": "", "reports/a.md": "", ".ignore": "*.log # logs\nbuild/\n!keep.log\n!build/x.py\n\n# c", "docs/.ignore": "/reports/*"})
    patterns = files.collect_patterns(rows, ".ignore")
    got = {r.path for r in files.with_match(rows, patterns).where("ignored").collect()}
    assert got == {"build/x.py", "src/a.log", "docs/reports/a.md"}


def test_pattern_regex_by_globs():
    from fnmatch import fnmatchcase
    from random import Random

    r = Random(3)
    for _ in range(3000):
        path = "/".join("".join(r.choice("ab.") for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 5)))
        glob = "".join(r.choice(["a", "b", ".", "*", "?", "/", "[ab]", "[!a]", "**/"]) for _ in range(r.randrange(1, 5))).strip("/")
        parts, found = path.split("/"), files.pattern_regex("", glob)
        if not glob:
            assert found is None
            continue
        leads = ["/".join(parts[:i]) for i in range(1, len(parts) + 1)]
        assert bool(found.fullmatch(path)) == any(fnmatchcase(x, glob) for x in [*parts, *leads]), (glob, path)
        assert bool(files.pattern_regex("a", "/" + glob).fullmatch(path)) == (path.startswith("a/") and fnmatchcase(path[2:], glob))


def test_pattern_lines(spark):
    text = "  a b  \r\n# c\nx\\#y #z\n\n#\n d\\  \n#!e\ne#f"
    rows = files.pattern_lines(frame(spark, {"p/q/.ignore": text, "n": "x"}), ".ignore").orderBy("line_no").collect()
    assert [(r.folder, r.pattern) for r in rows] == [("p/q", "a b"), ("p/q", "x#y"), ("p/q", "d\\ "), ("p/q", "e#f")]
    with pytest.raises(ValueError):
        files.collect_patterns(frame(spark, {"p/q/.ignore": text}), ".ignore", 3)


def test_apm():
    assert manifests.parse_apm("# x\nname: 'tool' # y\nversion: 1\ndependencies:\n- a/b\n- c: 1.0\n  d: 2\nother:\n  - z\n") == ("tool", ["a/b", "c"])
    assert manifests.parse_apm('name: t\ndependencies:\n  "@s/x": ^1\n  y:\n    git: u\n') == ("t", ["@s/x", "y"])
    assert manifests.parse_apm("- a\n") == (None, []) and manifests.parse_apm("") == (None, [])


def test_slices_cover_the_text(spark):
    text = "# a\n\nline one\nline two\n\n## b\n" + "word " * 50 + "\n\nend"
    for most in (7, 20, 60, 1000):
        points = files.slice_points(text, most)
        assert "".join(text[a:b] for a, b in points) == text and all(b - a <= most for a, b in points)
    rows = files.slices(frame(spark, {"a": text, "b": None, "c": ""}), 60).collect()
    assert {r.path for r in rows} == {"a", "c"} and {r.slice_total for r in rows if r.path == "a"} == {len(files.slice_points(text, 60))}
    assert files.bisect("ab\ncd", 0, 5) == [(0, 3), (3, 5)] and files.bisect("a", 0, 1) == []


def test_units_and_chunks(spark):
    text = "# a\n" + "x\n" * 40
    units = files.expand_oversized(frame(spark, {"a.md": text, "b.py": text, "c.txt": "x", "d.rst": None, "e": text}), 50).collect()
    assert {r.path: r.slice_total for r in units} == {"a.md": 2, "b.py": None, "c.txt": None, "d.rst": None, "e": None} and len(units) == 6
    sizes = {"a/x": 6, "a/y": 3, "b/x": 2, "b/y": 12, "b/z": 1, "c/1.png": 1, "c/2.png": 1, "c/3.png": 1, "c/z": None}
    rows = spark.createDataFrame(list(sizes.items()), "path string, tokens long")
    got = {r.path: r.chunk for r in files.pack_chunks(rows, 10, images=2).collect()}
    assert got == {"a/x": 0, "a/y": 0, "b/x": 1, "b/y": 2, "b/z": 3, "c/1.png": 3, "c/2.png": 3, "c/3.png": 4, "c/z": 4}
    blocks = {r.path: r.chunk for r in files.pack_chunks(rows, 100, images=9, per_block=4).collect()}
    assert [blocks[p] for p in sorted(sizes)] == [0, 0, 0, 0, 4, 4, 4, 4, 8]
    assert files.pack_chunks(rows.limit(0), 10).collect() == []


def test_front_matter_round_trip(spark):
    text = sinks.memory_document('what "is" it?\\', "answer", "useful", ["f()", 'g"h'])
    r = files.front_matter(spark.createDataFrame([(1, text), (2, "no"), (3, None), (4, "---- x")], "doc_id long, text string")).collect()
    assert [(x.doc_id, x.type, x.question, x.outcome, x.correction, x.source_nodes) for x in r] == [(1, "query", 'what "is" it?\\', "useful", None, ["f()", 'g"h'])]


def test_package_manifests(spark):
    got = {
        "a/pyproject.toml": '[project]\nname = "app"\ndependencies = ["requests>=2", "lib[x]; python_version<\'3.9\'"]\n', "b/go.mod": "module ex.org/m\nrequire (\n\tex.org/d v1.2\n)\nrequire ex.org/e v1\n",
        "c/pom.xml": '<project xmlns="u"><groupId>g</groupId><artifactId>p</artifactId><dependencies><dependency><artifactId>q</artifactId></dependency></dependencies></project>',
        "d/apm.yml": "name: tool\ndependencies:\n  - app\n", "e/pom.xml": "<broken", "x/other.toml": "",
    }
    nodes, edges = manifests.packages(frame(spark, got))
    assert {r.label for r in nodes.collect()} == {"app", "ex.org/m", "g:p", "tool"}
    assert {(r.source, r.target) for r in edges.collect()} == {("pkg_app", "pkg_requests"), ("pkg_app", "pkg_lib"), ("pkg_ex_org_m", "pkg_ex_org_d"), ("pkg_ex_org_m", "pkg_ex_org_e"), ("pkg_g_p", "pkg_q"), ("pkg_tool", "pkg_app")}
    nodes, edges = manifests.crates(frame(spark, {"a/Cargo.toml": '[package]\nname="a"\n[dependencies]\nb="1"\nserde="1"\n', "b/Cargo.toml": '[package]\nname="b"\n'}))
    assert [(r.source, r.target) for r in edges.collect()] == [("crate:a", "crate:b")] and nodes.count() == 2


def test_server_configs_never_show_values(spark):
    doc = {"mcpServers": {"fs": {"command": "/usr/bin/npx", "args": ["-y", "@scope/server-fs@1.2", "/secret/path"], "env": {"API_KEY": "sk-123"}}, "bad": 3}}
    nodes, edges = manifests.server_configs(frame(spark, {"p/.mcp.json": json.dumps(doc), "q/mcp.json": "{"}))
    rows = nodes.collect()
    assert {"fs", "npx", "@scope/server-fs", "API_KEY", ".mcp.json"} <= {r.label for r in rows}
    assert "sk-123" not in str(rows) + str(edges.collect()) and "/secret" not in str(rows)
    assert {r.relation for r in edges.collect()} == {"contains", "references", "requires_env"}


def test_symbol_index(spark):
    symbol = lambda s, **k: {"symbol": s, "display_name": s.split("#")[-1], **k}
    doc = {"documents": [
        {"relative_path": "a.py", "symbols": [symbol("m#A", relationships=[{"symbol": "m#B", "is_implementation": True}, {"symbol": "x#Z", "is_definition": "false"}], occurrences=[{"range": [4, 0]}])]},
        {"relative_path": "b.py", "symbols": [symbol("m#B")]},
    ]}
    nodes, edges = manifests.symbol_index(spark.createDataFrame([(json.dumps(doc),), ("nonsense",)], "text string"))
    by = {r.label: r for r in nodes.collect()}
    assert by["A"].source_location == "L5" and by["A"].id.startswith("scip_a_")
    got = {(r.relation, r.target) for r in edges.collect()}
    assert ("scip_impl", by["B"].id) in got and any(k == "scip_ref" and t.startswith("stub_") or k == "scip_def" and t.startswith("stub_") for k, t in got)


def test_catalog(spark):
    tables = spark.createDataFrame([("public", "users", "BASE TABLE"), ("public", "orders", "BASE TABLE")], "schema string, name string, type string")
    keys = spark.createDataFrame([("fk", "public", "orders", "public", "users")], "constraint string, schema string, `table` string, foreign_schema string, foreign_table string")
    nodes, edges = manifests.catalog_graph(tables, keys)
    assert [(r.source, r.target) for r in edges.collect()] == [("public_orders", "public_users")] and nodes.count() == 2
    views = spark.createDataFrame([("public", "v", "SELECT * FROM orders o JOIN \"public\".\"users\" u ON true -- from nothing"), ("app", "w", "SELECT 1 FROM v, x"), ("app", "hidden", None)], "schema string, name string, definition string")
    routines = spark.createDataFrame([("app", "f", "FUNCTION", "BEGIN SELECT 'from users' FROM app.w; END", "plpgsql"), ("app", "t", "TRIGGER", "x", None)], "schema string, name string, type string, definition string, language string")
    nodes, edges = manifests.catalog_graph(tables, keys, views, routines)
    assert {(r.id, r.kind) for r in nodes.collect()} == {("public_users", "base table"), ("public_orders", "base table"), ("public_v", "view"), ("app_w", "view"), ("app_hidden", "view"), ("app_f", "function")}
    assert {(r.source, r.target) for r in edges.where("relation = 'reads_from'").collect()} == {("public_v", "public_orders"), ("public_v", "public_users"), ("app_w", "public_v"), ("app_f", "app_w")}


def test_extractors(spark):
    got = {
        "p/m.py": '"""Module that does many things."""\nfrom q.util import run as go\nclass A(Base):\n    def f(self):\n        go()\n        self.g()\ndef h():\n    A()\n', "p/bad.py": "def (",
        "d/x.md": "# One\ntext\n```\n# no\n```\n## Two\n[link](y.md)\n", "s.sql": "CREATE TABLE users (id int); CREATE TABLE orders (u int REFERENCES users(id));\nCREATE VIEW v AS SELECT * FROM orders;",
        "c.json": '{"a": {"b": 1}}', "r.sh": "source ./lib.sh\nmain() {\n  helper\n}\n", "n.txt": "x",
    }
    rows = extractors.extract(frame(spark, got)).collect()
    of = lambda path, kind: {(r.label, r.relation, r.id) for r in rows if r.path == path and r.kind == kind}
    assert {".f()", "A", "h()", "m.py"} <= {x[0] for x in of("p/m.py", "node")}
    assert {x[0] for x in of("p/m.py", "call")} == {"go", "A"} and {x[0] for x in of("p/m.py", "member_call")} == {"g"}
    assert of("p/m.py", "alias") == {("go", None, "util")} or {(x[0], x[2]) for x in of("p/m.py", "alias")} == {("go", "util")}
    assert {x[0] for x in of("d/x.md", "node")} == {"x.md", "One", "Two"} and len(of("p/bad.py", "error")) == 1
    assert {("references", "users"), ("reads_from", "orders")} <= {(x[1], x[2]) for x in of("s.sql", "edge")}
    assert {x[0] for x in of("c.json", "node")} == {"c.json", "a", "b"} and {x[0] for x in of("r.sh", "call")} == {"helper"} and {x[0] for x in of("r.sh", "source")} == {"./lib.sh"}


def test_graph_document_round_trip(spark, tmp_path):
    g = simple(spark, [("b", "a"), ("b", "c")], communities={"a": 1})
    graph_json.write_document(g, str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    doc = json.loads(text)
    assert len(doc["nodes"]) == 3 and {(e["source"], e["target"]) for e in doc["links"]} == {("b", "a"), ("b", "c")}
    assert all(e["confidence_score"] == 1.0 for e in doc["links"])
    path = tmp_path / "g.json"
    path.write_text(text)
    back = graph_json.read(spark, str(path))
    assert {(r.id, r.community) for r in back.nodes.collect()} == {("a", 1), ("b", None), ("c", None)} and back.directed
    graph_json.write(g, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/edges")).count() == 2


def test_aliases(spark):
    rows = spark.createDataFrame([(0, {"uid": "x", "path": "a.md"}), (1, {"label": "only"})], "seq long, attrs map<string,string>")
    got = [(r.id, r.label, r.file_type, r.community) for r in graph_json.normalize_nodes(rows).orderBy("seq").collect()]
    assert got == [("x", "x", "document", "unknown"), ("node_2", "only", "code", "unknown")]
    rows = spark.createDataFrame([(0, {"src": "x", "dst": "y", "type": "CALLS", "score": "bad"}), (1, {"src": "x"})], "seq long, attrs map<string,string>")
    assert [tuple(r)[1:] for r in graph_json.normalize_edges(rows).collect()] == [("x", "y", "calls", "EXTRACTED", 1.0)]


def test_sinks(spark):
    g = simple(spark, [("a", "b")], labels={"a": "it's\n\\x"}, communities={"a": 1, "b": 2})
    lines = [r.line for r in sinks.cypher(g).orderBy("part", "seq").collect()]
    assert lines[0] == "MERGE (n:Code {id: 'a', label: 'it\\'s\\\\x'});" and "-[:CALLS {confidence: 'EXTRACTED'}]->" in lines[2]
    assert '<node id="a">' in sinks.graphml(g).where("part = 0").orderBy("seq").first().line
    assert "[[b]] calls" in {r.id: r.text for r in sinks.notes(g).collect()}["a"]
    assert "[[Community 2]] (1 shared" in {r.community: r.text for r in sinks.articles(g).collect()}[1]
    assert "2 nodes, 1 edges" in sinks.report(g)


def test_query_log_and_push(spark, tmp_path):
    sinks.log_query(spark, str(tmp_path / "log"), question="q", depth=2)
    sinks.log_query(spark, str(tmp_path / "log"), question="r")
    assert {json.loads(r.value)["question"] for r in spark.read.text(str(tmp_path / "log")).collect()} == {"q", "r"}
    out = tmp_path / "pushed"
    sinks.push(graph(spark, [("a", "b")]).edges, lambda rows: open(out, "a").writelines(r.source + "\n" for r in rows))
    assert out.read_text() == "a\n"


def test_streams(spark, tmp_path, sf, at):
    from nodeloom.session import table
    from nodeloom.streaming import changes

    src = str(tmp_path / "events")
    table(spark, sf, "events").write.parquet(src)
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(src)
    q = changes.counted(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM counted").first().n == table(spark, sf, "events").count()
    q = changes.debounced(stream, "30 minutes").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT count(*) AS n FROM bursts").first().n > 0
    q = changes.distinct_changes(stream, ["user_id", "event_type"]).writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < spark.sql("SELECT count(*) AS n FROM once").first().n <= table(spark, sf, "events").count()
    got = []
    renamed = stream.selectExpr("event_type AS path")
    changes.on_batch(renamed, lambda df, i: got.append({r.path for r in df.collect()}), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert got and got[0] == {r.event_type for r in table(spark, sf, "events").select("event_type").distinct().collect()}


def test_orphan_stream_equals_batch(spark, tmp_path, at):
    from nodeloom.streaming.changes import OrphanStream
    from tests.test_orphans import EDGES, NODES, brute, random_tables

    nodes, edges = random_tables(at, 8, 200)
    schema = "kind string, edge_seq long, source string, target string, arrived_at timestamp_ntz, id string, at timestamp_ntz, d int"
    rows = [("edge", k, s, t, a, None, None, None) for k, s, t, a, _ in edges if a]
    for _, i, a, r, _ in nodes:
        if a and (r is None or r > a):
            rows += [("parent", None, None, None, None, i, a, 1)] + ([("parent", None, None, None, None, i, r, -1)] if r else [])
    op = OrphanStream(str(tmp_path))
    cuts = [at(0), at(30), at(60), at(1000)]
    for b in range(3):
        part = [x for x in rows if cuts[b] <= (x[4] or x[6]) < cuts[b + 1]]
        op(spark.createDataFrame(part, schema), b)
        op(spark.createDataFrame(part, schema), b)  # run again after a failure
    found = {tuple(r) for b in range(3) for r in spark.read.parquet(f"{tmp_path}/found-{b}").collect()}
    assert found == brute(nodes, edges)
    whole = orphans.fold_history(spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES))
    assert sorted(map(tuple, whole.state().collect())) == sorted(map(tuple, op.state(spark, 2).collect()))
