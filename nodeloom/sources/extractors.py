"""Source extractors as one Arrow pass: text in, rows of nodes, edges and raw calls out.

``extract`` dispatches by suffix over :data:`EXTRACTORS`; more languages are added by putting a
function ``(path, text) -> rows`` there. What crosses files is resolved by joins
(``operators.symbols``).
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from nodeloom.functions.ids import make_id_py
from nodeloom.sources.languages import SUFFIXES

Row = tuple[str, str | None, str | None, str | None, str | None, int]  # kind, id, label, source, relation, line
SCHEMA = "path string, kind string, id string, label string, source string, relation string, line int"


def _file(path: str) -> tuple[str, list[Row]]:
    parts = path.rsplit("/", 2)
    name = parts[-1]
    nid = make_id_py(*parts[-2:-1], name.rsplit(".", 1)[0])
    return nid, [("node", nid, name, None, None, 1)]


def python(path: str, text: str) -> list[Row]:
    """Classes, functions and methods, inheritance, imports, raw calls, docstrings as rationale."""
    fid, rows = _file(path)
    tree = ast.parse(text)
    seen = {fid}

    def node(nid: str, label: str, parent: str, relation: str, line: int) -> None:
        if nid not in seen:
            seen.add(nid)
            rows.append(("node", nid, label, None, None, line))
        rows.append(("edge", nid, None, parent, relation, line))

    def docstring(owner: ast.AST, nid: str) -> None:
        doc = ast.get_docstring(owner)
        if doc and len(doc) > 20:
            line = getattr(owner, "lineno", 1)
            node(make_id_py(nid, "rationale", str(line)), " ".join(doc.split())[:256], nid, "documented_by", line)

    def body(owner: ast.AST, nid: str, inside_class: bool) -> None:
        for child in ast.iter_child_nodes(owner):
            if isinstance(child, ast.ClassDef):
                cid = make_id_py(nid, child.name)
                node(cid, child.name, nid, "contains", child.lineno)
                docstring(child, cid)
                for base in child.bases:
                    rows.append(("edge", make_id_py(ast.unparse(base)), None, cid, "inherits", child.lineno))
                body(child, cid, True)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                cid = make_id_py(nid, child.name)
                node(cid, f".{child.name}()" if inside_class else f"{child.name}()", nid, "method" if inside_class else "contains", child.lineno)
                docstring(child, cid)
                for call in ast.walk(child):
                    if isinstance(call, ast.Call):
                        member = isinstance(call.func, ast.Attribute)
                        callee = call.func.attr if member else getattr(call.func, "id", None)
                        if callee:
                            rows.append(("member_call" if member else "call", None, callee, cid, "calls", call.lineno))
                body(child, cid, False)

    docstring(tree, fid)
    for item in tree.body:
        if isinstance(item, ast.Import):
            rows += [("edge", make_id_py(a.name), None, fid, "imports", item.lineno) for a in item.names]
        elif isinstance(item, ast.ImportFrom):
            module = item.module or ""
            rows.append(("edge", make_id_py(module), None, fid, "imports_from", item.lineno))
            rows += [("alias", (module.rsplit(".", 1)[-1]), a.asname or a.name, a.name, None, item.lineno) for a in item.names if a.name != "*"]
    body(tree, fid, False)
    return rows


def markdown(path: str, text: str) -> list[Row]:
    """Headings under the heading above, fenced code left out, links to other documents."""
    fid, rows = _file(path)
    above, fenced = [(0, fid)], False
    for n, line in enumerate(re.split(r"\r\n|\r|\n", text), 1):
        if line.startswith("```"):
            fenced = not fenced
        heading = None if fenced else re.match(r"(#{1,6})[ \t]+(.*?)[ \t]*#*$", line)
        if heading and heading[2]:
            depth = len(heading[1])
            while above[-1][0] >= depth:
                above.pop()
            nid = make_id_py(fid, heading[2], str(n))
            rows += [("node", nid, heading[2][:256], None, None, n), ("edge", nid, None, above[-1][1], "contains", n)]
            above.append((depth, nid))
        elif not fenced:
            for target in re.findall(r"\]\(([^)#\s]+\.mdx?)(?:#[^)]*)?\)", line):
                rows.append(("edge", make_id_py(*target.rsplit("/", 2)[-2:]).removesuffix("_md"), None, fid, "references", n))
    return rows


def json_keys(path: str, text: str) -> list[Row]:
    """Keys of an object and of the objects in it, under the file."""
    fid, rows = _file(path)

    def walk(value, parent: str) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                nid = make_id_py(parent, k)
                rows.extend([("node", nid, k[:256], None, None, 1), ("edge", nid, None, parent, "contains", 1)])
                walk(v, nid)

    walk(json.loads(text), fid)
    return rows


_DDL = re.compile(r"(?is)\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(table|view|materialized\s+view|function|procedure)\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)(.*?)(?=\bcreate\s+(?:or\s+replace\s+)?(?:temp|table|view|materialized|function|procedure)|\Z)")


def sql(path: str, text: str) -> list[Row]:
    """Tables, views and functions, foreign keys, what views and functions read."""
    fid, rows = _file(path)
    text = re.sub(r"--[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    for m in _DDL.finditer(text):
        kind, name, rest = m[1].lower().split()[-1], m[2].replace('"', ""), m[3]
        line = text.count("\n", 0, m.start()) + 1
        nid = make_id_py(name)
        label = f"{name}()" if kind in ("function", "procedure") else name
        rows += [("node", nid, label, None, None, line), ("edge", nid, None, fid, "contains", line)]
        for pattern, relation in ((r"(?i)\breferences\s+([\w.\"]+)", "references"), (r"(?i)\b(?:from|join)\s+([\w.\"]+)", "reads_from")):
            if relation == "references" or kind != "table":
                rows += [("edge", t, None, nid, relation, line) for t in dict.fromkeys(make_id_py(x.replace('"', "")) for x in re.findall(pattern, rest)) if t != nid]
    return rows


def bash(path: str, text: str) -> list[Row]:
    """Functions, sourced scripts, raw calls of words in command position."""
    fid, rows = _file(path)
    current = fid
    for n, line in enumerate(text.splitlines(), 1):
        function = re.match(r"\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{?", line)
        sourced = re.match(r"\s*(?:source|\.)\s+[\"']?([^\s\"';]+)", line)
        if function:
            current = make_id_py(fid, function[1])
            rows += [("node", current, f"{function[1]}()", None, None, n), ("edge", current, None, fid, "contains", n)]
        elif sourced:
            rows.append(("source", None, sourced[1], fid, "imports_from", n))
        elif line.startswith("}"):
            current = fid
        else:
            word = re.match(r"\s*([A-Za-z_][\w-]*)(?=\s|$|;)", line)
            if word and word[1] not in ("if", "then", "else", "fi", "for", "do", "done", "while", "case", "esac", "echo", "local", "export", "return"):
                rows.append(("call", None, word[1], current, "calls", n))
    return rows


EXTRACTORS: dict[str, Callable[[str, str], list[Row]]] = {**SUFFIXES, ".py": python, ".pyi": python, ".md": markdown, ".mdx": markdown, ".markdown": markdown, ".json": json_keys, ".sql": sql, ".sh": bash, ".bash": bash}


def extract(files: DataFrame, extractors: dict[str, Callable[[str, str], list[Row]]] | None = None) -> DataFrame:
    """Rows of :data:`SCHEMA` for (path, text): kind node (id, label), edge (source -relation-> id),
    call and member_call (source calls label), alias (label = id.source), source (a sourced path),
    error (label). A file that can't be parsed gives one error row; other suffixes give nothing."""
    table = extractors or EXTRACTORS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text in zip(b.path, b.text):
                f = table.get("." + path.rsplit(".", 1)[-1].lower()) if "." in path else None
                if f is None:
                    continue
                try:
                    out += [(path, *row) for row in f(path, text)]
                except Exception as e:
                    out.append((path, "error", None, f"{type(e).__name__}: {e}"[:256], None, None, 0))
            yield pd.DataFrame(out, columns=["path", "kind", "id", "label", "source", "relation", "line"])

    return files.where("path IS NOT NULL AND text IS NOT NULL").select("path", "text").mapInPandas(run, SCHEMA)
