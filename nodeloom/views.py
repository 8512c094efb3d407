"""Drawings of a graph for people: pages and pictures of a bounded part of it.

:func:`drawn` picks the part on the cluster, the best connected nodes and the edges between them,
and is all that reaches the driver; the rest is plain text around it.
"""

from __future__ import annotations

import html
import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.text import safe_filename
from nodeloom.operators import analyze
from nodeloom.operators.build import degrees
from nodeloom.schema import Graph

PALETTE = ["#4E79A7", "#F28E2B", "#E15759", "#76B7B2", "#59A14F", "#EDC948", "#B07AA1", "#FF9DA7", "#9C755F", "#BAB0AC"]


@dataclass
class Drawing:
    """``nodes``: id, label, community, degree, file, name; ``edges``: source, target, relation,
    confidence; ``total``: nodes of the whole graph."""

    nodes: list[dict]
    edges: list[dict]
    total: int

    def communities(self) -> dict[int, list[dict]]:
        out: dict[int, list[dict]] = {}
        for n in self.nodes:
            out.setdefault(-1 if n["community"] is None else n["community"], []).append(n)
        return dict(sorted(out.items()))


def drawn(graph: Graph, most: int = 5000) -> Drawing:
    """The ``most`` best connected nodes, then by seq, and the edges between them."""
    total = graph.nodes.count()
    best = graph.nodes.join(degrees(graph), "id").orderBy(F.desc("degree"), "seq", "id").limit(most)
    best = best.select("id", F.coalesce("label", "id").alias("label"), "community", "degree", F.coalesce("source_file", F.lit("")).alias("file"), safe_filename(F.coalesce("label", "id")).alias("name"))
    nodes = [r.asDict() for r in best.collect()]  # at most ``most`` rows
    ids = F.broadcast(graph.edges.sparkSession.createDataFrame([(n["id"],) for n in nodes], "id string"))
    edges = graph.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    rows = edges.orderBy("seq").select("source", "target", "relation", "confidence").limit(20 * most).collect()
    return Drawing(nodes, [r.asDict() for r in rows], total)


def layout(d: Drawing) -> dict[str, tuple[float, float]]:
    """Positions from 0 to 1: communities on a spiral, their nodes on circles around it."""
    out, turn = {}, math.pi * (3 - math.sqrt(5))
    groups = sorted(d.communities().values(), key=len, reverse=True)
    for i, members in enumerate(groups):
        r = 0.42 * math.sqrt((i + 0.5) / len(groups)) if len(groups) > 1 else 0.0
        cx, cy, spread = 0.5 + r * math.cos(i * turn), 0.5 + r * math.sin(i * turn), 0.45 / math.sqrt(len(groups)) if len(groups) > 1 else 0.45
        for k, n in enumerate(members):
            q = spread * math.sqrt((k + 0.5) / len(members))
            out[n["id"]] = (cx + q * math.cos(k * turn), cy + q * math.sin(k * turn))
    return out


def _color(community: int | None) -> str:
    return PALETTE[(community or 0) % len(PALETTE)]


def _radius(n: dict) -> float:
    return 4 + 2.5 * math.log1p(n["degree"])


def svg(d: Drawing, size: int = 1200) -> str:
    """A static picture; edges that are not extracted are dashed."""
    at = {k: (x * size, y * size) for k, (x, y) in layout(d).items()}
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {size} {size}" font-family="sans-serif" font-size="9">']
    for e in d.edges:
        (x1, y1), (x2, y2) = at[e["source"]], at[e["target"]]
        dash = "" if (e["confidence"] or "EXTRACTED") == "EXTRACTED" else ' stroke-dasharray="4 3"'
        out.append(f'<line x1="{x1:.1f}" y1="{y1:.1f}" x2="{x2:.1f}" y2="{y2:.1f}" stroke="#aaa" stroke-width="0.6"{dash}/>')
    for n in d.nodes:
        x, y = at[n["id"]]
        out.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="{_radius(n):.1f}" fill="{_color(n["community"])}"><title>{html.escape(n["label"])}</title></circle>')
        out.append(f'<text x="{x + _radius(n) + 1:.1f}" y="{y + 3:.1f}">{html.escape(n["label"][:40])}</text>')
    return "\n".join([*out, "</svg>"])


_PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>{style}</style></head>
<body>{body}</body></html>
"""
_STYLE = "body{font-family:sans-serif;margin:0}header{padding:8px 12px;border-bottom:1px solid #ddd}main{padding:12px}svg{width:100%;height:88vh}table{border-collapse:collapse}td,th{border:1px solid #ddd;padding:3px 8px}details{margin-left:16px}.off{display:none}"
_SCRIPT = """<script>
const find = document.getElementById('find');
find.addEventListener('input', () => {
  const q = find.value.toLowerCase();
  document.querySelectorAll('svg circle').forEach(c => c.style.opacity = c.textContent.toLowerCase().includes(q) ? 1 : 0.12);
});
</script>"""


def page(title: str, body: str) -> str:
    return _PAGE.format(title=html.escape(title), style=_STYLE, body=body)


def graph_html(d: Drawing, title: str = "Graph") -> str:
    """A page with the picture, a search box and what was left out."""
    left = f" ({d.total - len(d.nodes)} less connected nodes left out)" if d.total > len(d.nodes) else ""
    legend = " ".join(f'<span style="color:{_color(c)}">&#9679; {"none" if c < 0 else c} ({len(m)})</span>' for c, m in d.communities().items())
    head = f"<header><b>{html.escape(title)}</b> {len(d.nodes)} nodes, {len(d.edges)} edges{left} <input id='find' placeholder='Find'><br>{legend}</header>"
    return page(title, head + svg(d) + _SCRIPT)


def canvas(d: Drawing) -> str:
    """JSON of a canvas: communities as groups in a grid, nodes as file cards in rows of three."""
    groups = d.communities()
    columns = max(1, math.ceil(math.sqrt(len(groups))))
    sizes = {c: (max(600, 220 * math.ceil(math.sqrt(len(m)))), max(400, 100 * math.ceil(len(m) / 3) + 120)) for c, m in groups.items()}
    order = list(groups)
    lines = [order[i : i + columns] for i in range(0, len(order), columns)]
    widths = [max(sizes[line[k]][0] for line in lines if k < len(line)) for k in range(min(columns, len(order)))]
    nodes, place, y = [], {}, 0
    for line in lines:
        for k, c in enumerate(line):
            place[c] = (sum(widths[:k]) + 80 * k, y)
        y += max(sizes[c][1] for c in line) + 80
    for i, (c, members) in enumerate(groups.items()):
        (gx, gy), (w, h) = place[c], sizes[c]
        nodes.append({"id": f"g{c}", "type": "group", "label": "No community" if c < 0 else f"Community {c}", "x": gx, "y": gy, "width": w, "height": h, "color": str(i % 6 + 1)})
        for k, n in enumerate(sorted(members, key=lambda n: n["label"])):
            nodes.append({"id": f"n_{n['id']}", "type": "file", "file": f"{n['name']}.md", "x": gx + 20 + k % 3 * 200, "y": gy + 80 + k // 3 * 80, "width": 180, "height": 60})
    edges = [{"id": f"e_{i}", "fromNode": f"n_{e['source']}", "toNode": f"n_{e['target']}", "label": f"{e['relation']} [{e['confidence'] or 'EXTRACTED'}]"} for i, e in enumerate(d.edges[:200])]
    return json.dumps({"nodes": nodes, "edges": edges}, ensure_ascii=False, indent=1)


def tree_html(nodes: DataFrame, most: int = 20_000, title: str = "Files") -> str:
    """A page of nested folders and files with their numbers of symbols, the ``most`` shallowest
    paths."""
    rows = analyze.path_tree(nodes).orderBy("depth", "path").limit(most).collect()
    below: dict[str, list] = {}
    for r in rows:
        below.setdefault(r["path"].rpartition("/")[0] if r["depth"] > 1 else "", []).append(r)

    def render(rows: list) -> str:
        out = []
        for r in sorted(rows, key=lambda r: (r["path"] not in below, r["path"])):
            name, inner = html.escape(r["path"].rpartition("/")[2] or "/"), below.get(r["path"], []) if r["depth"] < 200 else []
            out.append(f"<details><summary>{name} ({r['leaves']})</summary>{render(inner)}</details>" if inner else f"<div style='margin-left:16px'>{name} ({r['leaves']})</div>")
        return "".join(out)

    return page(title, f"<header><b>{html.escape(title)}</b></header><main>{render(below.get('', []))}</main>")


def _mermaid(text: str) -> str:
    return text.replace('"', "'").replace("[", "(").replace("]", ")").replace("\n", " ")[:60]


def flow_diagram(graph: Graph, n: int = 24) -> str:
    """Mermaid text of the nodes chosen by ``analyze.select_nodes`` and the calls between them."""
    chosen = analyze.select_nodes(graph, n).join(graph.nodes.select("id", F.coalesce("label", "id").alias("label")), "id").orderBy("rank").collect()
    ids = {r["id"]: f"n{i}" for i, r in enumerate(chosen)}
    frame = graph.edges.sparkSession.createDataFrame([(x,) for x in ids], "id string")
    small = F.broadcast(frame)
    inside = graph.edges.join(small.withColumnRenamed("id", "source"), "source", "left_semi").join(small.withColumnRenamed("id", "target"), "target", "left_semi")
    rows = inside.where(analyze.includable(F.col("confidence"), F.col("confidence_score"))).orderBy("seq").limit(20 * n).collect()
    lines = ["flowchart LR", *[f'  {ids[r["id"]]}["{_mermaid(r["label"])}"]' for r in chosen]]
    return "\n".join([*lines, *[f'  {ids[r["source"]]} -->|{_mermaid(r["relation"] or "")}| {ids[r["target"]]}' for r in rows]])


def callflow_html(graph: Graph, most: int = 15, title: str = "Architecture") -> str:
    """A page of the sections of a graph: for each its size and a diagram, and the links between
    the sections. The largest ``most`` sections are shown."""
    member = graph.nodes.where("community IS NOT NULL").join(analyze.sections(graph.nodes), "community").select("id", F.coalesce("section", F.concat(F.lit("community-"), F.col("community").cast("string"))).alias("section"))
    sizes = member.groupBy("section").count().orderBy(F.desc("count"), "section").limit(most).collect()
    links = analyze.classify_edges(graph.edges, member).where("kind = 'inter'").groupBy("s_section", "t_section").count().orderBy(F.desc("count"), "s_section", "t_section").limit(4 * most).collect()
    chain = analyze.flow_chain([(r["s_section"], r["t_section"], r["count"]) for r in links], [r["section"] for r in sizes])
    parts = [f"<header><b>{html.escape(title)}</b></header><main><p>{' &rarr; '.join(html.escape(x) for x in chain)}</p>"]
    parts.append("<table><tr><th>from</th><th>to</th><th>links</th></tr>" + "".join(f"<tr><td>{html.escape(r['s_section'])}</td><td>{html.escape(r['t_section'])}</td><td>{r['count']}</td></tr>" for r in links) + "</table>")
    for r in sizes:
        ids = member.where(F.col("section") == r["section"]).select("id")
        part = Graph(graph.nodes.join(ids, "id", "left_semi"), graph.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi"), graph.directed)
        parts.append(f"<h2>{html.escape(r['section'])}</h2><p>{r['count']} nodes</p><pre class='mermaid'>{html.escape(flow_diagram(part))}</pre>")
    return page(title, "".join(parts) + "</main>")


# resources of a served graph


def resources(graph: Graph, report: str = "") -> dict[str, str]:
    """The fixed views of a graph by name: report, stats, god-nodes, surprises, audit, questions."""
    counts = {r[0]: r[1] for r in graph.edges.groupBy(F.coalesce("confidence", F.lit("EXTRACTED"))).count().collect()}  # a few kinds
    n, total = graph.nodes.agg(F.count("*"), F.count_distinct("community")).first(), sum(counts.values())
    share = lambda k: f"{round(100 * counts.get(k, 0) / (total or 1))}%"
    kinds = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
    label = graph.nodes.select("id", F.coalesce("label", "id").alias("name"))
    surprises = analyze.surprising(graph, 10)
    named = surprises.join(label.withColumnsRenamed({"id": "source", "name": "a"}), "source", "left").join(label.withColumnsRenamed({"id": "target", "name": "b"}), "target", "left").collect()
    questions = analyze.suggested_questions(graph, n=10).collect()
    return {
        "report": report or "No report yet.",
        "stats": f"Nodes: {n[0]}\nEdges: {total}\nCommunities: {n[1]}\n" + "".join(f"{k}: {share(k)}\n" for k in kinds),
        "god-nodes": "\n".join(["God nodes (most connected):", *[f"  {i}. {r['label']} - {r['degree']} edges" for i, r in enumerate(analyze.god_nodes(graph, 10).collect(), 1)]]),
        "surprises": "\n".join(["Surprising cross-community connections:", *[f"  {r['a'] or r['source']} <-> {r['b'] or r['target']} [{r['relation']}]" for r in named]]) if named else "No surprising connections found.",
        "audit": f"Total edges: {total or 1}\n" + "".join(f"{k}: {counts.get(k, 0)} ({share(k)})\n" for k in kinds),
        "questions": "\n".join(["Suggested questions:", *[f"  - {r['kind']}: {r['subject'] or ''} {r['detail'] or ''}".rstrip() for r in questions]]),
    }
