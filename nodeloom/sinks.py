"""Sinks: line formats as DataFrames of text, reports, memory documents, query log."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.text import cypher_escape, cypher_name, safe_filename, yaml_string
from nodeloom.operators import analyze
from nodeloom.operators.build import degrees
from nodeloom.schema import Graph
from nodeloom.session import version


def _or(c: Column | str, fallback: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(F.lit(fallback))


def cypher(graph: Graph) -> DataFrame:
    """(part, seq, line): statements that merge the nodes (part 0), then the edges (part 1)."""
    kind = _or("file_type", "unknown")
    kind = cypher_name(F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, 2, 1000))), "Entity")
    q = lambda c: F.concat(F.lit("'"), cypher_escape(c), F.lit("'"))
    nodes = graph.nodes.select(F.lit(0).alias("part"), "seq", F.concat(F.lit("MERGE (n:"), kind, F.lit(" {id: "), q(F.col("id")), F.lit(", label: "), q(F.coalesce("label", "id")), F.lit("});")).alias("line"))
    rel = cypher_name(F.upper(_or("relation", "RELATES_TO")), "RELATES_TO")
    edges = graph.edges.select(
        F.lit(1).alias("part"), "seq", F.concat(F.lit("MATCH (a {id: "), q(F.col("source")), F.lit("}), (b {id: "), q(F.col("target")), F.lit("}) MERGE (a)-[:"), rel, F.lit(" {confidence: "), q(F.coalesce("confidence", F.lit("EXTRACTED"))), F.lit("}]->(b);")).alias("line")
    )
    return nodes.unionByName(edges)


def _xml(c: Column) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def graphml(graph: Graph) -> DataFrame:
    """(part, seq, line): the elements of a GraphML graph; community -1 where there is none."""
    data = lambda k, v: F.concat(F.lit(f'<data key="{k}">'), _xml(v.cast("string")), F.lit("</data>"))
    n = graph.nodes.select(F.lit(0).alias("part"), "seq", F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), data("label", F.col("label")), data("file_type", F.col("file_type")), data("source_file", F.col("source_file")), data("community", F.coalesce("community", F.lit(-1))), F.lit("</node>")).alias("line"))
    e = graph.edges.select(F.lit(1).alias("part"), "seq", F.concat(F.lit('<edge source="'), _xml(F.col("source")), F.lit('" target="'), _xml(F.col("target")), F.lit('">'), data("relation", F.col("relation")), data("confidence", F.col("confidence")), F.lit("</edge>")).alias("line"))
    return n.unionByName(e)


def notes(graph: Graph, most: int = 500) -> DataFrame:
    """(id, file, text): one note per node with front matter and links to its neighbours by seq. A
    node of more than ``most`` links has further notes with the next links, numbered from 2."""
    names = graph.nodes.select(F.col("id").alias("other"), safe_filename(F.coalesce("label", "id")).alias("name"))
    rows = analyze.neighbours(graph).join(names, "other")
    from pyspark.sql import Window

    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("seq", "other"))).withColumn("part", F.ceil(F.col("r") / most).cast("int"))
    links = ranked.groupBy("id", "part").agg(F.sort_array(F.collect_list(F.struct("r", F.concat(F.lit("- [["), "name", F.lit("]] "), F.coalesce("relation", F.lit(""))).alias("l")))).alias("m"))
    number = F.when(F.col("part") > 1, F.col("part").cast("string"))
    text = F.concat(
        F.lit("---\nid: "), yaml_string(F.col("id")), F.lit("\ntype: "), yaml_string(F.coalesce("file_type", F.lit(""))), F.lit("\nsource_file: "), yaml_string(F.coalesce("source_file", F.lit(""))), F.coalesce(F.concat(F.lit("\npart: "), number), F.lit("")), F.lit("\n---\n\n# "), F.coalesce("label", "id"), F.lit("\n\n"),
        F.coalesce(F.array_join("m.l", "\n"), F.lit("")),
    )
    file = F.concat(safe_filename(F.coalesce("label", "id")), F.lit("_"), F.substring(F.sha1(F.col("id").cast("binary")), 1, 8), F.coalesce(F.concat(F.lit("_"), number), F.lit("")), F.lit(".md"))
    return graph.nodes.join(links, "id", "left").select("id", file.alias("file"), text.alias("text"))


def articles(graph: Graph, top: int = 25) -> DataFrame:
    """(community, text): one article per community: its best connected members and its links."""
    from pyspark.sql import Window

    rows = graph.nodes.where("community IS NOT NULL").join(degrees(graph), "id")
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "seq"))).where(F.col("r") <= top)
    members = best.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("r", F.concat(F.lit("- **"), F.coalesce("label", "id"), F.lit("** ("), "degree", F.lit(" connections)")).alias("l")))).alias("m"))
    pairs = analyze.community_pairs(graph)
    both = pairs.select(F.col("low").alias("community"), F.col("high").alias("other"), "edges").unionByName(pairs.select(F.col("high").alias("community"), F.col("low").alias("other"), "edges"))
    links = both.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("edges"), "other"))).where("r <= 12")
    links = links.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("r", F.concat(F.lit("- [[Community "), "other", F.lit("]] ("), "edges", F.lit(" shared connections)")).alias("l")))).alias("k"))
    size = analyze.cohesion(graph)
    head = F.concat(F.lit("# Community "), "community", F.lit("\n\n> "), "members", F.lit(" nodes · cohesion "), F.format_number("cohesion", 2), F.lit("\n\n"))
    return size.join(members, "community").join(links, "community", "left").select("community", F.concat(head, F.array_join("m.l", "\n"), F.lit("\n\n"), F.coalesce(F.array_join("k.l", "\n"), F.lit("- No strong cross-community connections detected"))).alias("text"))


def report(graph: Graph, top: int = 10) -> str:
    """A short Markdown report; only counts and the first few rows reach the driver."""
    n, e = graph.nodes.count(), graph.edges.count()
    confidence = {r[0]: r[1] for r in graph.edges.groupBy(F.coalesce("confidence", F.lit("EXTRACTED"))).count().collect()}
    lines = ["# Graph report", "", f"- {n} nodes, {e} edges", *[f"- {k}: {v} ({round(100 * v / max(e, 1))}%)" for k, v in sorted(confidence.items())], "", "## Most connected", ""]
    lines += [f"{i}. {r.label} - {r.degree} edges" for i, r in enumerate(analyze.god_nodes(graph, top).collect(), 1)]
    lines += ["", "## Surprising connections", ""] + [f"- {r.source} --{r.relation}--> {r.target} [{r.confidence}]" for r in analyze.surprising(graph).collect()]
    return "\n".join(lines) + "\n"


def lessons_report(rows: DataFrame, most: int = 20) -> str:
    """Markdown of ``analyze.lessons``: the best of each verdict."""
    lines = ["# Lessons", ""]
    for verdict in ("preferred", "tentative", "contested"):
        some = rows.where(F.col("verdict") == verdict).orderBy(F.desc("score"), "node").limit(most).collect()
        lines += [f"## {verdict.capitalize()}", "", *[f"- {r.node} (+{r.pos} / -{r.neg}, {r.score:g})" for r in some], ""]
    return "\n".join(lines)


def memory_document(question: str, answer: str, outcome: str | None = None, source_nodes: list[str] | None = None, correction: str | None = None, now: dt.datetime | None = None) -> str:
    """Text of a memory document, as ``sources.files.front_matter`` reads it."""
    q = lambda s: json.dumps(s, ensure_ascii=False)
    head = ["type: " + q("query"), "date: " + q((now or dt.datetime.now(dt.timezone.utc)).isoformat()), "question: " + q(question)]
    head += ["outcome: " + q(outcome)] * bool(outcome) + ["correction: " + q(correction)] * bool(correction)
    head += ["source_nodes: [" + ", ".join(map(q, source_nodes or [])) + "]"]
    return "---\n" + "\n".join(head) + f"\n---\n\n{answer}\n"


def log_query(spark, path: str, **fields) -> None:
    """Append one JSON line to the query log."""
    spark.createDataFrame([(json.dumps({"at": dt.datetime.now(dt.timezone.utc).isoformat(), **fields}, default=str),)], "value string").coalesce(1).write.mode("append").text(path)


def push(rows: DataFrame, send) -> None:
    """Hand ``rows`` to an external store: ``send(iterator of rows)`` once per partition. Partitions
    are retried, so statements must be idempotent (MERGE)."""
    rows.foreachPartition(send)


def lessons_fresh(spark, out: str, inputs: list[str]) -> bool:
    """Whether ``out`` is there and no older than any file under ``inputs``."""
    def times(paths: list[str]) -> list[int]:
        found = []
        for p in paths:
            try:
                found += [t for _, _, t in version(spark, [p])]
            except Exception:  # not there
                continue
        return found

    made = times([out])
    return bool(made) and min(made) >= max(times(inputs), default=0)


def backup(spark, path: str, day: dt.date | None = None) -> str | None:
    """Copy of the tables under ``path`` beside it, one a day, before they are overwritten; None if
    there is nothing to keep. An existing copy of the day stays."""
    where = f"{path.rstrip('/')}-{(day or dt.date.today()).isoformat()}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(where)
    fs = source.getFileSystem(conf)
    if not fs.exists(source):
        return None
    if not fs.exists(target):
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, target, False, conf)
    return where
