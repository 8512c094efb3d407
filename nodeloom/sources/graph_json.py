"""Graphs from and to node-link JSON, tolerant of other producers' field names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions.text import search_form
from nodeloom.operators.build import EDGE_COLS, NODE_COLS, default_score
from nodeloom.schema import Graph, suffix
from nodeloom.session import version

# Names under which producers store a field, the preferred one first.
NODE_ALIASES = {
    "id": "id node_id key uid name qualified_name fqname symbol", "source_file": "source_file file file_path filepath path module_path defined_in",
    "label": "label display_name title name qualified_name fqname symbol", "community": "community community_id cluster cluster_id group group_id modularity_class",
    "node_type": "node_type kind type category", "file_type": "file_type content_type artifact_type",
}
EDGE_ALIASES = {
    "source": "source src from from_id start u", "target": "target dst to to_id end v", "relation": "relation type kind label predicate", "confidence": "confidence evidence provenance",
    "confidence_score": "confidence_score score weight probability",
}


def first_of(attrs: Column, names: str) -> Column:
    """First non-empty value among the names; null if there is none."""
    return F.coalesce(*[F.when(attrs[n] != "", attrs[n]) for n in names.split()])


def normalize_nodes(rows: DataFrame) -> DataFrame:
    """(seq, id, label, community, source_file, node_type, file_type) of (seq, attrs)."""
    a = F.col("attrs")
    node_id = F.coalesce(first_of(a, NODE_ALIASES["id"]), F.concat(F.lit("node_"), F.col("seq") + 1))
    rows = rows.select("seq", node_id.alias("id"), first_of(a, NODE_ALIASES["label"]).alias("label"), *[first_of(a, NODE_ALIASES[c]).alias(c) for c in ("community", "source_file", "node_type", "file_type")])
    doc = suffix(F.col("source_file")).isin(".md", ".mdx", ".rst", ".txt")
    return rows.select("seq", "id", F.coalesce("label", "id").alias("label"), F.coalesce("community", F.lit("unknown")).alias("community"), F.coalesce("source_file", F.lit("")).alias("source_file"), F.coalesce("node_type", F.lit("")).alias("node_type"), F.coalesce("file_type", F.when(doc, "document").otherwise("code")).alias("file_type"))


def normalize_edges(rows: DataFrame) -> DataFrame:
    """(seq, source, target, relation, confidence, confidence_score) of (seq, attrs); without an
    end it goes."""
    a = F.col("attrs")
    out = rows.select("seq", *[first_of(a, names).alias(c) for c, names in EDGE_ALIASES.items()]).where("source IS NOT NULL AND target IS NOT NULL")
    score = F.coalesce(F.expr("try_cast(confidence_score AS double)"), F.lit(1.0))
    return out.select("seq", "source", "target", F.lower(F.coalesce("relation", F.lit("relates"))).alias("relation"), F.upper(F.coalesce("confidence", F.lit("EXTRACTED"))).alias("confidence"), score.alias("confidence_score"))


#: Size up to which a node-link document is read: one document is one task's work.
MOST_BYTES = 512 << 20


def check_size(spark: SparkSession, path: str, most: int = MOST_BYTES) -> None:
    """Refuse a document that is larger than ``most`` before it is read."""
    size = sum(n for _, n, _ in version(spark, [path]))
    if size > most:
        raise ValueError(f"graph file {path} is {size:_d} bytes, exceeds {most:_d}-byte cap")


def read(spark: SparkSession, path: str, directed: bool = True, most: int = MOST_BYTES) -> Graph:
    """A node-link document (``links`` or ``edges``) as a graph; extra fields are left out."""
    check_size(spark, path, most)
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "nodes array<map<string,string>>, links array<map<string,string>>, edges array<map<string,string>>").alias("d"))
    nodes = doc.select(F.posexplode("d.nodes").alias("pos", "a")).where("a['id'] IS NOT NULL")
    kinds = {"community": "int"}
    nodes = nodes.select(F.col("pos").cast("long").alias("seq"), F.col("a")["id"].alias("id"), *[F.col("a")[c].cast(kinds.get(c, "string")).alias(c) for c in NODE_COLS])
    edges = doc.select(F.posexplode(F.coalesce("d.links", "d.edges")).alias("pos", "a"))
    pick = lambda c: F.coalesce(F.col("a")[c], F.col("a")["from" if c == "source" else "to"])
    kinds = {"confidence_score": "double", "weight": "double"}
    edges = edges.select(F.col("pos").cast("long").alias("seq"), pick("source").alias("source"), pick("target").alias("target"), F.col("a")["relation"].alias("relation"), *[F.col("a")[c].cast(kinds.get(c, "string")).alias(c) for c in EDGE_COLS])
    return Graph(nodes, edges.where("source IS NOT NULL AND target IS NOT NULL"), directed)


def node_rows(graph: Graph) -> DataFrame:
    """(seq, json): nodes as they are written, with their searchable label."""
    return graph.nodes.withColumn("norm_label", search_form(F.col("label"))).select("seq", F.to_json(F.struct("id", *NODE_COLS, "norm_label")).alias("json"))


def edge_rows(graph: Graph) -> DataFrame:
    """(seq, json): edges as they are written, in their true direction, with a score."""
    e = graph.edges.withColumn("confidence_score", default_score(F.col("confidence"), F.col("confidence_score")))
    return e.select("seq", F.to_json(F.struct("source", "target", "relation", *EDGE_COLS)).alias("json"))


def write(graph: Graph, path: str) -> None:
    """The graph as Parquet tables under ``path``: nodes, edges."""
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")


def write_document(graph: Graph, path: str) -> None:
    """One node-link document, written as a line stream by a single sorted pass: for graphs that
    another tool is to read whole."""
    parts = [(0, node_rows(graph)), (1, edge_rows(graph))]
    out = None
    for part, rows in parts:
        rows = rows.select(F.lit(part).alias("p"), "seq", "json")
        out = rows if out is None else out.unionByName(rows)
    from pyspark.sql import Window

    w = Window.partitionBy("p").orderBy("seq", "json")
    line = F.concat(F.when(F.row_number().over(w) > 1, ",").otherwise(""), "json")
    lines = out.select("p", F.row_number().over(w).alias("n"), line.alias("value"))
    spark = graph.nodes.sparkSession
    frame = spark.createDataFrame([(-1, 0, f'{{"directed": {str(graph.directed).lower()}, "multigraph": false, "nodes": ['), (0, 2**31 - 1, '], "links": ['), (1, 2**31 - 1, '], "hyperedges": []}')], "p int, n int, value string")
    lines.unionByName(frame).coalesce(1).sortWithinPartitions("p", "n").select("value").write.mode("overwrite").text(path)
