"""Incremental work: manifests, content hashes, caches, rebuilds, guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.operators.build import prune_dangling
from nodeloom.schema import Graph, suffix
from nodeloom.session import numbered
from nodeloom.sources.files import body


def content_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def file_hash(path: Column, text: Column) -> Column:
    """SHA-256 of content, a zero byte and the path in lower case; of Markdown only the body counts."""
    text = F.coalesce(text, F.lit(""))
    content = F.when(suffix(path) == ".md", body(text)).otherwise(text)
    return F.sha2(F.concat(content.cast("binary"), F.lit(b"\x00"), F.lower(path).cast("binary")), 256)


def normalize_manifest(rows: DataFrame) -> DataFrame:
    """(path, mtime, ast_hash, semantic_hash) from any older shape: a bare mtime, or mtime and hash."""
    have = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    ast = F.when(have("ast_hash") != "", have("ast_hash")).otherwise(have("hash"))
    return rows.select("path", F.col("mtime").cast("double").alias("mtime"), ast.alias("ast_hash"), have("semantic_hash").alias("semantic_hash"))


def changes(files: DataFrame, manifest: DataFrame, kind: str = "semantic") -> DataFrame:
    """(path, status): new, unchanged or deleted against the manifest.

    A file is new if the manifest lacks it or its hash of that kind, or if both time and content
    differ; contents are only hashed where the times differ."""
    stored = f"{kind}_hash"
    m = manifest.select("path", F.col("mtime").alias("_mtime"), F.coalesce(stored, F.lit("")).alias("_hash"), F.lit(True).alias("_there"))
    rows = files.select("path", "mtime", "text", F.lit(True).alias("_here")).join(m, "path", "full_outer")
    touched = F.col("_mtime").isNull() | F.col("mtime").isNull() | (F.col("mtime") != F.col("_mtime"))
    new = F.col("_there").isNull() | (F.col("_hash") == "") | (touched & (F.when(touched, content_hash(F.col("text"))) != F.col("_hash")))
    return rows.select("path", F.when(F.col("_here").isNull(), "deleted").when(new, "new").otherwise("unchanged").alias("status"))


def save_manifest(files: DataFrame, manifest: DataFrame, kind: str = "both") -> DataFrame:
    """The manifest after a run over ``files``: theirs stamped, others kept. After a run of kind
    'ast' a semantic hash only stays where the content is what was stamped before."""
    f = files.select("path", F.col("mtime").alias("_m"), content_hash(F.col("text")).alias("_h"))
    rows = f.join(manifest, "path", "full_outer")
    run = F.col("_h").isNotNull()
    old_ast, old_sem = F.coalesce("ast_hash", F.lit("")), F.coalesce("semantic_hash", F.lit(""))
    ast = F.col("_h") if kind in ("ast", "both") else old_ast
    sem = F.col("_h") if kind in ("semantic", "both") else F.when(F.col("_h") == old_ast, old_sem).otherwise("")
    return rows.select("path", F.when(run, F.col("_m")).otherwise(F.col("mtime")).alias("mtime"), F.when(run, ast).otherwise(old_ast).alias("ast_hash"), F.when(run, sem).otherwise(old_sem).alias("semantic_hash"))


def check_cache(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of files (path, text) in a cache keyed by file_hash."""
    keyed = files.withColumn("file_hash", file_hash(F.col("path"), F.col("text")))
    known = cache.select("file_hash").distinct()
    return keyed.join(known, "file_hash", "left_semi"), keyed.join(known, "file_hash", "left_anti")


def save_cache(rows: DataFrame, path: str, version: str) -> None:
    """Append cache rows, one folder per extractor version."""
    rows.withColumn("extractor_version", F.lit(version)).write.mode("append").partitionBy("extractor_version").parquet(path)


def rebuild(old: Graph, new: Graph, changed: DataFrame, deleted: DataFrame) -> Graph:
    """The graph after the files (path) changed or went: their nodes and edges leave, the newly
    extracted ones come in, edges that lost an end go."""
    gone = changed.select("path").unionByName(deleted.select("path")).distinct().withColumnRenamed("path", "source_file")
    again = new.nodes.select("id").distinct()
    kept = old.nodes.join(gone, "source_file", "left_anti").join(again, "id", "left_anti").select(old.nodes.columns)
    edges = old.edges.join(gone, "source_file", "left_anti").select(old.edges.columns)
    nodes = kept.unionByName(new.nodes.select(old.nodes.columns))
    return old.with_(nodes=nodes, edges=prune_dangling(nodes, edges.unionByName(new.edges.select(old.edges.columns))))


def lost_nodes(old: DataFrame, new: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(id, explained): nodes that are gone; explained if their file was rebuilt or they had none."""
    lost = old.join(new.select("id").distinct(), "id", "left_anti")
    r = rebuilt.select(F.col("path").alias("source_file"), F.lit(True).alias("_r")).distinct()
    return lost.join(r, "source_file", "left").select("id", (F.coalesce("_r", F.lit(False)) | (F.coalesce("source_file", F.lit("")) == "")).alias("explained"))


def may_shrink(old: DataFrame, new: DataFrame, rebuilt: DataFrame) -> bool:
    """Whether a smaller graph may replace the old one: all lost nodes are explained."""
    return new.count() >= old.count() or lost_nodes(old, new, rebuilt).where("NOT explained").isEmpty()


def topology(graph: Graph) -> DataFrame:
    """(nodes, node_sum, edges, edge_sum): an order-free signature of the graph without
    communities and scores; equal graphs have equal rows."""

    def part(df: DataFrame, cols: list[str], name: str) -> DataFrame:
        h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols])
        return df.agg(F.count("*").alias(f"{name}s"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"{name}_sum"))

    nodes = part(graph.nodes, [c for c in graph.nodes.columns if c not in ("community", "seq")], "node")
    return nodes.join(part(graph.edges, [c for c in graph.edges.columns if c not in ("confidence_score", "seq", "u", "v")], "edge"))


def merge_paths(parts: list[DataFrame]) -> DataFrame:
    """(path, ord): union in order, each path at its first place. Parts: (path, ord)."""
    rows = reduce(DataFrame.unionByName, [p.select("path", F.struct(F.lit(i).alias("p"), F.col("ord").alias("o")).alias("k")) for i, p in enumerate(parts)])
    first = rows.where("path <> ''").groupBy("path").agg(F.min("k").alias("k"))
    first = first.select("path", F.col("k.p").alias("p"), F.col("k.o").alias("o"))
    return numbered(first, [F.col("p"), F.col("o"), F.col("path")], "ord").select("path", "ord")
