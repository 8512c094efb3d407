"""Cross-file symbol resolution: names to definitions, only where they are unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.text import callable_key
from nodeloom.schema import basename

FILE_LABEL = r"\.(py|js|ts|tsx|java|go|rs)$"


def resolvable(nodes: DataFrame) -> DataFrame:
    """Code nodes with a symbol's label, with its key."""
    label = F.trim("label")
    rows = nodes.where("file_type = 'code'").where((label != "") & ~label.rlike(FILE_LABEL))
    return rows.withColumn("key", callable_key(F.col("label"))).where("key <> ''")


def unique_labels(nodes: DataFrame) -> DataFrame:
    """(key, id) of keys with one symbol only."""
    return resolvable(nodes).groupBy("key").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").select("key", "id")


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def unique_symbols(nodes: DataFrame) -> DataFrame:
    """(module, key, id) of Python symbols that are the only one of their name in their module."""
    rows = resolvable(nodes).where("source_file LIKE '%.py'").withColumn("module", stem(F.col("source_file")))
    return rows.groupBy("module", "key").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").select("module", "key", "id")


def call_pairs(edges: DataFrame) -> DataFrame:
    return edges.where("relation = 'calls'").select("source", "target").distinct()


def _new(rows: DataFrame, known: DataFrame) -> DataFrame:
    rows = rows.where("source <> target").join(known, ["source", "target"], "left_anti")
    return rows.groupBy("source", "target").agg(F.min_by(F.struct("seq", "source_file"), "seq").alias("x")).select("source", "target", "x.*")


def resolve_calls(calls: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, seq, source_file): INFERRED calls of unqualified names that only one
    symbol has. ``calls``: seq, caller, callee, is_member, source_file."""
    rows = calls.where("NOT is_member AND callee <> '' AND caller <> ''").withColumn("key", F.lower(F.trim("callee")))
    hit = rows.join(unique_labels(nodes), "key").select(F.col("caller").alias("source"), F.col("id").alias("target"), "seq", "source_file")
    return _new(hit, call_pairs(edges))


def resolve_imported_calls(calls: DataFrame, aliases: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """As :func:`resolve_calls`, but EXTRACTED: the name was imported. ``aliases``: source_file,
    local_name, module, imported_name."""
    rows = calls.where("NOT is_member AND callee <> '' AND caller <> ''").withColumn("local_name", F.trim("callee"))
    rows = rows.join(aliases, ["source_file", "local_name"]).withColumn("key", F.lower("imported_name"))
    hit = rows.join(unique_symbols(nodes), ["module", "key"]).select(F.col("caller").alias("source"), F.col("id").alias("target"), "seq", "source_file")
    return _new(hit, call_pairs(edges))


def resolve_targets(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref, target, how): a referenced symbol in its own document, else the only one of that name
    anywhere, else a stub. ``references``: ref, doc, symbol; ``symbols``: doc, symbol, id."""
    own = symbols.groupBy("doc", "symbol").agg(F.min("id").alias("own"))
    only = symbols.groupBy("symbol").agg(F.count_distinct("id").alias("n"), F.min("id").alias("only")).where("n = 1").drop("n")
    rows = references.join(own, ["doc", "symbol"], "left").join(only, "symbol", "left")
    stub = F.concat(F.lit("stub_"), F.substring(F.sha1(F.col("symbol").cast("binary")), 1, 12))
    how = F.when(F.col("own").isNotNull(), "same document").when(F.col("only").isNotNull(), "unique").otherwise("stub")
    return rows.select("ref", F.coalesce("own", "only", stub).alias("target"), how.alias("how"))


def sourced_calls(sourced: DataFrame, calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(source, target): shell calls of functions defined in exactly one of the scripts a script
    sources. ``sourced``: path, target_path; ``calls``: path, caller, callee; ``functions``: path,
    name, id."""
    rows = calls.join(sourced, "path").join(functions.select(F.col("path").alias("target_path"), F.col("name").alias("callee"), "id"), ["target_path", "callee"])
    one = rows.groupBy("caller", "callee").agg(F.count_distinct("id").alias("n"), F.min("id").alias("target")).where("n = 1")
    return one.where("caller <> target").select(F.col("caller").alias("source"), "target").distinct()
