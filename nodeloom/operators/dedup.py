"""Entity resolution: near-duplicate labels to components, components to survivors.

Every pair decision is independent of the others, so the result is the connected components of
exact pairs within a file and verified fuzzy pairs. Candidates come from MinHash bands.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from nodeloom.functions.ids import is_ascii
from nodeloom.functions.similarity import bands, jaro, jaro_winkler, one_typo
from nodeloom.functions.text import entropy, entropy_py
from nodeloom.operators.build import remap_edges, winner_rank
from nodeloom.session import materialize

MERGE, LONG, MIN_ENTROPY, BOOST = 92.0, 12, 2.5, 5.0


def norm_label_py(text: str) -> str:
    import re
    import unicodedata

    return re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", text).casefold()).strip()


@F.pandas_udf(StringType())
def _norm_other(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else norm_label_py(x))


_norm_other = _norm_other.asNondeterministic()  # else filters on its result would be pushed below it and run it twice


@F.pandas_udf(DoubleType())
def _entropy_other(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else entropy_py(norm_label_py(x)))


def norm_label(c: Column) -> Column:
    """NFKC, case folded, other than letters and digits to one space; null becomes ''."""
    c = F.coalesce(c, F.lit(""))
    plain = F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    return F.when(is_ascii(c), plain).otherwise(_norm_other(F.when(~is_ascii(c), c)))


def variant(a: Column, b: Column) -> Column:
    """Short labels of one stem with different suffixes: digits and letters, or two letters and more."""
    pattern = r"^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$"
    sa, sb = (F.regexp_extract(x, pattern, 1) for x in (a, b))
    ta, tb = (F.regexp_extract(x, pattern, 2) for x in (a, b))
    return (a != b) & (F.greatest(F.length(a), F.length(b)) < LONG) & a.rlike(pattern) & b.rlike(pattern) & (sa == sb) & (ta != tb)


def numbers_differ(a: Column, b: Column) -> Column:
    """Different digit runs as multisets, leading zeros aside."""
    runs = lambda x: F.array_sort(F.transform(F.regexp_extract_all(x, F.lit(r"(\d+)"), 1), lambda t: F.regexp_replace(t, r"^0+(?=\d)", "")))
    return (a != b) & (runs(a) != runs(b))


def extension(a: Column, b: Column) -> Column:
    return (a != b) & (a.startswith(b) | b.startswith(a))


def anchored(pairs: DataFrame) -> Column:
    """Either is bound to its file by type, and the files differ."""
    by_type = F.coalesce(F.col("a_type").isin("rationale", "document"), F.lit(False)) | F.coalesce(F.col("b_type").isin("rationale", "document"), F.lit(False))
    return by_type & other_file()


def other_file() -> Column:
    return F.coalesce("a_file", F.lit("")) != F.coalesce("b_file", F.lit(""))


def scored(pairs: DataFrame) -> DataFrame:
    """Adds score (0 to 100) to pairs with a_key, b_key, a_file, b_file: Jaro for long labels of
    different files, else Jaro-Winkler."""
    a, b = F.col("a_key"), F.col("b_key")
    longer = F.greatest(F.length(a), F.length(b)) >= LONG
    return pairs.withColumn("score", F.when(other_file() & longer, jaro(a, b)).otherwise(jaro_winkler(a, b)) * 100)


def verified(pairs: DataFrame) -> DataFrame:
    """Pairs of (a, b, a_key, b_key, a_file, b_file, a_type, b_type, same_community) that are the same."""
    a, b = F.col("a_key"), F.col("b_key")
    rows = scored(pairs)
    short_ok = (F.col("score") >= 97.0) & one_typo(a, b)
    short = F.greatest(F.length(a), F.length(b)) < LONG
    rows = rows.where(~variant(a, b) & ~extension(a, b) & ~numbers_differ(a, b)).where(~anchored(rows)).where(~short | short_ok)
    boosted = F.col("score") + F.when(F.col("same_community") & (F.least(F.length(a), F.length(b)) >= LONG), BOOST).otherwise(0.0)
    return rows.where(boosted >= MERGE).where((a != b) | ~other_file())


def candidates(nodes: DataFrame) -> DataFrame:
    """(id, key, label, file, type, community, repo): per repo and label the first of the nodes
    that may be merged by label: no code, a label of some entropy."""
    rows = nodes.where("id <> ''").withColumn("key", norm_label(F.coalesce("label", "id"))).where("key <> ''")
    rows = rows.where(~F.coalesce(F.col("file_type") == "code", F.lit(False)))
    first = rows.groupBy(F.coalesce("repo", F.lit("")).alias("repo"), "key").agg(F.min_by(F.struct("id", "label", "source_file", "file_type", "community"), "seq").alias("x"))
    rows = first.select("x.id", "key", "x.label", F.col("x.source_file").alias("file"), F.col("x.file_type").alias("type"), "x.community", "repo")
    return rows.where(entropy(F.col("key")) >= MIN_ENTROPY)


def band_pairs(cands: DataFrame, block: int = 500) -> DataFrame:
    """Distinct pairs of candidates that share a band, within a repo, a before b.

    Every two of a bucket meet. A bucket of more than ``block`` candidates is dealt over blocks by
    hash of the id and every block meets every other as a group of its own, so no task has to hold
    a bucket; the pairs themselves are as many as the bucket has."""
    k = ["repo", "band", "bucket"]
    rows = materialize(cands.select("repo", "id", F.posexplode(bands()("key")).alias("band", "bucket")), "bands")
    sizes = rows.groupBy(*k).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    rows = rows.join(sizes, k).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = rows.select(*k, F.col("id").alias("x"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    right = rows.select(*k, F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"))
    pairs = left.join(right, [*k, "i", "j"]).where("i < j OR x < y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def exact_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes of one label within one file, each with the preferred one."""
    rows = nodes.where("id <> '' AND source_file <> ''").withColumn("key", norm_label(F.coalesce("label", "id"))).where("key <> ''")
    rows = rows.where(~F.coalesce(F.col("file_type") == "code", F.lit(False)))
    best = rows.groupBy("repo", "source_file", "key").agg(F.min_by("id", winner_rank(F.col("id"), F.col("seq"))).alias("a"), F.count("*").alias("n")).where("n > 1")
    k = ["source_file", "key"]
    out = rows.join(best.withColumnRenamed("repo", "_r"), k).where(F.col("repo").eqNullSafe(F.col("_r")))
    return out.where("id <> a").select("a", F.col("id").alias("b"))


def described_pairs(pairs: DataFrame, cands: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        pairs = pairs.join(cands.select(F.col("id").alias(end), F.col("key").alias(f"{end}_key"), F.col("file").alias(f"{end}_file"), F.col("type").alias(f"{end}_type"), F.col("community").alias(f"{end}_c")), end)
    return pairs.withColumn("same_community", F.coalesce(F.col("a_c") == F.col("b_c"), F.lit(False)))


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root): connected components of (a, b), root the smallest id, by alternating large-star
    and small-star steps (Kiveris et al., 2014) until the stars no longer change.

    Minima are pre-aggregated, so a node of very many neighbours gathers nowhere; each step is
    written, and compared by an order-free checksum."""
    edges = materialize(pairs.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "stars")
    checksum = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    before = checksum(edges)
    for _ in range(most_rounds):
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("lo <> hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo")).where("lo <> hi").distinct()
        edges = materialize(small.select("lo", "hi"), "stars")
        now = checksum(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())


def winners(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(old, new) of (id, root): every other member to the preferred one."""
    rows = members.join(nodes.select("id", "seq"), "id")
    best = rows.groupBy("root").agg(F.min_by("id", winner_rank(F.col("id"), F.col("seq"))).alias("new"))
    return rows.join(best, "root").where("id <> new").select(F.col("id").alias("old"), "new")


def resolve(nodes: DataFrame, edges: DataFrame, resolver=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, remap) with near-identical entities merged, within each repo.

    Rows need one id each (``build.dedupe_nodes``). ``resolver(pairs) -> pairs`` may settle what
    scored from 75 up to the merge threshold, e.g. by a model."""
    cands = materialize(candidates(nodes), "candidates")
    pairs = described_pairs(band_pairs(cands), cands)
    same = verified(pairs).select("a", "b")
    if resolver is not None:
        same = same.unionByName(resolver(scored(pairs).where((F.col("score") >= 75) & (F.col("score") < MERGE))).select("a", "b"))
    remap = materialize(winners(components(exact_pairs(nodes).unionByName(same)), nodes), "remap")
    kept = nodes.join(remap.select(F.col("old").alias("id")), "id", "left_anti")
    return kept.select(nodes.columns), remap_edges(edges, remap).select(edges.columns), remap
