"""Session-level helpers shared by every operator.

Nothing here collects rows of the input: what reaches the driver is the list of hot buckets, at
most ``BUCKETS`` rows, a row per task (:func:`numbered`) and the names of input files.
"""

from __future__ import annotations

import atexit
import gc
import math
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Hash buckets in which hot keys are looked for; bounds what :func:`hot_buckets` collects.
BUCKETS = 65536


def local_session(cpus: int | str = "*", shuffle: int = 8, app: str = "nodeloom") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder of its own; on a
    cluster without it this raises, as a machine-local folder would not be seen by others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="nodeloom-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone; the folder is left to its owner
        pass


_written: list[str] = []
_kept: dict[tuple, object] = {}


def release(spark: SparkSession) -> None:
    """Remove all tables that :func:`materialize` has written so far; results that still need
    them must have been used. Happens at exit as well."""
    _kept.clear()
    while _written:
        _remove(spark, _written.pop())


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives the loss
    of executors, and lets an expensive narrow stage be read several times."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nodeloom-{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if not _written:
        atexit.register(release, spark)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables :func:`materialize` has written and nobody removed."""
    return len(_written)


def discard(spark: SparkSession, mark: int, keep: int) -> None:
    """Remove the tables that were written since there were ``mark``, but for the last ``keep``, and
    let go of their shuffle files."""
    gone = _written[mark : len(_written) - keep]
    del _written[mark : len(_written) - keep]
    for path in gone:
        _remove(spark, path)
    forget(spark)


def forget(spark: SparkSession) -> None:
    """Let go of the shuffle files of stages whose results are stored: Spark removes them once the
    driver has collected the garbage that refers to them, which may otherwise be never."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def version(spark: SparkSession, paths: list[str]) -> tuple:
    """(file, size, time of change) of all files under the paths: another version of an input has
    another value."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(conf).listFiles(where, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def stored(spark: SparkSession, name: str, paths: list[str], make):
    """What ``make()`` has stored for the present version of the input files, made only if this
    session has not done so before; until :func:`release`."""
    key = (spark.sparkContext.applicationId, name, version(spark, paths))
    if key not in _kept:
        _kept[key] = make()
        forget(spark)
    return _kept[key]


def kept(spark: SparkSession, name: str, paths: list[str]):
    """What :func:`stored` has for the present version of the input files, None if nothing."""
    return _kept.get((spark.sparkContext.applicationId, name, version(spark, paths)))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds ``name``: the position of each row in ``order`` (a total one), from 0. Rows are range
    partitioned and stored, numbered within their part, and offset by the sizes of the parts
    before: no task sees all rows."""
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}  # a row per task
    at, before = {}, 0
    for part in sorted(sizes):
        at[part], before = before, before + sizes[part]
    offset = F.create_map(*[F.lit(x) for kv in at.items() for x in kv])[F.col("_part")] if at else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + offset
    return parts.withColumn(name, place.cast("long")).drop("_part")


def scan_units(df: DataFrame) -> int:
    """How many tasks a scan of ``df``'s files can really use: row groups, not byte splits.

    Footers are only read while the files alone are too few to keep the cluster busy."""
    spark = df.sparkSession
    wanted = 2 * spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= wanted:  # no files: not a scan, left as it is
        return len(files) or wanted
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    groups = 0
    for f in files:
        try:
            source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f), conf)
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
            try:
                groups += reader.getRowGroups().size()
            finally:
                reader.close()
        except Exception:
            groups += 1
    return groups


def spread(df: DataFrame) -> DataFrame:
    """``df`` as it is if its files feed every core, else one round-robin repartition.

    For a narrow CPU-bound stage over a few large row groups; a large input has enough of them
    and is never shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if scan_units(df) >= cores else df.repartition(2 * cores)


def bucket(*cols: str) -> F.Column:
    return F.pmod(F.xxhash64(*cols), F.lit(BUCKETS))


def hot_buckets(df: DataFrame, cols: list[str], factor: float = 8.0, least: int = 200_000) -> dict[int, int]:
    """Salts for the key buckets that hold far more rows than their share.

    Rows are counted per hash bucket of the key (partial counts first, so at most ``BUCKETS``
    rows a map task are shuffled and at most ``BUCKETS`` reach the driver). A bucket is hot if it
    has more than ``factor`` times the mean and more than ``least`` rows; it gets one salt for
    each ``max(factor * mean, least)`` rows. Returns {bucket: number of salts}, empty without skew.
    """
    counts = df.groupBy(bucket(*cols).alias("b")).agg(F.count("*").alias("n")).collect()  # at most BUCKETS rows
    limit = max(least, factor * sum(r["n"] for r in counts) / BUCKETS)
    return {r["b"]: math.ceil(r["n"] / limit) for r in counts if r["n"] > limit}


def with_salts(df: DataFrame, cols: list[str], salts: dict[int, int], spread_by: list[str] | None) -> DataFrame:
    """Adds ``salt``: 0 outside hot buckets. Inside, a row gets one salt by the hash of
    ``spread_by``, or, if that is None, is repeated once for each salt of its bucket."""
    if not salts:
        return df.withColumn("salt", F.lit(0))
    table = F.create_map(*[F.lit(x) for kv in salts.items() for x in kv]) if len(salts) <= 256 else None
    if table is None:  # still at most BUCKETS rows
        small = df.sparkSession.createDataFrame(list(salts.items()), "_b long, _salts int")
        df = df.withColumn("_b", bucket(*cols)).join(F.broadcast(small), "_b", "left").drop("_b")
    else:
        df = df.withColumn("_salts", table[bucket(*cols)])
    n = F.coalesce(F.col("_salts"), F.lit(1))
    if spread_by is None:
        return df.withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_salts")
    return df.withColumn("salt", F.pmod(F.xxhash64(*spread_by), n).cast("int")).drop("_salts")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
