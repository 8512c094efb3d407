import os

from pyspark.sql import functions as F

from nodeloom import session


def test_hot_buckets_and_salts(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    salts = session.hot_buckets(rows, ["k"], factor=1.0, least=300)
    assert list(salts.values()) == [4]
    spread = session.with_salts(rows, ["k"], salts, ["v"])
    by = {r.salt: r.n for r in spread.where("k = 'hot'").groupBy("salt").agg(F.count("*").alias("n")).collect()}
    assert set(by) == {0, 1, 2, 3} and sum(by.values()) == 1000 and max(by.values()) < 350
    assert spread.count() == 3000 and spread.where("k <> 'hot' AND salt > 0").count() < 5
    small = session.with_salts(rows.select("k").distinct(), ["k"], salts, None)
    assert small.where("k = 'hot'").count() == 4
    assert session.hot_buckets(rows.limit(0), ["k"]) == {} and session.with_salts(rows, ["k"], {}, ["v"]).where("salt <> 0").isEmpty()


def test_many_hot_buckets_go_through_a_table(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("k"))
    every = {r.b: 2 for r in rows.select(session.bucket("k").alias("b")).distinct().collect()}
    padded = {**every, **{-i: 2 for i in range(1, 400)}}
    assert session.with_salts(rows, ["k"], padded, None).count() == 200 == session.with_salts(rows, ["k"], every, None).count()


def test_materialize_and_release(spark):
    df = session.materialize(spark.range(5).withColumn("x", F.lit("a")), "t")
    assert df.count() == 5 and df.columns == ["id", "x"]
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    kept = session.materialize(spark.range(0), "none")
    assert kept.collect() == [] and kept.columns == ["id"]
    session.release(spark)
    assert not os.path.exists(path)


def test_spread_follows_the_files(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert session.scan_units(one) == 1 and session.spread(one).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    spark.range(1000).repartition(30).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert session.spread(many) is many
