"""Stored tables: replaced partitions, pruned reads, text keys."""

from pyspark.sql import functions as F

from laurel.session import scratch_path, stored
from laurel.sources import tables


def test_numeric_looking_keys_stay_text(spark):
    path = scratch_path(spark, "t")
    tables.append_records(spark.createDataFrame([("007", 1), ("8", 2)], "key_id string, v int"), path)
    assert sorted(r.key_id for r in tables.load(spark, path).collect()) == ["007", "8"]


def test_store_factors_replaces_only_its_queries(spark):
    path = scratch_path(spark, "t")
    frame = lambda *rows: spark.createDataFrame(rows, "key_id string, a_id string, v int")
    tables.store_factors(frame(("a", "x", 1), ("b", "x", 1)), path)
    tables.store_factors(frame(("a", "x", 2), ("a", "y", 2)), path)
    assert sorted((r.key_id, r.a_id, r.v) for r in tables.load(spark, path).collect()) == [
        ("a", "x", 2), ("a", "y", 2), ("b", "x", 1)]


def test_reads_of_a_query_are_pruned(spark):
    path = scratch_path(spark, "t")
    tables.append_records(spark.range(100).select((F.col("id") % 10).cast("string").alias("key_id"), "id"), path)
    wanted = stored(spark.createDataFrame([("3",), ("3",), ("4",)], "key_id string"), "wanted")
    mine = tables.of_queries(tables.load(spark, path), wanted)
    assert mine.count() == 20
    assert "dynamicpruning" in mine._jdf.queryExecution().executedPlan().toString()
    many = spark.range(1005).select(F.col("id").cast("string").alias("key_id"))
    assert tables.of_queries(tables.load(spark, path), many).count() == 100


def test_scratch_goes_at_the_end_of_a_job(spark):
    other = spark.newSession()
    kept = scratch_path(other, "t")
    assert kept.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_stored_rows_are_computed_once(spark):
    drawn = stored(spark.range(1000).withColumn("r", F.rand()), "random")
    assert drawn.join(drawn.withColumnRenamed("r", "again"), "id").where("r <> again").count() == 0
