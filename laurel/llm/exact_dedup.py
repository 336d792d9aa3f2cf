"""Exact duplicates by content sort: equal texts become neighbours of a range-partitioned external sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laurel.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLITTER_CHARS = 48  # a sampled splitter holds so much of a text, and its digest, so that splitters stay small
RUNS_PER_PARTITION = 4  # a text with more rows than a partition's share by this factor is sorted as several runs


def normalised(text: str) -> Column:
    """The text with A-Z in lower case; null is empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def content_sort(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Sampled splitters (the first characters, then the digest) range-partition the normalised texts, each task sorts its
    texts externally, and rows are equal if the whole texts of neighbours are. The largest doc_id of equal texts stays.

    A text that holds many rows, up to all of them, is cut into runs by a salt behind the text in the sort key, so that
    its rows spread over tasks; the heads of its runs (whole texts, one per run) are compared again. There are at most
    RUNS_PER_PARTITION hot texts per partition, which bounds what is broadcast.

    Null text equals empty text. Null ids sort last: they stay only if no row of the group has an id. Of rows that
    share both id and text one stays. Further columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("norm"))
    rows = rows.withColumn("text_sha256", F.sha2("norm", 256))
    limit = max(1, docs.count() // (RUNS_PER_PARTITION * partitions))
    hot = (rows.groupBy("text_sha256").agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit)
           .select("text_sha256", F.ceil(F.col("_rows") / limit).alias("_runs")))
    head = F.substring("norm", 1, SPLITTER_CHARS)
    salted = (rows.join(F.broadcast(hot), "text_sha256", "left")
              .withColumn("_head", head)
              .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("_runs")), F.lit(0))))
    neighbours = Window.partitionBy("_head", "text_sha256", "_salt", "norm")
    run = neighbours.orderBy(F.col("doc_id").desc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.row_number().over(neighbours.orderBy(F.col("doc_id").desc_nulls_last()))
    runs = stored(
        salted.repartitionByRange("_head", "text_sha256", "_salt")
        .select("doc_id", "text_sha256", "_runs", "norm", F.first("doc_id").over(run).alias("_first"),
                F.count(F.lit(1)).over(run).alias("_size"), at.alias("_at"))
        .select("doc_id", "text_sha256", "_first", "_size", "_at",
                F.when(F.col("_runs").isNotNull() & (F.col("_at") == 1), F.col("norm")).alias("_run_text")), "runs")
    merged = (runs.where(F.col("_run_text").isNotNull()).groupBy("_run_text")
              .agg(F.max("_first").alias("_keep"), F.sum("_size").alias("_total"),
                   F.first("text_sha256").alias("text_sha256")).drop("_run_text"))
    keep = F.when(F.col("_total").isNull(), F.col("_first")).otherwise(F.col("_keep"))
    return (runs.join(F.broadcast(merged), "text_sha256", "left")
            .select("doc_id", keep.alias("keep_id"), F.coalesce("_total", "_size").alias("group_size"),
                    ((F.col("_at") == 1) & F.col("_first").eqNullSafe(keep)).alias("kept"), "text_sha256"))
