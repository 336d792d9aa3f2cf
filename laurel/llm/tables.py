"""Helpers shared by the operators: inputs, learning folds, bounded filters by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ID_FILTER_BITS = 1 << 26  # bits of the id filter: 2,048 bitmaps of 4 KB, 8 MB at most


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of the documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def split_by_ids(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` whose id may be in the first column of `ids` (all that are, and few others), and the rest.

    A bitmap of hashed ids is built on the executors and broadcast; its size is fixed (ID_FILTER_BITS). It spares the
    shuffle of texts that a join would drop or keep anyway; the exact join comes after it, on the first part.
    """
    def spot(column: str):
        return F.pmod(F.xxhash64(F.col(column)), F.lit(ID_FILTER_BITS))

    bitmaps = (ids.select(F.col(ids.columns[0]).alias("id")).select(spot("id").alias("spot"))
               .groupBy(F.bitmap_bucket_number("spot").alias("bucket"))
               .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), spot(doc_id).alias("spot"))
    marked = rows.withColumn("bucket", F.bitmap_bucket_number("spot")).join(F.broadcast(bitmaps), "bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(spot) div 8 + 1 as int), 1)")), 16, 10)
    marked = marked.withColumn("byte", byte.cast("int"))
    may = F.coalesce(F.expr("shiftright(byte, cast(bitmap_bit_position(spot) % 8 as int)) & 1 = 1"), F.lit(False))
    return marked.where(may).select("row.*"), marked.where(~may).select("row.*")


def with_ids(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id may be in `ids`: all that are, and few others."""
    return split_by_ids(docs, ids, doc_id)[0]


def without_ids(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id is not in the first column of `ids`; rows without id stay."""
    may, rest = split_by_ids(docs, ids, doc_id)
    return may.join(ids.select(F.col(ids.columns[0]).alias(doc_id)), doc_id, "left_anti").select(*docs.columns).union(rest)


def text_sha256(text: str = "text") -> Column:
    """With the id, what names a row: rows may share an id and differ in text. Null is empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def named_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row_id, text): the id and the text's SHA-256 as one struct, for operators that hand the id on."""
    return docs.select(F.struct(F.col(doc_id).alias("id"), text_sha256(text).alias("sha")).alias("row_id"), F.col(text))


def without_rows(docs: DataFrame, gone: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` but those whose id and text are in `gone` (id, sha); rows without id match by their text."""
    may, rest = split_by_ids(docs, gone.select("id"), doc_id)
    rows = may.select(F.struct(*[may[c] for c in may.columns]).alias("row"), F.col(doc_id).alias("own_id"),
                      text_sha256(text).alias("own_sha"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_sha") == F.col("sha"))
    return rows.join(gone, same, "left_anti").select("row.*").union(rest)
