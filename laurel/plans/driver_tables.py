"""The given tables read as bibliographic data: orders are records, suppliers authors, order priorities queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from laurel.session import dealt, tasks_for

_schemas: dict[str, StructType] = {}
_sizes: dict[str, int] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table. Its schema is read once per process: every read without one starts a job."""
    path = f"{folder}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def tasks(spark: SparkSession, folder: str) -> int | None:
    """Tasks for joins of all lines. The lines are counted once per process, from the files' footers."""
    if folder not in _sizes:
        _sizes[folder] = table(spark, folder, "lineitem").count()
    return tasks_for(spark, _sizes[folder])


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct authors per record with the line and the part they come first with.

    The lines are dealt by record once; the groupings, joins and windows by record that follow need no other exchange.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")
    return dealt(lines, tasks(spark, folder), "l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(
        F.min("l_linenumber").alias("line"), F.min("l_partkey").alias("partkey"))


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct authors per record with their query."""
    keys = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("key_id"))
    listed = _lines(spark, folder)
    return listed.join(keys, listed.l_orderkey == keys.o_orderkey)


def author_paper(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record and author. The window sees the distinct authors of one record: one author list."""
    in_record = Window.partitionBy("l_orderkey")
    return _listed(spark, folder).select(
        "key_id",
        F.col("l_suppkey").alias("a_id"),
        F.col("l_orderkey").alias("paper_id"),
        (F.row_number().over(in_record.orderBy("line", "l_suppkey")) - 1).alias("pos"),
        F.count("*").over(in_record).alias("n_authors"),
    )


def _people(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as (l_suppkey, author, author_inst)."""
    return table(spark, folder, "supplier").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("author"), F.col("n_name").alias("author_inst"))


def _author_lists(listed: DataFrame, people: DataFrame, keys, columns, *others, share: int | None = None) -> DataFrame:
    """`;` lists in author order. One group is one author list, rebuilt as the cell of a record it stands for.

    `share` tasks find the names, and as many build the lists and join them with what has the keys, too.
    """
    named = dealt(dealt(listed, share, "l_suppkey").join(people, "l_suppkey", "left"), share, *keys).withColumn(
        "author_id", F.col("l_suppkey").cast("string"))
    entry = F.when(F.col("author_inst").isNotNull(), F.struct("line", "l_suppkey", *columns))
    rebuilt = named.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("people"), *others)
    return rebuilt.select(
        *[c for c in rebuilt.columns if c != "people"],
        *[F.when(F.size("people") > 0, F.array_join(F.col("people")[c], ";")).alias(c) for c in columns])


def author_institutions(spark: SparkSession, folder: str, columns=("author_id", "author", "author_inst")) -> DataFrame:
    """Records that have authors, with `;` lists of supplier keys, supplier names and nations."""
    listed = _listed(spark, folder).withColumnRenamed("l_orderkey", "paper_id")
    return _author_lists(listed, _people(spark, folder), ["key_id", "paper_id"], columns,
                         share=tasks(spark, folder)).where(F.col(columns[0]).isNotNull())


def records(spark: SparkSession, folder: str, lists=()) -> DataFrame:
    """Orders as paper records; journal and texts come from the order's first part.

    `lists` names author lists to add; they are built in the same pass over the lines.
    """
    if lists:
        first = _author_lists(_lines(spark, folder), _people(spark, folder), ["l_orderkey"], lists,
                              F.min("partkey").alias("partkey"), share=tasks(spark, folder))
    else:
        first = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("partkey"))
    part = table(spark, folder, "part")
    price = F.floor("o_totalprice")
    return (
        table(spark, folder, "orders")
        .join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(part, F.col("p_partkey") == F.col("partkey"), "left")
        .select(
            F.col("o_orderpriority").alias("key_id"),
            F.col("o_orderkey").alias("paper_id"),
            F.year("o_orderdate").alias("issue_year"),
            F.when(F.col("o_orderkey") % 4 == 0, "kor").otherwise("eng").alias("issue_lang"),
            (price % 50).alias("citation"),
            (price % 7).alias("usage_count"),
            F.col("p_brand").alias("issue_inst"),
            F.col("p_name").alias("title"),
            F.col("p_type").alias("paper_keyword"),
            *lists,
        )
    )


def impact(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as journals with an impact factor; three brands have none."""
    return (
        table(spark, folder, "part")
        .where(~F.col("p_brand").isin("Brand#3", "Brand#13", "Brand#23"))
        .groupBy(F.when(F.col("p_size") <= 25, "kor").otherwise("eng").alias("lang"), F.col("p_brand").alias("name"))
        .agg(F.round(F.avg("p_retailprice") / 1000, 3).alias("jif"))
    )


def projects(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as projects: manager is the first supplier, fund the price; every tenth has no end date."""
    lead = author_paper(spark, folder).where("pos = 0").select(
        F.col("paper_id").alias("o_orderkey"), F.col("a_id").alias("manager_id"))
    base = table(spark, folder, "orders").join(lead, "o_orderkey", "left")
    ends = F.when(F.col("o_orderkey") % 10 == 0, "null").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    starts = F.when(F.col("o_orderkey") % 20 == 0, "null").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return base.select(
        F.col("o_orderpriority").alias("key_id"), F.col("o_orderkey").alias("paper_id"),
        F.col("manager_id").cast("string").alias("manager_id"),
        F.floor("o_totalprice").cast("string").alias("total_fund"),
        ends.alias("prd_end"), starts.alias("prd_start"),
    )
