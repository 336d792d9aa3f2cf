"""Facet counts and size-bounded batches over facet values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.operators.numbering import number_rows, running_sum
from laurel.session import stored


def facet_counts(df: DataFrame, facets: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, facet, value, n) for several facets at once, with GROUPING SETS."""
    text = df.select(*keys, *[F.col(f).cast("string").alias(f) for f in facets])
    grouped = text.groupingSets([[F.col(c) for c in (*keys, f)] for f in facets], *keys, *facets).agg(
        F.count("*").alias("n"), *[F.grouping(f).alias(f"_g_{f}") for f in facets])
    facet = reduce(lambda rest, f: F.when(F.col(f"_g_{f}") == 0, f).otherwise(rest), facets, F.lit(None))
    return grouped.select(*keys, facet.alias("facet"), F.coalesce(*facets).alias("value"), "n")


def sorted_facet(counts: DataFrame, keys: Sequence[str], value: str, largest: str = "from_largest",
                 smallest: str = "from_smallest") -> DataFrame:
    """Adds the place of every facet value by count from both ends (ties: by value).

    One range sort gives the places from the smallest; within a count the values stand in the same order from either
    end, so the places from the largest follow from how many values have a larger count.
    """
    placed = number_rows(counts, keys, [F.col("n").asc(), F.col(value)], smallest, "_all")
    runs = placed.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("n").alias("_n")).agg(
        F.min(smallest).alias("_first"), F.count("*").alias("_many"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "n")])
    above = F.col("_all") - (F.col("_first") + F.col("_many") - 1)
    return placed.join(runs, same).select(
        *counts.columns, (above + F.col(smallest) - F.col("_first") + 1).alias(largest), smallest)


def packed(counts: DataFrame, value: str, limit: int) -> DataFrame:
    """(value, n) -> (value, n, batch): values smallest first into batches of at most `limit` records.

    Values above the limit are set aside (batch NULL). Values with equal counts are interchangeable, so the fold
    that places batches runs over the distinct counts, at most `limit` numbers; every value then finds its batch
    from its place among the values with the same count.
    """
    counts = stored(counts, "facet")  # read by two branches
    small = counts.where(F.col("n") <= limit)
    sizes = small.groupBy(F.col("n").cast("long").alias("n")).agg(F.count("*").alias("many"))
    ordered = F.sort_array(F.collect_list(F.struct("n", "many")))
    state = F.struct(
        F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("load"),
        F.array().cast("array<struct<n:bigint,batch:bigint,room:bigint,per:bigint>>").alias("runs"))
    lim = F.lit(limit).cast("long")

    def place(acc, x):
        n, many = x["n"], x["many"]
        room = F.floor((lim - acc["load"]) / n).cast("long")  # values that still fit into the open batch
        per = F.floor(lim / n).cast("long")
        left = many - room
        full = F.ceil(left / per).cast("long")
        rest = left - (full - 1) * per
        fits = many <= room
        return F.struct(
            F.when(fits, acc["batch"]).otherwise(acc["batch"] + full).alias("batch"),
            F.when(fits, acc["load"] + many * n).otherwise(rest * n).alias("load"),
            F.array_append(acc["runs"], F.struct(n.alias("n"), acc["batch"].alias("batch"), room.alias("room"),
                                                 per.alias("per"))).alias("runs"))

    runs = sizes.agg(ordered.alias("s")).select(
        F.explode(F.aggregate("s", state, place, lambda acc: acc["runs"])).alias("r")).select(
        F.col("r.n").alias("_n"), F.col("r.batch").alias("_batch"), F.col("r.room").alias("_room"),
        F.col("r.per").alias("_per"))
    placed = number_rows(counts, ["n"], [F.col(value)], "_j").withColumn("_j", F.col("_j") - 1)
    batch = F.when(F.col("_j") < F.col("_room"), F.col("_batch")).otherwise(
        F.col("_batch") + 1 + F.floor((F.col("_j") - F.col("_room")) / F.col("_per")))
    return placed.join(runs, F.col("n") == F.col("_n"), "left").select(
        value, "n", batch.cast("long").alias("batch"))


def largest_excluded(counts: DataFrame, keys: Sequence[str], value: str, limit: int) -> DataFrame:
    """Adds `excluded`: the largest values, as many as needed until the rest holds at most `limit` records."""
    order = [F.col("n").desc(), F.col(value)]
    return (
        running_sum(counts, keys, order, "n", "_running", "_all")
        .withColumn("excluded", F.col("_all") - (F.col("_running") - F.col("n")) > limit)
        .drop("_running", "_all")
    )


def fixed_batches(df: DataFrame, keys: Sequence[str], order, size: int = 500, list_size: int = 50_000) -> DataFrame:
    """Adds `list_no` and `batch_no` (both from 0): batches of `size` within lists of `list_size`."""
    place = F.col("_rn") - 1
    return (
        number_rows(df, keys, order, "_rn")
        .withColumn("list_no", F.floor(place / list_size))
        .withColumn("batch_no", F.floor((place % list_size) / size))
        .drop("_rn")
    )
