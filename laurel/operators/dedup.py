"""Duplicate removal and set operations on record sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = ["key_id", "id"]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key by `order`. An aggregation, so copies are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    first = df.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def duplicate_counts(df: DataFrame, group: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows, distinct records and surplus copies per group."""
    sizes = df.groupBy(*group, *[k for k in keys if k not in group]).agg(F.count("*").alias("_n"))
    return sizes.groupBy(*group).agg(
        F.sum("_n").alias("n_rows"), F.count("*").alias("n_records"),
        (F.sum("_n") - F.count("*")).alias("n_duplicates"))


def union_of_searches(df: DataFrame, hits: Sequence[Column], keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys and columns of the records found by any of several searches of one table, once each.

    One scan, not one per search, and only the wanted columns are moved.
    """
    return first_per_key(df.where(reduce(lambda a, b: a | b, hits)).select(*keys, *columns), keys, [])


def union_of_sets(sets: Sequence[DataFrame]) -> DataFrame:
    """#1 OR #2 OR ...: the rows of any set, once each."""
    merged = sets[0]
    for s in sets[1:]:
        merged = merged.unionByName(s)
    return merged.distinct()


def complement_parts(df: DataFrame, inst: Column, countries: Sequence[str], name: str = "part") -> DataFrame:
    """One part per country and a part `other` for records of none. A record of two countries is in both parts."""
    hits = F.filter(F.array(*[F.when(inst.contains(c), c) for c in countries]), lambda x: x.isNotNull())
    parts = F.when(F.size(hits) == 0, F.array(F.lit("other"))).otherwise(hits)
    return df.withColumn(name, F.explode(parts))


def distinct_authors(author_paper: DataFrame) -> DataFrame:
    return author_paper.select("key_id", "a_id").distinct()
