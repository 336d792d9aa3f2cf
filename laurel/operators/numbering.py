"""Row numbers and running sums within keys that hold for any key size.

A window partitioned by the key puts a whole key into one task, and one key may hold a third of all rows. Here the
rows are range-sorted by (key, order), so a big key spreads over many slices; each slice is numbered on its own and
the slice totals (one row per slice and key) give the offsets and the totals of the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laurel.session import stored

_SLICE_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its lower 33 bits


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[Column], slices: int | None = None) -> DataFrame:
    """Globally sorted rows with `_slice` and `_at` (row number in the slice), stored.

    Stored because a recomputed sort could draw other range bounds than the slice totals saw. The number of slices
    follows the size of the rows unless `slices` fixes it.
    """
    ordered = df.sort(*keys, *order) if slices is None else df.repartitionByRange(
        slices, *keys, *order).sortWithinPartitions(*keys, *order)
    return stored(
        ordered
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_row", _SLICE_BITS))
        .withColumn("_at", F.col("_row").bitwiseAND(F.lit((1 << _SLICE_BITS) - 1)))
        .drop("_row"), "slices")


def _with_offsets(sliced: DataFrame, totals: DataFrame, keys: Sequence[str], total: str | None) -> DataFrame:
    """Adds `_before`, the total of the key's earlier slices, and `total`, that of all its slices."""
    of_key = Window.partitionBy(*keys)
    before = of_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    if total is not None:
        offsets = offsets.withColumn(total, F.sum("_total").over(of_key))
    offsets = offsets.drop("_total")
    match = F.col("o._slice") == F.col("s._slice")
    for k in keys:
        match &= F.col(f"o.{k}").eqNullSafe(F.col(f"s.{k}"))
    extra = [F.col(f"o.{c}") for c in offsets.columns if c not in {"_slice", *keys}]
    return sliced.alias("s").join(offsets.alias("o"), match).select("s.*", *extra)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn",
                total: str | None = None) -> DataFrame:
    """Exact row_number() over (partition by keys order by order), and count(*) of the key as `total` if named.

    `order` must be total within a key. The rows are sorted and stored once as they are, so pass only the columns the
    result needs.
    """
    rows = sliced(df, keys, order)
    sizes = rows.groupBy("_slice", *keys).agg(F.count("*").alias("_total"), F.min("_at").alias("_first"))
    placed = _with_offsets(rows, sizes, keys, total)
    number = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return placed.withColumn(name, number).drop("_slice", "_at", "_first", "_before")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], measure: str, name: str,
                total: str | None = None) -> DataFrame:
    """Exact sum(measure) over (partition by keys order by order), up to the row, and that of the key as `total`."""
    rows = sliced(df, keys, order)
    local = Window.partitionBy("_slice", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("_slice", *keys).agg(F.sum(measure).alias("_total"))
    placed = _with_offsets(rows.withColumn("_local", F.sum(measure).over(local)), sums, keys, total)
    return placed.withColumn(name, F.col("_before") + F.col("_local")).drop("_slice", "_at", "_local", "_before")
