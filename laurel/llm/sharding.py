"""Shards of nearly equal bytes by Karmarkar-Karp differencing over indivisible groups of equal texts."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.operators.numbering import number_rows
from laurel.session import stored

BLOCK = 8_000  # partial partitions that one task combines


def differenced(partials: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combines k-way partial partitions (rows: sums of their parts) by the largest differencing method.

    Returns for every row the final part of each of its parts, and the sums of the final parts. Always the two partial
    partitions of largest spread (largest less smallest part) are joined, the heaviest part of one with the lightest
    of the other. Ties go by row number, so the outcome depends on the rows only.
    """
    n, k = partials.shape
    order = np.argsort(-partials, axis=1, kind="stable")
    nodes = [tuple(row) for row in np.take_along_axis(partials, order, 1).tolist()]
    parents: list[tuple[int, int, list[int]]] = []  # of node n + i: the two joined, and the order of the joined parts
    heap = [(row[-1] - row[0], i) for i, row in enumerate(nodes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        sums = [x + y for x, y in zip(nodes[a], reversed(nodes[b]), strict=True)]
        by_size = sorted(range(k), key=lambda j: -sums[j])
        joined = tuple(sums[j] for j in by_size)
        nodes[a] = nodes[b] = ()
        parents.append((a, b, by_size))
        nodes.append(joined)
        heapq.heappush(heap, (joined[-1] - joined[0], len(nodes) - 1))
    places = np.zeros((len(nodes), k), np.int32)  # final part of each (ordered) part of a node
    places[-1] = range(k)
    for i in range(len(parents) - 1, -1, -1):
        a, b, by_size = parents[i]
        at = np.empty(k, np.int32)
        at[by_size] = places[n + i]  # by position in `sums`
        places[a], places[b] = at, at[::-1]
    parts = np.empty((n, k), np.int32)
    np.put_along_axis(parts, order, places[:n], 1)
    return parts, np.array(nodes[-1])


def _combined(partials: DataFrame, n_shards: int, blocks: int, level: int) -> DataFrame:
    """One differencing pass: (child, block, parts of the child, sums of the block), blocks chosen by hash."""
    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("child")
        parts, sums = differenced(np.array(pdf["sums"].tolist(), dtype=np.int64))
        return pd.DataFrame({"child": pdf["child"], "block": pdf["block"], "parts": list(parts),
                             "block_sums": [sums] + [None] * (len(pdf) - 1)})

    block = F.pmod(F.xxhash64("child", F.lit(level)), F.lit(blocks))
    child = dict(partials.dtypes)["child"]
    return partials.withColumn("block", block).groupBy("block").applyInPandas(
        combine, f"child {child}, block long, parts array<int>, block_sums array<long>")


def shards_by_bytes(docs: DataFrame, n_shards: int = 8, text: str = "text", doc_id: str = "doc_id",
                    block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows of equal text form one group that stays together; its weight is the sum of its rows' sizes (UTF-8 bytes plus
    one). Groups are differenced in blocks of about `block`, the blocks' partial partitions (one row of sums each) are
    differenced again, and so on until one is left, so no task sees more than a block at any corpus size. A group's
    shard is its part passed through the blocks' arrangements.

    Null text counts like empty text (size 1). Rows without id, repeated rows and further columns are fine; no rows
    give no rows. `slot` numbers the rows of a shard by id.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("child"))
    rows = stored(rows, "sizes")
    zeros = [F.lit(0).cast("long")] * (n_shards - 1)
    groups = stored(rows.groupBy("child").agg(F.sum("size").alias("bytes"))
                    .select("child", F.array("bytes", *zeros).alias("sums")), "groups")
    left, level, partials = groups.count(), 0, groups
    passes = []
    while left > 1 or level == 0:
        blocks = max(1, -(-left // block))
        done = stored(_combined(partials, n_shards, blocks, level), "parts")
        passes.append(done)
        partials = (done.where(F.col("block_sums").isNotNull())
                    .select(F.col("block").alias("child"), F.col("block_sums").alias("sums")))
        left, level = blocks, level + 1
    placed = passes[0].select("child", F.col("block").alias("_up"), F.element_at("parts", 1).alias("shard"))
    for done in passes[1:]:
        up = done.select(F.col("child").alias("_up"), F.col("block").alias("_next"), F.col("parts"))
        placed = (placed.join(up, "_up")
                  .select("child", F.col("_next").alias("_up"), F.expr("element_at(parts, shard + 1)").alias("shard")))
    sharded = rows.join(placed.drop("_up"), "child").select("doc_id", "size", "text_crc32", "shard")
    return (number_rows(sharded, ["shard"], [F.col("doc_id"), F.col("text_crc32")], "_rn")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("_rn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
