"""Row numbers, running sums, caps and packing against brute force, with one key holding a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from laurel.operators import facets, ranking, search
from laurel.operators.numbering import number_rows, running_sum


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    data = [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", i, rng.randrange(100)) for i in range(6000)]
    data += [(None, 10_000 + i, i) for i in range(50)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, id long, v int").repartition(7)


def groups(data):
    out = {}
    for k, i, v in data:
        out.setdefault(k, []).append((v, i))
    return out


def test_row_numbers(skewed):
    data, df = skewed
    got = {r.id: r.rn for r in number_rows(df, ["k"], [F.col("v").desc(), F.col("id")]).collect()}
    for members in groups(data).values():
        for place, (_, i) in enumerate(sorted(members, key=lambda m: (-m[0], m[1])), 1):
            assert got[i] == place


def test_running_sums(skewed):
    data, df = skewed
    got = {r.id: r.s for r in running_sum(df, ["k"], [F.col("v"), F.col("id")], "v", "s").collect()}
    for members in groups(data).values():
        total = 0
        for v, i in sorted(members):
            total += v
            assert got[i] == total


def test_cap_keeps_the_first_rows(skewed):
    data, df = skewed
    named = df.where("k is not null")
    got = {}
    for r in search.capped(named, ["k"], [("v", True), ("id", False)], 100).collect():
        got.setdefault(r.k, (set(), r.is_partial))[0].add(r.id)
    for k, members in groups(data).items():
        if k is not None:
            assert got[k] == ({i for _, i in sorted(members, key=lambda m: (-m[0], m[1]))[:100]}, len(members) > 100)


@pytest.mark.parametrize("limit", [7, 50, 2000])
def test_packing(spark, limit):
    rng = random.Random(limit)
    counts = [(f"v{i:04d}", rng.randrange(1, limit + limit // 5 + 2) if i % 4 else 1 + i % 3) for i in range(400)]
    df = spark.createDataFrame(counts, "value string, n long")
    got = {r.value: r.batch for r in facets.packed(df, "value", limit).collect()}
    batch, load, want = 0, 0, {}
    for value, n in sorted(counts, key=lambda c: (c[1], c[0])):
        if n > limit:
            want[value] = None
            continue
        if load + n > limit:
            batch, load = batch + 1, 0
        load += n
        want[value] = batch
    assert got == want


def test_largest_excluded(spark):
    counts = [("k", "a", 50), ("k", "b", 30), ("k", "c", 15), ("k", "d", 5), ("j", "a", 3)]
    df = spark.createDataFrame(counts, "key string, value string, n long")
    got = {(r.key, r.value): r.excluded for r in facets.largest_excluded(df, ["key"], "value", 20).collect()}
    assert got == {("k", "a"): True, ("k", "b"): True, ("k", "c"): False, ("k", "d"): False, ("j", "a"): False}


def test_pages_do_not_overlap(spark):
    df = spark.range(250).select(F.col("id").alias("a_id"))
    seen = [r.a_id for p in range(3) for r in ranking.author_page(df, [F.col("a_id")], p).collect()]
    assert seen == list(range(250))


def test_top_k_bounds():
    with pytest.raises(ValueError):
        ranking.top_experts(None, {"quality": 1}, 0)
