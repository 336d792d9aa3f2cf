"""Scalar, multi-value and similarity functions on the odd cases."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from laurel.functions import fuzzy
from laurel.functions import multivalue as R
from laurel.functions import text as X
from laurel.operators.identifiers import with_aligned_ids, with_best_author


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize("fn,given,want", [
    (X.strip_markup, "<b>a-b</b> <i\nx>", "ab <i\nx>"),
    (X.strip_tags, "a <i>b</i>-c", "a b-c"),
    (X.digits_only, "S12-3", 123), (X.digits_only, "none", 0),
    (X.page_number, "123.0", 123), (X.page_number, "E12", 12), (X.page_number, "", 0),
    (X.drop_last_symbol, "Title.", "Title"), (X.drop_last_symbol, "제목", "제목"), (X.drop_last_symbol, "A..", "A."),
    (X.person_id, '"007.12.3"', "12.3"), (X.person_id, "12", "12"),
    (X.grouped_number, "12,345", 12345), (X.node_id, "x?NODE12&NODE3", "NODE12&"),
    (X.registry_name, "KCI 등재", "KCI"), (X.language, "abc 가", "kor"), (X.language, "abc", "eng"),
    (X.joined_digit_runs, "/a12/b3", "12,3"), (X.clean_query, "a|b !c", "ab c"), (X.fold_null, "없음", None),
])
def test_scalar(spark, fn, given, want):
    assert value(spark, fn(F.lit(given))) == want


@pytest.mark.parametrize("given,start,end", [("pp.12-15", "12", "15"), ("pp.7", "7", ""), ("p-1", "", "1")])
def test_page_range(spark, given, start, end):
    got = value(spark, X.page_range(F.lit(given)))
    assert (got.start, got.end) == (start, end)


def test_name_inst_tokens(spark):
    got = value(spark, R.name_inst_pairs(F.array(*map(F.lit, ["Kim(MIT)", "Lee", "S.(KAIST (Daejeon))", "lost"]))))
    assert [(p.name, p.inst) for p in got] == [("Kim", "MIT"), ("Lee S.", "KAIST (Daejeon)")]


def test_institutions(spark):
    assert value(spark, R.institution_list(F.lit("KISTI&lt;MIT; X"))) == ["KISTI"] * 3
    assert value(spark, R.institution_list(F.lit(" A ;B"))) == ["A", "B"]
    got = value(spark, R.institutions_without_names(F.lit("Kim J.; Lee S.; Park K."), F.lit("Kim J.; Lee S., MIT, Boston; Park K.")))
    assert got == "; MIT Boston; MIT Boston"  # blank first place stays blank, a later one repeats


@pytest.mark.parametrize("address,want", [
    ("[A, B; C, D] X; [E, F] Y", ["X", "X", "Y"]),
    ("[E, F] Y; [A, B] X; [A, B; C, D] Z", ["X", "Z", "Y"]),
    ("[A, B] X", ["X", None, None]),
    ("X; Y; Z", ["X", "Y", "Z"]),
])
def test_bracketed_institutions(spark, address, want):
    assert value(spark, R.bracketed_institutions(F.lit("A, B; C, D; E, F"), F.lit(address))) == want


def test_jaro_equals_the_published_measure():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(300)] + ["MARTHA", "MARHTA", "김철수"]
    con = duckdb.connect()
    for a, b in [(rng.choice(words), rng.choice(words)) for _ in range(1500)]:
        want = con.execute("select jaro_similarity(?, ?)", [a, b]).fetchone()[0]
        assert fuzzy.jaro(a, b) == pytest.approx(want), (a, b)


def test_length_and_letter_bound_never_drops_a_match():
    rng = random.Random(9)
    for _ in range(20_000):
        a = "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 12)))
        b = list(a)
        for _ in range(rng.randrange(0, 4)):
            b[rng.randrange(len(b))] = rng.choice("abcdefg")
        b = "".join(b) + rng.choice(["", "", "x"])
        if fuzzy.jaro(a, b) >= 0.9:
            assert fuzzy.can_reach(a, b, frozenset(a), frozenset(b), 0.9)


def _names(rng, most):
    words = ["Kim", "Kím", "Min", "Minho", "Minhoo", "Soora", "Sora", "김철수", "Anderson", "Andersen", "a", "", ",", "-"]
    return [rng.choice([" ", "-", ", "]).join(rng.choice(words) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(most))]


def _tokens(name):
    return [t for t in name.replace(",", "").replace("-", " ").split(" ") if t]


@pytest.mark.parametrize("pairs", [1, 7, 1 << 18])
def test_batch_of_records_is_matched_like_each_record(monkeypatch, pairs):
    monkeypatch.setattr(fuzzy, "PAIRS", pairs)
    met = []
    bounded = fuzzy._similar_pairs
    monkeypatch.setattr(fuzzy, "_similar_pairs", lambda left, *more: met.append(len(left)) or bounded(left, *more))
    rng = random.Random(17)
    for _ in range(60):
        records = [(_names(rng, 6), _names(rng, 6)) for _ in range(rng.randrange(8))]
        lists = [pa.array([None if not x else ";".join(x) for x in side], pa.string()) for side in (
            [[f"{n}/ID{i}" for i, n in enumerate(e)] for e, _ in records], [a for _, a in records])]
        best, starts = fuzzy.best_of_batch(*lists, 0.9)
        want = [fuzzy.best_positions(*[[_tokens(n) for n in side if n.strip(" ")] for side in r], 0.9) for r in records]
        assert [best[i:j].tolist() for i, j in zip(starts, starts[1:])] == want
    assert max(met) <= max(pairs, 4 * 6)  # an entry token meets at least the tokens of one record


def test_conflicts_of_a_batch_are_those_of_each_record():
    rng = random.Random(3)
    rows = [[rng.randrange(-1, 3) for _ in range(rng.randrange(8))] for _ in range(200)]
    want = []
    for row in rows:
        taken = []
        for p in row:
            void = p >= 0 and p in taken
            taken = [-1 if void and t == p else t for t in taken] + [-1 if void else p]
        want += taken
    starts = np.cumsum([0] + [len(r) for r in rows])
    assert fuzzy.without_conflicts(np.array(sum(rows, []), np.int32), starts).tolist() == want


def test_ids_are_matched_once_and_parsed_once_per_record(spark):
    df = spark.createDataFrame([(1, "Kim, Min Ho; Lee, Sora", "Lee, Sora/B"), (2, "Park, K.", None)], "n long, author string, entries string")
    from laurel.catalog import authors

    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    best = authors.by_entry(with_best_author(df, "author", "entries"), "n")
    assert best.collect() == [(1, 0, 1)] and plan(best).count("run(") == 1
    aligned = plan(with_aligned_ids(df, "author", "entries", "ids"))
    assert "[(cast(array_position" in aligned and ")[(cast(array_position" not in aligned  # the ids are a variable there


@pytest.mark.parametrize("entries,want", [
    ("Kim, Min-Ho/A", "A;;"), ("Lee, Sora/B; Kim, Min Ho/A", "A;B;"), ("Choi, Xyz/C", ";;"), ("", ";;"), (None, ";;"),
    ("Kim, Min Ho/A; Kim, Minho/B", ";;"), ("Kim, Min Ho/A; Kim, Min Ho/B; Kim, Min Ho/C", "C;;"), ("/Z; Park, K./P", ";;P"),
])
def test_aligned_ids(spark, entries, want):
    df = spark.createDataFrame([("Kim, Min Ho; Lee, Sora; Park, K.", entries)], "author string, entries string")
    assert with_aligned_ids(df, "author", "entries", "ids").first().ids == want
