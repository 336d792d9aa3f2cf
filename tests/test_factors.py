"""Hand-computed factor rows for the branches of every factor."""

import math

import pytest
from pyspark.sql import functions as F

from laurel.operators import factors as A
from laurel.operators.relevance import with_relevance
from laurel.plans.scoring import expert_factors, ungated_factors

LISTING = "key_id string, a_id string, paper_id string, pos int, n_authors int"
RECORD = """key_id string, paper_id string, issue_year int, issue_lang string, citation int, usage_count int,
            issue_inst string, author_inst string, title string, abstract string"""


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def listing(spark):
    return rows(spark, [
        ("k", "ann", "p1", 0, 3), ("k", "bob", "p1", 1, 3), ("k", "cho", "p1", 2, 3),
        ("k", "ann", "p2", 0, 1), ("k", "ann", "p3", 1, 2), ("k", "dee", "gone", 0, 1),
        ("k", "bob", "gone", 0, 1),
    ], LISTING)


@pytest.fixture(scope="module")
def records(spark):
    return rows(spark, [
        ("k", "p1", 2020, "kor", 4, 0, "J1", "Kia Motors;MIT", "Fuel cell and fuel", None),
        ("k", "p2", 2017, "eng", 2, 5, "J1", "MIT", "Solar", "None"),
        ("k", "p3", 2018, "eng", 0, 1, "J9", "MIT;BMW;Kia", "cell cell", ""),
    ], RECORD)


@pytest.fixture(scope="module")
def impact(spark):
    return rows(spark, [("kor", "J1", 0.9), ("eng", "J1", 2.0), ("eng", "J1", 2.0)], "lang string, name string, jif double")


def queries(spark, text):
    return rows(spark, [("k", text)], "key_id string, query string")


def by_author(df):
    return {r.a_id: r for r in df.collect()}


def test_ungated_factors(spark, listing, records, impact):
    raw = by_author(ungated_factors(listing, records, A.paper_profile(), 2020, impact, queries(spark, "fuel cell")))
    assert set(raw) == {"ann", "bob", "cho"}  # dee has no record
    ann, bob, cho = raw["ann"], raw["bob"], raw["cho"]
    assert (ann.productivity, bob.productivity, cho.productivity) == (3, 2, 1)  # bob's lost record counts here
    assert ann.contrib == pytest.approx(1 + 1 + 3) and bob.contrib == pytest.approx(2 / 3) and cho.contrib == 3
    assert ann.recentness == pytest.approx((1 + 1.0 + 1) / 3)
    assert (ann.career, ann.longest_run, ann.durability) == (4, 2, 0.5)
    quality = [math.log((4 * 1 + 1) * (0.9 + 1.1)), math.log((2 * 3 + 1) * (2.0 + 1.1)), math.log(1 * 1.1)]
    assert ann.quality == pytest.approx(sum(quality)) and cho.quality == pytest.approx(quality[0])
    assert (ann.coop, bob.coop) == (2, 1)
    assert ann.relevance == pytest.approx(max(3 / math.sqrt(5), 1.0) / math.sqrt(2))


def test_usage_counts_into_quality(spark, listing, records, impact):
    raw = by_author(ungated_factors(listing, records, A.usage_profile(), 2020, impact))
    assert raw["cho"].quality == pytest.approx(math.log(5 * 2.0))  # usage 0 counts as 1
    assert raw["ann"].quality == pytest.approx(math.log(10.0) + math.log(7 * 3.1) + math.log(5) + math.log(1.1))


def test_normalised_rows(spark, listing, records, impact):
    out = by_author(expert_factors(listing, records, A.paper_profile(), 2020, impact, queries(spark, "fuel cell")))
    assert out["ann"].productivity == 1 and out["ann"].contrib == 1 and out["ann"].quality == 1 and out["ann"].coop == 1
    assert out["bob"].productivity == pytest.approx(2 / 3) and out["bob"].numpaper == 2


def test_same_record_listed_twice_counts_once_for_quality(spark, records, impact):
    twice = rows(spark, [("k", "ann", "p1", 0, 3), ("k", "ann", "p1", 2, 3)], LISTING)
    raw = by_author(ungated_factors(twice, records, A.paper_profile(), 2020, impact))["ann"]
    assert (raw.productivity, raw.contrib, raw.coop) == (2, 4.0, 1)
    assert raw.quality == pytest.approx(math.log(10.0))


@pytest.mark.parametrize("year,points", [(2020, 100), (2018, 100), (2017, 100), (2016, 90), (2008, 10), (2007, 0),
                                         (2006, 0), (2005, 0), (1990, 0), (2021, 100)])
def test_recency_points(spark, year, points):
    got = spark.range(1).select(A.recency_points(F.lit(year), 2020).alias("p")).first().p
    assert got == points


def test_gate_and_maxima(spark):
    raw = rows(spark, [("k", "a", 5, 0.0, 1.0, 1.0, 0, 9.0, 0.5), ("k", "b", 2, 4.0, 0.5, 0.25, 0, 3.0, None)],
               "key_id string, a_id string, productivity long, contrib double, durability double, recentness double, "
               "coop long, quality double, relevance double")
    gated = by_author(A.gated(raw))
    assert gated["a"].productivity == 0 and gated["a"].acc == 0.0 and gated["a"].numpaper == 5
    assert gated["b"].productivity == 2 and gated["b"].acc == A.DEFAULT_SCORE
    top = A.maxima(raw).first()
    assert (top.max_quality, top.max_productivity, top.max_contrib, top.max_coop) == (9.0, 5, 4.0, 1)
    norm = by_author(A.normalised(A.gated(raw), A.maxima(raw)))
    assert norm["b"].quality == pytest.approx(1 / 3) and norm["b"].coop == 0  # the gated author holds the maximum


def test_projects(spark):
    listing = rows(spark, [("k", "m", "1", 0, 1), ("k", "m", "2", 0, 1), ("k", "x", "1", 0, 1), ("k", "m", "3", 0, 1)], LISTING)
    projects = rows(spark, [("k", "1", "m", "99", 2019), ("k", "2", "y", "0", 2020), ("k", "3", None, "", 2020)],
                    "key_id string, paper_id string, manager_id string, total_fund string, issue_year int")
    raw = by_author(ungated_factors(listing, projects, A.project_profile(), 2020))
    assert raw["m"].contrib == 11.0 and raw["x"].contrib == 0.0
    assert raw["m"].quality == pytest.approx(math.log(100)) and raw["m"].coop == 0
    out = by_author(expert_factors(listing, projects, A.project_profile(), 2020))
    assert out["x"].productivity == 0 and out["x"].acc == 0 and out["m"].acc == A.DEFAULT_SCORE


def test_no_manager_at_all_gives_zero_contrib(spark):
    listing = rows(spark, [("k", "x", "1", 0, 1)], LISTING)
    projects = rows(spark, [("k", "1", "m", "9", 2019)], "key_id string, paper_id string, manager_id string, total_fund string, issue_year int")
    assert by_author(expert_factors(listing, projects, A.project_profile(), 2020))["x"].contrib == 0.0


@pytest.mark.parametrize("query,text,strict,score", [
    ("cell", "a cell, a Cell", False, 1.0),
    ("fuel cell", "fuel fuel", False, 1 / math.sqrt(2)),
    ("fuel cell", "cellar refuel", False, 0.02),
    ("fuel fuel", "fuel", False, 1.0),  # repeated word: sizes differ
    ("fuel fuel", "fuel", True, 1.0),
    ("fuel-cell", "the fuel cell cell", False, 1.0),  # hyphen: two words against one piece
    ("fuel-cell", "the fuel cell cell", True, 3 / math.sqrt(5) / math.sqrt(2)),
    ("fuel-cell", "nothing", False, 0.02),
    ("fuel !solar", "solar", False, 1 / math.sqrt(2)),  # NOT words score, too
    ("a b", "a b", False, 1.0),  # no word of two characters
    ("a b", "", False, 0.02),
    ("연료전지 cell", "연료전지 CELL", False, 1.0),
])
def test_relevance(spark, query, text, strict, score):
    records = rows(spark, [("k", "p", text)], "key_id string, paper_id string, title string")
    assert with_relevance(records, queries(spark, query), ["title"], strict).first().relevance == pytest.approx(score)


def test_profiles_by_site():
    assert A.profile_of("NTIS").by_manager and not A.profile_of("KCI").by_manager


def test_many_listings_are_dealt_to_tasks_by_their_number(spark, data, monkeypatch):
    from laurel import session
    from laurel.catalog.factors import a16

    assert session.tasks_for(spark, 4 * session.TASK_ROWS) is None
    assert session.tasks_for(spark, 100 * session.TASK_ROWS + 1) == 101
    few = a16(spark, data)
    want = few.collect()
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    many = a16(spark, data)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (few, many)]
    # The lines once per reader, then both sides of the join of listings and records, each to a number of tasks.
    assert "REPARTITION_BY_NUM" not in plans[0] and plans[1].count("REPARTITION_BY_NUM") >= 3
    assert sorted(many.collect()) == sorted(want)
