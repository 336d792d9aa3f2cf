"""The physical plans that scale depends on."""

import re

import pytest

from __spark_entry__ import queries

BATCH = [n for n in sorted(queries()) if not re.match(r"t0|s01|s03", n)]


def plan(spark, data, name):
    return queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in BATCH if re.match(r"[adjfwr]\d", n)])
def test_no_cross_join_and_no_row_at_a_time_python(spark, data, name):
    text = plan(spark, data, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas"):
        assert bad not in text


def test_top_k_is_pruned_before_the_shuffle(spark, data):
    assert plan(spark, data, "w09_top_experts").count("WindowGroupLimit") >= 2


def test_date_range_reaches_the_scan(spark, data):
    text = plan(spark, data, "f07_year_range")
    assert "GreaterThanOrEqual(o_orderdate" in text and "ReadSchema: struct<o_orderkey:bigint,o_orderdate" in text


def test_relevance_does_not_shuffle_texts(spark, data):
    text = plan(spark, data, "a15_acc_records")
    assert "SortMergeJoin [key_id" not in text and "Generate" not in text


def test_scalar_queries_do_not_shuffle(spark, data):
    for name in BATCH:
        if re.match(r"x(?!04|23)", name):
            assert "Exchange" not in plan(spark, data, name), name


def test_cut_is_joined_to_the_records_not_the_records_ranked(spark, data):
    text = plan(spark, data, "f09_result_cap")
    assert "_cut_o_orderdate" in text and "Window" not in text.split("_cut_o_orderdate")[0]


def test_many_lines_are_dealt_by_record_before_lists_are_built(spark, data, monkeypatch):
    from laurel import session

    monkeypatch.setattr(session, "TASK_ROWS", 500)
    text = plan(spark, data, "j06_j07_projects_with_author_ids")
    assert re.search(r"hashpartitioning\(l_orderkey#\d+L, \d+\), REPARTITION_BY_NUM", text)


def test_many_names_are_dealt_before_lists_are_built_and_joined(spark, data, monkeypatch):
    from laurel import session
    from laurel.plans import driver_tables as D

    lists = ["author", "author_inst", "author_id"]
    built = [lambda: D.records(spark, data, lists), lambda: D.author_institutions(spark, data)]
    whole = [sorted(map(str, make().collect())) for make in built]
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    for make, want in zip(built, whole, strict=True):
        df = make()
        assert sorted(map(str, df.collect())) == want
        dealt = re.findall(r"hashpartitioning\(([a-z_]+)#\d+L?(?:, paper_id#\d+L)?, \d+\), REPARTITION_BY_NUM",
                           df._jdf.queryExecution().optimizedPlan().toString() + plan_of(df))
        assert dealt.count("l_suppkey") >= 1 and len(set(dealt)) >= 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
