"""Queries for the factor operators (A-*, J-10 to J-12, F-13, F-14, X-20, U-01)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from laurel.catalog.registry import (AUTHOR_PAPER, IMPACT, INSTITUTIONS, PROJECTS, RAWDATA, query, with_views)
from laurel.functions import text as X
from laurel.functions.vectors import cosine
from laurel.operators import factors as A
from laurel.operators.relevance import usable, with_relevance
from laurel.plans import driver_tables as D
from laurel.plans.scoring import scored, ungated_factors

AS_OF = 2001
LIST_SIZE = 50
PARTNERS = ["NATION_1", "NATION_7"]
QUERY_TEXT = {"1-URGENT": "red widget", "2-HIGH": "small|ring !gizmo", "3-MEDIUM": "anvil",
              "4-NOT SPECIFIED": "hot hot rod", "5-LOW": "zeppelin"}


def r6(c):
    return F.round(c, 6)


def query_table(spark, texts):
    """Few rows known to the driver: an Arrow table becomes a local relation, whose size Catalyst knows."""
    return spark.createDataFrame(pa.table({"key_id": list(texts), "query": list(texts.values())}))


def recent_sql(as_of):
    return (f"sum(case when issue_year >= {as_of - 2} then 100 when issue_year > {as_of - 15} "
            f"then greatest(100 - ({as_of - 3} - issue_year) * 10, 0) else 0 end) / (100 * count(*))")


POINTS = "case when pos = 0 then 1.0 when pos = n_authors - 1 then 3.0 else (pos + 1) / n_authors end"
QUALITY = "ln((citation * case when issue_lang = 'kor' then 1 else 3 end + 1) * (coalesce(jif, 0) + 1.1))"
USAGE = QUALITY + " + ln(case when usage_count = 0 then 1 else usage_count end)"
JOURNAL = """left join impact i on i.name = r.issue_inst
  and i.lang = case when r.issue_lang = 'kor' then 'kor' else 'eng' end"""


def paper_rows(spark, d):
    """Author rows with the records they were found in."""
    return D.author_paper(spark, d).join(D.records(spark, d), ["key_id", "paper_id"])


def customer_papers(spark, d):
    """Customers as authors: their years have gaps, unlike those of the suppliers."""
    return D.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("key_id"), F.col("o_custkey").alias("a_id"),
        F.year("o_orderdate").alias("year"))


@query("a01_author_paper_list", with_views(AUTHOR_PAPER) + f"""
, listed as (select *, row_number() over (partition by key_id, a_id order by o_orderdate, paper_id) as rn
 from author_paper join orders on o_orderkey = paper_id)
select key_id, a_id, cast((rn - 1) // {LIST_SIZE} as bigint) as part, count(*) as n_papers,
 string_agg(cast(paper_id as varchar), ';' order by rn) as papers
from listed group by 1, 2, 3""")
def a01(spark, d):
    """Records arrive by order date."""
    arrival = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderdate").alias("seq"))
    lists = A.paper_lists(D.author_paper(spark, d).join(arrival, "paper_id"), LIST_SIZE)
    return lists.withColumn("papers", F.array_join(F.col("papers").cast("array<string>"), ";"))


@query("a02_productivity", with_views(AUTHOR_PAPER) + """
select key_id, a_id, count(*) as productivity from author_paper group by 1, 2""")
def a02(spark, d):
    return D.author_paper(spark, d).groupBy("key_id", "a_id").agg(F.count("*").alias("productivity"))


def recentness(as_of):
    def run(spark, d):
        points = F.sum(A.recency_points(F.col("issue_year"), as_of))
        return paper_rows(spark, d).groupBy("key_id", "a_id").agg(
            r6(A.recentness(points, F.count("*"))).alias("recentness"))

    return run


for year in (2001, 2010):
    query("a03_recentness" + ("" if year == AS_OF else f"_{year}"), with_views(AUTHOR_PAPER, RAWDATA) + f"""
select key_id, a_id, round({recent_sql(year)}, 6) as recentness
from author_paper join rawdata using (key_id, paper_id) group by 1, 2""")(recentness(year))


@query("a04_career", """
select o_orderpriority as key_id, o_custkey as a_id, max(year(o_orderdate)) - min(year(o_orderdate)) + 1 as career
from orders group by 1, 2""")
def a04(spark, d):
    return customer_papers(spark, d).groupBy("key_id", "a_id").agg(
        (F.max("year") - F.min("year") + 1).alias("career"))


RUNS = """with years as (select distinct o_orderpriority as key_id, o_custkey as a_id, year(o_orderdate) as y from orders),
islands as (select *, y - row_number() over (partition by key_id, a_id order by y) as island from years),
runs as (select key_id, a_id, island, count(*) as n from islands group by 1, 2, 3)"""


@query("a05_w01_longest_run", RUNS + " select key_id, a_id, max(n) as run from runs group by 1, 2")
def a05(spark, d):
    return A.longest_run(customer_papers(spark, d).distinct())


@query("a06_durability", RUNS + """, best as (select key_id, a_id, max(n) as run from runs group by 1, 2),
span as (select key_id, a_id, max(y) - min(y) + 1 as career from years group by 1, 2)
select key_id, a_id, round(run / career, 6) as durability from best join span using (key_id, a_id)""")
def a06(spark, d):
    years = customer_papers(spark, d).distinct()
    span = years.groupBy("key_id", "a_id").agg((F.max("year") - F.min("year") + 1).alias("career"))
    return A.longest_run(years).join(span, ["key_id", "a_id"]).select(
        "key_id", "a_id", r6(F.col("run") / F.col("career")).alias("durability"))


@query("a07_contrib_papers", with_views(AUTHOR_PAPER) + f"""
select key_id, a_id, round(sum({POINTS}), 6) as contrib from author_paper group by 1, 2""")
def a07(spark, d):
    return D.author_paper(spark, d).groupBy("key_id", "a_id").agg(r6(F.sum(A.position_points())).alias("contrib"))


PROJECT_POINTS = """points as (
 select p.key_id, a.a_id, count(*) filter (where manager_id = cast(a.a_id as varchar)) as managed,
  count(*) filter (where manager_id <> cast(a.a_id as varchar)) as assisted
 from author_paper a join projects p using (key_id, paper_id) group by 1, 2)"""


def project_yearly(spark, d):
    projects = D.projects(spark, d).withColumn(
        "issue_year", X.year_of(X.fold_null(F.col("prd_end")), X.fold_null(F.col("prd_start"))))
    values = A.record_values(projects, A.project_profile())
    return A.yearly_sums(A.author_records(D.author_paper(spark, d), values, True, D.tasks(spark, d)))


@query("a08_a09_contrib_projects", with_views(AUTHOR_PAPER, PROJECTS, PROJECT_POINTS) + """
select key_id, a_id, cast(case when managed > 0 then managed * 10 + assisted else 0 end as double) as contrib,
 case when managed > 0 then 1 else 0 end as contrib_bit from points""")
def a08(spark, d):
    raw = A.raw_factors(project_yearly(spark, d), AS_OF, by_manager=True)
    return raw.select("key_id", "a_id", "contrib", A.contribution_bit(F.col("contrib")).alias("contrib_bit"))


def quality(profile):
    def run(spark, d):
        values = A.with_impact(D.records(spark, d), D.impact(spark, d)).select(
            "key_id", "paper_id", profile().alias("quality"))
        return D.author_paper(spark, d).join(values, ["key_id", "paper_id"]).groupBy("key_id", "a_id").agg(
            r6(F.sum("quality")).alias("quality"))

    return run


for name, spark_form, sql_form in (("a10_quality_papers", A.paper_quality, QUALITY),
                                   ("a11_quality_usage", A.paper_quality_with_usage, USAGE)):
    query(name, with_views(AUTHOR_PAPER, RAWDATA, IMPACT) + f"""
select r.key_id, a.a_id, round(sum({sql_form}), 6) as quality
from author_paper a join rawdata r using (key_id, paper_id) {JOURNAL} group by 1, 2""")(quality(spark_form))


@query("a12_quality_projects", with_views(AUTHOR_PAPER, PROJECTS) + """
select p.key_id, a.a_id, round(sum(ln(cast(total_fund as bigint) + 1)), 6) as quality
from author_paper a join projects p using (key_id, paper_id) group by 1, 2""")
def a12(spark, d):
    raw = A.raw_factors(project_yearly(spark, d), AS_OF, by_manager=True)
    return raw.select("key_id", "a_id", r6("quality").alias("quality"))


COOP_SQL = " or ".join(f"contains(author_inst, '{p}')" for p in PARTNERS)


@query("a13_coop_papers", with_views(AUTHOR_PAPER, INSTITUTIONS) + f"""
select a.key_id, a.a_id, cast(sum(case when {COOP_SQL} then 1 else 0 end) as bigint) as coop
from author_paper a join institutions using (key_id, paper_id) group by 1, 2""")
def a13(spark, d):
    hits = D.author_institutions(spark, d, ["author_inst"]).select(
        "key_id", "paper_id", A.partner_hit(F.col("author_inst"), PARTNERS).alias("hit"))
    return D.author_paper(spark, d).join(hits, ["key_id", "paper_id"]).groupBy("key_id", "a_id").agg(
        F.sum("hit").alias("coop"))


# ---- relevance ------------------------------------------------------------------------------------------------------

DOC_QUERIES = {"en": "that with from", "de": "und der|die !das", "fr": "les les une", "es": "qqqq"}
TOKENS = r"[\p{L}\p{N}_]{2,}"


def relevance_sql(texts: str, queries: dict[str, str]) -> str:
    """CTE `scored` (key_id, paper_id, relevance) from a CTE `texts` (key_id, paper_id, text)."""
    values = ", ".join(f"('{k}', '{v}')" for k, v in queries.items())
    return f"""{texts},
queries as (select key_id, regexp_replace(q, '[|!]', '', 'g') as q from (values {values}) v(key_id, q)),
vocabulary as (select distinct key_id, unnest(regexp_extract_all(lower(q), '{TOKENS}')) as word from queries),
sizes as (select key_id, (select count(*) from vocabulary v where v.key_id = queries.key_id) as n,
  len(list_filter(string_split_regex(trim(q), '\\s+'), lambda w: length(w) >= 2)) as n_words from queries),
clean as (select key_id, paper_id, row_number() over () as text_id, text from texts
  where text is not null and text not in ('', 'None')),
tokens as (select key_id, paper_id, text_id, unnest(regexp_extract_all(lower(text), '{TOKENS}')) as word from clean),
tf as (select key_id, paper_id, text_id, word, count(*) as n from tokens semi join vocabulary using (key_id, word)
  group by all),
directions as (select key_id, paper_id, text_id, sum(n) / sqrt(sum(n * n)) as d from tf group by all),
best as (select key_id, paper_id, max(d) as d from directions group by all),
scored as (select t.key_id, t.paper_id,
  case when d is null then 0.02 when n <> n_words then 1 else d / sqrt(n) end as relevance
  from (select distinct key_id, paper_id from texts) t join sizes using (key_id)
  left join best using (key_id, paper_id))"""


DOC_TEXTS = "with texts as (select lang as key_id, doc_id as paper_id, text from documents)"


@query("a15_f13_f14_acc_documents", relevance_sql(DOC_TEXTS, DOC_QUERIES) + """
select key_id, source as a_id, round(max(relevance), 6) as acc
from scored join documents on doc_id = paper_id group by 1, 2""")
def a15(spark, d):
    docs = D.table(spark, d, "documents").withColumnRenamed("lang", "key_id")
    rated = with_relevance(docs, query_table(spark, DOC_QUERIES), ["text"])
    return rated.groupBy("key_id", F.col("source").alias("a_id")).agg(
        r6(F.max("relevance")).alias("acc"))


@query("a15_acc_records", relevance_sql("with " + RAWDATA + """, texts as (
 select key_id, paper_id, title as text from rawdata union all select key_id, paper_id, paper_keyword from rawdata)""",
                                        QUERY_TEXT) + """
select key_id, paper_id, round(relevance, 6) as relevance from scored""")
def a15_records(spark, d):
    rated = with_relevance(D.records(spark, d), query_table(spark, QUERY_TEXT), ["title", "paper_keyword"])
    return rated.select("key_id", "paper_id", r6("relevance").alias("relevance"))


@query("f13_usable_texts", """
with t as (select doc_id, unnest(string_split(text, chr(10))) as text from documents)
select doc_id, count(*) as n_texts, sum(length(text)) as n_chars
from t where text is not null and text not in ('', 'None') group by 1""")
def f13(spark, d):
    lines = D.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return lines.where(usable(F.col("text"))).groupBy("doc_id").agg(
        F.count("*").alias("n_texts"), F.sum(F.length("text")).alias("n_chars"))


@query("f14_query_cleaning", "select page_id, md5(regexp_replace(html, '[|!]', '', 'g')) as cleaned from pages")
def f14(spark, d):
    return D.table(spark, d, "pages").select("page_id", F.md5(X.clean_query(F.col("html"))).alias("cleaned"))


@query("x20_cosine", """
select vec_id, round(list_sum(list_transform(embedding, lambda x: cast(x as double)))
 / (sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) * sqrt(len(embedding))), 6)
 as cosine from embeddings""")
def x20(spark, d):
    """Against the all-ones vector, as the relevance score does."""
    ones = F.transform("embedding", lambda _: F.lit(1.0))
    return D.table(spark, d, "embeddings").select("vec_id", r6(cosine(F.col("embedding"), ones)).alias("cosine"))


# ---- the whole factor row -------------------------------------------------------------------------------------------

def factor_sql(by_usage: bool = False) -> str:
    """CTEs up to `ungated` for papers."""
    texts = "with " + ",\n".join([AUTHOR_PAPER, RAWDATA, IMPACT, INSTITUTIONS]) + """, texts as (
 select key_id, paper_id, title as text from rawdata union all select key_id, paper_id, paper_keyword from rawdata)"""
    return relevance_sql(texts, QUERY_TEXT) + f""",
joined as (select a.*, r.issue_year, {USAGE if by_usage else QUALITY} as q,
  case when {COOP_SQL} then 1 else 0 end as hit, relevance
 from author_paper a join rawdata r using (key_id, paper_id) {JOURNAL}
 left join institutions n using (key_id, paper_id) left join scored s using (key_id, paper_id)),
years as (select distinct key_id, a_id, issue_year as y from joined),
islands as (select *, y - row_number() over (partition by key_id, a_id order by y) as island from years),
runs as (select key_id, a_id, max(n) as run from
  (select key_id, a_id, island, count(*) as n from islands group by 1, 2, 3) group by 1, 2),
sums as (select key_id, a_id, count(*) as productivity, sum({POINTS}) as contrib,
  {recent_sql(AS_OF)} as recentness, max(issue_year) - min(issue_year) + 1 as career,
  cast(sum(hit) as bigint) as coop, sum(q) as quality, max(relevance) as relevance from joined group by 1, 2),
ungated as (select s.*, run / career as durability, case when contrib > 0 then 1 else 0 end as bit
  from sums s join runs using (key_id, a_id)),
tops as (select key_id, max(quality) as max_quality, max(productivity) as max_productivity,
  max(contrib) as max_contrib, case when max(coop) = 0 then 1 else max(coop) end as max_coop from ungated group by 1)
"""


def paper_factors(spark, d, usage=False):
    profile = A.usage_profile(PARTNERS) if usage else A.paper_profile(PARTNERS)
    records = D.records(spark, d, ["author_inst"])
    return ungated_factors(D.author_paper(spark, d), records, profile, AS_OF, D.impact(spark, d),
                           query_table(spark, QUERY_TEXT), tasks=D.tasks(spark, d))


def rounded(df):
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


GATED = """key_id, a_id, productivity * bit as productivity, round(contrib, 6) as contrib,
 round(durability * bit, 6) as durability, round(recentness * bit, 6) as recentness, coop * bit as coop,
 round(quality * bit, 6) as quality, round(case when bit = 0 then 0 else relevance end, 6) as acc,
 productivity as numpaper"""


@query("a16_expert_factors", factor_sql() + f"select {GATED} from ungated")
def a16(spark, d):
    return rounded(A.gated(paper_factors(spark, d)))


@query("a17_query_maxima", factor_sql() + """select key_id, round(max_quality, 6) as max_quality, max_productivity,
 round(max_contrib, 6) as max_contrib, max_coop from tops""")
def a17(spark, d):
    return rounded(A.maxima(paper_factors(spark, d)))


NORMALISED = """key_id, a_id, round(productivity * bit / max_productivity, 6) as productivity,
 round(contrib / max_contrib, 6) as contrib, round(durability * bit, 6) as durability,
 round(recentness * bit, 6) as recentness, round(coop * bit / max_coop, 6) as coop,
 round(quality * bit / max_quality, 6) as quality,
 round(case when bit = 0 then 0 else relevance end, 6) as acc, productivity as numpaper"""


def normalised_papers(spark, d, usage=False):
    return scored(paper_factors(spark, d, usage))


@query("a18_w02_expert_scores", factor_sql() + f"select {NORMALISED} from ungated join tops using (key_id)")
def a18(spark, d):
    return rounded(normalised_papers(spark, d))


@query("u01_usage_profile_scores", factor_sql(True) + f"select {NORMALISED} from ungated join tops using (key_id)")
def u01(spark, d):
    return rounded(normalised_papers(spark, d, usage=True))


PROJECT_SCORES = f"""
joined as (select p.key_id, a.a_id, manager_id, ln(cast(total_fund as bigint) + 1) as q,
  coalesce(try_cast(nullif(left(prd_end, 4), 'null') as integer),
    try_cast(nullif(left(prd_start, 4), 'null') as integer), 2000) as issue_year
 from author_paper a join projects p using (key_id, paper_id)),
years as (select distinct key_id, a_id, issue_year as y from joined),
islands as (select *, y - row_number() over (partition by key_id, a_id order by y) as island from years),
runs as (select key_id, a_id, max(n) as run from
  (select key_id, a_id, island, count(*) as n from islands group by 1, 2, 3) group by 1, 2),
counted as (select key_id, a_id, count(*) as productivity, sum(q) as quality,
  {recent_sql(AS_OF)} as recentness, max(issue_year) - min(issue_year) + 1 as career,
  count(*) filter (where manager_id = cast(a_id as varchar)) as managed,
  count(*) filter (where manager_id <> cast(a_id as varchar)) as assisted from joined group by 1, 2),
ungated as (select c.*, run / career as durability, case when managed > 0 then 1 else 0 end as bit,
  cast(case when managed > 0 then managed * 10 + assisted else 0 end as double) as contrib
  from counted c join runs using (key_id, a_id)),
tops as (select key_id, max(quality) as mq, max(productivity) as mp, max(contrib) as mc from ungated group by 1)
select key_id, a_id, round(productivity * bit / mp, 6) as productivity,
 round(coalesce(contrib / nullif(mc, 0), 0), 6) as contrib, round(durability * bit, 6) as durability,
 round(recentness * bit, 6) as recentness, 0 as coop, round(quality * bit / mq, 6) as quality,
 case when bit = 0 then 0 else 0.02 end as acc, productivity as numpaper
from ungated join tops using (key_id)"""


@query("a14_a18_project_scores", with_views(AUTHOR_PAPER, PROJECTS) + "," + PROJECT_SCORES)
def a14(spark, d):
    raw = A.raw_factors(project_yearly(spark, d), AS_OF, by_manager=True)
    return rounded(scored(raw, with_coop=False))


@query("a19_query_counts", with_views(AUTHOR_PAPER, RAWDATA) + """
select key_id, data, coalesce(experts, 0) as experts from (select key_id, count(*) as data from rawdata group by 1)
left join (select key_id, count(distinct a_id) as experts from author_paper group by 1) using (key_id)""")
def a19(spark, d):
    return A.query_counts(D.records(spark, d), D.author_paper(spark, d))


@query("a20_min_max_scaling", """
with ends as (select s_nationkey, min(s_acctbal) as lo, max(s_acctbal) as hi from supplier group by 1)
select s_suppkey, round(case when s_acctbal = lo then 0.02 else (s_acctbal - lo) / (hi - lo) end, 6) as scaled
from supplier join ends using (s_nationkey)""")
def a20(spark, d):
    rows = A.min_max_scaled(D.table(spark, d, "supplier"), ["s_nationkey"], "s_acctbal", "scaled")
    return rows.select("s_suppkey", r6("scaled").alias("scaled"))


# ---- lookups behind the factors ---------------------------------------------------------------------------------------

@query("j10_s10_impact_factor", with_views(RAWDATA, IMPACT) + f"""
select key_id, paper_id, coalesce(jif, 0) as jif from rawdata r {JOURNAL}""")
def j10(spark, d):
    return A.with_impact(D.records(spark, d), D.impact(spark, d)).select("key_id", "paper_id", "jif")


@query("j11_author_records", with_views(AUTHOR_PAPER, RAWDATA) + """
select key_id, a_id, paper_id, issue_year, title from author_paper join rawdata using (key_id, paper_id)""")
def j11(spark, d):
    return paper_rows(spark, d).select("key_id", "a_id", "paper_id", "issue_year", "title")


@query("j12_authors_with_records", """
select distinct o_orderpriority as key_id, o_custkey as a_id from orders where year(o_orderdate) = 2001""")
def j12(spark, d):
    """Authors of any year against records of 2001: those without a record are dropped."""
    orders = D.table(spark, d, "orders")
    listed = orders.select(F.col("o_orderpriority").alias("key_id"), F.col("o_custkey").alias("a_id"),
                           F.col("o_orderkey").alias("paper_id"))
    recent = orders.where(F.year("o_orderdate") == 2001).select(
        F.col("o_orderpriority").alias("key_id"), F.col("o_orderkey").alias("paper_id"))
    return listed.join(recent, ["key_id", "paper_id"], "left_semi").select("key_id", "a_id").distinct()
