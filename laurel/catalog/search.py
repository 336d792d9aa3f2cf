"""Queries for filters, set operations, facets, pages and ranking (F-*, D-*, A-21 to A-23, W-*, J-16)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from laurel.catalog.factors import NORMALISED, factor_sql, normalised_papers, r6
from laurel.catalog.registry import AUTHOR_PAPER, INSTITUTIONS, RAWDATA, query, with_views
from laurel.operators import dedup, facets, ranking, search
from laurel.plans import driver_tables as D


def docs(spark, d):
    """Documents as records: first line as title, text as abstract, source as keyword."""
    return D.table(spark, d, "documents").select(
        F.col("lang").alias("key_id"), F.col("doc_id").alias("id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("abstract"),
        F.col("source").alias("paper_keyword"))


DOCS = """docs as (select lang as key_id, doc_id as id, split_part(text, chr(10), 1) as title, text as abstract,
 source as paper_keyword from documents)"""


@query("f01_keyword_filter_and", """
select doc_id from documents where contains(text, 'the') and contains(text, 'with') and not contains(text, 'only')""")
def f01(spark, d):
    docs_ = D.table(spark, d, "documents")
    return docs_.where(search.keyword_filter(F.col("text"), ["the", "with"], ["nothing"], ["only"])).select("doc_id")


@query("f01_keyword_filter_or", """
select doc_id from documents where (contains(text, 'und') or contains(text, 'que')) and not contains(text, 'the')""")
def f01_or(spark, d):
    docs_ = D.table(spark, d, "documents")
    return docs_.where(search.keyword_filter(F.col("text"), [], ["und", "que"], ["the"])).select("doc_id")


@query("f02_f03_every_and_no_term", with_views(DOCS) + """select id from docs
where (contains(lower(title), 'that') or contains(lower(abstract), 'that'))
 and (contains(lower(title), 'from') or contains(lower(abstract), 'from'))
 and not contains(title, 'With') and not contains(abstract, 'With')""")
def f02(spark, d):
    texts = [F.col("title"), F.col("abstract")]
    return docs(spark, d).where(search.every_term(texts, ["That", "FROM"]) & search.no_term(texts, ["With"])).select("id")


@query("f04_term_language_folding", """
with t as (select p_partkey, p_name || case when p_partkey % 3 = 0 then ' 연료전지 Cell' when p_partkey % 3 = 1
 then ' 연료 Cell' else ' CELL 연료전지' end as title from part)
select p_partkey from t where contains(title, '연료전지') and contains(lower(title), 'cell') and contains(lower(title), 'red')""")
def f04(spark, d):
    tail = F.when(F.col("p_partkey") % 3 == 0, " 연료전지 Cell").when(F.col("p_partkey") % 3 == 1, " 연료 Cell").otherwise(
        " CELL 연료전지")
    titled = D.table(spark, d, "part").select("p_partkey", F.concat("p_name", tail).alias("title"))
    return titled.where(search.every_term([F.col("title")], ["연료전지", "cELL", "Red"])).select("p_partkey")


TAK = "lower(concat_ws(' ', title, abstract, paper_keyword))"


@query("f05_title_abstract_keyword", with_views(DOCS) + f"""select id from docs
where contains({TAK}, 'the') and contains({TAK}, 'src1') and not contains({TAK}, 'only') and not contains({TAK}, 'src11')""")
def f05(spark, d):
    texts = [F.col("title"), F.col("abstract"), F.col("paper_keyword")]
    return docs(spark, d).where(
        search.title_abstract_keyword(texts, ["The", "and", "SRC1"], [], ["only", "src11"])).select("id")


@query("f06_topic_search", with_views(DOCS) + f"""select id from docs
where contains({TAK}, 'that') and contains({TAK}, 'from') and not contains({TAK}, 'which')""")
def f06(spark, d):
    texts = [F.col("title"), F.col("abstract"), F.col("paper_keyword")]
    return docs(spark, d).where(search.topic_search(texts, ["that", '"from"', "!which"])).select("id")


@query("f07_year_range", """select o_orderkey, year(o_orderdate) as issue_year from orders
where year(o_orderdate) between 1997 and 1999""")
def f07(spark, d):
    dated = D.table(spark, d, "orders").where(search.dated_within(F.col("o_orderdate"), 1997, 1999))
    return dated.select("o_orderkey", F.year("o_orderdate").alias("issue_year"))


@query("f07_year_range_of_records", with_views(RAWDATA) + """
select key_id, paper_id, issue_year from rawdata where issue_year between 1996 and 1998""")
def f07_records(spark, d):
    return D.records(spark, d).where(search.year_range(F.col("issue_year"), 1996, 1998)).select(
        "key_id", "paper_id", "issue_year")


@query("f08_country", with_views(AUTHOR_PAPER, INSTITUTIONS) + """
select key_id, paper_id from institutions where contains(author_inst, 'NATION_12')""")
def f08(spark, d):
    return D.author_institutions(spark, d).where(search.in_country(F.col("author_inst"), "NATION_12")).select(
        "key_id", "paper_id")


def cap_sql(cap):
    return f"""
with o as (select nullif(o_orderpriority, '5-LOW') as key_id, o_orderkey as id, o_orderdate from orders),
r as (select key_id, id, row_number() over (partition by key_id order by o_orderdate desc, id) as rn,
  count(*) over (partition by key_id) > {cap} as is_partial from o)
select key_id, id, is_partial from r where rn <= {cap}"""


def with_cap(cap):
    """One query has no id; its records are capped like the others'."""
    def run(spark, d):
        key = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
        rows = D.table(spark, d, "orders").select(key.alias("key_id"), F.col("o_orderkey").alias("id"), "o_orderdate")
        return search.capped(rows, ["key_id"], [("o_orderdate", True), ("id", False)], cap).select(
            "key_id", "id", "is_partial")
    return run


for name, cap in (("f09_result_cap", 1500), ("f09_large_cap", 100_000)):
    query(name, cap_sql(cap))(with_cap(cap))


@query("f10_known_author", """select o_orderkey from orders where o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0""")
def f10(spark, d):
    orders = D.table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 13 == 0, "No author id available").otherwise(F.col("o_custkey").cast("string"))
        .alias("author_id"),
        F.when(F.col("o_orderkey") % 11 == 0, "No author name available").otherwise(F.lit("Kim, J.")).alias("author"))
    return orders.where(search.known_author(F.col("author_id"), F.col("author"))).select("o_orderkey")


@query("f11_performing_agent", """select o_orderkey from orders where o_orderstatus is not null and o_orderkey % 5 = 3""")
def f11(spark, d):
    agent = F.struct(F.lpad((F.col("o_orderkey") % 5).cast("string"), 2, "0").alias("code"),
                     F.col("o_orderstatus").alias("value"))
    projects = D.table(spark, d, "orders").select("o_orderkey", agent.alias("perfAgent"))
    return projects.where(search.performed_by(F.col("perfAgent.code"))).select("o_orderkey")


@query("f12_has_author", """select o_orderkey from orders left join
 (select l_orderkey, min(l_suppkey) as author from lineitem group by 1) on l_orderkey = o_orderkey
 where author is not null""")
def f12(spark, d):
    first = D.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("author"))
    orders = D.table(spark, d, "orders")
    return orders.join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left").where(
        search.has_author(F.col("author"))).select("o_orderkey")


@query("f15_real_names", """select c_custkey, c_name as name from customer where c_custkey % 5 not in (0, 1, 2)""")
def f15(spark, d):
    spelled = (F.when(F.col("c_custkey") % 5 == 0, "없음").when(F.col("c_custkey") % 5 == 1, "null")
               .when(F.col("c_custkey") % 5 == 2, F.concat(F.left("c_name", F.lit(6)), F.lit("...")))
               .otherwise(F.col("c_name")))
    named = D.table(spark, d, "customer").select("c_custkey", spelled.alias("name"))
    return named.where(search.real_name(F.col("name")))


# ---- duplicates and sets ------------------------------------------------------------------------------------------------

COPIES = """copies as (select l_orderkey as key_id, l_linenumber as id, l_partkey, l_suppkey, l_shipdate, l_quantity,
 l_extendedprice from lineitem)"""


def copies(spark, d):
    return D.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("key_id"), F.col("l_linenumber").alias("id"), "l_partkey", "l_suppkey",
        "l_shipdate", "l_quantity", "l_extendedprice")


@query("d01_one_record_per_key", with_views(COPIES) + """
select * exclude (rn) from (select *, row_number() over (partition by key_id, id order by l_shipdate, l_partkey,
 l_suppkey, l_quantity, l_extendedprice) as rn from copies) where rn = 1""")
def d01(spark, d):
    return dedup.first_per_key(copies(spark, d), dedup.RECORD, ["l_shipdate"])


@query("d02_duplicate_counts", """
select l_returnflag, cast(sum(n) as bigint) as n_rows, count(*) as n_records, cast(sum(n) - count(*) as bigint) as n_duplicates
from (select l_returnflag, l_orderkey, l_linenumber, count(*) as n from lineitem group by all) group by 1""")
def d02(spark, d):
    return dedup.duplicate_counts(D.table(spark, d, "lineitem"), ["l_returnflag"], ["l_orderkey", "l_linenumber"])


@query("d03_union_of_field_searches", with_views(DOCS) + """
select distinct key_id, id, title from docs
where contains(lower(title), 'the') or contains(lower(paper_keyword), 'src7') or contains(lower(abstract), 'which')""")
def d03(spark, d):
    hits = [search.holds(F.col("title"), "the"), search.holds(F.col("paper_keyword"), "src7"),
            search.holds(F.col("abstract"), "which")]
    return dedup.union_of_searches(docs(spark, d), hits, dedup.RECORD, ["title"])


@query("d04_union_of_sets", """
select l_orderkey as id from lineitem where l_shipdate < timestamp '1996-01-01' union
select l_orderkey from lineitem where l_returnflag = 'R' union select l_orderkey from lineitem where l_quantity > 45""")
def d04(spark, d):
    lines = D.table(spark, d, "lineitem")
    sets = [lines.where(c).select(F.col("l_orderkey").alias("id")) for c in (
        F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp"), F.col("l_returnflag") == "R", F.col("l_quantity") > 45)]
    return dedup.union_of_sets(sets)


@query("d05_complement_parts", with_views(AUTHOR_PAPER, INSTITUTIONS) + """
select key_id, paper_id, 'NATION_2' as part from institutions where contains(author_inst, 'NATION_2') union all
select key_id, paper_id, 'NATION_15' from institutions where contains(author_inst, 'NATION_15') union all
select key_id, paper_id, 'other' from institutions
 where not contains(author_inst, 'NATION_2') and not contains(author_inst, 'NATION_15')""")
def d05(spark, d):
    insts = D.author_institutions(spark, d)
    return dedup.complement_parts(insts, F.col("author_inst"), ["NATION_2", "NATION_15"]).select(
        "key_id", "paper_id", "part")


@query("d06_distinct_authors", with_views(AUTHOR_PAPER) + "select distinct key_id, a_id from author_paper")
def d06(spark, d):
    return dedup.distinct_authors(D.author_paper(spark, d))


# ---- facets, batches ------------------------------------------------------------------------------------------------------

@query("a21_facet_counts", """
with o as (select cast(year(o_orderdate) as varchar) as y, o_orderstatus as s, o_orderpriority as p from orders)
select 'year' as facet, y as value, count(*) as n from o group by 2 union all
select 'status', s, count(*) from o group by 2 union all select 'priority', p, count(*) from o group by 2""")
def a21(spark, d):
    facet_table = D.table(spark, d, "orders").select(
        F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"))
    return facets.facet_counts(facet_table, ["year", "status", "priority"])


def hits_sql(term):
    return " + ".join(f"cast(contains(lower({f}), '{term}') as integer)" for f in ("title", "paper_keyword", "abstract"))


@query("a22_rarest_term", with_views(DOCS) + f""",
h as (select key_id, 'the' as term, 0 as pos, sum({hits_sql('the')}) as hits from docs group by 1 union all
 select key_id, 'src1', 1, sum({hits_sql('src1')}) from docs group by 1 union all
 select key_id, 'only', 2, sum({hits_sql('only')}) from docs group by 1)
select key_id, term, cast(hits as bigint) as hits from
 (select *, row_number() over (partition by key_id order by hits, pos) as rn from h) where rn = 1""")
def a22(spark, d):
    return search.rarest_term(docs(spark, d), ["key_id"], ["title", "paper_keyword", "abstract"], ["the", "src1", "only"])


@query("w03_author_pages", with_views(AUTHOR_PAPER) + """
select key_id, a_id, cast((row_number() over (partition by key_id order by a_id) - 1) // 7 as bigint) as page
from (select distinct key_id, a_id from author_paper)""")
def w03(spark, d):
    return ranking.paged(dedup.distinct_authors(D.author_paper(spark, d)), ["key_id"], [F.col("a_id")], 7)


@query("w04_sorted_facet", """
with c as (select l_returnflag, l_suppkey as value, count(*) as n from lineitem group by 1, 2)
select *, row_number() over (partition by l_returnflag order by n desc, value) as from_largest,
 row_number() over (partition by l_returnflag order by n, value) as from_smallest from c""")
def w04(spark, d):
    counts = D.table(spark, d, "lineitem").groupBy("l_returnflag", F.col("l_suppkey").alias("value")).agg(
        F.count("*").alias("n"))
    return facets.sorted_facet(counts, ["l_returnflag"], "value")


@query("w05_packed_batches", """
with recursive c as (select l_partkey as value, count(*) as n from lineitem group by 1),
s as (select *, row_number() over (order by n, value) as rn from c where n <= 120),
fold as (select value, n, rn, 0 as batch, n as load from s where rn = 1 union all
 select s.value, s.n, s.rn, case when fold.load + s.n > 120 then fold.batch + 1 else fold.batch end,
  case when fold.load + s.n > 120 then s.n else fold.load + s.n end from fold join s on s.rn = fold.rn + 1)
select c.value, c.n, cast(batch as bigint) as batch from c left join fold on fold.value = c.value""")
def w05(spark, d):
    counts = D.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("value")).agg(F.count("*").alias("n"))
    return facets.packed(counts, "value", 120)


@query("w06_largest_excluded", """
with c as (select l_linestatus as key_id, l_suppkey as value, count(*) as n from lineitem group by 1, 2),
r as (select *, sum(n) over (partition by key_id order by n desc, value) as running,
 sum(n) over (partition by key_id) as total from c)
select key_id, value, n, total - (running - n) > 2000 as excluded from r""")
def w06(spark, d):
    counts = D.table(spark, d, "lineitem").groupBy(
        F.col("l_linestatus").alias("key_id"), F.col("l_suppkey").alias("value")).agg(F.count("*").alias("n"))
    return facets.largest_excluded(counts, ["key_id"], "value", 2000)


@query("w07_fixed_batches", """
with r as (select o_orderpriority as key_id, o_orderkey as id,
 row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) - 1 as rn from orders)
select key_id, id, rn // 1000 as list_no, rn % 1000 // 50 as batch_no from r""")
def w07(spark, d):
    rows = D.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("key_id"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return facets.fixed_batches(rows, ["key_id"], [F.col("o_orderdate"), F.col("id")], 50, 1000).drop("o_orderdate")


@query("w08_newest_set_first", """
select key_id, issue_year, n, row_number() over (partition by key_id order by issue_year desc) as place from
 (select o_orderpriority as key_id, year(o_orderdate) as issue_year, count(*) as n from orders group by 1, 2)""")
def w08(spark, d):
    sets = D.table(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("key_id"), F.year("o_orderdate").alias("issue_year")).agg(F.count("*").alias("n"))
    newest = F.row_number().over(Window.partitionBy("key_id").orderBy(F.col("issue_year").desc()))
    return sets.withColumn("place", newest).orderBy("key_id", F.col("issue_year").desc())


# ---- ranking ----------------------------------------------------------------------------------------------------------------

WEIGHTS = {"productivity": 3, "contrib": 2, "durability": 1, "recentness": 2, "coop": 1, "quality": 3, "acc": 4}
SCORED = factor_sql() + f""", normalised as (select {NORMALISED} from ungated join tops using (key_id)),
weighted as (select key_id, a_id, round({' + '.join(f'{f} * {w}' for f, w in WEIGHTS.items())}, 6) as score
 from normalised)
"""


def scores(spark, d):
    """Normalised factors, rounded, so that equal scores tie in every engine."""
    df = normalised_papers(spark, d)
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("w09_top_experts", SCORED + """select key_id, a_id, score, rank from
 (select *, rank() over (partition by key_id order by score desc) as rank from weighted) where rank <= 10""")
def w09(spark, d):
    return ranking.top_experts(scores(spark, d), WEIGHTS, 10).select("key_id", "a_id", "score", "rank")


TIED = """with s as (select l_returnflag as key_id, l_orderkey as a_id, round(max(l_quantity) * 2, 6) as score
 from lineitem group by 1, 2) """


@query("w09_wide_tied_ranking", TIED + """select * from (select *, rank() over (partition by key_id order by score desc) as rank from s)
where rank <= 1001""")
def w09_wide(spark, d):
    """More experts than Spark prunes for, and very many equal scores: all of one score are kept."""
    rows = D.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("key_id"), F.col("l_orderkey").alias("a_id")).agg(
        F.max("l_quantity").alias("quality"))
    return ranking.top_experts(rows, {"quality": 2}, 1001).select("key_id", "a_id", "score", "rank")


@query("w09_complete_ranking", SCORED + """select key_id, a_id, score,
 row_number() over (partition by key_id order by score desc, a_id) as place from weighted""")
def w09_all(spark, d):
    return ranking.all_ranked(scores(spark, d), WEIGHTS).select("key_id", "a_id", "score", "place")


@query("j16_relations_of_top_experts", SCORED + """, leaders as (select key_id, a_id from
 (select *, rank() over (partition by key_id order by score desc) as rank from weighted) where rank <= 3)
select b.key_id, b.a_id, o.a_id as co_a_id, count(*) as n_papers
from leaders b join author_paper p on p.key_id = b.key_id and p.a_id = b.a_id
join author_paper o on o.key_id = p.key_id and o.paper_id = p.paper_id and o.a_id <> p.a_id group by 1, 2, 3""")
def j16(spark, d):
    best = ranking.top_experts(scores(spark, d), WEIGHTS, 3)
    return ranking.relations(best, D.author_paper(spark, d))
