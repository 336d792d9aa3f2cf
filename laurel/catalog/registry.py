"""Registered queries: name -> (Spark function, equal DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
ENTRIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = (fn, sql)
        return fn

    return add


# The driver tables as views, in SQL. Same reading as laurel.plans.driver_tables.
AUTHOR_PAPER = """author_paper as (
 select o_orderpriority as key_id, l_suppkey as a_id, l_orderkey as paper_id,
  row_number() over (partition by l_orderkey order by min(l_linenumber), l_suppkey) - 1 as pos,
  count(*) over (partition by l_orderkey) as n_authors
 from lineitem join orders on l_orderkey = o_orderkey
 group by o_orderpriority, l_suppkey, l_orderkey)"""

RAWDATA = """rawdata as (
 select o.o_orderpriority as key_id, o.o_orderkey as paper_id, year(o.o_orderdate) as issue_year,
  case when o.o_orderkey % 4 = 0 then 'kor' else 'eng' end as issue_lang,
  cast(floor(o.o_totalprice) as bigint) % 50 as citation,
  cast(floor(o.o_totalprice) as bigint) % 7 as usage_count,
  p.p_brand as issue_inst, p.p_name as title, p.p_type as paper_keyword
 from orders o
 left join (select l_orderkey, min(l_partkey) as partkey from lineitem group by l_orderkey) f
   on f.l_orderkey = o.o_orderkey
 left join part p on p.p_partkey = f.partkey)"""

IMPACT = """impact as (
 select case when p_size <= 25 then 'kor' else 'eng' end as lang, p_brand as name,
  round(avg(p_retailprice) / 1000, 3) as jif
 from part where p_brand not in ('Brand#3', 'Brand#13', 'Brand#23') group by 1, 2)"""

INSTITUTIONS = """institutions as (
 select key_id, paper_id, string_agg(cast(a_id as varchar), ';' order by pos) as author_id,
  string_agg(s_name, ';' order by pos) as author, string_agg(n_name, ';' order by pos) as author_inst
 from author_paper join supplier on s_suppkey = a_id join nation on n_nationkey = s_nationkey
 group by key_id, paper_id)"""

PROJECTS = """projects as (
 select o_orderpriority as key_id, o_orderkey as paper_id, cast(a_id as varchar) as manager_id,
  cast(cast(floor(o_totalprice) as bigint) as varchar) as total_fund,
  case when o_orderkey % 10 = 0 then 'null' else strftime(o_orderdate, '%Y-%m-%d') end as prd_end,
  case when o_orderkey % 20 = 0 then 'null' else strftime(o_orderdate, '%Y-%m-%d') end as prd_start
 from orders left join (select paper_id, a_id from author_paper where pos = 0) l on l.paper_id = o_orderkey)"""


def with_views(*views: str) -> str:
    return "with " + ",\n".join(views) + "\n"
