"""Queries for author resolution and id matching (J-01 to J-09, J-13 to J-15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from laurel.catalog.registry import AUTHOR_PAPER, query, with_views
from laurel.catalog.scalars import PEOPLE
from laurel.operators import authors as J
from laurel.operators.identifiers import with_aligned_ids, with_best_author
from laurel.plans import driver_tables as D

STORED = """stored as (select cast(c_custkey as varchar) as a_id, c_name as name, n_name as inst
 from customer join nation on c_nationkey = n_nationkey where c_custkey % 3 <> 0)"""
REFS = """refs as (select o_orderkey as seq, cast(o_custkey as varchar) as a_id, c_name as name,
 case when o_orderkey % 5 = 0 then 'New ' || n_name else n_name end as inst
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def customers(spark, d):
    people = D.table(spark, d, "customer").join(
        D.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return people.select(F.col("c_custkey").cast("string").alias("a_id"), F.col("c_name").alias("name"),
                         F.col("n_name").alias("inst"))


def stored(spark, d):
    return customers(spark, d).where(F.col("a_id").cast("long") % 3 != 0)


def refs(spark, d):
    """One mention of an author per order; every fifth with a changed institution."""
    orders = D.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("a_id"))
    moved = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("New "), F.col("inst"))).otherwise(F.col("inst"))
    return orders.join(customers(spark, d), "a_id").select("seq", "a_id", "name", moved.alias("inst"))


@query("j01_author_by_name_inst", with_views(STORED, REFS) + """
select seq, r.name, r.inst, s.a_id from refs r left join stored s on s.name = r.name and s.inst = r.inst""")
def j01(spark, d):
    return J.by_name_inst(refs(spark, d).drop("a_id"), stored(spark, d)).select("seq", "name", "inst", "a_id")


@query("j02_author_by_id", with_views(STORED, REFS) + """
select seq, a_id, s.name as known_name, s.inst as known_inst from refs left join stored s using (a_id)""")
def j02(spark, d):
    return J.by_id(refs(spark, d), stored(spark, d)).select("seq", "a_id", "known_name", "known_inst")


@query("j03_new_author_ids", with_views(STORED, REFS) + """
select distinct 's' || substr(md5(r.name || chr(1) || r.inst), 1, 16) as a_id, r.name, r.inst
from refs r anti join stored s on s.name = r.name and s.inst = r.inst""")
def j03(spark, d):
    return J.new_authors(refs(spark, d), stored(spark, d))


@query("j04_authors_to_insert", with_views(STORED, REFS) + """
select a_id, name, inst from (select *, row_number() over (partition by a_id order by seq) as rn from refs)
where rn = 1 and a_id not in (select a_id from stored)""")
def j04(spark, d):
    return J.missing_authors(refs(spark, d), stored(spark, d))


@query("j05_latest_institution", with_views(STORED, REFS) + """
select s.a_id, s.name, coalesce(r.inst, s.inst) as inst from stored s left join
 (select a_id, inst, row_number() over (partition by a_id order by seq desc) as rn from refs) r
 on r.a_id = s.a_id and r.rn = 1""")
def j05(spark, d):
    return J.with_latest_inst(stored(spark, d), refs(spark, d))


SUPPLIERS = """known as (select cast(s_suppkey as varchar) as a_id, s_name as name, n_name as inst
 from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 2 = 0)"""


def suppliers(spark, d):
    people = D.table(spark, d, "supplier").join(
        D.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return people.where(F.col("s_suppkey") % 2 == 0).select(
        F.col("s_suppkey").cast("string").alias("a_id"), F.col("s_name").alias("name"), F.col("n_name").alias("inst"))


def project_messages(spark, d):
    """Projects as sent: marked-up agency, prefixed and quoted ids, missing ids spelled in several ways."""
    base = D.author_institutions(spark, d)
    n = F.col("paper_id")
    first = lambda c: F.split_part(c, F.lit(";"), F.lit(1))
    quoted = F.transform(F.split("author_id", ";"), lambda a: F.when(a.cast("long") % 5 == 0, F.lit("없음")).otherwise(
        F.concat(F.lit('"007.'), a, F.lit('"'))))
    return base.select(
        "key_id", F.col("paper_id").alias("id"), first("author").alias("mng"),
        F.when(n % 3 == 0, "null").when(n % 3 == 1, F.concat(F.lit("007."), first("author_id"))).alias("mngId"),
        F.concat(F.lit('"'), F.replace("author", F.lit(";"), F.lit('";"')), F.lit('"')).alias("rsc"),
        F.array_join(quoted, ";").alias("rscId"),
        F.concat(F.lit("Lab <span class=\\search_word\\>"), first("author_inst"), F.lit("</span>")).alias("ldAgency"),
        F.struct(F.when(n % 4 == 0, "09").otherwise("03").alias("code"), F.lit("University").alias("value"))
        .alias("perfAgent"))


def labs(known):
    """Known authors work in the lab of their nation."""
    return known.withColumn("inst", F.concat(F.lit("Lab"), F.col("inst")))


@query("j06_project_managers", with_views(AUTHOR_PAPER, PEOPLE, SUPPLIERS) + """
select key_id, p.paper_id as id, p.name, 'Lab' || p.inst as inst,
 case when p.paper_id % 3 = 1 then cast(p.a_id as varchar) else coalesce(k.a_id,
  's' || substr(md5(p.name || chr(1) || 'Lab' || p.inst), 1, 16)) end as a_id
from people p left join known k on k.name = p.name and k.inst = p.inst where pos = 0 and p.paper_id % 4 <> 0""")
def j06(spark, d):
    return J.project_managers(project_messages(spark, d), labs(suppliers(spark, d)))


@query("j07_project_researchers", with_views(AUTHOR_PAPER, PEOPLE, SUPPLIERS) + """
, lead as (select paper_id, 'Lab' || inst as lead from people where pos = 0)
select key_id, p.paper_id as id, pos, cast(p.a_id as varchar) as a_id, p.name,
 case when k.a_id is not null then 'Lab' || k.inst else lead end as inst
from people p join lead using (paper_id) left join known k on k.a_id = cast(p.a_id as varchar)
where p.paper_id % 4 <> 0 and p.a_id % 5 <> 0""")
def j07(spark, d):
    return J.project_researchers(project_messages(spark, d), labs(suppliers(spark, d)))


PROJECT_PEOPLE = """lead as (select paper_id, 'Lab' || inst as lead from people where pos = 0),
listing as (
 select key_id, p.paper_id as id, -1 as pos, case when p.paper_id % 3 = 1 then cast(p.a_id as varchar) else coalesce(k.a_id,
  's' || substr(md5(p.name || chr(1) || 'Lab' || p.inst), 1, 16)) end as a_id, p.name, 'Lab' || p.inst as inst
 from people p left join known k on k.name = p.name and k.inst = p.inst where pos = 0 and p.paper_id % 4 <> 0
 union all
 select key_id, p.paper_id, pos, cast(p.a_id as varchar), p.name, case when k.a_id is not null then 'Lab' || k.inst else lead end
 from people p join lead using (paper_id) left join known k on k.a_id = cast(p.a_id as varchar)
 where p.paper_id % 4 <> 0 and p.a_id % 5 <> 0)"""


@query("j05_j06_j07_authors_after_projects", with_views(AUTHOR_PAPER, PEOPLE, SUPPLIERS, PROJECT_PEOPLE) + """,
firsts as (select a_id, name, inst, row_number() over (partition by a_id order by id, name, inst) as rn from listing),
moved as (select a_id, inst, row_number() over (partition by a_id order by id desc, inst desc) as rn from listing where pos = -1)
select k.a_id, k.name, coalesce(m.inst, 'Lab' || k.inst) as inst from known k left join moved m on m.a_id = k.a_id and m.rn = 1
union all select a_id, name, inst from firsts where rn = 1 and a_id not in (select a_id from known)""")
def j07_authors(spark, d):
    projects = project_messages(spark, d).withColumn("seq", F.col("id"))
    return J.resolve_projects(projects, labs(suppliers(spark, d)))[1]


@query("j06_j07_projects_with_author_ids", with_views(AUTHOR_PAPER, PEOPLE, SUPPLIERS, PROJECT_PEOPLE) + """
select key_id, id, min(name) filter (where pos = -1) as mng, min(a_id) filter (where pos = -1) as "mngId",
 coalesce(string_agg(name, ';' order by pos) filter (where pos >= 0), '') as rsc,
 coalesce(string_agg(a_id, ';' order by pos) filter (where pos >= 0), '') as "rscId" from listing group by 1, 2""")
def j07_written_back(spark, d):
    projects = project_messages(spark, d).withColumn("seq", F.col("id"))
    return J.listed_people(J.resolve_projects(projects, labs(suppliers(spark, d)))[0])


def paper_messages(spark, d, with_ids=False):
    base = D.author_institutions(spark, d).withColumnRenamed("paper_id", "id")
    return base if with_ids else base.withColumn("author_id", F.lit(None).cast("string"))


RESOLVED = """resolved as (select p.*, coalesce(k.a_id, 's' || substr(md5(p.name || chr(1) || p.inst), 1, 16)) as rid
 from people p left join known k on k.name = p.name and k.inst = p.inst)"""


@query("j08_papers_with_author_ids", with_views(AUTHOR_PAPER, PEOPLE, SUPPLIERS, RESOLVED) + """
select key_id, paper_id as id, string_agg(rid, ';' order by pos) as author_id, string_agg(name, ';' order by pos) as author,
 string_agg(inst, ';' order by pos) as author_inst, count(*) as n_authors from resolved group by 1, 2""")
def j08(spark, d):
    listing, _ = J.resolve_papers(paper_messages(spark, d), suppliers(spark, d))
    return J.listed_ids(listing)


@query("j08_blank_provider_ids", with_views(AUTHOR_PAPER, PEOPLE, SUPPLIERS, RESOLVED) + """
select key_id, paper_id as id, string_agg(case when a_id % 3 = 0 then cast(a_id as varchar) else rid end, ';' order by pos) as author_id,
 count(*) as n_authors from resolved group by 1, 2""")
def j08_blank(spark, d):
    """Two thirds of the provider ids are blank: these authors are found by name and institution."""
    some = F.transform(F.split("author_id", ";"), lambda a: F.when(a.cast("long") % 3 == 0, a).otherwise(F.lit(" ")))
    papers = paper_messages(spark, d, with_ids=True).withColumn("author_id", F.array_join(some, ";"))
    listing, _ = J.resolve_papers(papers, suppliers(spark, d))
    return J.listed_ids(listing).select("key_id", "id", "author_id", "n_authors")


@query("j08_authors_after_papers", with_views(AUTHOR_PAPER, PEOPLE, SUPPLIERS, RESOLVED) + """
select a_id, name, inst from known union select distinct rid, name, inst from resolved""")
def j08_authors(spark, d):
    return J.resolve_papers(paper_messages(spark, d), suppliers(spark, d))[1]


@query("j09_pending_provider_authors", with_views(AUTHOR_PAPER, PEOPLE, SUPPLIERS) + """
select distinct cast(a_id as varchar) as a_id, name, '' as inst, false as has_inst from people where a_id % 2 = 1""")
def j09(spark, d):
    papers = paper_messages(spark, d, with_ids=True).withColumn("author_inst", F.lit(None).cast("string"))
    listed = J.paper_authors(papers).select(F.col("provider_id").alias("a_id"), "name", "inst", F.col("id").alias("seq"))
    return J.pending_provider_authors(listed, suppliers(spark, d))


@query("j09_pending_count", "select count(distinct l_suppkey) as n_pending from lineitem join orders on l_orderkey = o_orderkey where l_suppkey % 2 = 1")
def j09_count(spark, d):
    return j09(spark, d).agg(F.count("*").alias("n_pending"))


# ---- similarity -------------------------------------------------------------------------------------------------------------

ENTRIES = """names as (select paper_id, pos, n_authors, s_suppkey,
  'Author' || substr(md5(s_name), 1, 6) || ', ' || substr(md5(s_name), 7, 8) as name
 from author_paper join supplier on s_suppkey = a_id),
entries as (select paper_id, n_authors - 1 - pos as e, pos,
  case when s_suppkey % 2 = 0 then substr(md5(s_suppkey_name), 7, 8) || ' Author' || substr(md5(s_suppkey_name), 1, 6)
   else 'Author' || substr(md5(s_suppkey_name), 1, 6) || ', ' || substr(md5(s_suppkey_name), 7, 7) end as entry,
  'ID-' || s_suppkey as id
 from (select *, 'Supplier#' || lpad(cast(s_suppkey as varchar), 9, '0') as s_suppkey_name from names))"""


def id_records(spark, d):
    """Records with `Name/ID` entries in reverse author order: exact names turned around, or one letter short."""
    base = D.author_institutions(spark, d).select("paper_id", "author", "author_id")
    digest = F.transform(F.split("author", ";"), lambda n: F.md5(n))
    who = F.zip_with(digest, F.split("author_id", ";"), lambda m, a: F.struct(m.alias("m"), a.alias("a")))
    family = lambda w: F.concat(F.lit("Author"), F.left(w["m"], F.lit(6)))
    given = lambda w, n: F.substring(w["m"], 7, n)
    author = F.array_join(F.transform(who, lambda w: F.concat(family(w), F.lit(", "), given(w, 8))), "; ")
    entry = F.transform(who, lambda w: F.concat(
        F.when(w["a"].cast("long") % 2 == 0, F.concat(given(w, 8), F.lit(" "), family(w)))
        .otherwise(F.concat(family(w), F.lit(", "), given(w, 7))), F.lit("/ID-"), w["a"]))
    return base.select("paper_id", author.alias("author"), F.array_join(F.reverse(entry), "; ").alias("entries"))


SIMILARITY = with_views(AUTHOR_PAPER, ENTRIES) + """,
author_tokens as (select paper_id, pos, unnest(list_filter(string_split(replace(replace(name, ',', ''), '-', ' '), ' '),
  lambda t: t <> '')) as token from names),
entry_tokens as (select paper_id, e, unnest(list_filter(string_split(replace(replace(entry, ',', ''), '-', ' '), ' '),
  lambda t: t <> '')) as token from entries),
sums as (select paper_id, e, pos, sum(jaro_similarity(a.token, t.token)) as s
 from entry_tokens t join author_tokens a using (paper_id) where jaro_similarity(a.token, t.token) >= 0.9 group by 1, 2, 3),
best as (select paper_id, e, pos from (select *, row_number() over (partition by paper_id, e
  order by round(s, 9) desc, pos) as rn from sums) where rn = 1)
"""


def by_entry(matched, key):
    """One row per entry. An inner explode would have Catalyst ask for `size(best) > 0` first and evaluate the UDF twice."""
    return matched.select(key, F.posexplode_outer("best").alias("e", "best")).where(F.col("e").isNotNull())


@query("j13_best_author_per_entry", SIMILARITY + """
select n.paper_id, n.e, coalesce(b.pos, -1) as best from entries n left join best b using (paper_id, e)""")
def j13(spark, d):
    return by_entry(with_best_author(id_records(spark, d), "author", "entries"), "paper_id")


@query("j14_j15_aligned_ids", SIMILARITY + """,
owners as (select paper_id, pos, min(e) as e from best group by 1, 2 having count(*) = 1)
select n.paper_id, string_agg(coalesce(x.id, ''), ';' order by n.pos) as r_id
from names n left join owners o on o.paper_id = n.paper_id and o.pos = n.pos
left join entries x on x.paper_id = n.paper_id and x.e = o.e group by 1""")
def j14(spark, d):
    return with_aligned_ids(id_records(spark, d), "author", "entries", "r_id").select("paper_id", "r_id")


@query("j14_conflicts", with_views(AUTHOR_PAPER) + """
select paper_id, string_agg(case (paper_id + a_id) % 4 when 1 then 'A' || a_id when 3 then 'C' || a_id else 'none' end,
 ';' order by pos) as r_id from author_paper group by 1""")
def j14_conflicts(spark, d):
    """None to three entries for each author of a record: the second voids the first, a third takes the author."""
    rows = D.author_institutions(spark, d, ("author_id",))
    name = lambda a: F.concat(F.lit("Person "), F.lower(F.translate(a, "0123456789", "KWZQXVBJYP")), a)
    listed = F.transform(F.split("author_id", ";"), lambda a: a)
    of_one = lambda a: F.transform(
        F.slice(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.lit(1), ((F.col("paper_id") + a.cast("long")) % 4).cast("int")),
        lambda mark: F.concat(name(a), F.lit("/"), mark, a))
    rows = rows.select("paper_id", F.array_join(F.transform(listed, name), "; ").alias("author"),
                       F.array_join(F.flatten(F.transform(listed, of_one)), "; ").alias("entries"))
    ids = F.transform(F.split("r_id", ";"), lambda x: F.when(x == "", "none").otherwise(x))
    return with_aligned_ids(rows, "author", "entries", "r_id").select("paper_id", F.array_join(ids, ";").alias("r_id"))


NAMED = """named as (select s_suppkey as a_id, n_name as inst,
  lower((['Kim', 'Lee', 'Park', 'Choi', 'Jung'])[s_suppkey % 5 + 1]) as surname,
  lower(case when s_suppkey % 4 = 0 then 'M' else (['Min Ho', 'So Ra', 'Mi Na'])[s_suppkey % 3 + 1] end) as given
 from supplier join nation on s_nationkey = n_nationkey)"""


PAIRS = """shared as (select distinct a.key_id, a.a_id, b.a_id as co from author_paper a join author_paper b
 on a.key_id = b.key_id and a.paper_id = b.paper_id and a.a_id <> b.a_id),
p as (select s.key_id, s.co, n.* from shared s join named n using (a_id)),
pairs as (select distinct l.key_id, l.a_id, r.a_id as other_id, l.surname as ls, r.surname as rs, l.given as lg, r.given as rg,
  l.inst as li, r.inst as ri from p l join p r on l.key_id = r.key_id and l.co = r.co and l.a_id < r.a_id)"""
REASONS = """select key_id, a_id, other_id, 'short name' as reason from pairs
 where ls = rs and left(lg, 1) = left(rg, 1) and (length(lg) > 1) <> (length(rg) > 1)
union all select key_id, a_id, other_id, 'moved' from pairs where ls = rs and lg = rg and li <> ri
union all select key_id, a_id, other_id, 'new surname' from pairs where lg = rg and length(lg) > 1 and li = ri and ls <> rs"""


def named_suppliers(spark, d):
    """Suppliers with personal names; every fourth goes by an initial."""
    n = F.col("s_suppkey")
    one_of = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (n % by + 1).cast("int"))
    given = F.when(n % 4 == 0, "M.").otherwise(one_of(["Min Ho", "So Ra", "Mi Na"], 3))
    people = D.table(spark, d, "supplier").join(D.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return people.select(n.alias("a_id"), F.concat(one_of(["Kim", "Lee", "Park", "Choi", "Jung"], 5), F.lit(", "), given)
                         .alias("name"), F.col("n_name").alias("inst"))


@query("j17_same_author", with_views(AUTHOR_PAPER, NAMED, PAIRS) + REASONS)
def j17(spark, d):
    return J.same_author(D.author_paper(spark, d), named_suppliers(spark, d))


@query("j17_persons", "with recursive " + ",\n".join([AUTHOR_PAPER, NAMED, PAIRS]) + f""",
named_pairs as (select a_id, other_id, count(*) as n from ({REASONS}) group by 1, 2),
ids as (select a_id from named_pairs union select other_id from named_pairs),
links as (select * from named_pairs p where not exists (select 1 from author_paper x join author_paper y
  on x.key_id = y.key_id and x.paper_id = y.paper_id where x.a_id = p.a_id and y.a_id = p.other_id)),
both_ways as (select a_id, other_id, n from links union all select other_id, a_id, n from links),
reach as (select distinct a_id, a_id as other_id from both_ways union select r.a_id, b.other_id from reach r join both_ways b on b.a_id = r.other_id),
groups as (select a_id, min(other_id) as root from reach group by 1),
broken as (select distinct root from (select root, key_id, paper_id, count(distinct a_id) as n from groups join author_paper using (a_id)
  group by all) where n > 1),
best as (select a_id, other_id from (select *, row_number() over (partition by a_id order by n desc, other_id) as rn from both_ways) where rn = 1),
mutual as (select a.a_id, a.other_id from best a join best b on b.a_id = a.other_id and b.other_id = a.a_id)
select a_id, case when root is null then a_id when root in (select root from broken) then least(a_id, coalesce(m.other_id, a_id))
 else root end as person from ids left join groups using (a_id) left join mutual m using (a_id)""")
def j17_persons(spark, d):
    listing = D.author_paper(spark, d)
    records = J.author_lists(listing)
    return J.persons(J.same_author(listing, named_suppliers(spark, d), records), listing, records)
