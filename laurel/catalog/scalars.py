"""Queries for scalar and multi-value functions (X-*, R-*). Inputs are strings derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from laurel.catalog.registry import AUTHOR_PAPER, INSTITUTIONS, query, with_views
from laurel.functions import fuzzy
from laurel.functions import multivalue as R
from laurel.functions import text as X
from laurel.plans import driver_tables as D


def order_strings(spark, d, **columns):
    """Orders with derived string columns, given as SQL expressions that both engines share."""
    return D.table(spark, d, "orders").select("o_orderkey", *[F.expr(e).alias(n) for n, e in columns.items()])


@query("x01_strip_markup", r"select page_id, md5(regexp_replace(html, '<[^\n]*?>|-', '', 'g')) as plain from pages")
def x01(spark, d):
    return D.table(spark, d, "pages").select("page_id", F.md5(X.strip_markup(F.col("html"))).alias("plain"))


@query("x02_strip_tags", r"select page_id, md5(regexp_replace(html, '<[^\n]+?>', '', 'g')) as plain from pages")
def x02(spark, d):
    return D.table(spark, d, "pages").select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("plain"))


@query("x03_strip_highlight", """select s_suppkey, s_name as name, 'Institute' || s_name as inst from supplier""")
def x03(spark, d):
    opening = F.lit("<span class=\\search_word\\>")
    return D.table(spark, d, "supplier").select(
        "s_suppkey",
        X.strip_highlight(F.concat(opening, F.col("s_name"), F.lit("</span>"))).alias("name"),
        X.strip_highlight(F.concat(F.lit("Institute "), opening, F.col("s_name"), F.lit("</span>")), True).alias("inst"))


TITLE = "case when p_partkey % 3 = 0 then concat(p_name, ' 연구') else p_name end"


@query("x04_x05_language", f"""select p_partkey, case when regexp_matches({TITLE}, '[가-힣]') then 'kor' else 'eng' end as lang from part
 union all select -doc_id - 1, 'eng' from documents""")
def x04(spark, d):
    part = D.table(spark, d, "part").select("p_partkey", X.language(F.expr(TITLE)).alias("lang"))
    return part.union(D.table(spark, d, "documents").select(-F.col("doc_id") - 1, X.language(F.col("text"))))


@query("x06_x07_title_and_abstract_routing", """select p_partkey, case when p_partkey % 2 = 0 then concat('연구 ', p_name) else '' end as title,
 p_brand as english_title, p_type as abstract,
 case p_partkey % 3 when 0 then p_brand when 1 then p_name else '' end as english_abstract from part""")
def x06(spark, d):
    titles = F.expr("""case when p_partkey % 2 = 0 then array('Former', '옛 연구', p_brand, concat('연구 ', p_name))
        else array('Former', p_brand) end""")
    abstracts = F.expr("""array(named_struct('lang', 'original', 'text', p_type), named_struct('lang',
        case p_partkey % 3 when 0 then 'english' when 1 then 'foreign' else 'other' end, 'text',
        case p_partkey % 3 when 0 then p_brand else p_name end))""")
    return D.table(spark, d, "part").select(
        "p_partkey", X.title_in(titles, "kor").alias("title"), X.title_in(titles, "eng").alias("english_title"),
        X.tagged_text(abstracts, "original").alias("abstract"),
        X.tagged_text(abstracts, "english", "foreign").alias("english_abstract"))


@query("x08_page_range", """select o_orderkey, cast(o_custkey as varchar) as first_page,
 case when o_orderkey % 3 = 0 then '' else cast(o_orderkey as varchar) end as last_page from orders""")
def x08(spark, d):
    s = order_strings(spark, d, p="""concat('pp.', o_custkey, case when o_orderkey % 3 = 0 then '' else concat('-', o_orderkey) end)""")
    pages = X.page_range(F.col("p"))
    return s.select("o_orderkey", pages["start"].alias("first_page"), pages["end"].alias("last_page"))


@query("x09_digit_runs", """select o_orderkey, cast(o_custkey as bigint) as first_page,
 case when o_orderkey % 3 = 0 then 0 else cast(o_orderkey as bigint) end as last_page from orders""")
def x09(spark, d):
    s = order_strings(spark, d, p="concat('p.', o_custkey, case when o_orderkey % 3 = 0 then '' else concat(' ~ ', o_orderkey, ' (7)') end)")
    return s.select("o_orderkey", X.digit_run(F.col("p"), 0).alias("first_page"), X.digit_run(F.col("p"), 1).alias("last_page"))


@query("x10_digits_only", r"""select o_orderkey, coalesce(try_cast(regexp_replace(o_orderpriority || o_custkey || '00000012345', '\D', '', 'g') as bigint), 0) as n,
 coalesce(try_cast(regexp_replace(o_orderpriority[2:], '\D', '', 'g') as bigint), 0) as none from orders""")
def x10(spark, d):
    s = order_strings(spark, d, a="concat(o_orderpriority, o_custkey, '00000012345')", b="substr(o_orderpriority, 2)")
    return s.select("o_orderkey", X.digits_only(F.col("a")).alias("n"), X.digits_only(F.col("b")).alias("none"))


@query("x09_x10_digits_of_any_length", r"""select o_orderkey, ltrim(o_orderkey || '0000000000000000000012345', '0') as digits,
 case when o_orderkey = 0 then 12345 end as n, cast(o_orderkey as bigint) as run, case when o_orderkey % 2 = 0 then 0 end as long_run from orders""")
def x10_long(spark, d):
    """Beyond a long the text survives, and the number is unknown instead of 0."""
    s = order_strings(spark, d, a="concat('p', o_orderkey, '-00000000000000000000', '12345')",
                      b="concat('p', o_orderkey, case when o_orderkey % 2 = 0 then '' else '-99999999999999999999' end)")
    return s.select("o_orderkey", X.digits_of(F.col("a")).alias("digits"), X.digits_only(F.col("a")).alias("n"),
                    X.digit_run(F.col("b"), 0).alias("run"), X.digit_run(F.col("b"), 1).alias("long_run"))


@query("x11_record_ids", """select o_orderkey, 'NODE0' || o_orderkey as node, '85' || o_orderkey as eid,
 '000' || o_orderkey as ut from orders""")
def x11(spark, d):
    s = order_strings(spark, d, url="concat('https://example.org/detail?nodeId=NODE0', o_orderkey)",
                      eid="concat('2-s2.0-85', o_orderkey)", ut="concat('WOS:000', o_orderkey)")
    return s.select("o_orderkey", X.node_id(F.col("url")).alias("node"), X.drop_text(F.col("eid"), "2-s2.0-").alias("eid"),
                    X.drop_text(F.col("ut"), "WOS:").alias("ut"))


@query("x12_profile_ids", r"select page_id, array_to_string(regexp_extract_all(url, '\d+'), ',') as ids from pages")
def x12(spark, d):
    return D.table(spark, d, "pages").select("page_id", X.joined_digit_runs(F.col("url")).alias("ids"))


@query("x13_affiliation_codes", "select s_suppkey, s_name || ' Seoul' as inst from supplier")
def x13(spark, d):
    coded = F.concat("s_name", F.lit("AB"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0"), F.lit(" <b>Seoul</b>"))
    return D.table(spark, d, "supplier").select(
        "s_suppkey", X.strip_markup(X.drop_affiliation_codes(coded)).alias("inst"))


@query("x14_registry", """select p_partkey, case when p_size % 2 = 0 then 'KCI' else p_type end as registry from part""")
def x14(spark, d):
    raw = F.expr("case when p_size % 2 = 0 then concat(p_type, ' KCI candidate') else p_type end")
    return D.table(spark, d, "part").select("p_partkey", X.registry_name(raw).alias("registry"))


@query("x15_title_end", r"select doc_id, md5(regexp_replace(text, '[^\p{L}\p{N}]\z', '')) as title from documents")
def x15(spark, d):
    return D.table(spark, d, "documents").select("doc_id", F.md5(X.drop_last_symbol(F.col("text"))).alias("title"))


@query("x16_x17_years", """select o_orderkey, cast(year(o_orderdate) as bigint) as exported,
 case when o_orderkey % 10 <> 0 or o_orderkey % 20 <> 0 then cast(year(o_orderdate) as integer) else 2000 end as scored from orders""")
def x16(spark, d):
    s = order_strings(
        spark, d,
        col44="case when o_orderkey % 3 = 0 then concat(year(o_orderdate), if(o_orderkey % 2 = 0, '.0', '')) else '' end",
        col56="case when o_orderkey % 3 = 1 then cast(year(o_orderdate) as string) else concat('JAN ', year(o_orderdate)) end",
        last="case when o_orderkey % 10 = 0 then 'null' else cast(o_orderdate as string) end",
        first="case when o_orderkey % 20 = 0 then 'null' else cast(o_orderdate as string) end")
    return s.select("o_orderkey", X.export_year(F.col("col44"), F.col("col56")).alias("exported"),
                    X.year_of(X.fold_null(F.col("last")), X.fold_null(F.col("first"))).alias("scored"))


@query("x18_whole_numbers", """select o_orderkey, case when o_orderkey % 7 = 0 then 0 else cast(floor(o_totalprice) as bigint) end as n from orders""")
def x18(spark, d):
    s = order_strings(spark, d, n="case when o_orderkey % 7 = 0 then '' else concat(floor(o_totalprice), if(o_orderkey % 2 = 0, '.0', '')) end")
    return s.select("o_orderkey", X.whole_number(F.col("n")).alias("n"))


@query("x19_person_ids", "select o_orderkey, cast(o_custkey as varchar) || '.7' as person from orders")
def x19(spark, d):
    s = order_strings(spark, d, p="""concat('"', o_orderkey, '.', o_custkey, '.7"')""")
    return s.select("o_orderkey", X.person_id(F.col("p")).alias("person"))


@query("x21_drop_symbols", r"""
with w as (select doc_id, regexp_replace(unnest(string_split(text, ' ')), '[-=.#/?:$}()]', '', 'g') as word from documents)
select doc_id, count(*) as n_words, md5(string_agg(word, ' ' order by word)) as words from w
where word <> '' and word <> 'None' and length(word) >= 4 group by 1""")
def x21(spark, d):
    kept = X.drop_symbols(F.split("text", " "), 4)
    return D.table(spark, d, "documents").select("doc_id", F.sort_array(kept).alias("w")).where(F.size("w") > 0).select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words"))


@query("x22_time_stamps", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as stamp from events")
def x22(spark, d):
    return D.table(spark, d, "events").select("event_id", X.stamp(F.col("ts")).alias("stamp"))


@query("x23_jaro_similarity", """select a.c_custkey, round(jaro_similarity(a.c_name, p.p_name), 6) as name_part,
 round(jaro_similarity(c_mktsegment, p_type), 6) as segment_type
 from customer a join part p on p.p_partkey = a.c_custkey""")
def x23(spark, d):
    pairs = D.table(spark, d, "customer").join(D.table(spark, d, "part"), F.col("c_custkey") == F.col("p_partkey"))
    return pairs.select("c_custkey", F.round(fuzzy.jaro_similarity("c_name", "p_name"), 6).alias("name_part"),
                        F.round(fuzzy.jaro_similarity("c_mktsegment", "p_type"), 6).alias("segment_type"))


@query("x24_grouped_numbers", "select o_orderkey, cast(floor(o_totalprice) as bigint) * 100000 as n from orders")
def x24(spark, d):
    s = order_strings(spark, d, n="format_number(floor(o_totalprice) * 100000, 0)")
    return s.select("o_orderkey", X.grouped_number(F.col("n")).alias("n"))


# ---- multi-value ----------------------------------------------------------------------------------------------------------

VIEWS = with_views(AUTHOR_PAPER, INSTITUTIONS)
PEOPLE = """people as (select key_id, paper_id, pos, n_authors, s_name as name, n_name as inst, a_id
 from author_paper join supplier on s_suppkey = a_id join nation on n_nationkey = s_nationkey)"""


def institutions(spark, d):
    return D.author_institutions(spark, d)


@query("r01_pairs", with_views(AUTHOR_PAPER, PEOPLE) + """
select key_id, paper_id, pos as place, name, inst from people where pos <> n_authors - 1 or paper_id % 2 = 1""")
def r01(spark, d):
    """Every other record lacks its last institution, so the lists differ in length."""
    cut = F.when((F.col("paper_id") % 2 == 0), F.regexp_replace("author_inst", "(^|;)[^;]*$", "")).otherwise(F.col("author_inst"))
    insts = F.when(cut == "", F.array().cast("array<string>")).otherwise(R.items(F.replace(cut, F.lit(";"), F.lit(" ; "))))
    pairs = R.paired(R.items(F.col("author")), insts)
    return institutions(spark, d).select("key_id", "paper_id", F.posexplode(pairs).alias("place", "p")).select(
        "key_id", "paper_id", "place", "p.name", "p.inst")


@query("r02_r03_equal_lengths", VIEWS + """
select key_id, paper_id from institutions where paper_id % 3 <> 0 or paper_id % 5 = 0""")
def r02(spark, d):
    """Every third record has one name more than ids, unless it is a fifth."""
    extra = F.when((F.col("paper_id") % 3 == 0) & (F.col("paper_id") % 5 != 0), ";Another Name").otherwise("")
    names = F.split(F.concat("author", extra), ";")
    ids = F.split("author_id", ";")
    return institutions(spark, d).where(R.same_size(ids, names) & R.both_filled(ids, names)).select("key_id", "paper_id")


@query("r04_a23_separator_counts", VIEWS + """
select key_id, count(*) as n_read, count(*) filter (where paper_id % 4 = 0) as n_mismatched from institutions group by 1""")
def r04(spark, d):
    insts = F.when(F.col("paper_id") % 4 == 0, F.concat("author_inst", F.lit(";"))).otherwise(F.col("author_inst"))
    same = R.same_separator_count(F.col("author"), insts)
    return institutions(spark, d).groupBy("key_id").agg(
        F.count("*").alias("n_read"), F.count_if(~same).alias("n_mismatched"))


@query("r05_shared_institution", VIEWS + """
select key_id, paper_id, case when paper_id % 5 = 0
 then rtrim(repeat('KISTI ' || split_part(author_inst, ';', 1) || ';', len(string_split(author_inst, ';'))), ';')
 else author_inst end as insts from institutions""")
def r05(spark, d):
    marked = F.when(F.col("paper_id") % 5 == 0, F.regexp_replace("author_inst", "^([^;]*)", "KISTI $1&lt")).otherwise(
        F.col("author_inst"))
    return institutions(spark, d).select("key_id", "paper_id", R.emit(R.institution_list(marked)).alias("insts"))


@query("r06_name_inst_tokens", with_views(AUTHOR_PAPER, PEOPLE) + """
select key_id, paper_id, string_agg(case when a_id % 3 = 0 then 'Dr. ' || name else name end, ';' order by pos) as author,
 string_agg(inst || case when a_id % 2 = 0 then ' (HQ)' else '' end, ';' order by pos) as author_inst from people group by 1, 2""")
def r06(spark, d):
    """Every third author's token is split in two, every second institution holds brackets."""
    insts = institutions(spark, d).withColumn("who", F.arrays_zip(
        F.split("author", ";").alias("name"), F.split("author_inst", ";").alias("inst"), F.split("author_id", ";").alias("a")))
    tokens = F.flatten(F.transform("who", lambda w: F.when(
        w["a"].cast("long") % 3 == 0, F.array(F.lit("Dr."), token_of(w))).otherwise(F.array(token_of(w)))))
    pairs = insts.withColumn("p", R.name_inst_pairs(tokens))
    return pairs.select("key_id", "paper_id", R.emit(F.col("p")["name"]).alias("author"),
                        R.emit(F.col("p")["inst"]).alias("author_inst"))


def token_of(w):
    hq = F.when(w["a"].cast("long") % 2 == 0, " (HQ)").otherwise("")
    return F.concat(w["name"], F.lit("("), w["inst"], hq, F.lit(")"))


@query("r07_institutions_without_names", with_views(AUTHOR_PAPER, PEOPLE) + """,
blanked as (select *, case when a_id % 4 = 0 and pos > 0 then null else inst end as shown from people),
filled as (select *, coalesce(last_value(shown ignore nulls) over (partition by key_id, paper_id order by pos), '') as kept from blanked)
select key_id, paper_id, string_agg(kept, '; ' order by pos) as author_inst from filled group by 1, 2""")
def r07(spark, d):
    """Every fourth author (but a first one) has no institution of their own and takes the one before."""
    whole = F.array_join(F.zip_with(
        F.split("author", ";"), F.transform(F.split("author_id", ";"), lambda a: a.cast("long") % 4 == 0),
        lambda name, blank: F.struct(name.alias("name"), blank.alias("blank")))["name"], ";")
    who = F.arrays_zip(F.split(whole, ";").alias("name"), F.split("author_inst", ";").alias("inst"),
                       F.split("author_id", ";").alias("a"))
    listed = F.array_join(F.transform(who, lambda w, i: F.concat(
        w["name"], F.when((i > 0) & (w["a"].cast("long") % 4 == 0), F.lit(",")).otherwise(
            F.concat(F.lit(", "), w["inst"])))), "; ")
    author = F.replace("author", F.lit(";"), F.lit("; "))
    return institutions(spark, d).select(
        "key_id", "paper_id", R.institutions_without_names(author, listed).alias("author_inst"))


@query("r08_bracketed_institutions", with_views(AUTHOR_PAPER, PEOPLE) + """
select key_id, paper_id, string_agg(inst, ';' order by pos) as author_inst from people group by 1, 2""")
def r08(spark, d):
    """Groups in reverse author order; the first author is listed again at the end with another institution."""
    names, insts = F.split("author", ";"), F.split("author_inst", ";")
    groups = F.reverse(F.zip_with(names, insts, lambda n, i: F.concat(F.lit("["), n, F.lit("] "), i)))
    address = F.concat(F.array_join(groups, "; "), F.lit("; ["), F.get(names, F.lit(0)), F.lit("; Nobody] Elsewhere"))
    return institutions(spark, d).select(
        "key_id", "paper_id", R.emit(R.bracketed_institutions(F.col("author"), address)).alias("author_inst"))


@query("r09_separators", VIEWS + """
select key_id, paper_id, author, author_id from institutions""")
def r09(spark, d):
    commas = F.replace("author", F.lit(";"), F.lit(","))
    return institutions(spark, d).select(
        "key_id", "paper_id", R.comma_to_semicolon(commas).alias("author"),
        R.drop_final_separator(F.concat("author_id", F.lit(";"))).alias("author_id"))


@query("r10_flattened_texts", """select doc_id, len(string_split(text, ' ')) as n_words from
 (select doc_id, replace(text, chr(10), ' ') as text from documents)""")
def r10(spark, d):
    nested = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    return D.table(spark, d, "documents").select("doc_id", F.size(F.flatten(nested)).cast("long").alias("n_words"))
