"""Queries for sources and provider parsers (S-*, P-*, F-16). The payloads are written from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from laurel.catalog.factors import NORMALISED, factor_sql, normalised_papers, r6, rounded
from laurel.catalog.registry import AUTHOR_PAPER, INSTITUTIONS, query, with_views
from laurel.plans import driver_tables as D
from laurel.session import scratch_path, stored
from laurel.sources import files, messages, providers, tables
from laurel.streaming import jobs

VIEWS = with_views(AUTHOR_PAPER, INSTITUTIONS)
PAGE = 100  # records per provider page
EXPORT = 2_000  # records per export, the provider's own limit
DOCUMENT = 20_000  # elements per XML document, which one task reads


def source_rows(spark, d):
    """Orders with authors, as the content of the payloads."""
    orders = D.table(spark, d, "orders")
    return D.author_institutions(spark, d).withColumnRenamed("paper_id", "n").join(
        orders.select(F.col("o_orderkey").alias("n"), "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus"), "n")


ROWS = """src as (select i.*, i.paper_id as n, o_custkey, o_totalprice, o_orderdate, o_orderstatus
 from institutions i join orders on o_orderkey = paper_id)"""
SRC = with_views(AUTHOR_PAPER, INSTITUTIONS, ROWS)


def xml(tag, *parts, **attributes):
    head = F.concat(F.lit(f"<{tag}"), *[F.concat(F.lit(f' {k.replace("_", "-")}="'), v, F.lit('"'))
                                        for k, v in attributes.items()], F.lit(">"))
    return F.concat(head, *parts, F.lit(f"</{tag}>"))


def text(c):
    return F.coalesce(c.cast("string"), F.lit(""))


def pages(rows, item, separator=""):
    """Items in pages of 100 by record number."""
    page = F.floor(F.col("n") / PAGE).alias("page")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]), separator)
    return rows.select("key_id", "n", item.alias("item")).groupBy(page).agg(listed.alias("items"))


# ---- NTIS -------------------------------------------------------------------------------------------------------------

def ntis_folder(spark, d):
    """XML files of HIT elements, one packed document of a bounded number of elements per file."""
    n = F.col("n")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    first = lambda c: F.split_part(c, F.lit(";"), F.lit(1))
    folder = scratch_path(spark, "ntis")
    source_rows(spark, d).select(
        text(n).alias("ProjectNumber"),
        F.struct(F.concat(F.lit("<b>연구</b> "), text(n)).alias("Korean"), F.concat(F.lit("Study-"), text(n)).alias("English"))
        .alias("ProjectTitle"),
        F.struct(first("author").alias("Name"), F.concat(F.lit("007."), first("author_id")).alias("HumanID")).alias("Manager"),
        F.struct(F.col("author").alias("Name"), F.col("author_id").alias("HumanID"), text(n % 7).alias("ManCount"),
                 text(n % 3).alias("WomanCount")).alias("Researchers"),
        F.struct(F.concat(F.lit("<i>Goal</i> "), text(n)).alias("Full")).alias("Goal"),
        F.struct(F.concat(F.lit("요약 "), text(n)).alias("Full")).alias("Abstract"),
        F.struct(F.concat(F.lit("Effect "), F.col("o_orderstatus")).alias("Full")).alias("Effect"),
        F.struct(F.lit("전-지").alias("Korean"), F.col("o_orderstatus").alias("English")).alias("Keyword"),
        F.struct(F.concat(F.lit("Agency"), text(n % 5)).alias("Name")).alias("OrderAgency"),
        first("author_inst").alias("LeadAgency"),
        F.struct(*[F.concat(F.lit(c[0]), text(n % k)).alias(c) for c, k in (("Large", 4), ("Medium", 6), ("Small", 8))])
        .alias("MinistryScienceClass"),
        F.when(n % 2 == 0, "서울").alias("Region"),
        F.struct(F.when(n % 20 == 0, "null").otherwise(day).alias("Start"), F.when(n % 10 == 0, "null").otherwise(day).alias("End")).alias("ProjectPeriod"),
        F.struct(F.when(n % 4 == 0, "09").otherwise("03").alias("_code"), F.lit("University").alias("_VALUE"))
        .alias("PerformAgent"),
        F.floor("o_totalprice").cast("string").alias("TotalFunds"),
    ).write.format("xml").options(rootTag="RESULTSET", rowTag="HIT", maxRecordsPerFile=DOCUMENT, compression="gzip", **files.XML).save(folder)
    return folder


@query("s07_s09_p01_ntis_projects", SRC + """
select cast(n as varchar) as id, '연구 ' || n as "koTitle", 'Study' || n as "enTitle", split_part(author, ';', 1) as mng,
 '007.' || split_part(author_id, ';', 1) as "mngId", author as rsc, author_id as "rscId", cast(n % 7 as varchar) as "cntRscMan",
 cast(n % 3 as varchar) as "cntRscWom", 'Goal ' || n as "goalAbs", '요약 ' || n as "absAbs", 'Effect ' || o_orderstatus as "effAbs",
 '전지' as "koKeyword", o_orderstatus as "enKeyword", 'Agency' || n % 5 as "odAgency", split_part(author_inst, ';', 1) as "ldAgency",
 case when n % 20 = 0 then 'null' else strftime(o_orderdate, '%Y%m%d') end as "prdStart",
 case when n % 10 = 0 then 'null' else strftime(o_orderdate, '%Y%m%d') end as "prdEnd", 'L' || n % 4 as "mscL", 'M' || n % 6 as "mscM",
 'S' || n % 8 as "mscS", case when n % 4 = 0 then '09' else '03' end as agent, 'University' as agent_name,
 case when n % 2 = 0 then '서울' end as region, cast(cast(floor(o_totalprice) as bigint) as varchar) as "totalFund",
 false as is_partial from src""")
def p01(spark, d):
    """All fields of the parser."""
    hits = files.read_xml(spark, ntis_folder(spark, d), "HIT", providers.NTIS_HIT)
    done = providers.accepted(providers.ntis_projects(hits))
    return done.withColumns({"agent": F.col("perfAgent.code"), "agent_name": F.col("perfAgent.value")}).drop("perfAgent")


# ---- DBPIA ------------------------------------------------------------------------------------------------------------

def dbpia_pages(spark, d):
    rows = source_rows(spark, d)
    n = F.col("n")
    who = F.arrays_zip(F.split("author", ";").alias("name"), F.split("author_id", ";").alias("a"))
    authors = F.array_join(F.transform(who, lambda w, i: xml("author", xml("name", w["name"]), F.when(
        (n % 11 == 0) & (i == 0), F.lit("")).otherwise(xml("url", F.lit("https://example.org/author/"), w["a"])))), "")
    title = F.when(n % 2 == 0, F.concat(F.lit("&lt;i&gt;연료&lt;/i&gt; "), text(n))).otherwise(F.concat(F.lit("Cell "), text(n)))
    item = xml(
        "item", xml("title", title), xml("authors", authors),
        F.when(n % 3 == 0, F.lit("<publication/>")).otherwise(xml("publication", xml("name", F.lit("Journal "), F.col("o_orderstatus")))),
        xml("publisher", xml("name", F.lit("Society "), F.col("o_orderstatus"))),
        F.when(n % 5 == 0, F.lit("")).when(n % 7 == 0, F.lit("<pages>12</pages>")).otherwise(
            xml("pages", F.lit("pp."), text(n), F.lit("-"), text(n + 9))),
        xml("link_url", F.lit("https://example.org/NODE"), text(n)),
        xml("dreg_name", F.when(n % 2 == 0, "KCI candidate").otherwise("SCI")),
        xml("issue", xml("yymm", F.date_format("o_orderdate", "yyyyMM"))))
    return pages(rows, item).select("page", xml("root", xml("result", xml("items", F.col("items")))).alias("payload"))


@query("p02_s09_dbpia_papers", SRC + """
select 'NODE' || n as id, case when n % 2 = 0 then '연료 ' || n else 'Cell ' || n end as title, author, author_id,
 case when n % 3 = 0 then 'Society ' else 'Journal ' end || o_orderstatus as journal, 'Society ' || o_orderstatus as issue_inst,
 case when n % 5 = 0 then 0 else cast(n as bigint) end as start_page, case when n % 5 = 0 then 0 else cast(n + 9 as bigint) end as end_page,
 case when n % 2 = 0 then 'KCI' else 'SCI' end as dreg_name, strftime(o_orderdate, '%Y%m') as issue_year,
 case when n % 2 = 0 then 'kor' else 'eng' end as issue_lang, 0 as citation
from src where (n % 7 <> 0 or n % 5 = 0) and n % 11 <> 0""")
def p02(spark, d):
    """Every seventh record has one page number only, every eleventh an author without an id: rejected."""
    done = providers.accepted(providers.dbpia_papers(dbpia_pages(spark, d)))
    return done.drop("page")


# ---- NDSL -------------------------------------------------------------------------------------------------------------

def ndsl_pages(spark, d):
    """Every tenth record lacks its last institution; every seventeenth page is cut off."""
    rows = source_rows(spark, d)
    n = F.col("n")
    tagged = lambda c: F.transform(F.split(c, ";"), lambda t: F.struct(t.alias("#text")))
    code = F.transform(F.split("author_inst", ";"), lambda t, i: F.struct(
        F.when(i == 0, F.concat(F.lit("AB0000012"), t)).otherwise(t).alias("#text")))
    short = F.when(n % 10 == 0, F.slice(code, F.lit(1), F.size(code) - 1)).otherwise(code)
    article = F.struct(
        F.concat(F.lit("ART"), text(n)).alias("@kistiID"),
        F.struct(F.concat(F.lit("<b>논문</b> "), text(n)).alias("articleTitle"), F.concat(F.lit("Paper-"), text(n)).alias("articleTitle2")).alias("articleTitleInfo"),
        F.array(F.concat(F.lit("Abstract of "), text(n))).alias("abstractInfo"),
        F.struct(tagged("author").alias("author"), short.alias("affiliation")).alias("authorInfo"),
        F.concat(F.lit("pp."), text(n), F.lit("-"), text(n + 1)).alias("page"), F.col("o_orderstatus").alias("keyword"))
    journal = F.struct(F.lit("Publisher").alias("publisher"), F.array(F.col("o_orderstatus")).alias("journalTitleInfo"),
                       F.date_format("o_orderdate", "yyyy").alias("year"))
    item = F.to_json(F.struct(journal.alias("journalInfo"), article.alias("articleInfo")))
    whole = F.concat(F.lit('callback({"resultSummary":{"totalCount":"1"},"outputData":['), F.col("items"), F.lit("]})"))
    return pages(rows, item, ",").select("page", F.when(
        F.col("page") % 17 == 0, F.left(whole, F.length(whole) - 20)).otherwise(whole).alias("payload"))


NDSL_KEPT = "n % 10 <> 0 and n // 100 % 17 <> 0"


@query("s08_p03_ndsl_papers", SRC + f"""
select 'ART' || n as id, '논문 ' || n as title, 'Paper' || n as english_title, 'Abstract of ' || n as abstract, author, author_inst,
 o_orderstatus as journal, 'Publisher' as issue_inst, strftime(o_orderdate, '%Y') as issue_year, 'kor' as issue_lang,
 cast(n as bigint) as start_page, cast(n + 1 as bigint) as end_page, o_orderstatus as paper_keyword from src where {NDSL_KEPT}""")
def p03(spark, d):
    done = providers.accepted(providers.ndsl_papers(ndsl_pages(spark, d)))
    return done.drop("page", "english_abstract", "citation")


@query("f16_a23_rejects", SRC + """
select reject_reason, count(*) as n_rows from (select case when n // 100 % 17 = 0 then null
 when n % 10 = 0 then 'author and institution counts differ' end as reject_reason from src) where reject_reason is not null group by 1
union all select 'malformed', count(distinct n // 100) from src where n // 100 % 17 = 0 having count(*) > 0""")
def f16(spark, d):
    """A cut-off page is one malformed row; the rest of the batch goes on."""
    parsed = providers.ndsl_papers(ndsl_pages(spark, d))
    return providers.rejected(parsed).groupBy("reject_reason").agg(F.count("*").alias("n_rows"))


@query("a23_reject_counts", SRC + """
select n // 100 as page, count(*) as n_read, 0 as n_failed, count(*) filter (where n % 10 = 0) as n_mismatched
from src where n // 100 % 17 <> 0 group by 1 union all
select distinct n // 100, 1, 1, 0 from src where n // 100 % 17 = 0""")
def a23(spark, d):
    return providers.reject_counts(providers.ndsl_papers(ndsl_pages(spark, d)), ["page"])


# ---- KCI --------------------------------------------------------------------------------------------------------------

def kci_pages(spark, d):
    rows = source_rows(spark, d)
    n = F.col("n")
    who = F.arrays_zip(F.split("author", ";").alias("name"), F.split("author_inst", ";").alias("inst"))
    authors = F.array_join(F.transform(who, lambda w: xml("author", w["name"], F.lit("("), w["inst"], F.lit(")"))), "")
    titles = F.concat(xml("article-title", F.lit("옛 제목"), lang=F.lit("original")),
                      F.when(n % 2 == 0, xml("article-title", F.lit("Former Title"), lang=F.lit("english"))).otherwise(""),
                      xml("article-title", F.lit("연료전지 "), text(n), lang=F.lit("original")),
                      F.when(n % 2 == 0, xml("article-title", F.lit("Fuel Cell "), F.col("o_orderstatus"), lang=F.lit("english"))).otherwise(""))
    abstracts = F.concat(xml("abstract", F.lit("요약 "), text(n), lang=F.lit("original")),
                         xml("abstract", F.lit("On Batteries "), text(n % 9), lang=F.lit("english")))
    record = xml(
        "record", xml("journalInfo", xml("journal-name", F.col("o_orderstatus")), xml("publisher-name", F.lit("Society")),
                      xml("pub-year", F.date_format("o_orderdate", "yyyy"))),
        xml("articleInfo", xml("title-group", titles), xml("abstract-group", abstracts), xml("author-group", authors),
            xml("citation-count", text(n % 50)), xml("fpage", text(n)), xml("lpage", text(n + 5)),
            article_id=F.concat(F.lit("ART"), text(n))))
    return pages(rows, record).select("page", xml(
        "MetaData", xml("outputData", xml("result", xml("total", F.lit("1"))), F.col("items"))).alias("payload"))


@query("p04_f02_f03_kci_papers", SRC + """
select 'ART' || n as id, '연료전지 ' || n as title, 'Fuel Cell ' || o_orderstatus as english_title,
 '요약 ' || n as abstract, 'On Batteries ' || n % 9 as english_abstract, author, author_inst, o_orderstatus as journal,
 'Society' as issue_inst, strftime(o_orderdate, '%Y') as issue_year, cast(n % 50 as bigint) as citation,
 cast(n as bigint) as start_page, cast(n + 5 as bigint) as end_page
from src where n % 2 = 0 and n % 9 <> 4""")
def p04(spark, d):
    """AND terms `fuel cell` (folded) and `연료전지`; the NOT term `Batteries 4` drops a ninth."""
    parsed = providers.kci_papers(kci_pages(spark, d), terms=["fuel CELL", "연료전지"], excluded=["Batteries 4"])
    return providers.accepted(parsed).drop("page", "paper_keyword", "issue_lang")


# ---- SCOPUS -----------------------------------------------------------------------------------------------------------

def scopus_cells(spark, d):
    rows = source_rows(spark, d)
    n = F.col("n")
    names = F.split("author", ";")
    affiliated = F.array_join(F.zip_with(names, F.split("author_inst", ";"), lambda a, i: F.concat(a, F.lit(", "), i)), "; ")
    cells = {
        "Authors": F.array_join(names, ", "),
        "Author(s) ID": F.when(n % 12 == 0, "No author id available").otherwise(F.concat(F.col("author_id"), F.lit(";"))),
        "Title": F.concat(F.lit('A "quoted" title\nof '), text(n), F.when(n % 2 == 0, ".").otherwise("")),
        "Year": F.date_format("o_orderdate", "yyyy"), "Source title": F.col("o_orderstatus"),
        "Page start": F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("S"), text(n))), "Page end": F.lit(""),
        "Cited by": F.when(n % 5 == 0, "").otherwise(text(n % 50)), "Link": F.lit("https://example.org"),
        "Affiliations": F.when(n % 2 == 0, F.col("author_inst")).otherwise(""), "Authors with affiliations": affiliated,
        "Abstract": F.lit("One, two; three"), "Author Keywords": F.col("o_orderstatus"), "Index Keywords": F.lit(""),
        "Funding Details": F.lit(""), "Funding Text 1": F.concat(F.lit("Grant "), text(n)),
        "Funding Text 2": F.when(n % 4 == 0, "More").otherwise(""), "Correspondence Address": F.lit(""),
        "Editors": F.lit(""), "Publisher": F.concat(F.lit("Press "), F.col("o_orderstatus")), "ISSN": F.lit("1234"),
        "Language of Original Document": F.when(n % 4 == 0, "Korean").otherwise("English"),
        "Abbreviated Source Title": F.lit("J."), "Document Type": F.lit("Article"), "Publication Stage": F.lit("Final"),
        "Source": F.lit("Scopus"), "EID": F.concat(F.lit("2-s2.0-"), text(n)),
    }
    return rows.select("n", *[c.alias(k) for k, c in cells.items()])


def scopus_folder(spark, d):
    folder = scratch_path(spark, "scopus")
    scopus_cells(spark, d).drop("n").write.option("maxRecordsPerFile", EXPORT).csv(folder, header=True, escape='"', emptyValue="")
    return folder


SCOPUS_SQL = """
select cast(n as varchar) as id, 'A "quoted" title' || chr(10) || 'of ' || n as title, replace(author, ';', '; ') as author, author_id,
 replace(author_inst, ';', '; ') as author_inst, case when n % 2 = 0 then author_inst else '' end as issue_inst,
 'Press ' || o_orderstatus as journal, strftime(o_orderdate, '%Y') as issue_year,
 case when n % 4 = 0 then 'Korean' else 'English' end as issue_lang,
 case when n % 3 = 0 then 0 else cast(n as bigint) end as start_page, 0 as end_page,
 case when n % 5 = 0 then 0 else cast(n % 50 as bigint) end as citation, o_orderstatus as paper_keyword,
 o_orderstatus as source_title, 'https://example.org' as link, 'One, two; three' as abstract, '1234' as "ISSN",
 'Press ' || o_orderstatus as publisher, 'J.' as abbreviated_source_title, 'Article' as document_type, 'Final' as publication_stage,
 'Scopus' as source, '' as english_title, '' as english_abstract, cast(null as varchar) as index_keywords,
 cast(null as varchar) as funding_details, cast(null as varchar) as correspondence_address, cast(null as varchar) as editors, """


@query("s04_s05_p05_p07_scopus_papers", SRC + SCOPUS_SQL + """
 'Grant ' || n || case when n % 4 = 0 then '|More' else '|' end as funding from src where n % 12 <> 0""")
def p05(spark, d):
    parsed = providers.scopus_papers(files.read_export(spark, scopus_folder(spark, d), providers.SCOPUS_COLUMNS))
    return scopus_fields(providers.accepted(parsed))


def scopus_fields(records):
    """Every field of the parser, the funding texts as one text."""
    return records.withColumn("funding", F.array_join("funding_text", "|")).drop("funding_text")


# ---- WOS --------------------------------------------------------------------------------------------------------------

MIXED = SCOPUS_SQL + """
 case n % 4 when 0 then '' when 1 then 'Grant ' || n when 2 then 'Grant ' || n || '|' else 'Grant ' || n || '||Third' end as funding
from src where n % 12 <> 0"""


def mixed_scopus_folder(spark, d):
    """Exports without, with one, two and three funding columns in one folder."""
    folder = scratch_path(spark, "mixed")
    cells = stored(scopus_cells(spark, d), "cells")  # four writes read it
    base = [c for c in cells.columns if c not in ("n", "Funding Text 1", "Funding Text 2")]
    at = base.index("Funding Details") + 1
    extra = [F.lit("Third").alias("Funding Text 3")]
    for kind in range(4):
        funding = [F.col("Funding Text 1"), F.lit("").alias("Funding Text 2"), *extra][:kind]
        cells.where(F.col("n") % 4 == kind).select(*[F.col(f"`{c}`") for c in base[:at]], *funding,
                                                 *[F.col(f"`{c}`") for c in base[at:]]).write.csv(
            f"{folder}/export{kind}", header=True, escape='"', emptyValue="")
    return folder


@query("s05_mixed_headers", SRC + MIXED)
def s05_mixed(spark, d):
    folder = f"{mixed_scopus_folder(spark, d)}/*"
    return scopus_fields(providers.accepted(providers.scopus_papers(files.read_export(spark, folder, providers.SCOPUS_COLUMNS))))


def landed_scopus(spark, d):
    """The same exports as they land, a few files at a time: accepted and rejected records and their counts."""
    out = scratch_path(spark, "landed_mixed")
    rows = files.landed_exports(spark, mixed_scopus_folder(spark, d), providers.SCOPUS_COLUMNS, per_trigger=3)
    run = jobs.land(providers.scopus_papers(rows), out, scratch_path(spark, "ck"))
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    return out


@query("s03_s05_landed_mixed_headers", SRC + MIXED)
def s05_landed(spark, d):
    return scopus_fields(spark.read.parquet(f"{landed_scopus(spark, d)}/records").drop("batch"))


@query("s03_f16_a23_landed_rejects", SRC + """
select cast(n as varchar) as id, 'no author' as reject_reason, count(*) over () as n_failed, (select count(*) from src) as n_read
from src where n % 12 = 0""")
def s03_rejects(spark, d):
    """Records that a landed export loses are stored with the reason, and counted."""
    out = landed_scopus(spark, d)
    counts = spark.read.parquet(f"{out}/counts").agg(F.sum("n_read").alias("n_read"), F.sum("n_failed").alias("n_failed")).first()
    lost = spark.read.parquet(f"{out}/rejected").select("id", "reject_reason")
    return lost.withColumns({"n_read": F.lit(counts["n_read"]), "n_failed": F.lit(counts["n_failed"])})


def wos_cells(spark, d):
    rows = source_rows(spark, d)
    n = F.col("n")
    names, insts = F.split("author", ";"), F.split("author_inst", ";")
    listed = F.zip_with(names, insts, lambda a, i: F.concat(F.lit("["), a, F.lit("] "), i))
    short = F.when(n % 6 == 0, F.slice(listed, F.lit(1), F.size(listed) - 1)).otherwise(listed)
    year = F.date_format("o_orderdate", "yyyy")
    at = {
        5: F.array_join(names, "; "), 8: F.concat(F.lit("Title "), text(n)), 9: F.col("o_orderstatus"), 12: F.lit("English"),
        20: F.lit("plus"), 21: F.lit("An abstract"), 22: F.array_join(F.reverse(short), "; "),
        25: F.when(n % 2 == 0, F.concat(F.element_at(names, -1), F.lit("/R-"), text(n))).otherwise(""),
        26: F.when(n % 3 == 0, F.concat(F.element_at(names, 1), F.lit("/O-"), text(n))).otherwise(""),
        30: F.concat(text(n % 50), F.when(n % 2 == 0, ".0").otherwise("")),
        34: F.when(n % 7 == 0, "").otherwise(F.concat(text(n % 7), F.when(n % 3 == 0, ".0").otherwise(""))),
        35: F.lit("Venue"), 41: F.lit("Publisher"),
        44: F.when(n % 3 == 0, F.concat(year, F.when(n % 2 == 0, ".0").otherwise(""))).otherwise(""),
        51: F.when(n % 4 == 0, F.concat(text(n), F.lit(".0"))).otherwise(F.concat(F.lit("E"), text(n))), 52: F.lit(""),
        56: F.when(n % 3 == 1, year).otherwise(F.concat(F.lit("APR "), year)),
        59: F.when(n % 2 == 0, "Energy").otherwise(""), 61: F.concat(F.lit("WOS:"), F.lpad(text(n), 12, "0")),
    }
    return rows.select(*[at.get(i, F.lit("")).alias(f"c{i}") for i in range(providers.WOS_WIDTH)])


def wos_folder(spark, d):
    folder = scratch_path(spark, "wos")
    wos_cells(spark, d).write.csv(folder, header=True, sep="\t", emptyValue="")
    return folder


WOS_SQL = SRC + """
select lpad(cast(n as varchar), 12, '0') as id, 'Title ' || n as title, replace(author, ';', '; ') as author,
 case when n % 6 = 0 then '' else author_inst end as author_inst,
 strftime(o_orderdate, '%Y') as issue_year, cast(n as bigint) as start_page, 0 as end_page,
 cast(n % 50 as bigint) as citation, case when n % 7 = 0 then 1 else cast(n % 7 as bigint) end as usage_count,
 case when n % 2 = 0 then 'Energy' else 'plus' end as paper_keyword,
 repeat(';', len(string_split(author, ';')) - 1) || case when n % 2 = 0 then 'R-' || n else '' end as r_id,
 case when n % 3 = 0 then 'O-' || n else '' end || repeat(';', len(string_split(author, ';')) - 1) as o_id,
 o_orderstatus as source_title, 'Publisher' as journal, 'Venue' as issue_inst, 'English' as issue_lang, 'An abstract' as abstract,
 '' as english_title, '' as english_abstract, '' as author_keyword
from src where n % 6 <> 0 or not contains(author, ';')"""
WOS_FIELDS = ["id", "title", "author", "author_inst", "issue_year", "start_page", "end_page", "citation", "usage_count",
              "paper_keyword", "r_id", "o_id", "source_title", "journal", "issue_inst", "issue_lang", "abstract", "english_title",
              "english_abstract", "author_keyword"]


@query("s06_p06_r04_wos_papers", WOS_SQL)
def p06(spark, d):
    """Every sixth record lacks an institution: rejected, unless it has one author and no address at all. The id
    entry belongs to the last author."""
    parsed = providers.wos_papers(files.read_positional(spark, wos_folder(spark, d), providers.WOS_WIDTH))
    return providers.accepted(parsed).select(*WOS_FIELDS)


# ---- tags, progress ---------------------------------------------------------------------------------------------------

@query("p08_query_tags", """select o_orderpriority as key_id, o_orderkey as id, 'fuel cell' as "qryKeyword",
 strftime(o_orderdate, '%Y-%m-%dT%H:%M') as "qryTime" from orders""")
def p08(spark, d):
    orders = D.table(spark, d, "orders").withColumn("id", F.col("o_orderkey"))
    return providers.tagged(orders, F.col("o_orderpriority"), "fuel cell", F.col("o_orderdate")).select(
        "key_id", "id", "qryKeyword", "qryTime")


def orders_by_key(spark, d):
    return D.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("key_id"), F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"))


@query("p09_progress", """
select key_id, id, round(case when p >= 1 then 0.99 else p end, 6) as progress from (select o_orderpriority as key_id, o_orderkey as id,
 row_number() over (partition by o_orderpriority order by o_orderkey) / count(*) over (partition by o_orderpriority) as p from orders)""")
def p09(spark, d):
    rows = providers.with_progress(orders_by_key(spark, d), ["key_id"], [F.col("id")])
    return rows.select("key_id", "id", r6("progress").alias("progress"))


@query("p10_yearly_progress", """
select key_id, id, round(case when p >= 1 then 0.99 else p end, 6) as progress from (
 select o_orderpriority as key_id, o_orderkey as id, (year(o_orderdate) - 1995) / 7
  + (row_number() over (partition by o_orderpriority, year(o_orderdate) order by o_orderkey))
   / count(*) over (partition by o_orderpriority, year(o_orderdate)) / 7 as p from orders)""")
def p10(spark, d):
    rows = providers.with_yearly_progress(orders_by_key(spark, d), ["key_id"], "year", [F.col("id")], 1995, 2001)
    return rows.select("key_id", "id", r6("progress").alias("progress"))


# ---- tables and messages ------------------------------------------------------------------------------------------------

@query("s02_messages_round_trip", VIEWS + """
select 'SITE' as site, key_id, cast(paper_id as varchar) as id, author, author_id, author_inst from institutions""")
def s02(spark, d):
    """Records to JSON and back, as they pass a topic."""
    rows = D.author_institutions(spark, d).select(
        F.lit("SITE").alias("site"), "key_id", F.col("paper_id").cast("string").alias("id"), "author", "author_id", "author_inst")
    sent = messages.as_messages(rows).select("topic", F.col("value").cast("binary"), F.lit(0).cast("long").alias("offset"))
    return messages.topic_rows(sent).select("site", "key_id", "id", "author", "author_id", "author_inst")


@query("s11_s13_stored_records", VIEWS + """
select site, key_id, paper_id, author_id, author, author_inst from institutions, (values ('A'), ('B')) sites(site)
where site = 'A' or paper_id % 3 = 0""")
def s11(spark, d):
    """Two providers store records of the same queries, in two appends."""
    path = scratch_path(spark, "rawdata")
    rows = D.author_institutions(spark, d)
    both = rows.withColumn("site", F.lit("A")).union(rows.where("paper_id % 3 = 0").withColumn("site", F.lit("B")))
    for half in (F.col("paper_id") % 2 == 0, F.col("paper_id") % 2 == 1):
        tables.append_records(both.where(half), path)
    return tables.load(spark, path)


@query("s13_author_papers", with_views(AUTHOR_PAPER) + "select key_id, a_id, paper_id, pos, n_authors from author_paper")
def s13(spark, d):
    path = scratch_path(spark, "author_paper")
    rows = D.author_paper(spark, d)
    for half in (F.col("paper_id") % 2 == 0, F.col("paper_id") % 2 == 1):
        tables.append_author_papers(rows.where(half), path)
    return tables.load(spark, path)


@query("s12_stored_factors", factor_sql() + f"""
select 'A' as site, {NORMALISED} from ungated join tops using (key_id)
union all select 'B', {NORMALISED} from ungated join tops using (key_id) where key_id < '3'""")
def s12(spark, d):
    """Two providers store the factors of the same queries, one of them twice: that replaces its own rows only."""
    path = scratch_path(spark, "factors")
    rows = stored(normalised_papers(spark, d), "scored")
    tables.store_factors(rows.withColumn("site", F.lit("A")), path)
    tables.store_factors(rows.where("key_id < '3'").withColumn("site", F.lit("B")).withColumn("quality", F.lit(0.0)), path)
    tables.store_factors(rows.where("key_id < '3'").withColumn("site", F.lit("B")), path)
    return rounded(tables.load(spark, path))
