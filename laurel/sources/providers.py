"""Provider payloads to common records: one projection per provider.

Every parser keeps all rows and adds `reject_reason` (NULL: accepted), so a bad row never stops a batch and rejects
can be stored and counted with `accepted`, `rejected` and `reject_counts`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laurel.functions import multivalue as R
from laurel.functions import text as X
from laurel.operators.identifiers import with_all_aligned_ids
from laurel.operators.numbering import number_rows
from laurel.operators.search import every_term, known_author, no_term
from laurel.schemas import PAPER
from laurel.sources.files import parse_jsonp, parse_xml

# ---- fixed values: field maps of the providers ------------------------------------------------------------------------

NTIS_HIT = """ProjectNumber string, ProjectTitle struct<Korean: string, English: string>,
 Manager struct<Name: string, HumanID: string>,
 Researchers struct<Name: string, HumanID: string, ManCount: string, WomanCount: string>,
 Goal struct<Full: string>, Abstract struct<Full: string>, Effect struct<Full: string>,
 Keyword struct<Korean: string, English: string>, OrderAgency struct<Name: string>, LeadAgency string,
 ProjectPeriod struct<Start: string, End: string>,
 MinistryScienceClass struct<Large: string, Medium: string, Small: string>,
 PerformAgent struct<_code: string, _VALUE: string>, Region string, TotalFunds string"""

DBPIA_ITEM = """title string, authors struct<author: array<struct<name: string, url: string>>>,
 publication struct<name: string>, publisher struct<name: string>, pages string, link_url string,
 dreg_name string, issue struct<yymm: string>"""
DBPIA_PAGE = f"result struct<items: struct<item: array<struct<{DBPIA_ITEM}>>>>"

NDSL_PAGE = """resultSummary struct<totalCount: string>, outputData array<struct<
 journalInfo: struct<publisher: string, journalTitleInfo: array<string>, year: string>,
 articleInfo: struct<`@kistiID`: string, articleTitleInfo: struct<articleTitle: string, articleTitle2: string>,
  abstractInfo: array<string>, authorInfo: struct<author: string, affiliation: string>, page: string,
  keyword: string>>>"""

KCI_PAGE = """outputData struct<result: struct<total: string>, record: array<struct<
 journalInfo: struct<`journal-name`: string, `publisher-name`: string, `pub-year`: string>,
 articleInfo: struct<`_article-id`: string, `citation-count`: string, fpage: string, lpage: string,
  `title-group`: struct<`article-title`: array<struct<_lang: string, _VALUE: string>>>,
  `abstract-group`: struct<abstract: array<struct<_lang: string, _VALUE: string>>>,
  `author-group`: struct<author: array<string>>>>>>"""

SCOPUS_COLUMNS = {
    "id": "EID", "title": "Title", "author": "Authors", "journal": "Publisher", "issue_inst": "Affiliations",
    "issue_year": "Year", "issue_lang": "Language of Original Document", "start_page": "Page start",
    "end_page": "Page end", "paper_keyword": "Author Keywords", "abstract": "Abstract",
    "author_inst": "Authors with affiliations", "author_id": "Author(s) ID", "citation": "Cited by", "link": "Link",
    "source_title": "Source title", "index_keywords": "Index Keywords", "funding_details": "Funding Details",
    "correspondence_address": "Correspondence Address", "editors": "Editors", "publisher": "Publisher",
    "ISSN": "ISSN", "abbreviated_source_title": "Abbreviated Source Title", "document_type": "Document Type",
    "publication_stage": "Publication Stage", "source": "Source",
}

WOS_WIDTH = 62
WOS_POSITIONS = {
    "author": 5, "title": 8, "source_title": 9, "issue_lang": 12, "author_keyword": 19, "keyword_plus": 20,
    "abstract": 21, "address": 22, "researcher_ids": 25, "orcids": 26, "times_cited": 30, "usage": 34,
    "issue_inst": 35, "journal": 41, "year": 44, "first_page": 51, "last_page": 52, "early_access": 56,
    "category": 59, "id": 61,
}


# ---- accepted, rejected -------------------------------------------------------------------------------------------------

def reject(*rules: tuple[str, Column]) -> Column:
    """The first reason whose test is not true; NULL when all are."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), reason) for reason, ok in rules])


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNotNull())


def reject_counts(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows read, rows that failed to parse, rows with unequal author and institution counts."""
    reason = F.col("reject_reason")
    return parsed.groupBy(*keys).agg(
        F.count("*").alias("n_read"),
        F.count_if(reason.isNotNull() & (reason != "author and institution counts differ")).alias("n_failed"),
        F.count_if(reason == "author and institution counts differ").alias("n_mismatched"))


def conform(df: DataFrame, ddl: str = PAPER) -> DataFrame:
    """The columns of a record kind in order; what a provider does not send is NULL. Other columns follow."""
    wanted = T.StructType.fromDDL(ddl)
    have = set(df.columns)
    cols = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in wanted]
    return df.select(*cols, *[c for c in df.columns if c not in wanted.fieldNames()])


# ---- tags and progress ----------------------------------------------------------------------------------------------------

def tagged(df: DataFrame, key_id, keyword: str, at: Column) -> DataFrame:
    """Adds the query id, its keyword and the time of the query (ISO minutes)."""
    return (
        df.withColumn("key_id", key_id if isinstance(key_id, Column) else F.lit(key_id))
        .withColumn("qryKeyword", F.lit(keyword))
        .withColumn("qryTime", F.date_format(at, "yyyy-MM-dd'T'HH:mm"))
    )


def with_progress(df: DataFrame, keys: Sequence[str], order: Sequence[Column], top: float = 0.99) -> DataFrame:
    """Adds `progress`: the record's place / total of the query, at most `top` once it reaches 1."""
    share = F.col("_rn") / F.col("_of")
    return (
        number_rows(df, keys, order, "_rn", "_of")
        .withColumn("progress", F.when(share >= 1, top).otherwise(share)).drop("_rn", "_of")
    )


def with_yearly_progress(df: DataFrame, keys: Sequence[str], year: str, order: Sequence[Column], first: int,
                         last: int, top: float = 0.99) -> DataFrame:
    """Progress over a search year by year: years done / years + place in the year / total of the year / years."""
    span = last - first + 1
    share = (F.col(year) - first) / span + F.col("_rn") / F.col("_of") / span
    return (
        number_rows(df, [*keys, year], order, "_rn", "_of")
        .withColumn("progress", F.when(share >= 1, top).otherwise(share)).drop("_rn", "_of")
    )


# ---- providers ------------------------------------------------------------------------------------------------------------

def ntis_projects(hits: DataFrame) -> DataFrame:
    """HIT elements to project records."""
    clean = X.strip_markup
    c = F.col
    return hits.select(
        c("ProjectNumber").alias("id"),
        clean(c("ProjectTitle.Korean")).alias("koTitle"), clean(c("ProjectTitle.English")).alias("enTitle"),
        clean(c("Manager.Name")).alias("mng"), c("Manager.HumanID").alias("mngId"),
        clean(c("Researchers.Name")).alias("rsc"), c("Researchers.HumanID").alias("rscId"),
        c("Researchers.ManCount").alias("cntRscMan"), c("Researchers.WomanCount").alias("cntRscWom"),
        clean(c("Goal.Full")).alias("goalAbs"), clean(c("Abstract.Full")).alias("absAbs"),
        clean(c("Effect.Full")).alias("effAbs"),
        clean(c("Keyword.Korean")).alias("koKeyword"), clean(c("Keyword.English")).alias("enKeyword"),
        clean(c("OrderAgency.Name")).alias("odAgency"), clean(c("LeadAgency")).alias("ldAgency"),
        c("ProjectPeriod.Start").alias("prdStart"), c("ProjectPeriod.End").alias("prdEnd"),
        c("MinistryScienceClass.Large").alias("mscL"), c("MinistryScienceClass.Medium").alias("mscM"),
        c("MinistryScienceClass.Small").alias("mscS"),
        F.struct(c("PerformAgent._code").alias("code"), c("PerformAgent._VALUE").alias("value")).alias("perfAgent"),
        c("Region").alias("region"), c("TotalFunds").alias("totalFund"), F.lit(False).alias("is_partial"),
        reject(("malformed", c("ProjectNumber").isNotNull())).alias("reject_reason"),
    )


def dbpia_papers(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """XML pages to paper records. A page that cannot be parsed stays as one rejected row."""
    items = pages.withColumn("_page", parse_xml(F.col(payload), DBPIA_PAGE)).drop(payload)
    p = F.col
    rows = items.select(*[c for c in items.columns if c != "_page"],
                        F.explode_outer("_page.result.items.item").alias("i"))
    plain = X.strip_tags(p("i.title"))
    has_pages = p("i.pages").isNotNull()
    two_pages = ~has_pages | (F.size(F.regexp_extract_all("i.pages", F.lit(r"(\d+)"), F.lit(1))) >= 2)
    return rows.select(
        *[c for c in rows.columns if c != "i"],
        X.node_id(p("i.link_url")).alias("id"), plain.alias("title"),
        F.array_join(F.transform("i.authors.author", lambda a: a["name"]), ";").alias("author"),
        F.array_join(F.transform("i.authors.author", lambda a: X.joined_digit_runs(a["url"])), ";").alias("author_id"),
        F.coalesce("i.publication.name", "i.publisher.name").alias("journal"),
        p("i.publisher.name").alias("issue_inst"),
        F.when(has_pages, X.digit_run(p("i.pages"), 0)).otherwise(F.lit(0).cast("long")).alias("start_page"),
        F.when(has_pages, X.digit_run(p("i.pages"), 1)).otherwise(F.lit(0).cast("long")).alias("end_page"),
        X.registry_name(p("i.dreg_name")).alias("dreg_name"), p("i.issue.yymm").alias("issue_year"),
        X.language(plain).alias("issue_lang"), F.lit(0).cast("long").alias("citation"),
        reject(("malformed", p("i").isNotNull()), ("no author", F.size("i.authors.author") > 0),
               ("no author id", ~F.exists("i.authors.author", lambda a: F.coalesce(X.joined_digit_runs(a["url"]), F.lit("")) == "")),
               ("no record id", p("i.link_url").contains("NODE")), ("no page numbers", two_pages)).alias("reject_reason"),
    )


def _texts(c: Column) -> Column:
    """A JSON value that is one string or a list of {"#text": ...}, as an array of strings."""
    many = F.from_json(c, "array<struct<`#text`: string>>")
    return F.when(c.startswith("["), F.filter(F.transform(many, lambda x: x["#text"]), lambda t: t.isNotNull())).when(
        c != "", F.array(c)).otherwise(F.array().cast("array<string>"))


def ndsl_papers(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """JSONP pages to paper records; names and institutions must agree in number."""
    parsed = pages.withColumn("_page", parse_jsonp(F.col(payload), NDSL_PAGE)).drop(payload)
    rows = parsed.select(*[c for c in parsed.columns if c != "_page"], F.explode_outer("_page.outputData").alias("d"))
    a = "d.articleInfo"
    rows = rows.withColumn("names", _texts(F.col(f"{a}.authorInfo.author"))).withColumn(
        "insts", F.transform(_texts(F.col(f"{a}.authorInfo.affiliation")),
                             lambda t: X.strip_markup(X.drop_affiliation_codes(t))))
    title = X.strip_markup(F.col(f"{a}.articleTitleInfo.articleTitle"))
    pages_of = X.page_range(F.col(f"{a}.page"))
    return rows.select(
        *[c for c in rows.columns if c not in ("d", "names", "insts")],
        F.col(f"{a}.`@kistiID`").alias("id"), title.alias("title"),
        X.strip_markup(F.col(f"{a}.articleTitleInfo.articleTitle2")).alias("english_title"),
        X.strip_markup(F.get(f"{a}.abstractInfo", F.lit(0))).alias("abstract"), F.lit("").alias("english_abstract"),
        R.emit(F.col("names")).alias("author"), R.emit(F.col("insts")).alias("author_inst"),
        F.get("d.journalInfo.journalTitleInfo", F.lit(0)).alias("journal"),
        F.col("d.journalInfo.publisher").alias("issue_inst"), F.col("d.journalInfo.year").alias("issue_year"),
        X.language(title).alias("issue_lang"), F.lit(0).cast("long").alias("citation"),
        X.digits_only(pages_of["start"]).alias("start_page"), X.digits_only(pages_of["end"]).alias("end_page"),
        F.col(f"{a}.keyword").alias("paper_keyword"),
        reject(("malformed", F.col("d").isNotNull()),
               ("author and institution counts differ", R.both_filled(F.col("names"), F.col("insts")))).alias("reject_reason"),
    )


def kci_papers(pages: DataFrame, payload: str = "payload", terms: Sequence[str] = (), excluded: Sequence[str] = ()):
    """XML pages to paper records, filtered by the remaining AND terms and the NOT terms of the query."""
    parsed = pages.withColumn("_page", parse_xml(F.col(payload), KCI_PAGE)).drop(payload)
    rows = parsed.select(*[c for c in parsed.columns if c != "_page"],
                         F.explode_outer("_page.outputData.record").alias("r"))
    a = "r.articleInfo"
    rows = (
        rows.withColumn("titles", F.col(f"{a}.`title-group`.`article-title`")["_VALUE"])
        .withColumn("abstracts", F.transform(f"{a}.`abstract-group`.abstract", lambda x: F.struct(
            x["_lang"].alias("lang"), x["_VALUE"].alias("text"))))
        .withColumn("people", R.name_inst_pairs(F.col(f"{a}.`author-group`.author")))
    )
    texts = [F.array_join("titles", "\n"), F.array_join(F.col("abstracts")["text"], "\n")]
    return rows.select(
        *[c for c in rows.columns if c not in ("r", "titles", "abstracts", "people")],
        F.col(f"{a}.`_article-id`").alias("id"),
        X.title_in(F.col("titles"), "kor").alias("title"), X.title_in(F.col("titles"), "eng").alias("english_title"),
        X.tagged_text(F.col("abstracts"), "original").alias("abstract"),
        X.tagged_text(F.col("abstracts"), "english", "foreign").alias("english_abstract"),
        F.lit("").alias("paper_keyword"),
        R.emit(F.col("people")["name"]).alias("author"), R.emit(F.col("people")["inst"]).alias("author_inst"),
        F.col("r.journalInfo.`journal-name`").alias("journal"),
        F.col("r.journalInfo.`publisher-name`").alias("issue_inst"),
        F.col("r.journalInfo.`pub-year`").alias("issue_year"), F.lit("kor").alias("issue_lang"),
        X.digits_only(F.col(f"{a}.`citation-count`")).alias("citation"),
        X.digits_only(F.col(f"{a}.fpage")).alias("start_page"), X.digits_only(F.col(f"{a}.lpage")).alias("end_page"),
        reject(("malformed", F.col("r").isNotNull()), ("excluded term", no_term(texts, excluded)),
               ("missing term", every_term(texts, terms)), ("no author", F.size("people") > 0)).alias("reject_reason"),
    )


def scopus_papers(export: DataFrame) -> DataFrame:
    """Exports read by the headers of SCOPUS_COLUMNS (see `files.read_export`) to paper records."""
    raw = export.select(*SCOPUS_COLUMNS, "funding_text")
    filled = {c: F.coalesce(F.col(c), F.lit("")) for c in ("author", "author_inst", "author_id", "issue_inst",
                                                          "paper_keyword")}
    author = R.comma_to_semicolon(filled["author"])
    changed = {
        "id": X.drop_text(F.col("id"), "2-s2.0-"),
        "title": X.drop_last_symbol(F.col("title")),
        "author": author,
        "author_id": R.drop_final_separator(filled["author_id"]),
        "author_inst": R.institutions_without_names(author, filled["author_inst"]),
        "issue_inst": filled["issue_inst"], "paper_keyword": filled["paper_keyword"],
        "citation": X.digits_only(F.coalesce("citation", F.lit(""))),
        "start_page": X.digits_only(F.coalesce("start_page", F.lit(""))),
        "end_page": X.digits_only(F.coalesce("end_page", F.lit(""))),
    }
    return raw.select(
        *[changed.get(c, F.col(c)).alias(c) for c in raw.columns],
        F.lit("").alias("english_title"), F.lit("").alias("english_abstract"),
        reject(("malformed", F.col("id").isNotNull() & (F.col("title") != "")),
               ("no author", known_author(F.col("author_id"), F.col("author")))).alias("reject_reason"),
    )


def wos_papers(export: DataFrame) -> DataFrame:
    """A positional export to paper records with ids aligned to the authors."""
    raw = export.select(*[F.col(f"c{i}").alias(f) for f, i in WOS_POSITIONS.items()])
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    matched = with_all_aligned_ids(raw.withColumn("author", blank("author")), "author", {
        "r_id": "researcher_ids", "o_id": "orcids"}).withColumn(
        "insts", R.bracketed_institutions(F.col("author"), blank("address")))
    usage = X.whole_number(F.col("usage"), 1)
    return matched.select(
        X.drop_text(F.col("id"), "WOS:").alias("id"), "title", F.lit("").alias("english_title"), "abstract",
        F.lit("").alias("english_abstract"), "author", R.emit(F.col("insts")).alias("author_inst"),
        "source_title", "journal", "issue_inst", "issue_lang",
        X.export_year(F.col("year"), F.col("early_access")).cast("string").alias("issue_year"),
        X.page_number(blank("first_page")).alias("start_page"), X.page_number(blank("last_page")).alias("end_page"),
        X.whole_number(F.col("times_cited")).alias("citation"),
        F.when(usage == 0, 1).otherwise(usage).alias("usage_count"),
        blank("author_keyword").alias("author_keyword"),
        F.coalesce(X.fold_null(F.col("category")), F.col("keyword_plus"), F.lit("")).alias("paper_keyword"),
        "r_id", "o_id",
        reject(
            ("malformed", F.col("id").isNotNull()),
            ("author and institution counts differ",
             R.let(F.col("insts"), lambda insts: R.same_size(F.split("author", ";"), insts) & ~F.exists(
                 insts, lambda i: i.isNull()))),
            ("no year", X.export_year(F.col("year"), F.col("early_access")).isNotNull()),
        ).alias("reject_reason"),
    )


PARSERS = {"NTIS": ntis_projects, "DBPIA": dbpia_papers, "SCIENCEON": ndsl_papers, "KCI": kci_papers,
           "SCOPUS": scopus_papers, "WOS": wos_papers}
