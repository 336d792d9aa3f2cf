"""Author resolution: provider ids or (name, institution) to stable author ids.

Lookups are equi-joins against one row per author or (name, institution): broadcast where that side is small by its
statistics, else a sort-merge join, in which AQE splits the partition of an author with very many mentions. New ids
are derived from (name, institution), so no counter and no order of arrival is needed.

`scope` names columns that come before every key, such as the provider: tables then hold the records and authors of
several providers side by side, and nothing of one is looked up in another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions import multivalue as R
from laurel.functions import text as X
from laurel.operators.dedup import first_per_key
from laurel.operators.graph import connected
from laurel.operators.namesakes import meet
from laurel.operators.search import performed_by, real_name
from laurel.session import stored

CELL = 6_000_000  # listings with the co-authors of a cell, which a task holds as numbers
HUB = 50_000  # listings of a co-author who is left out of the cells


def surrogate_id(name: Column, inst: Column) -> Column:
    """A stable id for an author without a provider id."""
    return F.concat(F.lit("s"), F.left(F.md5(F.concat(name, F.lit("\x01"), inst)), F.lit(16)))


def by_name_inst(refs: DataFrame, authors: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Adds `a_id` (NULL if unknown) to refs (name, inst, ...). Of several authors the smallest id wins."""
    known = authors.groupBy(*scope, "name", "inst").agg(F.min("a_id").alias("a_id"))
    return refs.join(known, [*scope, "name", "inst"], "left")


def by_id(refs: DataFrame, authors: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Adds the stored name and institution of `a_id` as `known_name`, `known_inst`."""
    known = authors.select(*scope, "a_id", F.col("name").alias("known_name"), F.col("inst").alias("known_inst"))
    return refs.join(known, [*scope, "a_id"], "left")


def new_authors(refs: DataFrame, authors: DataFrame) -> DataFrame:
    """Author rows with new ids for the (name, inst) that no author has."""
    unknown = refs.select("name", "inst").distinct().join(authors, ["name", "inst"], "left_anti")
    return unknown.select(surrogate_id(F.col("name"), F.col("inst")).alias("a_id"), "name", "inst")


def missing_authors(refs: DataFrame, authors: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Rows for ids not stored yet: the first (name, inst) by `seq` per id."""
    key = [*scope, "a_id"]
    first = refs.groupBy(*key).agg(F.min(F.struct("seq", "name", "inst")).alias("_first"))
    return first.join(authors.select(*key), key, "left_anti").select(*key, "_first.name", "_first.inst")


def with_latest_inst(authors: DataFrame, updates: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Stored authors with the institution of their latest update, where there is one."""
    key = [*scope, "a_id"]
    latest = updates.groupBy(*key).agg(F.max(F.struct("seq", "inst")).alias("_last"))
    return (
        authors.join(latest, key, "left")
        .withColumn("inst", F.coalesce("_last.inst", "inst"))
        .drop("_last")
    )


def resolve(refs: DataFrame, authors: DataFrame) -> DataFrame:
    """Adds `a_id` to refs (name, inst): the stored id, else a new one."""
    return by_name_inst(refs, authors).withColumn(
        "a_id", F.coalesce("a_id", surrogate_id(F.col("name"), F.col("inst"))))


def pending_provider_authors(refs: DataFrame, authors: DataFrame) -> DataFrame:
    """New authors with a provider id but no institution yet, marked for a later look-up."""
    return missing_authors(refs, authors).withColumn("has_inst", F.lit(False))


# ---- papers ---------------------------------------------------------------------------------------------------------

def refusal() -> Column:
    """Why a paper is not stored: it has no authors, or its id list differs in length from its names. Else NULL."""
    ids, names = F.split("author_id", ";"), F.split("author", ";")
    return F.when(F.col("author").isNull(), "no author").when(
        F.col("author_id").isNotNull() & (F.size(ids) != F.size(names)), "author and id counts differ")


def paper_authors(papers: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One row per listed author of a paper: (key_id, id, pos, n_authors, name, inst, provider_id).

    Names and institutions pair up to the shorter list, whose length is `n_authors`; without institutions every name
    has ''. Refused papers (see `refusal`) have no rows. A blank provider id is none.
    """
    names = F.split("author", ";")
    trimmed = R.items(F.col("author"))
    ids = F.split("author_id", ";")
    insts = R.institution_list(F.col("author_inst"))
    no_inst = F.col("author_inst").isNull() | (F.col("author_inst") == "")
    blank = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("").alias("inst")))
    people = F.when(no_inst, blank).otherwise(R.paired(trimmed, insts))
    return papers.where(refusal().isNull()).select(
        *scope, "key_id", "id", F.size(people).alias("n_authors"), "author_id", F.posexplode(people).alias("pos", "person")).select(
        *scope, "key_id", "id", "pos", "n_authors", "person.name", "person.inst",
        X.fold_null(F.trim(F.get(ids, F.col("pos")))).alias("provider_id"))


def resolve_papers(papers: DataFrame, authors: DataFrame, scope: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(listing, authors): every listed author with an id, and the author table with the new rows.

    A provider id is the id; others are found by (name, institution) or get a new id.
    """
    resolved = resolved_papers(papers, authors, scope)
    return resolved, grown(resolved, authors, scope)


def resolved_papers(papers: DataFrame, authors: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The listing of `resolve_papers`."""
    return by_name_inst(paper_authors(papers, scope), authors, scope).withColumn(
        "a_id", F.coalesce("provider_id", "a_id", surrogate_id(F.col("name"), F.col("inst")))
    ).drop("provider_id")


def grown(resolved: DataFrame, authors: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The authors of `resolve_papers`, from its listing, which may be stored."""
    refs = resolved.withColumn("seq", F.lit(0))
    return authors.select(*scope, "a_id", "name", "inst").unionByName(missing_authors(refs, authors, scope))


def listed_ids(resolved: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Author ids and names written back to the paper in listed order, as `;` lists. One group is one author list."""
    people = F.sort_array(F.collect_list(F.struct("pos", "a_id", "name", "inst")))
    return resolved.groupBy(*scope, "key_id", "id").agg(people.alias("p")).select(
        *scope, "key_id", "id",
        R.emit(F.col("p")["a_id"]).alias("author_id"),
        R.emit(F.col("p")["name"]).alias("author"),
        R.emit(F.col("p")["inst"]).alias("author_inst"),
        F.size("p").alias("n_authors"),
    )


# ---- projects -------------------------------------------------------------------------------------------------------

def project_managers(projects: DataFrame, authors: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Projects of agent code 03 with the manager's id: the listed one without its prefix, else by (name, lead
    agency), else a new one; without an id, a name and a lead agency are both needed. Columns: key_id, id, name, inst, a_id."""
    rows = projects.where(performed_by(F.col("perfAgent.code"))).select(
        *scope, "key_id", "id",
        F.col("mng").alias("name"),
        X.strip_highlight(F.col("ldAgency"), leading_space=True).alias("inst"),
        X.fold_null(X.person_id(X.fold_null(F.col("mngId")))).alias("listed_id"),
    ).where(F.col("listed_id").isNotNull() | (F.col("name").isNotNull() & F.col("inst").isNotNull()))
    return by_name_inst(rows, authors, scope).withColumn(
        "a_id", F.coalesce("listed_id", "a_id", surrogate_id(F.col("name"), F.col("inst")))).drop("listed_id")


def project_researchers(projects: DataFrame, authors: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Researchers of those projects with an id: a known id keeps the stored name and institution, an unknown one
    takes the listed name and the lead agency. Columns: key_id, id, pos, a_id, name, inst."""
    rows = projects.where(performed_by(F.col("perfAgent.code")) & F.col("rsc").isNotNull() & F.col("rscId").isNotNull())
    quoteless = lambda c: F.split(F.replace(c, F.lit('"'), F.lit("")), ";")
    listed = rows.select(
        *scope, "key_id", "id", quoteless(F.col("rsc")).alias("names"),
        X.strip_highlight(F.col("ldAgency"), leading_space=True).alias("lead"),
        F.posexplode(quoteless(F.col("rscId"))).alias("pos", "listed_id"),
    ).where(~F.col("listed_id").isin("없음", "null")).select(
        *scope, "key_id", "id", "pos", "lead", X.person_id(F.col("listed_id")).alias("a_id"),
        X.strip_highlight(F.get("names", F.col("pos"))).alias("listed_name"))
    found = by_id(listed, authors, scope)
    keep = F.col("known_name").isNotNull() | F.coalesce(real_name(F.col("listed_name")), F.lit(False))
    return found.where(keep).select(
        *scope, "key_id", "id", "pos", "a_id",
        F.coalesce("known_name", "listed_name").alias("name"),
        F.when(F.col("known_name").isNotNull(), F.col("known_inst")).otherwise(F.col("lead")).alias("inst"))


def resolve_projects(projects: DataFrame, authors: DataFrame, distinct: bool = False,
                     scope: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(listing, authors): manager (pos -1) and researchers of every project, and the author table afterwards.

    A person who is both is listed twice, unless `distinct`, which keeps the first listing. A known manager takes the
    lead agency as institution, unknown people are added. `projects` needs `seq`, the order of arrival.
    """
    listing = resolved_projects(projects, authors, distinct, scope)
    arrival = projects.select(*scope, "key_id", "id", "seq").hint("merge")  # wide rows look smaller than they are
    return listing, after_projects(listing.join(arrival, [*scope, "key_id", "id"]), authors, scope)


def resolved_projects(projects: DataFrame, authors: DataFrame, distinct: bool = False,
                      scope: Sequence[str] = ()) -> DataFrame:
    """The listing of `resolve_projects`."""
    record = [*scope, "key_id", "id"]
    managers = project_managers(projects, authors, scope).withColumn("pos", F.lit(-1))
    columns = [*record, "pos", "a_id", "name", "inst"]
    listing = managers.select(*columns).unionByName(project_researchers(projects, authors, scope).select(*columns))
    return first_per_key(listing, [*record, "a_id"], ["pos"]) if distinct else listing


def after_projects(listing: DataFrame, authors: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The authors of `resolve_projects`, from its listing with `seq`, which may be stored."""
    moved = with_latest_inst(authors.select(*scope, "a_id", "name", "inst"), listing.where(F.col("pos") == -1), scope)
    return moved.unionByName(missing_authors(listing, authors, scope))


def listed_people(listing: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Manager and researchers written back to the project, in listed order. One group is one project's list."""
    people = F.sort_array(F.collect_list(F.struct("pos", "a_id", "name")))
    grouped = listing.groupBy(*scope, "key_id", "id").agg(people.alias("p"))
    lead = F.get("p", F.lit(0))
    rest = F.filter("p", lambda x: x["pos"] >= 0)
    return grouped.select(*scope, "key_id", "id", lead["name"].alias("mng"), lead["a_id"].alias("mngId"),
                          R.emit(rest["name"]).alias("rsc"), R.emit(rest["a_id"]).alias("rscId"))


# ---- one person behind several ids ----------------------------------------------------------------------------------

def same_author(author_paper: DataFrame, people: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Ids of one query that may be one person: (key_id, a_id, other_id, reason) with a_id < other_id.

    Two ids are compared only if they share a co-author and part of the name (`Surname, Given`, case folded):
    `short name` - same surname, one given name is the other's initial; `moved` - same full name, other institution;
    `new surname` - same given name (no initial) and institution, other surname. Blocks are (query, co-author, reason,
    the name part that must agree), so no pairs are formed beyond them. `people` has (a_id, name, inst).

    Pairs are formed again for every co-author they share, so the rows that meet are numbers alone: queries, blocks and
    what must differ within a block are numbered first, and blocks in which nothing differs are left out. Records move
    with their whole author lists to cells of a query's co-authors. A cell forms its pairs at once and gives each of them
    once, so what is left to tell apart grows with the cells, not with the shared co-authors. Co-authors with more than
    HUB listings are not put into a cell; what they share is found by a join, which AQE can split. `records` may name the
    stored author lists of `author_paper`.
    """
    kind = author_paper.schema["a_id"].dataType.simpleString()
    records = author_lists(author_paper) if records is None else records
    queries = _numbered(records.select("key_id"), "q")
    marks = _name_marks(people)
    values = _numbered(marks.select("value"), "v")
    blocks = _numbered(marks.select("reason", "block"), "b")
    numbered = stored(marks.join(values, "value").join(blocks, ["reason", "block"]).select("a_id", "b", "v"), "marks")
    mixed = numbered.groupBy("b").agg(F.min("v").alias("_least"), F.max("v").alias("_most")).where("_least < _most").select("b")
    numbered = numbered.join(mixed, "b").withColumn("a_id", F.col("a_id").cast(kind))
    met = records.where(F.size("ids") > 1).join(queries, "key_id").select("q", F.explode("ids").alias("co"), "ids").withColumn(
        "ids", F.array_remove("ids", F.col("co")))
    listings = stored(met.groupBy("q", "co").agg(F.sum(F.size("ids")).alias("n")), "listings")
    hubs = stored(listings.where(F.col("n") > HUB).select("q", "co"), "hubs")
    cells = stored(listings.where(F.col("n") <= HUB).groupBy("q").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("cells")), "cells")
    dealt_out = met.join(hubs, ["q", "co"], "left_anti").join(cells, "q").select(
        "q", F.pmod(F.xxhash64("co"), F.col("cells")).cast("int").alias("cell"), "co", "ids")
    listed = listings.select("q", F.col("co").alias("a_id")).join(cells, "q").join(numbered, "a_id").select(
        "q", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "a_id", "b", "v")
    in_cells = dealt_out.groupBy("q", "cell").cogroup(listed.groupBy("q", "cell")).applyInArrow(
        meet, f"q long, b long, a_id {kind}, other_id {kind}")
    pairs = in_cells.union(_of_hubs(met, hubs, numbered)).distinct()
    return pairs.join(blocks, "b").join(queries, "q").select("key_id", "a_id", "other_id", "reason")


def author_lists(author_paper: DataFrame) -> DataFrame:
    """(no, key_id, ids): the author list of every record under a number, stored. One group is one author list."""
    listed = author_paper.where("key_id is not null and paper_id is not null and a_id is not null")
    lists = listed.groupBy("key_id", "paper_id").agg(F.collect_set("a_id").alias("ids"))
    return stored(lists.select(F.monotonically_increasing_id().alias("no"), "key_id", "ids"), "records")


def _of_hubs(met: DataFrame, hubs: DataFrame, numbered: DataFrame) -> DataFrame:
    """Pairs (q, b, a_id, other_id) of ids listed with the same hub (q, co)."""
    shared = met.join(hubs, ["q", "co"], "left_semi").select("q", "co", F.explode("ids").alias("a_id")).distinct()
    rows = shared.join(numbered, "a_id")
    left, right = rows.alias("l"), rows.alias("r")
    keys = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("co", "b", "q")]
    return left.join(right, [*keys, F.col("l.a_id") < F.col("r.a_id"), F.col("l.v") != F.col("r.v")]).select(
        F.col("l.q").alias("q"), F.col("l.b").alias("b"), F.col("l.a_id").alias("a_id"), F.col("r.a_id").alias("other_id"))


def _name_marks(people: DataFrame) -> DataFrame:
    """(a_id, reason, block, value): two ids of one reason and block may be one person if their values differ."""
    name = F.lower("name")
    given = F.rtrim(F.trim(F.split_part(name, F.lit(","), F.lit(2))), F.lit("."))
    person = people.select("a_id", F.trim(F.split_part(name, F.lit(","), F.lit(1))).alias("surname"), given.alias("given"), "inst")
    full = F.length("given") > 1
    marks = F.array(
        F.struct(F.lit("short name").alias("reason"), F.concat_ws("|", "surname", F.left("given", F.lit(1))).alias("block"),
                 full.cast("string").alias("value")),
        F.struct(F.lit("moved").alias("reason"), F.concat_ws("|", "surname", "given").alias("block"), F.col("inst").alias("value")),
        F.struct(F.lit("new surname").alias("reason"), F.concat_ws("|", "given", "inst").alias("block"),
                 F.when(full, F.col("surname")).alias("value")))
    return person.select("a_id", F.inline(marks)).where("value is not null").distinct()


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """The distinct rows with a number each, stored, so that every reader sees the same numbers."""
    return stored(rows.distinct().withColumn(name, F.monotonically_increasing_id()), name)


def persons(pairs: DataFrame, author_paper: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(a_id, person): the least id among the ids that stand for one person, for every id in `pairs` (see `same_author`).

    Ids are one person if pairs join them, but two ids on one record are two people. So a pair of ids that share a
    record does not count. If a chain of the others still joins two ids of one record, that group falls back to its
    pairs of ids that are each other's best candidate: by the number of queries and reasons that name the pair, then by
    the lesser id. Which ids share a record is told from the records' own pairs, as a pair of ids may have very many records;
    these are read as one author list each, under a number (`records`, see `same_author`). `pairs` is evaluated once.
    """
    named = stored(pairs.groupBy("a_id", "other_id").agg(F.count("*").alias("n")), "named")
    ids = named.select("a_id").union(named.select("other_id")).distinct()
    records = author_lists(author_paper) if records is None else records
    later = F.filter("ids", lambda x: x > F.col("a_id"))
    together = records.select(F.explode("ids").alias("a_id"), "ids").select("a_id", F.explode(later).alias("other_id")).distinct()
    links = stored(named.join(together, ["a_id", "other_id"], "left_anti"), "links")
    groups = stored(connected(links.select(F.col("a_id").alias("a"), F.col("other_id").alias("b"))), "groups")
    listed = records.where(F.size("ids") > 1).select("no", F.explode("ids").alias("a_id"))
    seen = groups.withColumnRenamed("node", "a_id").join(listed, "a_id").groupBy("root", "no").agg(F.count("*").alias("n"))
    broken = seen.where("n > 1").select("root").distinct()
    both = links.select("a_id", "other_id", "n").union(links.select("other_id", "a_id", "n"))
    most = both.groupBy("a_id").agg(F.max("n").alias("n"))
    best = both.join(most, ["a_id", "n"]).groupBy("a_id").agg(F.min("other_id").alias("other_id"))
    mutual = best.join(best.select(F.col("a_id").alias("other_id"), F.col("other_id").alias("a_id")), ["a_id", "other_id"], "left_semi")
    fallen = groups.join(broken, "root", "left_semi").withColumnRenamed("node", "a_id").join(mutual, "a_id", "left")
    whole = groups.join(broken, "root", "left_anti").select(F.col("node").alias("a_id"), F.col("root").alias("person"))
    split = fallen.select("a_id", F.least("a_id", "other_id").alias("person"))
    alone = ids.join(groups.select(F.col("node").alias("a_id")), "a_id", "left_anti").select("a_id", F.col("a_id").alias("person"))
    return whole.union(split).union(alone)
