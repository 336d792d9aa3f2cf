"""Queries for streaming operators (S-01, S-03, T-*). Messages are derived from the given tables and streamed from files."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from laurel.catalog.authors import PEOPLE, PROJECT_PEOPLE, labs, project_messages
from laurel.catalog.authors import SUPPLIERS as KNOWN
from laurel.catalog.authors import suppliers as half_of_suppliers
from laurel.catalog.factors import (AS_OF, NORMALISED, PARTNERS, PROJECT_SCORES, QUERY_TEXT, factor_sql, query_table, r6,
                                    rounded)
from laurel.catalog.payloads import WOS_FIELDS, WOS_SQL, wos_folder
from laurel.catalog.registry import AUTHOR_PAPER, INSTITUTIONS, PROJECTS, RAWDATA, query, with_views
from laurel.operators import factors as A
from laurel.operators.numbering import number_rows
from laurel.operators.ranking import top_experts
from laurel.plans import driver_tables as D
from laurel.plans.scoring import expert_factors, paper_records, project_records
from laurel.session import scratch_path, stored, tasks_for, temporary
from laurel.sources import files, messages, providers, tables
from laurel.streaming import jobs
from laurel.streaming import progress as P
from laurel.streaming import records as S

SENDS = 4
PAPER_SITE = "SITE"


def event_messages(spark, d):
    """Events as messages of one query per user, in time order.

    Users ending in 7 end with a failure, those in 8 start with an API limit, those in 9 end with one; the last
    record of all others has progress 1.
    """
    events = D.table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    rows = number_rows(events, ["user_id"], [F.col("ts"), F.col("event_id")], "rn", "total")
    group, last, first = F.col("user_id") % 10, F.col("rn") == F.col("total"), F.col("rn") == 1
    fails, limits = last & (group == 7), (last & (group == 9)) | (first & (group == 8))
    return rows.select(
        F.col("event_type").alias("site"), F.concat(F.lit("q"), "user_id").alias("key_id"),
        F.when(~fails & ~limits, F.concat("event_type", F.lit("-"), F.floor("value"))).alias("id"),
        F.col("rn").alias("seq"), F.when(fails | limits, 1.0).otherwise(F.col("rn") / F.col("total")).alias("progress"),
        F.when(fails, 1).alias("fail"), F.when(limits, -3).alias("api_limit"),
        F.when(limits, True).alias("is_partial"), (F.col("rn") * SENDS / (F.col("total") + 1)).cast("int").alias("send"))


def one_provider_messages(spark, d):
    """The same messages, all sent by one provider."""
    return event_messages(spark, d).withColumn("site", F.lit("SITE"))


EVENTS = """rows as (select *, row_number() over (partition by user_id order by ts, event_id) as rn,
  count(*) over (partition by user_id) as total from events),
m as (select event_type as site, 'q' || user_id as key_id, rn as seq,
  rn = total and user_id % 10 = 7 as fails, (rn = total and user_id % 10 = 9) or (rn = 1 and user_id % 10 = 8) as limits,
  rn / total as p, event_type || '-' || cast(floor(value) as bigint) as record from rows),
msg as (select *, case when fails then 'fail' when limits then 'api_limit' else 'data' end as kind,
  case when fails or limits then 1.0 else p end as progress, case when fails or limits then null else record end as id from m)"""


def landed_messages(spark, d, source=event_messages):
    """Messages sent in order: every part holds a query's rows in one file."""
    folder = scratch_path(spark, "messages")
    with temporary(spark):
        rows = stored(source(spark, d), "sent")
        for i in range(SENDS):
            messages.send(rows.where(F.col("send") == i).drop("send").repartition("key_id"), folder)
    return folder


def run(query_):
    query_.awaitTermination()
    if query_.exception():
        raise query_.exception()


@query("s01_t01_t02_t04_routed_messages", with_views(EVENTS) + """
select site, key_id, seq, kind, id, case when kind <> 'data' or progress <> 1 then round(progress, 6) end as progress from msg union all
 select site, key_id, seq, 'end', null, 1.0 from msg where kind = 'data' and progress = 1""")
def t02(spark, d):
    """Every message with its kind; the last record of a query is followed by an end marker."""
    out = scratch_path(spark, "routed")
    stream = S.routed(messages.stream(spark, landed_messages(spark, d), per_trigger=4))
    run(jobs.to_table(stream, out, scratch_path(spark, "ck")))
    return spark.read.parquet(out).select("site", "key_id", "seq", "kind", "id", r6("progress").alias("progress"))


@query("t03_stream_dedup", with_views(EVENTS) + "select distinct key_id, id from msg where kind = 'data'")
def t03(spark, d):
    out = scratch_path(spark, "dedup")
    stream = S.data_rows(S.routed(messages.stream(spark, landed_messages(spark, d), per_trigger=4)))
    run(jobs.to_table(S.deduplicated(stream).select("key_id", "id"), out, scratch_path(spark, "ck")))
    return spark.read.parquet(out)


# One row per message, in order: the same state machine as a recursive fold.
FOLD = """steps as (select key_id, seq, kind, progress * 100 as percent, limits from msg),
fold as (select key_id, cast(0 as bigint) as seq, cast(0 as double) as last, 0 as state, false as has_data, false as part,
  cast(null as double) as shown from (select distinct key_id from msg)
 union all
 select f.key_id, s.seq,
  case when f.state = 0 and s.kind = 'data' and ((f.last + 1 <= s.percent and s.percent <> 100) or f.last > s.percent)
   then s.percent else f.last end,
  case when f.state <> 0 then f.state when s.kind = 'fail' then -1 when s.kind = 'api_limit' and not f.has_data then -3
   when s.percent = 100 and f.last <= s.percent then 1 else 0 end,
  f.has_data or s.kind = 'data', f.part or s.limits,
  case when f.state <> 0 then null when s.kind = 'fail' then 100 when s.kind = 'api_limit' and not f.has_data then 100
   when (f.last + 1 <= s.percent and s.percent <> 100) or f.last > s.percent then s.percent
   when s.percent = 100 then 0 end
 from fold f join steps s on s.key_id = f.key_id and s.seq = f.seq + 1)"""


@query("t05_t06_t07_t11_status_updates", "with recursive " + EVENTS + ", " + FOLD + """
select key_id, seq, round(shown, 6) as progress, state, part as is_partial from fold where shown is not null""")
def t05(spark, d):
    return tracked(spark, d, one_provider_messages).drop("site")


def tracked(spark, d, source, slices=None):
    """The updates that the messages of `source` lead to, sent in several micro-batches."""
    folder = scratch_path(spark, "progress")
    stream = messages.stream(spark, landed_messages(spark, d, source), per_trigger=4)
    run(jobs.track(stream, folder, scratch_path(spark, "ck"), slices))
    return jobs.Progress(spark, folder).log("updates", P.UPDATE).withColumn("progress", r6("progress"))


@query("t06_query_status", "with recursive " + EVENTS + ", " + FOLD + """
select key_id, round(shown, 6) as progress, state, part as is_partial from
 (select *, row_number() over (partition by key_id order by seq desc) as rn from fold where shown is not null) where rn = 1""")
def t06(spark, d):
    status = P.current_status(tracked(spark, d, one_provider_messages))
    return status.select("key_id", r6("progress").alias("progress"), "state", "is_partial")


HOT_EVENTS = """sent as (select *, 'S' || event_id % 2 as site, case when event_id % 3 = 0 then 'hot' else 'q' || user_id end as query from events),
numbered as (select *, row_number() over (partition by site, query order by ts, event_id) as rn,
  count(*) over (partition by site, query) as total from sent),
msg as (select site || '|' || query as key_id, rn as seq, 'data' as kind, event_id % 500 = 0 as limits,
  case when event_id % 97 = 0 and rn < total then rn / total - 0.03 else rn / total end as progress from numbered)"""


def hot_messages(spark, d):
    """Two providers; a third of all messages of each are of one query. Now and then the progress falls by 3 points."""
    sent = D.table(spark, d, "events").select(
        "event_id", "ts", F.concat(F.lit("S"), F.col("event_id") % 2).alias("site"),
        F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("q"), "user_id")).alias("key_id"))
    rows = number_rows(sent, ["site", "key_id"], [F.col("ts"), F.col("event_id")], "rn", "total")
    share, last = F.col("rn") / F.col("total"), F.col("rn") == F.col("total")
    return rows.select(
        "site", "key_id", F.col("event_id").cast("string").alias("id"), F.col("rn").alias("seq"),
        F.when((F.col("event_id") % 97 == 0) & ~last, share - 0.03).otherwise(share).alias("progress"),
        F.when(F.col("event_id") % 500 == 0, True).alias("is_partial"),
        (F.col("rn") * SENDS / (F.col("total") + 1)).cast("int").alias("send"))


@query("t05_t06_hot_query", "with recursive " + HOT_EVENTS + ", " + FOLD + """
select split_part(key_id, '|', 1) as site, split_part(key_id, '|', 2) as key_id, seq, round(shown, 6) as progress, state,
 part as is_partial from fold where shown is not null""")
def t05_hot(spark, d):
    """Every batch is folded in six slices, over which the hot query spreads."""
    return tracked(spark, d, hot_messages, slices=6)


BOUND, COPY_SENDS, DAY = "75 minutes", 11, 86_400


def copied_messages(spark, d):
    """Orders sent once, some again an hour later (within the bound), some again five hours later (beyond it)."""
    key = F.col("o_orderkey")
    copies = F.array_compact(F.array(F.lit(0), F.when(key % 2 == 0, 1), F.when(key % 5 == 0, 5)))
    rows = D.table(spark, d, "orders").select("o_orderpriority", key, F.explode(copies).alias("later"))
    send = key % 6 + F.col("later")
    return rows.select(F.col("o_orderpriority").alias("key_id"), key.cast("string").alias("id"), send.cast("int").alias("send"),
                       F.timestamp_seconds((send * 60 + key % 50) * 60 + DAY).alias("sent"))


@query("t03_bounded_dedup", """
with copies as (select o_orderpriority as key_id, o_orderkey, unnest([0] || case when o_orderkey % 2 = 0 then [1] else [] end
  || case when o_orderkey % 5 = 0 then [5] else [] end) as later from orders),
sent as (select key_id, o_orderkey as id, (o_orderkey % 6 + later) * 60 + o_orderkey % 50 as at_minute from copies),
gaps as (select *, at_minute - lag(at_minute) over (partition by key_id, id order by at_minute) as gap from sent)
select key_id, cast(id as varchar) as id, at_minute from gaps where gap is null or gap > 75""")
def t03_bounded(spark, d):
    """One record per key within the bound, with state that forgets older ones, in RocksDB; hour after hour in batches."""
    folder, out = scratch_path(spark, "copies"), scratch_path(spark, "bounded")
    rows = copied_messages(spark, d)
    for i in range(COPY_SENDS):
        rows.where(F.col("send") == i).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    with jobs.state_on_disk(spark):
        run(jobs.to_table(S.deduplicated(stream, "sent", BOUND), out, scratch_path(spark, "ck")))
    return spark.read.parquet(out).select("key_id", "id", ((F.unix_timestamp("sent") - DAY) / 60).cast("long").alias("at_minute"))


@query("t12_worker_outcomes", """
select user_id as key_id, case when count(*) filter (where event_type in ('error', 'signup')) = count(*) then 1 end as fail,
 count(*) filter (where event_type in ('error', 'signup')) between 1 and count(*) - 1 as is_partial from events group by 1""")
def t12(spark, d):
    workers = D.table(spark, d, "events").select(
        F.col("user_id").alias("key_id"), F.col("event_type").isin("error", "signup").alias("failed"))
    return S.worker_outcome(workers)


# ---- the whole job --------------------------------------------------------------------------------------------------------

def record_messages(spark, d):
    """Records with authors as messages: one query per order priority, every eighth record sent twice.

    By record number modulo 9: 1 lacks the last institution, 2 has provider ids (of other people), 3 has an id too many
    and 4 no author (both refused). The first query ends before the others send; the second one's end is a message of
    its own after all of theirs.
    """
    rows = D.records(spark, d, ["author", "author_inst", "author_id"]).where("author is not null")
    numbered = number_rows(rows, ["key_id"], [F.col("paper_id")], "rn", "total")
    kind, first, second = F.col("paper_id") % 9, F.col("key_id") == "1-URGENT", F.col("key_id") == "2-HIGH"
    copies = F.when(F.col("paper_id") % 8 == 0, 2).otherwise(1)
    names, insts, ids = (F.split(c, ";") for c in ("author", "author_inst", "author_id"))
    outside = F.array_join(F.transform(ids, lambda a: F.concat(F.lit("X"), a)), ";")
    progress = F.col("rn") / F.col("total")
    records = numbered.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select(
        F.lit(PAPER_SITE).alias("site"), "key_id", F.col("paper_id").cast("string").alias("id"),
        (F.col("rn") * 2 + F.col("copy")).alias("seq"),
        F.when(second & (progress == 1), 0.999).otherwise(progress).alias("progress"),
        F.when(kind == 2, F.array_join(F.transform(names, lambda a: F.concat(a, F.lit(" P"))), ";"))
        .when(kind != 4, F.col("author")).alias("author"),
        F.when((kind == 1) & (F.size(insts) > 1), F.array_join(F.slice(insts, F.lit(1), F.size(insts) - 1), ";"))
        .otherwise(F.col("author_inst")).alias("author_inst"),
        F.when(kind == 2, outside).when(kind == 3, F.concat(outside, F.lit(";X0"))).alias("author_id"),
        "title", "paper_keyword", "issue_inst", "issue_lang", F.col("issue_year").cast("string").alias("issue_year"),
        F.col("citation").cast("long").alias("citation"),
        F.when(first, 0).otherwise((F.col("rn") * (SENDS - 2) / (F.col("total") + 1)).cast("int") + 1).alias("send"))
    end = numbered.where(second & (F.col("rn") == F.col("total"))).select(
        F.lit(PAPER_SITE).alias("site"), "key_id", (F.col("rn") * 2 + 9).alias("seq"), F.lit(1.0).alias("progress"),
        F.lit(SENDS - 1).alias("send"))
    return records.unionByName(end, allowMissingColumns=True)


SENT = """listed0 as (select key_id, paper_id, a_id as s_id, pos, n_authors, s_name as name, n_name as inst
 from all_listed join supplier on s_suppkey = a_id join nation on n_nationkey = s_nationkey),
author_paper as (select key_id, paper_id, pos, case when paper_id % 9 = 1 and n_authors > 1 then n_authors - 1 else n_authors end as n_authors,
  case when paper_id % 9 = 2 then name || ' P' else name end as name, inst,
  case when paper_id % 9 = 2 then 'X' || s_id when s_id % 2 = 0 then cast(s_id as varchar)
   else 's' || substr(md5(name || chr(1) || inst), 1, 16) end as a_id
 from listed0 where paper_id % 9 not in (3, 4) and not (paper_id % 9 = 1 and n_authors > 1 and pos = n_authors - 1)),
rawdata as ("""


STORED_LISTS = """institutions as (
 select key_id, paper_id, string_agg(a_id, ';' order by pos) as author_id, string_agg(name, ';' order by pos) as author,
  string_agg(inst, ';' order by pos) as author_inst from author_paper group by key_id, paper_id)"""


def job_sql(sql):
    """The batch SQL over the listing that the messages leave."""
    listed = sql.replace("author_paper as (", "all_listed as (", 1).replace("rawdata as (", SENT, 1)
    return listed.replace(INSTITUTIONS, STORED_LISTS)


LISTED = job_sql(with_views(AUTHOR_PAPER, RAWDATA))


_done: dict[tuple, tuple] = {}


def once_per_folder(run_job):
    """A job over the messages of a folder runs once per session; the queries over what it stored share its tables."""
    def job(spark, d):
        key = (run_job.__name__, spark.sparkContext.applicationId, d)
        if key not in _done:
            _done[key] = run_job(spark, d)
        return _done[key]

    return job


@once_per_folder
def paper_job(spark, d):
    """The job over all messages, with the scores stored in a table of their own."""
    factors = scratch_path(spark, "scored")

    known = half_of_suppliers(spark, d).withColumn("site", F.lit(PAPER_SITE))
    job = jobs.Collection(spark, scratch_path(spark, "facts"), known, site_scores(spark, d),
                          lambda rows: tables.store_factors(rows, factors), query_table(spark, QUERY_TEXT))
    landed = landed_messages(spark, d, record_messages)
    run(jobs.ingest(messages.stream(spark, landed, per_trigger=5), job, scratch_path(spark, "ck")))
    return job, factors


def site_scores(spark, d):
    """How the job scores the finished queries of a provider: projects by their managers, papers with their partners."""
    def score(site, listing, records, queries):
        tasks = tasks_for(spark, listing.count())
        if site == jobs.PROJECT_SITE:
            return expert_factors(listing, project_records(records), A.profile_of(site), AS_OF, tasks=tasks)
        profile = replace(A.profile_of(site), coop=A.partner_hit(F.col("author_inst"), PARTNERS))
        return expert_factors(listing, paper_records(records), profile, AS_OF, D.impact(spark, d), queries, tasks=tasks)

    return score


@query("t08_t09_t10_collect_and_score", job_sql(factor_sql()) + f""", normalised as (select {NORMALISED} from ungated join tops using (key_id)),
counts as (select key_id, count(distinct paper_id) as data, count(distinct a_id) as experts from author_paper group by 1)
select n.*, 2 as state, 100.0 as progress, data, experts, true as timed, (select count(*) from normalised) as analysed
from normalised n join counts using (key_id)""")
def t09(spark, d):
    """Messages to facts, facts to factor rows of the finished queries, and their status; equal to the batch result.

    `analysed` is the number of rows that the analysis reported while it stored them.
    """
    job, factors = paper_job(spark, d)
    done = job.log("status", jobs.STATUS).select(
        "key_id", "state", "progress", "data", "experts", (F.col("crawl_time") <= F.col("a_time")).alias("timed"))
    parts = job.log("analysis", jobs.ANALYSIS).groupBy("site", "key_id").agg(F.max("rows").alias("rows"))
    reported = parts.agg(F.sum("rows")).first()[0]
    rows = tables.load(spark, factors).drop("site", "part")
    return rounded(rows.join(done, "key_id")).withColumn("analysed", F.lit(reported))


@query("t08_f16_stored_and_refused_records", LISTED + """
select key_id, cast(paper_id as varchar) as id, string_agg(a_id, ';' order by pos) as author_id, string_agg(name, ';' order by pos) as author,
 string_agg(inst, ';' order by pos) as author_inst, count(*) as n_authors, null as reason from author_paper group by 1, 2
union all select distinct key_id, cast(paper_id as varchar), null, null, null, null,
 case when paper_id % 9 = 4 then 'no author' else 'author and id counts differ' end from all_listed where paper_id % 9 in (3, 4)""")
def t08_stored(spark, d):
    """Records are stored with the resolved author lists; refused ones lie apart with the reason."""
    job, _ = paper_job(spark, d)
    lists = ["author_id", "author", "author_inst"]
    kept = job.table("raw").select("key_id", "id", *lists, F.col("n_authors").cast("long").alias("n_authors"))
    refused = job.table("refused").select("key_id", "id", "reason")
    return kept.unionByName(refused, allowMissingColumns=True)


# ---- authors without institution --------------------------------------------------------------------------------------------

CLAIMS = 10


def id_messages(spark, d):
    """Papers with provider ids. Only the later ones (two sends of four), and of these every second, list institutions."""
    rows = D.records(spark, d, ["author", "author_inst", "author_id"]).where("author is not null")
    numbered = number_rows(rows, ["key_id"], [F.col("paper_id")], "rn", "total")
    send = (F.col("rn") * SENDS / (F.col("total") + 1)).cast("int")
    brings = (send >= SENDS // 2) & (F.col("paper_id") % 40 == 0)
    return numbered.select(
        F.lit("DBPIA").alias("site"), "key_id", F.col("paper_id").cast("string").alias("id"), F.col("rn").alias("seq"),
        (F.col("rn") / F.col("total")).alias("progress"), "author", "author_id",
        F.when(brings, F.col("author_inst")).alias("author_inst"), "title", send.alias("send"))


@query("j09_pending_in_the_job", with_views(AUTHOR_PAPER) + f""",
placed as (select *, row_number() over (partition by key_id order by paper_id) as rn, count(*) over (partition by key_id) as total
 from (select distinct key_id, paper_id from author_paper)),
listed as (select cast(a_id as varchar) as a_id, s_name as name, n_name, paper_id % 40 = 0
  and cast(floor(rn * 4 / (total + 1)) as integer) >= 2 as brings
 from author_paper join placed using (key_id, paper_id) join supplier on s_suppkey = a_id join nation on n_nationkey = s_nationkey),
people as (select a_id, name, coalesce(max(case when brings then n_name end), '') as inst from listed group by 1, 2),
queued as (select *, row_number() over (order by a_id) as place from people where inst = '')
select p.a_id, p.name, case when q.place <= {CLAIMS} and q.place % 2 = 1 then 'Found ' || p.a_id else p.inst end as inst,
 p.inst <> '' or coalesce(q.place <= {CLAIMS} and q.place % 2 = 1, false) as has_inst,
 case when q.place is null or (q.place <= {CLAIMS} and q.place % 2 = 1) then null when q.place <= {CLAIMS} then 'claimed'
  else 'waiting' end as state from people p left join queued q using (a_id)""")
def j09_job(spark, d):
    """The job queues authors who have an id but no institution; later records settle some, a worker claims ten and
    completes every second of them."""
    nobody = spark.createDataFrame([], "site string, a_id string, name string, inst string")
    job = jobs.Collection(spark, scratch_path(spark, "facts"), nobody)
    run(jobs.ingest(messages.stream(spark, landed_messages(spark, d, id_messages), per_trigger=5), job, scratch_path(spark, "ck")))
    claimed = job.claim(CLAIMS, "worker-1")
    odd = number_rows(claimed, ["site"], [F.col("a_id")], "place").where(F.col("place") % 2 == 1)
    job.complete(odd.select("site", "a_id", F.concat(F.lit("Found "), "a_id").alias("inst")))
    waiting = job.table("pending").where(F.col("state") != jobs.DONE).select("a_id", "state")
    return job.authors().select("a_id", "name", "inst", "has_inst").join(waiting, "a_id", "left")


def sent_projects(spark, d):
    """Projects as messages of one site; the last of a query has progress 1."""
    rows = project_messages(spark, d).withColumn("paper_id", F.col("id"))
    dates = D.projects(spark, d).select("key_id", "paper_id", "total_fund", "prd_start", "prd_end")
    numbered = number_rows(rows.join(dates, ["key_id", "paper_id"]), ["key_id"], [F.col("id")], "rn", "total")
    return numbered.select(
        F.lit(jobs.PROJECT_SITE).alias("site"), "key_id", F.col("id").cast("string").alias("id"), F.col("rn").alias("seq"),
        (F.col("rn") / F.col("total")).alias("progress"), "mng", "mngId", "rsc", "rscId", "ldAgency", "perfAgent",
        F.col("total_fund").alias("totalFund"), F.col("prd_start").alias("prdStart"), F.col("prd_end").alias("prdEnd"),
        F.lit(0).alias("send"))


LISTED_PROJECTS = PROJECT_PEOPLE + """,
all_projects as (select * from projects), ours as (select distinct key_id, a_id, id as paper_id from listing),
managed as (select p.key_id, p.paper_id, l.a_id as manager_id, total_fund, prd_end, prd_start
 from all_projects p join listing l on l.key_id = p.key_id and l.id = p.paper_id and l.pos = -1)"""


@query("t08_project_collect_and_score", with_views(AUTHOR_PAPER, PROJECTS, PEOPLE, KNOWN, LISTED_PROJECTS) + ", "
       + PROJECT_SCORES.replace("author_paper a join projects p", "ours a join managed p"))
def t08_project(spark, d):
    """Projects through the same job: the site chooses the profile."""
    factors = scratch_path(spark, "scored")
    known = labs(half_of_suppliers(spark, d)).withColumn("site", F.lit(jobs.PROJECT_SITE))
    job = jobs.Collection(spark, scratch_path(spark, "facts"), known, site_scores(spark, d),
                          lambda rows: tables.store_factors(rows, factors))
    run(jobs.ingest(messages.stream(spark, landed_messages(spark, d, sent_projects)), job, scratch_path(spark, "ck")))
    rows = rounded(tables.load(spark, factors).drop("site", "part"))
    return rows.withColumn("coop", F.col("coop").cast("long"))  # no cooperation among projects


# ---- one query, two providers -----------------------------------------------------------------------------------------------

def two_providers_messages(spark, d):
    """Papers of one provider and projects of another under the same queries.

    The projects of the first query end one batch after its papers, those of the second and third in the batch in which
    their papers end, the others before.
    """
    late = F.when(F.col("key_id") == "1-URGENT", 1).when(F.col("key_id").isin("2-HIGH", "3-MEDIUM"), SENDS - 1).otherwise(0)
    return record_messages(spark, d).unionByName(sent_projects(spark, d).withColumn("send", late), allowMissingColumns=True)


@once_per_folder
def two_providers_job(spark, d):
    factors = scratch_path(spark, "scored")
    known = half_of_suppliers(spark, d)
    both = known.withColumn("site", F.lit(PAPER_SITE)).unionByName(labs(known).withColumn("site", F.lit(jobs.PROJECT_SITE)))
    job = jobs.Collection(spark, scratch_path(spark, "facts"), both, site_scores(spark, d),
                          lambda rows: tables.store_factors(rows, factors), query_table(spark, QUERY_TEXT), best_experts)
    landed = landed_messages(spark, d, two_providers_messages)
    run(jobs.ingest(messages.stream(spark, landed, per_trigger=5), job, scratch_path(spark, "ck")))
    return job, factors


def best_experts(rows):
    """The experts whose relations are stored: a finished query's five best by quality; equal ones share a place."""
    return top_experts(rows, {"quality": 1}, 5)


PAPER_SCORES = job_sql(factor_sql()) + f""", normalised as (select {NORMALISED} from ungated join tops using (key_id))"""
PROJECT_SQL = with_views(AUTHOR_PAPER, PROJECTS, PEOPLE, KNOWN, LISTED_PROJECTS)
PROJECT_FACTORS = PROJECT_SQL + ", " + PROJECT_SCORES.replace("author_paper a join projects p", "ours a join managed p")
PAPER_COUNTS = LISTED + "select key_id, count(distinct paper_id) as data, count(distinct a_id) as experts from author_paper group by 1"
PROJECT_COUNTS = PROJECT_SQL + "select key_id, count(distinct id) as data, count(distinct a_id) as experts from listing group by 1"


@query("t06_t09_two_providers", f"""
with scores as (select '{PAPER_SITE}' as site, * from ({PAPER_SCORES} select * from normalised)
 union all by name select '{jobs.PROJECT_SITE}' as site, * from ({PROJECT_FACTORS})),
counts as (select '{PAPER_SITE}' as site, * from ({PAPER_COUNTS}) union all by name select '{jobs.PROJECT_SITE}' as site, * from ({PROJECT_COUNTS}))
select s.*, 2 as state, 100.0 as progress, data, experts from scores s join counts using (site, key_id)""")
def t09_two_providers(spark, d):
    """Every provider's factor rows and status are those of a batch over its own records, whenever the other one ends."""
    job, factors = two_providers_job(spark, d)
    done = job.log("status", jobs.STATUS).select("site", "key_id", "state", "progress", "data", "experts")
    return rounded(tables.load(spark, factors).drop("part").join(done, ["site", "key_id"]))


@query("t06_query_roll_up", f"""
with counts as (select * from ({PAPER_COUNTS}) union all by name select * from ({PROJECT_COUNTS}))
select key_id, count(*) as n_sites, count(*) as n_analysed, 0 as n_failed, 100.0 as progress, 2 as state, false as is_partial,
 sum(data)::bigint as data, sum(experts)::bigint as experts, 0 as pending from counts group by 1""")
def t06_roll_up(spark, d):
    """One status per query over its providers."""
    return two_providers_job(spark, d)[0].query_status()


@query("t10_analysis_progress", f"""
with scores as (select '{PAPER_SITE}' as site, key_id, a_id from ({PAPER_SCORES} select key_id, a_id from normalised)
 union all by name select '{jobs.PROJECT_SITE}' as site, key_id, a_id from ({PROJECT_FACTORS}))
select site, key_id, count(*) as total, count(*) as last_rows, 100.0 as last_progress, true as rising, 4 as n_lines from scores group by 1, 2""")
def t10_progress(spark, d):
    """The lines that an analysis adds while its rows are stored: they rise, and end at the total."""
    lines = two_providers_job(spark, d)[0].log("analysis", jobs.ANALYSIS)
    in_order = F.sort_array(F.collect_list(F.struct("part", "rows", "progress")))
    return lines.groupBy("site", "key_id", "total").agg(in_order.alias("lines")).select(
        "site", "key_id", "total", F.element_at("lines", -1)["rows"].alias("last_rows"),
        F.element_at("lines", -1)["progress"].alias("last_progress"),
        (F.array_sort(F.col("lines")["rows"]) == F.col("lines")["rows"]).alias("rising"), F.size("lines").alias("n_lines"))


@query("j16_t09_stored_relations", f"""
with scores as (select '{PAPER_SITE}' as site, * from ({PAPER_SCORES} select * from normalised)
 union all by name select '{jobs.PROJECT_SITE}' as site, * from ({PROJECT_FACTORS})),
listings as (select '{PAPER_SITE}' as site, * from ({LISTED} select distinct key_id, paper_id, a_id from author_paper)
 union all by name select '{jobs.PROJECT_SITE}' as site, * from ({PROJECT_SQL} select distinct key_id, id as paper_id, a_id from listing)),
best as (select * from (select *, rank() over (partition by site, key_id order by quality desc) as place from scores) where place <= 5)
select l.site, l.key_id, l.a_id, o.a_id as co_a_id, count(*) as n_papers
from listings l join best b using (site, key_id, a_id) join listings o on o.site = l.site and o.key_id = l.key_id and o.paper_id = l.paper_id
 and o.a_id <> l.a_id group by all""")
def j16_stored(spark, d):
    """The relations of the best experts, stored by the job with the scores."""
    return two_providers_job(spark, d)[0].log("relations", jobs.RELATION)


@query("s03_t13_landed_exports", WOS_SQL)
def t13(spark, d):
    """Exports become records as their files land."""
    folder, out = wos_folder(spark, d), scratch_path(spark, "landed")
    stream = files.landed(spark, folder, files.positional_schema(providers.WOS_WIDTH), header=True, enforceSchema=True,
                          sep="\t")
    run(jobs.to_table(providers.accepted(providers.wos_papers(stream)).select(*WOS_FIELDS), out, scratch_path(spark, "ck")))
    return spark.read.parquet(out)
