"""The collecting job: one loop over the message stream that stores records, reports progress and scores finished queries.

A query may go to several providers. Everything is kept per provider and query: records, listings, authors, progress,
status and scores; `query_status` sums up a query. The tables are runs with a manifest per batch (`sources/runs.py`), so a
batch opens the files of its own queries and authors only, however many batches there were, and a repeated batch
neither loses nor doubles rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from laurel.functions import text as X
from laurel.operators import authors as J
from laurel.operators import ranking
from laurel.operators.search import performed_by
from laurel.schemas import PAPER, PROJECT, names
from laurel.session import stored, temporary, together
from laurel.sources.providers import accepted, reject_counts, rejected
from laurel.sources.runs import Layout, Runs
from laurel.streaming import progress as P
from laurel.streaming import records as S

PROJECT_SITE = "NTIS"
AT_ONCE = 2  # providers that are scored side by side
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
SCOPE = ["site"]
QUERY = ["site", "key_id"]
RECORD = ["site", "key_id", "id"]
PERSON = ["site", "a_id"]
LAYOUTS = {
    "raw": Layout(f"{PAPER}, site string, seq long, n_authors int, crawl_time string", ("site", "key_id")),
    "project": Layout(f"{PROJECT}, site string, seq long, crawl_time string", ("site", "key_id")),
    "author_paper": Layout("site string, key_id string, paper_id string, a_id string, pos int, n_authors int, seq long",
                           ("site", "key_id")),
    "refused": Layout("site string, key_id string, id string, seq long, reason string", ("site", "key_id")),
    "state": Layout(f"site string, key_id string, {P.STATE}", ("site", "key_id"), ("site", "key_id")),
    "author": Layout("site string, a_id string, name string, inst string, has_inst boolean", ("site", "a_id"), ("site", "a_id")),
    "author_name": Layout("site string, name string, a_id string", ("site", "name"), ("site", "name", "a_id")),
    "pending": Layout("site string, a_id string, name string, state string, worker string", ("site", "a_id"), ("site", "a_id")),
    "query": Layout("key_id string, query string", ("key_id",), ("key_id",)),
}
FACTORS = ["productivity", "contrib", "durability", "recentness", "coop", "quality", "acc"]  # of one type for all providers
WAITING, CLAIMED, DONE = "waiting", "claimed", "done"
STATUS = f"{P.UPDATE}, data long, experts long, pending long, crawl_time string, a_time string"
ANALYSIS = "site string, key_id string, part int, rows long, total long, progress double"
RELATION = "site string, key_id string, a_id string, co_a_id string, n_papers long"


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a Parquet table, over what is available now."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def in_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _with_site(messages: DataFrame) -> DataFrame:
    return messages.withColumn("site", F.coalesce("site", F.lit("")))


def _arrival(kept: DataFrame) -> DataFrame:
    """The records' arrival numbers, to be joined with a sort on both sides.

    Stored records are wide and mostly NULL, so Catalyst takes a few of their columns for a small share of the file and
    would send millions of rows through the driver as a broadcast.
    """
    return kept.select(*RECORD, "seq").hint("merge")


class Progress:
    """Progress alone: the updates of every provider and query, with the states between batches in runs.

    `slices` fixes into how many slices a batch's messages are sorted; without it their size decides.
    """

    slices: int | None = None

    def __init__(self, spark: SparkSession, folder: str, slices: int | None = None):
        self.spark, self.folder, self.slices = spark, folder, slices
        self.tables = Runs(spark, f"{folder}/tables", {"state": LAYOUTS["state"]})
        if not self.tables.open():
            self.tables.commit(-1)

    def add(self, messages: DataFrame, batch: int) -> None:
        self.tables.begin(batch)
        self.report(stored(_with_site(messages), "messages"), batch)
        self.tables.commit(batch)

    def report(self, rows: DataFrame, batch: int) -> DataFrame:
        """The batch's status updates, stored."""
        states = self.tables.find("state", rows.where("key_id is not null"))
        folded = stored(P.folded(rows, states, self.slices), "folded")
        self.tables.append("state", folded.where("seq is null"))
        self._log(folded.where("seq is not null").select(*names(P.UPDATE)), "updates", batch)
        return self.spark.read.schema(P.UPDATE).parquet(f"{self.folder}/updates/batch={batch}/step=0")

    def _log(self, df: DataFrame, name: str, batch: int, step: int = 0) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}/step={step}")

    def log(self, name: str, ddl: str) -> DataFrame:
        """The rows that the batches reported: `updates`, `status`, `analysis`, `relations`, `malformed`."""
        fs, where = self.tables._fs(f"{self.folder}/{name}")
        if not fs.exists(where):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(f"{self.folder}/{name}").drop("batch", "step")


def land(parsed: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Parsed records of a stream: accepted ones to `folder`/records, the others with their reason to `folder`/rejected,
    and what was read and rejected per batch to `folder`/counts. A repeated batch replaces its rows."""
    def each(rows: DataFrame, batch: int) -> None:
        rows = stored(rows, "parsed")
        for name, part in (("records", accepted(rows)), ("rejected", rejected(rows)), ("counts", reject_counts(rows, []))):
            part.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")

    return in_batches(parsed, each, checkpoint)


def track(stream: DataFrame, folder: str, checkpoint: str, slices: int | None = None) -> StreamingQuery:
    """Progress alone; the updates are in `folder`/updates."""
    return in_batches(S.routed(stream), Progress(stream.sparkSession, folder, slices).add, checkpoint)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started here keep their state in RocksDB, so it need not fit in the executors' heaps."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


class Collection(Progress):
    """Facts of the message stream in `folder`, and the scores of finished queries.

    `score(site, listing, records, queries)` gives the factor rows of finished queries of one provider (it chooses the
    profile, see `factors.profile_of`); `queries` has the stored query texts. `store(rows)` must replace the rows of the
    providers, queries and parts in `rows` (site, key_id, part, ...): rows come in `parts` parts per provider, and every
    part adds a line to the `analysis` log. `ranked(rows)` may name experts whose relations are stored with the scores.
    """

    def __init__(self, spark: SparkSession, folder: str, authors: DataFrame,
                 score: Callable[[str, DataFrame, DataFrame, DataFrame], DataFrame] | None = None,
                 store: Callable[[DataFrame], None] | None = None, queries: DataFrame | None = None,
                 ranked: Callable[[DataFrame], DataFrame] | None = None, parts: int = 4):
        self.spark, self.folder, self.score, self.store, self.ranked, self.parts = spark, folder, score, store, ranked, parts
        self.tables = Runs(spark, f"{folder}/tables", LAYOUTS)
        if not self.tables.open():
            self._add_authors(authors.select(*PERSON, "name", "inst"))
            if queries is not None:
                self.tables.append("query", queries)
            self.tables.commit(-1)

    def table(self, name: str) -> DataFrame:
        """A table as it stands."""
        return self.tables.read(name)

    # ---- authors --------------------------------------------------------------------------------------------------------

    def _add_authors(self, rows: DataFrame) -> None:
        rows = rows.withColumn("has_inst", F.coalesce(F.col("inst") != "", F.lit(False)))
        self.tables.append("author", rows)
        self.tables.append("author_name", rows.where("name is not null"))

    def authors(self) -> DataFrame:
        """The author table as it stands: the latest row of every provider and id."""
        return self.table("author")

    def _known(self, people: DataFrame) -> DataFrame:
        """The stored authors that `people` (site, name, a_id) may mean, by name or by id."""
        by_name = self.tables.find("author_name", people.where("name is not null")).select(*PERSON)
        return self.tables.find("author", by_name.union(people.where("a_id is not null").select(*PERSON)))

    # ---- the queue of authors without institution -------------------------------------------------------------------------

    def claim(self, n: int, worker: str) -> DataFrame:
        """Gives up to `n` waiting authors (site, a_id, name) to a worker. To be called between batches."""
        waiting = self.table("pending").where(F.col("state") == WAITING).orderBy(*PERSON).limit(n)
        mine = stored(waiting.withColumns({"state": F.lit(CLAIMED), "worker": F.lit(worker)}), "claimed")
        self.tables.append("pending", mine)
        self.tables.commit(self.tables.batch)
        return mine.select(*PERSON, "name")

    def complete(self, found: DataFrame) -> None:
        """Institutions (site, a_id, inst) that a worker found: stored with the authors, whose entries are done."""
        found = stored(found.where("inst <> ''").groupBy(*PERSON).agg(F.min("inst").alias("inst")), "found")
        self._add_authors(self.tables.find("author", found).drop("inst", "has_inst").join(found, PERSON))
        self._settle(found)
        self.tables.commit(self.tables.batch)

    def _settle(self, people: DataFrame) -> None:
        open_ = self.tables.find("pending", people).where(F.col("state") != DONE)
        self.tables.append("pending", open_.withColumn("state", F.lit(DONE)))

    # ---- one micro-batch ------------------------------------------------------------------------------------------------

    def add(self, messages: DataFrame, batch: int) -> None:
        """Stores the records of a batch and reports its progress, then scores the queries that it finished.

        Papers, projects and progress write tables, or rows of providers, of their own, and go side by side. The batch's
        scratch tables are deleted once it is committed.
        """
        with temporary(self.spark):
            self._add(messages, batch)

    def _add(self, messages: DataFrame, batch: int) -> None:
        self.tables.begin(batch)
        rows = stored(_with_site(messages), "messages")
        updates: list[DataFrame] = []
        together(lambda: self._add_records(rows, batch), lambda: self._apart(3, lambda: updates.append(self.report(rows, batch))))
        self._score(updates[0].where("state = 1"), batch)
        self.tables.commit(batch)

    def _apart(self, branch: int, step: Callable[[], None]) -> None:
        with self.tables.apart(branch):
            step()

    def _add_records(self, rows: DataFrame, batch: int) -> None:
        self._log(S.malformed(rows).select(*RECORD, "seq", F.lit("malformed").alias("reason")), "malformed", batch)
        new = stored(self._new(S.data_rows(rows)), "new")
        project = F.col("site") == PROJECT_SITE
        ours = performed_by(F.col("perfAgent.code"))
        counts = new.agg(F.count_if(~project & J.refusal().isNull()), F.count_if(~project & J.refusal().isNotNull()),
                         F.count_if(project & ours), F.count_if(project & ~ours)).first()
        steps = []
        if counts[0]:
            steps.append(lambda: self._apart(0, lambda: self._add_papers(new.where(~project & J.refusal().isNull()))))
        if counts[2]:
            steps.append(lambda: self._apart(1, lambda: self._add_projects(new.where(project & ours))))
        if counts[1] or counts[3]:
            reason = F.when(project, F.when(~ours, "agent not analysed")).otherwise(J.refusal())
            steps.append(lambda: self._apart(2, lambda: self.tables.append(
                "refused", new.withColumn("reason", reason).where("reason is not null"))))
        together(*steps)

    def _new(self, data: DataFrame) -> DataFrame:
        """Records that are not stored yet, once each as they came first. Only the batch's own queries are looked up.

        The first copy is found by a row number: `dropDuplicates` would carry every column of the wide records through two
        interpreted sort aggregations.
        """
        seen = reduce(DataFrame.union, [self.tables.find(n, data).select(*RECORD) for n in ("raw", "project", "refused")])
        first = F.row_number().over(Window.partitionBy(*RECORD).orderBy("seq"))
        fresh = data.join(seen.hint("merge"), RECORD, "left_anti")
        return fresh.withColumn("_copy", first).where("_copy = 1").drop("_copy")

    def _add_papers(self, kept: DataFrame) -> None:
        """Papers with resolved authors written back."""
        listed = J.paper_authors(kept, SCOPE)
        known = stored(self._known(listed.select("site", "name", F.col("provider_id").alias("a_id"))), "known")
        listing = stored(J.resolved_papers(kept, known, SCOPE).join(_arrival(kept), RECORD), "listing")
        after = J.grown(listing, known, SCOPE)
        columns = [c for c in kept.columns if c not in ("author", "author_id", "author_inst")]
        written = kept.select(*columns).join(J.listed_ids(listing, SCOPE), RECORD)
        self.tables.append("raw", written.withColumn("crawl_time", X.stamp(F.current_timestamp())))
        self.tables.append("author_paper", listing.withColumnRenamed("id", "paper_id"))
        self._add_paper_authors(after, known, listing, listed)

    def _add_paper_authors(self, after: DataFrame, known: DataFrame, listing: DataFrame, listed: DataFrame) -> None:
        """New authors, and institutions for authors who had none. Who has an id but no institution yet is queued."""
        blank = F.coalesce("inst", F.lit("")) == ""
        without = after.where(blank).select(*PERSON)
        first = F.min(F.struct("seq", "id", "pos", "inst")).alias("_first")
        brought = (listing.where(~blank).join(without, PERSON, "left_semi").groupBy(*PERSON).agg(first)
                   .select(*PERSON, F.col("_first.inst").alias("brought")))
        people = after.join(known.select(*PERSON, F.lit(True).alias("stored")), PERSON, "left").join(brought, PERSON, "left")
        people = stored(people.where("stored is null or brought is not null")
                        .withColumn("inst", F.coalesce("brought", "inst")), "people")
        n, n_settled, n_blank = people.agg(F.count("*"), F.count("stored"), F.count_if(F.col("stored").isNull() & blank)).first()
        if n:
            self._add_authors(people.select(*PERSON, "name", "inst"))
        if n_settled:
            self._settle(people.where("stored"))
        if n_blank:
            given = listed.where("provider_id is not null").select("site", F.col("provider_id").alias("a_id")).distinct()
            queued = people.where(F.col("stored").isNull() & blank).join(given, PERSON, "left_semi")
            self.tables.append("pending", queued.select(
                *PERSON, "name", F.lit(WAITING).alias("state"), F.lit(None).alias("worker")))

    def _add_projects(self, kept: DataFrame) -> None:
        """Projects of the agents that are analysed, with manager and researchers resolved and written back."""
        listed = F.transform(F.split(F.replace("rscId", F.lit('"'), F.lit("")), ";"), X.person_id)
        ids = F.array_append(F.coalesce(listed, F.array().cast("array<string>")), X.person_id(F.col("mngId")))
        people = kept.select("site", F.col("mng").alias("name"), F.explode(ids).alias("a_id"))
        known = stored(self._known(people), "known")
        listing = stored(J.resolved_projects(kept, known, True, SCOPE).join(_arrival(kept), RECORD), "listing")
        after = J.after_projects(listing, known, SCOPE)
        sized = listing.withColumn("n_authors", F.count("*").over(Window.partitionBy(*RECORD)))  # a record's people
        written = kept.drop("mng", "mngId", "rsc", "rscId").join(J.listed_people(listing, SCOPE), RECORD)
        self.tables.append("project", written.withColumn("crawl_time", X.stamp(F.current_timestamp())))
        self.tables.append("author_paper", sized.withColumnRenamed("id", "paper_id").withColumn(
            "n_authors", F.col("n_authors").cast("int")))
        self._add_authors(stored(after.join(known, [*PERSON, "name", "inst"], "left_anti"), "people"))

    # ---- scores -----------------------------------------------------------------------------------------------------------

    def _score(self, finished: DataFrame, batch: int) -> None:
        """Scores the queries whose records are complete, provider by provider, and reports them as analysed."""
        if self.score is None or finished.isEmpty():
            return
        ended = stored(finished.groupBy(*QUERY).agg(F.max("seq").alias("seq"), F.bool_or("is_partial").alias("is_partial")), "ended")
        sites = sorted(r.site for r in ended.select("site").distinct().collect())  # one row per provider
        listing, papers, projects = (stored(self.tables.find(n, ended), n) for n in ("author_paper", "raw", "project"))
        queries = self.tables.find("query", ended)
        scores: dict[int, DataFrame] = {}

        def of_site(step: int, site: str) -> None:
            here = F.col("site") == site
            records = (projects if site == PROJECT_SITE else papers).where(here)
            mine = listing.where(here)
            rows = self.score(site, mine, records, queries).withColumn("site", F.lit(site))
            rows = stored(rows.withColumns({c: F.col(c).cast("double") for c in FACTORS if c in rows.columns}), "scored")
            if self.ranked is not None:
                related = ranking.relations(self.ranked(rows), mine).withColumn("site", F.lit(site))
                self._log(related.select(*names(RELATION)), "relations", batch, step)
            scores[step] = rows

        for first in range(0, len(sites), AT_ONCE):
            together(*(partial(of_site, i, sites[i]) for i in range(first, min(first + AT_ONCE, len(sites)))))
        for step in range(len(sites)):
            self._store(scores[step], batch, step)  # one after the other: they may write into one folder
        both = papers.select(*QUERY, "crawl_time").union(projects.select(*QUERY, "crawl_time"))
        crawled = both.groupBy(*QUERY).agg(F.count("*").alias("data"), F.max("crawl_time").alias("crawl_time"))
        people = listing.select(*QUERY, "a_id").distinct()
        unknown = self.tables.find("pending", people).where(F.col("state") != DONE).select(*PERSON, F.lit(1).alias("open"))
        experts = people.join(unknown, PERSON, "left").groupBy(*QUERY).agg(
            F.count("*").alias("experts"), F.count("open").alias("pending"))
        none = F.lit(0).cast("long")
        done = ended.join(crawled, QUERY, "left").join(experts, QUERY, "left").select(
            *QUERY, "seq", F.lit(100.0).alias("progress"), F.lit(2).alias("state"), "is_partial",
            *(F.coalesce(c, none).alias(c) for c in ("data", "experts", "pending")),
            "crawl_time", X.stamp(F.current_timestamp()).alias("a_time"))
        self._log(done, "status", batch)

    def _store(self, rows: DataFrame, batch: int, step: int) -> None:
        """Stores factor rows part by part, and after each part the rows stored so far, of all, per query."""
        part = F.pmod(F.xxhash64("a_id"), F.lit(self.parts)).cast("int")
        rows = rows.withColumn("part", part)
        counts = stored(rows.groupBy(*QUERY, "part").agg(F.count("*").alias("n")), "parts")
        for i in range(self.parts):
            self.store(rows.where(F.col("part") == i))
            lines = counts.groupBy(*QUERY).agg(
                F.lit(i).alias("part"), F.coalesce(F.sum(F.when(F.col("part") <= i, F.col("n"))), F.lit(0)).alias("rows"),
                F.sum("n").alias("total"))
            self._log(lines.withColumn("progress", F.col("rows") * 100.0 / F.col("total")), "analysis", batch, step * self.parts + i)

    def query_status(self) -> DataFrame:
        """One row per query over all its providers: see `progress.rolled_up`; with the providers' records and experts."""
        updates, done = self.log("updates", P.UPDATE), self.log("status", STATUS)
        status = P.current_status(updates.unionByName(done.select(*names(P.UPDATE))))
        sums = done.groupBy("key_id").agg(F.sum("data").alias("data"), F.sum("experts").alias("experts"), F.sum("pending").alias("pending"))
        return P.rolled_up(status).join(sums, "key_id", "left")


def ingest(stream: DataFrame, collection: Collection, checkpoint: str) -> StreamingQuery:
    """The whole job over a message stream, one loop: store, report, score."""
    return in_batches(S.routed(stream), collection.add, checkpoint)
