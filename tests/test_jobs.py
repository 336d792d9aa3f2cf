"""The collecting job batch by batch: providers side by side, repeated batches, pending authors, landed exports."""

import re

import pytest
from pyspark.sql import functions as F

from laurel.schemas import MESSAGE, names
from laurel.session import scratch_path
from laurel.sources import tables
from laurel.streaming import jobs
from laurel.streaming import records as S

FIELDS = "site string, key_id string, id string, seq long, progress double, author string, author_id string, author_inst string"


def batch(spark, rows):
    df = spark.createDataFrame(rows, FIELDS)
    kinds = dict(zip(names(MESSAGE), [t.split(None, 1)[1] for t in _ddl()], strict=True))
    return S.routed(df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names(MESSAGE)]))


def _ddl():
    from laurel.schemas import fields

    return [f"{n} {t}" for n, t in fields(MESSAGE).items()]


def count_papers(site, listing, records, queries):
    """Scores: papers per author; the query text counts as quality, so that it can be seen."""
    counted = listing.groupBy("key_id", "a_id").agg(F.count("*").cast("double").alias("productivity"))
    return counted.join(queries.select("key_id", F.length("query").cast("double").alias("quality")), "key_id", "left")


@pytest.fixture()
def job(spark):
    factors = scratch_path(spark, "factors")
    authors = spark.createDataFrame([("A", "7", "Kim", "MIT")], "site string, a_id string, name string, inst string")
    queries = spark.createDataFrame([("q", "fuel")], "key_id string, query string")
    made = jobs.Collection(spark, scratch_path(spark, "facts"), authors, count_papers,
                           lambda rows: tables.store_factors(rows, factors), queries, parts=2)
    made.factors = factors
    return made


FIRST = [("A", "q", "1", 1, 0.5, "Kim;Lee", None, "MIT;MIT"), ("A", "q", "2", 2, 1.0, "Lee", None, "MIT"),
         ("B", "q", "1", 1, 0.3, "Kim", None, "MIT"), ("B", "q", "9", 2, 0.4, None, None, None)]
SECOND = [("B", "q", "1", 3, 0.6, "Kim", None, "MIT"), ("B", "q", "3", 4, 1.0, "Kim;Park", None, "MIT;KAIST")]


def state(spark, job):
    listing = sorted((r.site, r.paper_id, r.pos, r.a_id) for r in job.table("author_paper").collect())
    status = sorted((r.site, r.key_id, r.state, r.data, r.experts, r.pending) for r in job.log("status", jobs.STATUS).collect())
    return listing, status, sorted((r.site, r.id, r.reason) for r in job.table("refused").collect()), job.authors().count()


def test_providers_of_one_query_side_by_side(spark, job):
    job.add(batch(spark, FIRST), 0)
    assert state(spark, job)[1] == [("A", "q", 2, 2, 2, 0)]
    assert [(r.state, r.n_sites, r.progress) for r in job.query_status().collect()] == [(0, 2, 70.0)]
    job.add(batch(spark, SECOND), 1)
    listing, status, refused, n_authors = state(spark, job)
    assert status == [("A", "q", 2, 2, 2, 0), ("B", "q", 2, 2, 2, 0)]
    assert refused == [("B", "9", "no author")]
    ids = {(s, p, i): a for s, p, i, a in listing}
    assert len(listing) == 6 and ids["A", "1", 0] == "7" and ids["B", "1", 0].startswith("s")  # known to one provider only
    assert n_authors == 4
    rows = {(r.site, r.a_id): (r.productivity, r.quality) for r in tables.load(spark, job.factors).collect()}
    assert sorted(rows.values()) == [(1.0, 4.0), (1.0, 4.0), (2.0, 4.0), (2.0, 4.0)] and rows["A", "7"] == (1.0, 4.0)
    assert [(r.state, r.n_sites, r.data, r.experts) for r in job.query_status().collect()] == [(2, 2, 4, 4)]


def test_repeated_batches_and_a_restart_change_nothing(spark, job):
    job.add(batch(spark, FIRST), 0)
    job.add(batch(spark, FIRST), 0)
    job.add(batch(spark, SECOND), 1)
    once = state(spark, job)
    again = jobs.Collection(spark, job.folder, spark.createDataFrame([], "site string, a_id string, name string, inst string"),
                            count_papers, job.store, parts=2)
    assert state(spark, again) == once
    again.add(batch(spark, SECOND), 1)
    assert state(spark, again) == once


def test_authors_without_institution_wait(spark, job):
    job.add(batch(spark, [("D", "q", "1", 1, 0.5, "Han;Cho", "h1;c1", None), ("D", "q", "2", 2, 0.6, "Yu", "y1", "SNU"),
                          ("D", "q", "3", 3, 0.7, "Oh", "o1", None), ("D", "q", "4", 4, 0.8, "Oh", "o1", "KU")]), 0)
    waiting = lambda: sorted((r.a_id, r.state) for r in job.table("pending").collect())
    assert waiting() == [("c1", "waiting"), ("h1", "waiting")]
    assert [r.a_id for r in job.claim(1, "w").collect()] == ["c1"]
    assert waiting() == [("c1", "claimed"), ("h1", "waiting")]
    job.add(batch(spark, [("D", "q", "5", 5, 1.0, "Han", "h1", "POSTECH")]), 1)
    assert waiting() == [("c1", "claimed"), ("h1", "done")]
    assert [(r.experts, r.pending) for r in job.log("status", jobs.STATUS).collect()] == [(4, 1)]
    job.complete(spark.createDataFrame([("D", "c1", "KAIST"), ("D", "unknown", "X")], "site string, a_id string, inst string"))
    assert {w[1] for w in waiting()} == {"done"}
    people = {r.a_id: (r.inst, r.has_inst) for r in job.authors().where("site = 'D'").collect()}
    assert people == {"h1": ("POSTECH", True), "c1": ("KAIST", True), "y1": ("SNU", True), "o1": ("KU", True)}


def test_analysis_lines_rise_to_the_total(spark, job):
    many = ";".join(f"Author {i}" for i in range(60))
    job.add(batch(spark, [("A", "q", "1", 1, 1.0, many, None, ";".join(["MIT"] * 60))]), 0)
    lines = sorted((r.part, r.rows, r.total, r.progress) for r in job.log("analysis", jobs.ANALYSIS).collect())
    assert [p for p, *_ in lines] == [0, 1] and lines[-1][1:] == (60, 60, 100.0)
    assert [r for _, r, *_ in lines] == sorted(r for _, r, *_ in lines) and lines[0][1] > 0


def test_state_of_bounded_duplicates_falls(spark):
    folder, out = scratch_path(spark, "copies"), scratch_path(spark, "out")
    for hour in range(8):
        rows = spark.range(100).select(F.lit("q").alias("key_id"), (F.col("id") + 100 * hour).cast("string").alias("id"),
                                       F.timestamp_seconds(F.lit((hour + 1) * 3600)).alias("sent"))
        rows.union(rows).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    with jobs.state_on_disk(spark):
        run = jobs.to_table(S.deduplicated(stream, "sent", "90 minutes"), out, scratch_path(spark, "ck"))
        run.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert spark.read.parquet(out).count() == 800 and max(held) <= 500
    assert spark.conf.get(jobs.STATE_STORE).endswith("HDFSBackedStateStoreProvider")


def test_records_of_a_batch_are_never_broadcast(spark, job, monkeypatch, capsys):
    """Stored records are wide and mostly NULL: by their file size Catalyst takes any number of them for a small table."""
    plans, stored = {}, jobs.stored

    def seen(df, name):
        capsys.readouterr()
        df.explain()
        plans.setdefault(name, capsys.readouterr().out)
        return stored(df, name)

    monkeypatch.setattr(jobs, "stored", seen)
    job.add(batch(spark, FIRST), 0)
    for name in ("listing", "new"):
        joins = [line for line in plans[name].splitlines() if re.search(r"Join \[site#\d+, key_id#\d+, id#\d+\]", line)]
        assert joins and all("SortMergeJoin" in line for line in joins)


def test_copies_within_a_batch_keep_the_first_and_no_wide_aggregation(spark, job):
    rows = [("A", "q", "1", 5, 0.5, "Park", None, "MIT"), ("A", "q", "1", 1, 0.5, "Kim", None, "MIT"), ("A", "q", "1", 1, 0.5, "Kim", None, "MIT"),
            ("A", "q", None, 3, 0.5, "Lee", None, "MIT"), ("A", "q", "2", 2, 0.5, "Lee", None, "MIT"), ("B", "q", "1", 4, 0.5, "Cho", None, "MIT")]
    job.add(batch(spark, [("A", "q", "2", 1, 0.2, "Lee", None, "MIT")]), 0)
    job.tables.begin(1)
    new = job._new(S.data_rows(batch(spark, rows)))
    assert sorted((r.site, r.id, r.seq, r.author) for r in new.collect()) == [("A", "1", 1, "Kim"), ("B", "1", 4, "Cho")]
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan.split("== Initial Plan ==")[-1]


def test_a_batch_leaves_no_scratch_tables(spark, job, monkeypatch):
    """What a batch stores for itself is gone once it is committed, and what it reports can still be read."""
    from pathlib import Path

    from laurel import session

    made, path_of = [], session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda spark, name: made.append(path_of(spark, name)) or made[-1])
    job.add(batch(spark, FIRST), 0)
    assert len(made) > 5 and not any(Path(p.removeprefix("file:")).exists() for p in made)
    assert state(spark, job)[1] == [("A", "q", 2, 2, 2, 0)]


def test_papers_and_progress_go_side_by_side(spark, job, monkeypatch):
    """Progress is reported while the records are stored: neither waits for the other to end."""
    from threading import Barrier

    both = Barrier(2, timeout=120)
    for name in ("_add_papers", "report"):
        monkeypatch.setattr(job, name, lambda *a, step=getattr(job, name): (both.wait(), step(*a))[1])
    job.add(batch(spark, FIRST), 0)
    assert state(spark, job)[1] == [("A", "q", 2, 2, 2, 0)]


def test_landed_messages_are_packed_in_order(spark, data, monkeypatch):
    """A query's rows of a send lie in one file; the tables that the messages were made from are gone."""
    from pathlib import Path

    from laurel.catalog import streams
    from laurel.sources import messages

    made = []
    monkeypatch.setattr(streams, "stored", lambda df, name, put=streams.stored: made.append(put(df, name)) or made[-1])
    folder = streams.landed_messages(spark, data, streams.sent_projects)
    files = list(Path(folder.removeprefix("file:")).glob("part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files)
    placed = spark.read.json(folder).select("keyId", F.input_file_name().alias("file")).distinct()
    assert placed.count() == placed.select("keyId").distinct().count()
    assert made and not any(Path(f.removeprefix("file://")).exists() for df in made for f in df.inputFiles())
    assert spark.read.json(folder).count() == streams.sent_projects(spark, data).count()
    assert messages.stream(spark, folder).isStreaming
