"""Provider payloads: single and repeated children, rejects, conform."""

import pytest
from pyspark.sql import functions as F

from laurel.catalog import payloads
from laurel.schemas import PAPER
from laurel.sources import files, providers


def accepted(df):
    return providers.accepted(df).collect()


def payload(spark, text):
    return spark.createDataFrame([(text,)], "payload string")


def test_single_and_repeated_children(spark):
    item = "<item><title>T{0}</title><authors>{1}</authors><publisher><name>P</name></publisher><link_url>NODE{0}</link_url><issue><yymm>202001</yymm></issue></item>"
    author = "<author><name>{0}</name><url>/a/{0}1</url></author>"
    one = item.format(1, author.format("Kim"))
    two = item.format(2, author.format("Lee") + author.format("Park"))
    for items in (one, one + two):
        got = accepted(providers.dbpia_papers(payload(spark, f"<root><result><items>{items}</items></result></root>")))
        assert [r.author for r in got] == ["Kim", "Lee;Park"][: items.count("<item>")]
        assert got[0].journal == "P" and (got[0].start_page, got[0].end_page) == (0, 0)


def test_ndsl_one_author_as_text(spark):
    page = ('callback({"resultSummary":{"totalCount":"2"},"outputData":[{"journalInfo":{"publisher":"P","journalTitleInfo":["J"],'
            '"year":"2020"},"articleInfo":{"@kistiID":"A1","articleTitleInfo":{"articleTitle":"T"},"abstractInfo":["x-y"],'
            '"authorInfo":{"author":"Kim","affiliation":"AB0000001MIT"},"page":"pp.1-9","keyword":"k"}},'
            '{"journalInfo":{},"articleInfo":{"@kistiID":"A2","authorInfo":{"author":"","affiliation":""}}}]})')
    parsed = providers.ndsl_papers(payload(spark, page))
    (row,) = accepted(parsed)
    assert (row.author, row.author_inst, row.abstract, row.start_page, row.end_page) == ("Kim", "MIT", "xy", 1, 9)
    assert [r.reject_reason for r in providers.rejected(parsed).collect()] == ["author and institution counts differ"]


def test_malformed_payload_is_counted(spark):
    parsed = providers.kci_papers(payload(spark, "<MetaData><outputData>"))
    row = providers.reject_counts(parsed.withColumn("k", F.lit(1)), ["k"]).first()
    assert (row.n_read, row.n_failed, row.n_mismatched) == (1, 1, 0)


def test_scopus_number_of_funding_columns_varies(spark, tmp_path):
    head = list(dict.fromkeys(providers.SCOPUS_COLUMNS.values()))
    for extra in ([], ["Funding Text 1"], ["Funding Text 1", "Funding Text 2"]):
        columns = ["﻿Authors", *[c for c in head if c != "Authors"], *extra]
        cells = {"EID": "2-s2.0-9", "Title": "Title!", "Author(s) ID": "1;", "Cited by": "", "Page start": "e5"}
        line = ",".join(cells.get(c, "F" if c in extra else "") for c in columns).replace("", "", 1)
        path = tmp_path / f"export{len(extra)}.csv"
        path.write_text(",".join(columns) + "\n" + '"Kim, J."' + line + "\n")
        (row,) = accepted(providers.scopus_papers(files.read_export(spark, str(path), providers.SCOPUS_COLUMNS)))
        assert (row.id, row.title, row.author, row.author_id, row.citation, row.start_page) == ("9", "Title", "Kim; J.", "1", 0, 5)
        assert row.funding_text == ["F"] * len(extra)


def test_exports_of_unequal_headers_in_one_scan(spark, tmp_path):
    """Quoted cells with separators, line breaks and quotes; short and long rows; blank lines; both line ends."""
    (tmp_path / "a.csv").write_text('Name,EID,Title,Funding Text 1\n"x, y",1,"a ""b""\nc, d",F1\n\n,2,"",\n"""",3,"""q"""\n', newline="")
    (tmp_path / "b.csv").write_text('?,Funding Text 1,Title,Funding Text 2,EID\r\nz,,"t,\r\nu",G2,4,more\r\nw,H1,plain,,5', newline="")
    (tmp_path / "c.csv").write_text("Name,EID,Title\n")
    (tmp_path / "d.csv").write_text("")
    got = files.read_export(spark, f"{tmp_path}/*.csv", {"who": "Authors", "id": "EID", "title": "Title", "no": "Missing"})
    rows = sorted((tuple(r) for r in got.collect()), key=lambda r: r[1])
    assert rows == [("x, y", "1", 'a "b"\nc, d', None, ["F1"]), (None, "2", None, None, [""]), ('"', "3", '"q"', None, [""]),
                    ("z", "4", "t,\r\nu", None, ["", "G2"]), ("w", "5", "plain", None, ["H1", ""])]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan text") == 1 and "Exchange" not in plan


def test_wos_year_chain_and_defaults(spark):
    width = providers.WOS_WIDTH
    def line(**at):
        return tuple(at.get(f"c{i}", "") for i in range(width))
    rows = [line(c5="Kim, J", c22="MIT", c61="WOS:1", c44="2019", c30="3", c34="0"),
            line(c5="Kim, J", c22="", c61="WOS:2", c56="2020", c59="Cat", c20="Plus"),
            line(c5="Kim, J", c22="MIT", c61="WOS:3", c56="APR 2021", c20="Plus"),
            line(c5="Kim, J", c22="MIT", c61="WOS:4"),
            line(c5="Kim, J; Lee, S", c22="[Kim, J] MIT", c61="WOS:5", c44="2019")]
    parsed = providers.wos_papers(spark.createDataFrame(rows, files.positional_schema(width)))
    got = {r.id: r for r in accepted(parsed)}
    assert {k: r.issue_year for k, r in got.items()} == {"1": "2019", "2": "2020", "3": "2021"}
    assert (got["1"].usage_count, got["2"].usage_count, got["2"].paper_keyword, got["3"].paper_keyword) == (1, 1, "Cat", "Plus")
    assert {r.id: r.reject_reason for r in providers.rejected(parsed).collect()} == {
        "4": "no year", "5": "author and institution counts differ"}


def test_conform(spark):
    df = providers.conform(spark.createDataFrame([("1", "7")], "id string, citation string"))
    assert df.columns == [c.strip().split()[0] for c in PAPER.split(",")]
    assert df.first().citation == 7 and df.first().title is None


@pytest.mark.parametrize("site", ["NTIS", "DBPIA", "SCIENCEON", "KCI", "SCOPUS", "WOS"])
def test_every_provider_has_a_parser(site):
    assert callable(providers.PARSERS[site])


@pytest.mark.parametrize("bound,folder,start", [("EXPORT", "scopus_folder", '"2-s2.0-|,2-s2.0-'), ("DOCUMENT", "ntis_folder", "<HIT>")])
def test_files_of_bounded_size(spark, data, monkeypatch, bound, folder, start):
    """A file that one task reads whole holds a bounded number of records, however many a task writes."""
    monkeypatch.setattr(payloads, bound, 7)
    whole = spark.read.text(getattr(payloads, folder)(spark, data), wholetext=True)
    sizes = [r.n for r in whole.select(F.size(F.split("value", start)).alias("n")).collect()]
    rows = payloads.source_rows(spark, data).count()
    assert max(sizes) <= 8 and sum(n - 1 for n in sizes) == rows > 70


def test_wos_institutions_are_worked_out_once_for_the_check(spark):
    """The addresses are read once for the check and once for the field."""
    cells = {5: "Kim, A; Lee, B", 22: "[Kim, A; Lee, B] Seoul", 25: "Lee, B/R-1", 26: "Kim, A/O-2", 44: "2001", 61: "WOS:1"}
    export = spark.createDataFrame([[cells.get(i, "") for i in range(providers.WOS_WIDTH)]], files.positional_schema(providers.WOS_WIDTH))
    done = providers.accepted(providers.wos_papers(export))
    row = done.first()
    assert (row.author_inst, row.r_id, row.o_id) == ("Seoul;Seoul", ";R-1", "O-2;")
    assert done._jdf.queryExecution().optimizedPlan().toString().count("Contains(") == 2


def test_documents_are_packed_and_read_whole(spark, data):
    """Tags repeat in every element: a packed document is a fraction of its text, and all of its elements are read."""
    from pathlib import Path

    from laurel.catalog import payloads
    from laurel.sources import files, providers

    folder = payloads.ntis_folder(spark, data)
    parts = list(Path(folder.removeprefix("file:")).glob("part-*"))
    assert parts and all(p.name.endswith(".gz") for p in parts)
    text = spark.read.text(folder).agg(F.sum(F.octet_length("value"))).first()[0]
    assert sum(p.stat().st_size for p in parts) * 5 < text
    assert files.read_xml(spark, folder, "HIT", providers.NTIS_HIT).count() == payloads.source_rows(spark, data).count()
