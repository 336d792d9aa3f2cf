"""Author resolution on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from laurel.operators import authors as J
from laurel.operators import dedup, ranking, search

PAPER = "key_id string, id string, author string, author_id string, author_inst string"
PROJECT = """key_id string, id string, seq long, mng string, mngId string, rsc string, rscId string, ldAgency string,
             perfAgent struct<code: string, value: string>"""


@pytest.fixture(scope="module")
def authors(spark):
    return spark.createDataFrame([("7", "Kim", "MIT"), ("8", "Lee", "")], "a_id string, name string, inst string")


def listed(df):
    return sorted((r.id, r.pos, r.a_id, r.name, r.inst) for r in df.collect())


def test_papers(spark, authors):
    papers = spark.createDataFrame([
        ("k", "1", "Kim ; Choi", None, " MIT;KAIST;extra"),  # known and new; the longer list is cut
        ("k", "2", "Lee", None, None),                       # no institution
        ("k", "3", "Kim;Park", "7;9", None),                 # provider ids
        ("k", "4", "Kim;Park", "7", None),                   # lengths differ: rejected
        ("k", "5", None, None, "MIT"),                       # no author
    ], PAPER)
    listing, grown = J.resolve_papers(papers, authors)
    rows = listed(listing)
    new = rows[1][2]
    assert new.startswith("s") and len(new) == 17
    assert rows == [("1", 0, "7", "Kim", "MIT"), ("1", 1, new, "Choi", "KAIST"), ("2", 0, "8", "Lee", ""),
                    ("3", 0, "7", "Kim", ""), ("3", 1, "9", "Park", "")]
    assert {r.a_id: (r.name, r.inst) for r in grown.collect()} == {
        "7": ("Kim", "MIT"), "8": ("Lee", ""), new: ("Choi", "KAIST"), "9": ("Park", "")}
    back = {r.id: r.author_id for r in J.listed_ids(listing).collect()}
    assert back == {"1": f"7;{new}", "2": "8", "3": "7;9"}


def projects(spark):
    span = "<span class=\\search_word\\>"
    return spark.createDataFrame([
        ("k", "1", 1, "Kim", '"001.7"', 'Kim;Choi;없음;Yoo...', "001.7;001.20;001.21;001.22", f"KAIST {span}Lab</span>", ("03", "U")),
        ("k", "2", 2, "Han", "null", "A;B", None, "POSTECH", ("03", "U")),
        ("k", "3", 3, "Kim", "7", None, None, "Elsewhere", ("09", "U")),
        ("k", "4", 4, "Kim", "7", "Song", "null", "UNIST", ("03", "U")),
    ], PROJECT)


def test_projects(spark, authors):
    listing, after = J.resolve_projects(projects(spark), authors)
    rows = listed(listing)
    han = rows[3][2]
    assert rows == [
        ("1", -1, "7", "Kim", "KAISTLab"), ("1", 0, "7", "Kim", "MIT"), ("1", 1, "20", "Choi", "KAISTLab"),
        ("2", -1, han, "Han", "POSTECH"), ("4", -1, "7", "Kim", "UNIST")]
    table = {r.a_id: (r.name, r.inst) for r in after.collect()}
    assert table == {"7": ("Kim", "UNIST"), "8": ("Lee", ""), "20": ("Choi", "KAISTLab"), han: ("Han", "POSTECH")}
    once = listed(J.resolve_projects(projects(spark), authors, distinct=True)[0])
    assert [r[:3] for r in once] == [("1", -1, "7"), ("1", 1, "20"), ("2", -1, han), ("4", -1, "7")]
    back = {r.id: (r.mng, r.mngId, r.rsc, r.rscId) for r in J.listed_people(listing).collect()}
    assert back["1"] == ("Kim", "7", "Kim;Choi", "7;20") and back["4"] == ("Kim", "7", "", "")


def test_surrogates_are_stable_and_distinct(spark):
    ids = spark.createDataFrame([("a", "b"), ("a", "b"), ("ab", "")], "n string, i string").select(
        J.surrogate_id(F.col("n"), F.col("i")).alias("s")).collect()
    assert ids[0].s == ids[1].s != ids[2].s


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([("k", "1", 3, "x"), ("k", "1", 2, "y"), ("k", "2", 1, None)], "key_id string, id string, seq int, v string")
    once = dedup.first_per_key(df, dedup.RECORD, ["seq"])
    rows = sorted((r.id, r.seq, r.v) for r in once.collect())
    assert rows == [("1", 2, "y"), ("2", 1, None)]
    assert sorted((r.id, r.seq, r.v) for r in dedup.first_per_key(once, dedup.RECORD, ["seq"]).collect()) == rows


def test_relations_count_shared_records(spark):
    pairs = [("p1", "a"), ("p1", "b"), ("p1", "c"), ("p2", "a"), ("p2", "b"), ("p2", "b"), ("p3", "c")]
    listing = spark.createDataFrame([("k", *p) for p in pairs], "key_id string, paper_id string, a_id string")
    got = {(r.a_id, r.co_a_id): r.n_papers for r in ranking.relations(listing.where("a_id = 'a'"), listing).collect()}
    assert got == {("a", "b"): 2, ("a", "c"): 1}


@pytest.mark.parametrize("all_of,any_of,none_of,want", [
    (["fuel"], ["x"], [], ["1", "3"]), ([], ["fuel", "solar"], [], ["1", "2", "3"]), (["fuel"], [], ["cell"], ["3"]),
    ([], [], ["fuel"], ["2"])])
def test_keyword_groups(spark, all_of, any_of, none_of, want):
    df = spark.createDataFrame([("1", "fuel cell"), ("2", "solar"), ("3", "fuel")], "id string, t string")
    assert sorted(r.id for r in df.where(search.keyword_filter(F.col("t"), all_of, any_of, none_of)).collect()) == want


def test_topic_search_terms(spark):
    df = spark.createDataFrame([("1", "Fuel cell stack"), ("2", "fuel cell membrane"), ("3", "cell")], "id string, t string")
    got = df.where(search.topic_search([F.col("t")], ["fuel", '"cell"', "!membrane"]))
    assert [r.id for r in got.collect()] == ["1"]


def test_persons_of_pairs(spark):
    """Chains become one person; ids of one record do not, and a chain over such a pair falls back to best pairs."""
    pairs = [("q", "a", "b"), ("q", "b", "c"), ("q", "d", "e"), ("q", "k", "l"), ("r", "k", "l"), ("q", "l", "m"), ("q", "m", "n"), ("q", "x", "y")]
    df = spark.createDataFrame([(*p, "moved") for p in pairs], "key_id string, a_id string, other_id string, reason string")
    records = [("q", "1", "d"), ("q", "1", "e"), ("q", "2", "k"), ("q", "2", "n"), ("q", "3", "a"), ("r", "3", "b"), ("q", "4", "z")]
    listing = spark.createDataFrame(records, "key_id string, paper_id string, a_id string")
    got = {r.a_id: r.person for r in J.persons(df, listing).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "k": "k", "l": "k", "m": "m", "n": "n", "x": "x", "y": "x"}


def test_pairs_of_one_person_by_brute_force(spark, capsys):
    """Equal to all pairs tested one by one, missing parts of names too; what meets per co-author holds no text."""
    rng = random.Random(5)
    names = ["Kim, Min Ho", "KIM, M.", "Kim,", "Lee, Min Ho", "Lee, So Ra", None, "Park", "Lee, S", ", Min Ho"]
    people = [(i, rng.choice(names), rng.choice(["A", "B", None])) for i in range(30)]
    listing = sorted({(rng.choice(["q", "r"]), rng.randrange(40), rng.randrange(30)) for _ in range(160)})
    by_record, shared = {}, {}
    for k, p, a in listing:
        by_record.setdefault((k, p), set()).add(a)
    for (k, _), ids in by_record.items():
        for a in ids:
            shared.setdefault((k, a), set()).update(ids - {a})

    def parts(name):
        cut = (name.lower().split(",") + [""])[:2]
        return cut[0].strip(), cut[1].strip().rstrip(".").rstrip()

    want = set()
    for k in "qr":
        for a, na, ia in people:
            for b, nb, ib in people:
                if a >= b or not shared.get((k, a), set()) & shared.get((k, b), set()) or na is None or nb is None:
                    continue
                (s, g), (t, h) = parts(na), parts(nb)
                if s == t and g[:1] == h[:1] and (len(g) > 1) != (len(h) > 1):
                    want.add((k, a, b, "short name"))
                if s == t and g == h and None not in (ia, ib) and ia != ib:
                    want.add((k, a, b, "moved"))
                if g == h and len(g) > 1 and ia == ib and s != t:
                    want.add((k, a, b, "new surname"))
    found = J.same_author(spark.createDataFrame(listing, "key_id string, paper_id long, a_id long"),
                          spark.createDataFrame([p for p in people if p[1]], "a_id long, name string, inst string"))
    assert {tuple(r) for r in found.collect()} == want and {r[3] for r in want} == {"short name", "moved", "new surname"}
    found.explain()
    meets = [line for line in capsys.readouterr().out.splitlines() if "Join" in line and "<" in line]
    assert meets and not any(c in line for line in meets for c in ("block#", "reason#", "key_id#"))


def test_pairs_met_under_many_co_authors_leave_a_cell_once():
    """Two marks that share very many co-authors are one pair; blocks and ids of another type are kept apart."""
    import pyarrow as pa

    from laurel.operators.namesakes import meet

    lists = [(f"c{i}", ["x", "y", "z", "none"]) for i in range(300)] * 2 + [("x", ["y"])]
    marks = [("x", 7, 1), ("y", 7, 2), ("z", 7, 1), ("x", 9, 1), ("z", 9, 2), ("z", 9, 3), ("w", 9, 4)]
    got = meet(pa.table({"q": pa.array([5] * 601), "co": [c for c, _ in lists], "ids": [i for _, i in lists]}),
               pa.table({"q": pa.array([5] * 7), "a_id": [a for a, _, _ in marks], "b": [b for _, b, _ in marks], "v": [v for _, _, v in marks]}))
    assert sorted(zip(*(got[c].to_pylist() for c in ("q", "b", "a_id", "other_id")))) == [
        (5, 7, "x", "y"), (5, 7, "y", "z"), (5, 9, "x", "z"), (5, 9, "x", "z")]


@pytest.mark.parametrize("cell,hub,table", [(40, 50_000, 1 << 26), (10_000, 25, 7), (30, 20, 64)])
def test_cells_and_hubs_change_no_pairs(spark, monkeypatch, cell, hub, table):
    """Cells of few co-authors, hubs apart, and pairs in strips give what one cell gives."""
    from laurel.operators import namesakes

    rng = random.Random(8)
    names = ["Kim, Min Ho", "Kim, M.", "Kim, So Ra", "Lee, Min Ho", "Lee, M", "Park, Mi Na"]
    people = spark.createDataFrame([(f"p{i}", rng.choice(names), rng.choice("AB")) for i in range(40)], "a_id string, name string, inst string")
    listing = spark.createDataFrame(sorted({(rng.choice("qr"), rng.randrange(60), f"p{rng.choice([0, 1, *range(40)])}") for _ in range(300)}),
                                    "key_id string, paper_id long, a_id string")
    want = sorted(map(tuple, J.same_author(listing, people).collect()))
    monkeypatch.setattr(J, "CELL", cell)
    monkeypatch.setattr(J, "HUB", hub)
    monkeypatch.setattr(namesakes, "TABLE", table)
    monkeypatch.setattr(namesakes, "MARKS", 5)
    monkeypatch.setattr(namesakes, "MET", 4)
    assert sorted(map(tuple, J.same_author(listing, people, J.author_lists(listing)).collect())) == want and len(want) > 50


def test_persons_take_pairs_once(spark):
    """The pairs are evaluated once, and ids of very many records are not met record by record."""
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    pairs = spark.createDataFrame([("q", 1, 2, "moved"), ("q", 2, 3, "moved")], "key_id string, a_id long, other_id long, reason string")
    listing = spark.createDataFrame([("q", 7, 1), ("q", 7, 3), ("q", 8, 2)], "key_id string, paper_id long, a_id long")
    got = {r.a_id: r.person for r in J.persons(pairs.mapInArrow(seen, pairs.schema), listing).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and runs.value == 2


def test_connected(spark):
    from laurel.operators.graph import connected

    pairs = [(i, i + 1) for i in range(50)] + [(80, 70), (75, 80), (90, 90), (None, 2), (100, 101)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 70: 70, 75: 70, 80: 70, 100: 100, 101: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []
