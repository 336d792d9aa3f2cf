"""The pipeline next to brute-force versions of its stages."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from laurel.llm.queries import tokenizer_file
from laurel.session import stored


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage took in and gave out."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # Awkward rows go through all stages.
    more = spark.createDataFrame([(90_001, None, None, None, None), (90_002, "", "en", "s", 0), (90_003, "12 34", "en", "s", 5),
                                  (90_004, "The same words again", "en", "s", 1), (90_004, "The same words again", "en", "s", 1),
                                  (90_005, "the SAME words again", "en", None, 1), (None, "Words without any id", None, None, None)],
                                 docs.schema)
    docs = stored(docs.union(more), "docs")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stored(stage(spark, steps[-1], sf), "step"))
    return steps


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_columns_stay(stages):
    for step in stages[1:-1]:
        assert step.columns == stages[0].columns


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    left = {i for i, _ in texts(stages[1])}
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    toxic, clean = ([i for i, t in marks.items() if t == k] for k in (1, 0))
    assert np.mean([i in left for i in clean]) > 0.98
    assert np.mean([i not in left for i in toxic]) > 0.5  # 38 toxic documents to learn from; some carry no sign


def test_language_stage_rejects_texts_without_letters(stages):
    before, after = texts(stages[1]), texts(stages[2])
    gone = {i for i, _ in before} - {i for i, _ in after}
    assert gone == {i for i, t in before if not any(c.isalpha() for c in t)}


def test_exact_copies(stages):
    before, after = texts(stages[2]), texts(stages[3])
    keep = {}
    for i, t in before:
        keep[lowered(t)] = max(keep.get(lowered(t), -1), -1 if i is None else i)
    assert sorted((-1 if i is None else i, lowered(t)) for i, t in after) == sorted((i, t) for t, i in keep.items())


def test_near_copies(stages):
    from test_operators import brute_classes

    before, after = texts(stages[3]), texts(stages[4])
    classes = brute_classes([(i, t) for i, t in before if i is not None])
    assert {i for i, _ in after} == {i for i, (_, root) in classes.items() if i == root} | {None}


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    clean = "A quiet walk along the river in the morning light"
    more = spark.createDataFrame([(95_001, "you idiot you stupid moron", None), (95_001, clean, None), (None, "you idiot you stupid moron", None),
                                  (95_002, "12 34", None), (95_002, clean, None), (95_002, None, None)], docs.schema)
    docs = docs.union(more)
    added = "doc_id > 95000 or doc_id is null"
    left = texts(corpus_pipeline.drop_toxic(spark, docs, sf).where(added))
    assert sorted(map(repr, left)) == sorted(map(repr, [(95_001, clean), (95_002, "12 34"), (95_002, clean), (95_002, "")]))
    left = texts(corpus_pipeline.drop_undetermined(spark, docs, sf).where("doc_id = 95002"))
    assert left == [(95_002, clean)]


def test_near_copies_of_rows_that_share_an_id(spark):
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(3, base), (5, "a unique text of its own"), (5, base + " more"), (6, other), (4, other + " tail"), (4, "yet another text"),
            (7, other + " end"), (8, "alone"), (8, "alone"), (9, base + " x"), (9, base + " y"), (None, base)]
    got = texts(corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), ""))
    want = [(3, base), (5, "a unique text of its own"), (4, other + " tail"), (4, "yet another text"), (8, "alone"), (8, "alone"), (None, base)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


AWKWARD = ("doc_id long, text string, lang string, id string, sha string, number int, _key string, row string, doc string, spot int, "
           "bucket int, bits string, own_id int, own_sha int, place int, _rank int, _text string, _lang string, toxic int, size int")


@pytest.fixture(scope="module")
def awkward(spark):
    """Repeated ids and rows, null and empty texts, the largest id, and columns named like those used inside."""
    base = " ".join(f"the river w{i}" for i in range(40))
    texts_ = [(1, base), (1, base + " more"), (2, None), (2, ""), (3, "Some words of a quiet morning"), (3, "Some words of a quiet morning"),
              (4, "some WORDS of a quiet morning"), (2**63 - 1, base + " end"), (2**63 - 1, "another text altogether"), (None, base), (None, None),
              (5, "you idiot you stupid moron"), (6, "12 34")]
    return spark.createDataFrame([(i, t, "en", "i", "s", 1, "k", "r", "d", 2, 3, "b", 4, 5, 6, 7, "t", "l", 1, 9) for i, t in texts_], AWKWARD)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_tables(spark, awkward, name, stage):
    sf = "/root/testdata/sf0.001"
    got = stage(spark, awkward, sf)
    if stage is corpus_pipeline.pack_sequences:
        assert got.select("doc_id").distinct().count() == 8
    else:
        assert got.columns == awkward.columns and 0 < got.count() <= awkward.count()
        assert {r.row for r in got.collect()} == {"r"}
    assert stage(spark, awkward.limit(0), sf).collect() == []


def test_near_copies_on_awkward_tables(spark, awkward):
    got = sorted((repr((r.doc_id, r.text)) for r in corpus_pipeline.drop_near_copies(spark, awkward, "").collect()))
    base = " ".join(f"the river w{i}" for i in range(40))
    first = min((base, base + " more"), key=lambda t: __import__("hashlib").sha256(t.encode()).hexdigest())
    want = [(1, first), (2, None), (2, ""), (3, "Some words of a quiet morning"), (3, "Some words of a quiet morning"),
            (2**63 - 1, "another text altogether"), (None, base), (None, None), (5, "you idiot you stupid moron"), (6, "12 34")]
    assert got == sorted(map(repr, want))


def test_packing_covers_what_is_left(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    total = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts(stages[4])}
    got = stages[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == total


def test_run_on_a_folder(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.length > 0 and zlib.crc32(b"") <= r.ids_crc32 for r in rows)
