"""The operators on awkward rows, and next to brute force or the library they must agree with."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from compare import compare, oracle
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from laurel.llm import (exact_dedup, fingerprints, html_text, jaccard_join, language, packing, pieces, sharding, tables,
                        toxicity, url_lists)
from laurel.llm.components import components

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, norm string, size long, block int, "
        "edges string, kind string, row string, bits string, a long, root long, features string")
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


@pytest.fixture(scope="module")
def messy(spark):
    """Nulls in any column, empty, blank and long texts, repeated rows and texts, clashing column names."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    texts = [(1, "Alpha beta gamma"), (2, "alpha BETA gamma"), (3, None), (4, ""), (5, "   \n\t "), (6, LONG), (7, LONG + " x"),
             (8, "é ÉÈ 日本 \U0001f600"), (8, "é ÉÈ 日本 \U0001f600"), (9, base), (10, base.upper()), (11, base + " more"),
             (12, "123 ... !!!"), (None, "no id here"), (None, None), (13, "you idiot you stupid moron"), (14, "x"),
             (15, "it's a we'RE <|endoftext|> \x1c y\xa0z"), (16, "a" * 5000)]
    rows = [(i, t, None if k % 3 else "en", None, None, "n", 7, 1, "e", "k", "r", "b", 5, 6, "f") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]


def same_rows(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_id_filter_keeps_every_id(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("spot"), F.lit("x").alias("row"))
    ids = spark.range(0, 5000, 7).select("id")
    assert {r.doc_id for r in tables.with_ids(docs, ids).collect()} >= set(range(0, 5000, 7))
    left = tables.without_ids(docs, ids)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [i for i in range(5000) if i % 7]


def test_content_sort_on_awkward_rows(messy, none):
    got = rows(exact_dedup.content_sort(messy))
    texts = [(r.doc_id, (r.text or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER))) for r in messy.collect()]
    groups = {}
    for i, t in texts:
        groups.setdefault(t, []).append(i)
    assert len(got) == len(texts)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
    for h, ids in by_hash.items():
        kept = [r for r in got if r["text_sha256"] == h and r["kept"]]
        assert len(kept) == 1 and kept[0]["doc_id"] == max((i for i in ids if i is not None), default=None)
    assert rows(exact_dedup.content_sort(none)) == []


def test_content_sort_of_one_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("Hot ")).otherwise(
        F.concat(F.lit("t"), (F.col("id") % 700).cast("string"))).alias("text"))
    got = {r["doc_id"]: r for r in rows(exact_dedup.content_sort(docs))}
    assert got[0]["keep_id"] == 2997 and got[0]["group_size"] == 1000
    assert sum(r["kept"] for r in got.values()) == len({r["text_sha256"] for r in got.values()})


def test_differencing_is_a_partition_and_tight():
    weights = np.random.default_rng(5).integers(1, 10_000, 3000)
    partials = np.zeros((3000, 8), np.int64)
    partials[:, 0] = weights
    parts, sums = sharding.differenced(partials)
    assert np.array_equal(np.bincount(parts[:, 0], weights, 8).astype(int), sums)
    assert sums.max() - sums.min() <= 1


def test_shards(messy, none):
    got = rows(sharding.shards_by_bytes(messy, 3, block=4))
    assert len(got) == messy.count()
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    want = sorted((r.doc_id or 0, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in messy.collect())
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == want
    assert len({(r["text_crc32"], r["shard"]) for r in got}) == len({r["text_crc32"] for r in got})
    assert rows(sharding.shards_by_bytes(none)) == []


def plain_differencing(weights, k):
    """Largest differencing on plain lists: always the two partitions of largest spread, heaviest part with lightest."""
    left = [[w] + [0] * (k - 1) for w in weights]
    while len(left) > 1:
        left.sort(key=lambda parts: max(parts) - min(parts))
        a, b = left.pop(), left.pop()
        left.append([x + y for x, y in zip(sorted(a), sorted(b, reverse=True), strict=True)])
    return sorted(left[0])


def test_differencing_against_plain_lists():
    rng = np.random.default_rng(8)
    for k in (2, 3, 8):
        for _ in range(20):
            weights = (rng.pareto(1.2, rng.integers(1, 40)) * 1000).astype(np.int64) + 1
            start = np.concatenate((weights[:, None], np.zeros((len(weights), k - 1), np.int64)), axis=1)
            parts, sums = sharding.differenced(start)
            placed = np.bincount(parts[:, 0], weights, k).astype(np.int64)  # column 0 holds the weight
            assert placed.tolist() == sums.tolist()
            mine, plain = sums.max() - sums.min(), plain_differencing(weights.tolist(), k)
            assert mine <= max(weights.max(), 2 * (plain[-1] - plain[0]) + 64)


def test_shards_of_one_heap_and_of_blocks_are_even(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    spread = []
    for block in (10**9, 50):
        sizes = sharding.shards_by_bytes(docs, 8, block=block).groupBy("shard").agg(F.sum("size").alias("n")).collect()
        assert len(sizes) == 8
        spread.append(max(r.n for r in sizes) - min(r.n for r in sizes))
    largest = docs.groupBy("text").agg(F.sum(F.octet_length("text") + 1).alias("n")).agg(F.max("n")).first()[0]
    assert spread[0] <= 1 and spread[1] <= largest / 2  # blocks of 50 groups are far below the least in use


def test_plan_uses_every_piece():
    histogram = np.random.default_rng(2).integers(0, 50, 256)
    used = np.zeros(256, np.int64)
    chosen = packing.plan(histogram)
    for combination, times in chosen:
        assert sum(combination) <= 256
        for v in combination:
            used[v - 1] += times
    assert np.array_equal(used, histogram)
    assert len(packing.plan(np.zeros(256, np.int64))) == 0


def test_least_squares_against_a_scan():
    a = np.array([[1.0, 0.0, 1.0], [0.0, 1.0, 1.0], [0.0, 0.0, 1.0]])
    x = packing.nonnegative_least_squares(a, np.array([3.0, 1.0, -2.0]), 30)
    grid = np.stack(np.meshgrid(*[np.linspace(0, 4, 41)] * 3), -1).reshape(-1, 3)
    best = ((grid @ a.T - np.array([3.0, 1.0, -2.0])) ** 2).sum(1).min()
    assert (x >= 0).all() and ((a @ x - np.array([3.0, 1.0, -2.0])) ** 2).sum() <= best + 1e-9


def test_packing_holds_the_tokenizer_ids(messy, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    got = rows(packing.pack(messy, WORDS))
    want = []
    for r in messy.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, at, min(2048, len(ids) - at), zlib.crc32(ids[at:at + 2048].tobytes()), len(ids))
                 for at in range(0, len(ids), 2048)]
    same_rows([(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got], want)
    for sequence in {r["sequence_id"] for r in got}:
        own = sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == sequence)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 2048
    assert rows(packing.pack(none, WORDS)) == []


def brute_classes(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, set()).update({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_classes_on_awkward_rows(messy, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.near_duplicate_classes(messy))
           if r["doc_id"] is not None}
    assert got == brute_classes([(r.doc_id, r.text) for r in messy.collect() if r.doc_id is not None])
    assert rows(jaccard_join.near_duplicate_classes(none)) == []


def test_jaccard_classes_of_near_copies(spark):
    r = np.random.default_rng(3)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = []
    for c in range(12):
        base = [f"w{v}" for v in r.integers(0, 400, int(r.integers(20, 120)))]
        for _ in range(int(r.integers(1, 9))):
            own = list(base)
            for _ in range(int(r.integers(0, 5))):
                own[int(r.integers(0, len(own)))] = f"w{int(r.integers(0, 400))}"
            texts.append(" ".join(own) + (" " + shared if c % 2 else ""))
    texts += [f"{shared} tail{i} of{i} its{i} own{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.near_duplicate_classes(docs))}
    assert got == brute_classes(list(enumerate(texts)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (200, 201), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}


def brute_class(window):
    total = sum(fingerprints._TERM[c] for c in np.bincount(window) if c)
    top = 64 * 6 * fingerprints._SCALE
    return (top - total) * fingerprints.CLASSES // top


def test_entropy_of_every_window():
    text = np.random.default_rng(1).integers(97, 104, 300).astype(np.uint8)
    got = fingerprints.entropy_classes(text, np.array([0, 200, 230, 300]))
    for lo, hi in ((0, 200), (200, 230), (230, 300)):
        for s in range(lo, hi):
            assert got[s] == (brute_class(text[s:s + 64]) if s + 64 <= hi else -1)


def test_fingerprints(messy, none):
    got = rows(fingerprints.fingerprints(messy, fingerprints.rarity(messy)))
    assert len(got) == messy.count()
    docs = sorted(((r.doc_id, r.text or "") for r in messy.collect() if r.doc_id is not None), key=lambda d: -d[0])
    following = {docs[i][0]: docs[i + 1][1] for i in range(len(docs) - 1)}
    for r in got:
        if r["doc_id"] in following and r["doc_id"] != 8:
            own = dict(docs)[r["doc_id"]]
            assert r["n_chars"] == len(own)
            changed = fingerprints.edited(own, following[r["doc_id"]])
            assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[4]["fingerprint"] == by_id[3]["fingerprint"] == ""
    assert by_id[7]["near_next"] > 0.9 > 0.1 > by_id[6]["near_next"]
    assert rows(fingerprints.fingerprints(none, fingerprints.rarity(none))) == []


def test_one_document_is_its_own_next(spark):
    one = spark.createDataFrame([(1, "abc" * 50)], "doc_id long, text string")
    assert rows(fingerprints.fingerprints(one, fingerprints.rarity(one)))[0]["near_next"] == 1.0


def test_pieces_equal_the_library(messy, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table = pieces.PieceTable.load(PIECES)
    encoded = pieces.encode(messy, table)
    want = [(r.doc_id, library.encode(r.text or "")) for r in messy.collect()]
    same_rows([(r.doc_id, r.ids) for r in encoded.collect()], want)
    back = {r.doc_id: r.back for r in encoded.withColumn("back", pieces.decoded(F.col("ids"), table)).collect()}
    for r in messy.where("text is not null and doc_id is not null").collect():
        assert back[r.doc_id] == r.text
    assert rows(pieces.encode(none, table)) == []


def test_words_are_asked_for_once_whatever_blocks_they_are_in(spark, messy, monkeypatch):
    import sentencepiece

    texts = spark.createDataFrame([(0, "a b a"), (63, "b c"), (64, "b"), (130, "c  d")], "block int, body string")
    asked = {(r.word.replace(pieces.SPACE, " "), r.part, r.blocks % (1 << 64)) for r in pieces.asked_words(texts).collect()}
    assert asked == {(" a", 0, 1), (" b", 0, 1 + (1 << 63)), (" b", 1, 1), (" c", 0, 1 << 63), (" c", 2, 4), ("  d", 2, 4)}
    monkeypatch.setattr(pieces, "BLOCK_DOCS", 1)
    monkeypatch.setattr(pieces, "SET", 4)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = pieces.encode(messy, pieces.PieceTable.load(PIECES))
    same_rows([(r.doc_id, r.ids) for r in encoded.collect()], [(r.doc_id, library.encode(r.text or "")) for r in messy.collect()])
    # The texts are cut into words once.
    text = encoded._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert text.count("Generate explode(CASE WHEN") == 1


def test_lattices_are_folded_many_at_once_and_whole(spark, monkeypatch):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table = pieces.PieceTable.load(PIECES)
    words = sorted({w for t in ("the quick brown foxes jumped", "누군가의 안녕 \U0001f40d\x07 naïve", "a a b  1999-12-31") for w in pieces._split(t)})
    known = spark.createDataFrame(table.pieces, "piece string, id int, score double")
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, part int").coalesce(1)
    monkeypatch.setattr(pieces, "EDGES", 7)  # words go on from one Arrow batch to the next
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "5")
    try:
        folded = pieces.segmented(pieces.lattice(frame, known, table.longest), table)
        got = {(r.word, r.part): r.ids for r in folded.collect()}
    finally:
        spark.conf.set(size, before)
    assert got == {(w, i): library.encode(w.replace(pieces.SPACE, " ")[1:]) for i, w in enumerate(words)}
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "aggregate(" not in plan  # no lists of edges, no fold row by row


def test_piece_query_decodes_every_document(spark, data):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r.doc_id: r.text or "" for r in tables.table(spark, data, "documents").collect()}
    name = next(n for n in queries() if n.startswith("op7_"))
    got = queries()[name](spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        back = library.decode(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
        assert r.same_text == (back == texts[r.doc_id])


def test_best_path_against_all_segmentations(spark):
    table = pieces.PieceTable([("a", 0, -3.0), ("b", 1, -3.5), ("ab", 2, -4.0), ("aba", 3, -9.0), ("ba", 4, -4.5), ("bb", 5, -5.0)],
                              10, 300, False, [])
    scores = {p: (i, s) for p, i, s in table.pieces}

    def best(word):
        if not word:
            return 0.0, []
        ways = []
        for k in range(1, len(word) + 1):
            if word[:k] in scores or k == 1:
                total, ids = best(word[k:])
                i, s = scores.get(word[:k], (None, -1e6))
                ways.append((total + s, ([i] if i is not None else [10 + b for b in word[:k].encode()]) + ids))
        return max(ways, key=lambda w: w[0])

    words = ["a", "ab", "abab", "abba", "babab", "aabbaabb", "xaby", "é", "bbbbb"]
    known = spark.createDataFrame(table.pieces, "piece string, id int, score double")
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    for r in pieces.segmented(pieces.lattice(frame, known, 3), table).collect():
        total = sum(dict((i, s) for i, s in scores.values()).get(i, -1e6) for i in r.ids)
        assert total == pytest.approx(sum(dict((i, s) for i, s in scores.values()).get(i, -1e6) for i in best(r.word)[1])), r


def test_long_words_take_the_best_path(spark):
    table = pieces.PieceTable([("a", 0, -3.0), ("b", 1, -3.5), ("ab", 2, -4.0), ("aba", 3, -9.0), ("ba", 4, -4.5), ("bb", 5, -5.0),
                               ("▁a", 6, -3.0), ("▁", 7, -2.0)], 10, 300, False, [])
    texts = ["ab" * 30, "abbaxé" * 12, "b" * 41, "aab" * 30 + " ab " + "babab" * 20]
    words = [w for t in texts for w in pieces._split(t)]
    assert max(map(len, words)) > pieces.LONG
    known = spark.createDataFrame(table.pieces, "piece string, id int, score double")
    frame = spark.createDataFrame([(w,) for w in set(words)], "word string")
    folded = {r.word: r.ids for r in pieces.segmented(pieces.lattice(frame, known, 3), table).collect()}
    got = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), table).collect()
    for r in got:
        assert r.ids == [i for w in pieces._split(texts[r.doc_id]) for i in folded[w]]
    assert len(got) == len(texts)


def test_url_lists_on_awkward_rows(spark):
    captures = spark.createDataFrame([(1, "https://A.b.com:80/x", "2024-01-05"), (2, "http://u@b.com", "2024-01-01"), (3, None, "2024-01-05"),
                                      (4, "nonsense", "2024-01-05"), (5, "http://a.b.com/", None), (5, "http://a.b.com/", None),
                                      (6, "ftp://x.a.b.com/?q", "2024-02-01")],
                                     "page_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("date"))
    entries = spark.createDataFrame([("b.com", "2024-01-02", 1, "block"), ("a.b.com", "2024-01-05", 2, "block"),
                                     ("a.b.com", "2024-01-05", 3, "allow"), ("b.com", "2024-01-20", 4, "remove"),
                                     ("a.b.com", "2024-01-25", 5, "remove"), (None, "2024-01-01", 6, "block"), ("b.com", None, 7, "block")],
                                    "entry string, day string, seq int, action string").withColumn("day", F.col("day").cast("date"))
    got = sorted((r.page_id, r.verdict, r.entry) for r in url_lists.verdicts(captures, entries).collect())
    assert got == [(1, "allow", "a.b.com"), (2, "none", None), (3, "none", None), (4, "none", None), (5, "none", None),
                   (5, "none", None), (6, "none", None)]
    assert {r.verdict for r in url_lists.verdicts(captures, entries.where("false")).collect()} == {"none"}
    assert rows(url_lists.verdicts(captures.where("false"), entries)) == []


def test_language(spark, messy, none, data):
    docs = tables.table(spark, "/root/testdata/sf0.01", "documents")
    got = language.identified(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    model = language.fit(docs)
    by_id = {r.doc_id: r for r in language.identified(messy, model).collect()}
    assert {i for i in by_id if by_id[i].lang_pred == "und"} >= {3, 4, 5, 12}
    assert all(0 <= r.score <= 1 for r in by_id.values())
    assert language.identified(messy, model).count() == messy.count()
    assert language.fit(none) is None and rows(language.identified(none, None)) == []
    assert {r.lang_pred for r in language.identified(messy, None).collect()} == {"und"}


def test_toxicity(spark, messy, none):
    docs, labels = (tables.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert "idiot" in model.lexicon.words
    got = toxicity.scored(docs, model).join(labels, "doc_id").where("held_out").collect()  # nothing was learned from these
    assert len(got) > 50 and np.mean([r.predicted == r.toxic for r in got]) > 0.9
    by_id = {r.doc_id: r for r in toxicity.scored(messy, model).collect()}
    assert by_id[13].predicted == 1 and by_id[3].predicted == by_id[4].predicted == by_id[9].predicted == 0
    assert toxicity.scored(messy, model).count() == messy.count() and rows(toxicity.scored(none, model)) == []
    unlabelled = toxicity.fit(messy, labels.where("false"))
    assert {r.score for r in toxicity.scored(messy, unlabelled).collect()} == {0.0}


def test_learning_samples_keep_their_bounds(spark):
    """Rows that share an id are no further sample, and a text goes with its own row's language."""
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    texts = [(held[0], f"wort zahl {k} und mehr", "de") for k in range(900)] + [(held[0], "the same words again", "en")] * 300
    texts += [(i, f"plain english words number {i}", "en") for i in held[1:]]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    known = docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("text").alias("_text"))
    first = language._first_rows(known).collect()
    assert len(first) == language.PER_LANGUAGE + len(held) and len({(r._lang, r._rank) for r in first}) == len(first)
    model = language.fit(docs)
    found = {r.doc_id: r.lang_pred for r in language.identified(docs.where(f"doc_id <> {held[0]}"), model).collect()}
    assert set(found.values()) == {"en"}
    labels = spark.createDataFrame([(i, i % 2) for i in held], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) is not None


def test_presence_kernel_and_ridge_against_dense_numpy(spark):
    """Scores of the hashed weights equal kernel rows times dual weights, solved without any shortcut."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = [r.text for r in docs.where("text is not null").orderBy("doc_id").limit(60).collect()]
    labels = ["ab"[i % 2] for i in range(len(some))]
    import pyarrow as pa
    matrix = np.concatenate([m for _, m, _ in language.presence(pa.array(some, pa.large_string()))]).astype(float)
    bits = np.packbits(matrix.astype(bool), axis=1)
    model = language.learned(bits, labels)
    unit = matrix / np.sqrt(np.maximum(matrix.sum(1, keepdims=True), 1))
    marks = unit[np.linspace(0, len(unit) - 1, min(language.LANDMARKS, len(unit))).astype(int)]
    kernel, inner = unit @ marks.T, marks @ marks.T
    values, vectors = np.linalg.eigh(inner)
    kept = values > 1e-6 * values[-1]
    features = kernel @ (vectors[:, kept] / np.sqrt(values[kept]))
    target = np.array([[1.0, -1.0] if x == "a" else [-1.0, 1.0] for x in labels])
    moved = features - features.mean(0)
    ridge = language.RIDGE * len(bits) / 100
    weights = np.linalg.solve(moved.T @ moved + ridge * np.eye(moved.shape[1]), moved.T @ (target - target.mean(0)))
    assert np.abs(model.scores(matrix.astype(np.float32)) - (moved @ weights + target.mean(0))).max() < 1e-3


def test_edited_texts_have_the_digest_of_a_full_run(spark):
    """Only the windows over the seam are computed anew; the digest is that of the whole edited text."""
    import pyarrow as pa
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").limit(80).collect()
    texts = [r.text for r in docs] + ["", "short", "x" * 63, "y" * 64, "z" * 65, "é" * 100, "", "a" * 200, "b"]
    ranks = np.random.default_rng(0).permutation(fingerprints.CLASSES + 1)
    own = fingerprints.profiles(pa.array(texts, pa.large_string()), ranks)
    got = fingerprints._compared(list(range(len(texts))), texts, own, ranks)
    changed = [fingerprints.edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    want = fingerprints.digests(pa.array(changed, pa.large_string()), ranks)
    assert [r[6] for r in got] == want
    assert [r[4] for r in got] == [hashlib.sha256(t.encode()).hexdigest() for t in changed]


def test_disguised_insults_count():
    lexicon = toxicity.Lexicon(frozenset({"loser"}), frozenset({"vequ"}))
    assert toxicity._word_flags("1d10t!", lexicon)[5:] == (True, True)
    assert toxicity._word_flags("Loser,", lexicon)[1] and toxicity._word_flags("vequille", lexicon)[2]


PAGES = [
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p>One<br>two  <b>three</b></p><p>Four"
     "<aside>Advert</aside></article><footer>&copy; me</footer></body></html>", "Title & more\nOne two three\nFour"),
    ("<main><p>Text &lt;b&gt; &#233;&eacute;<script>var a='</p>';</script> end</p><div class='comments'><p>A reader says a lot of"
     " words here that are not part of it</p></div><form><label>Name</label></form></main>", "Text <b> éé end"),
    ("<article><p>cut off &am", "cut off &am"), ("", ""), (None, ""), ("<nav>only menu</nav>", ""), ("<article></article>", ""),
    ("<div class=\"cookie-notice\">We use cookies</div><article>Body <!-- <p>hidden</p> -->goes on</article><div id=sidebar>Side</div>",
     "Body goes on"),
    ("<html><head><title>x</title><body><article>After a head without end tag</article></body></html>", "After a head without end tag"),
    ("<head><meta charset=utf-8><style>p {}</style>\n<article><p>No body tag</article>", "No body tag"),
    ("<head><noscript><img src=x></noscript><script>var a;</script><title>x</title></head><body><main>Closed head</main>", "Closed head"),
    ("<article>" + "<p>" + "lange Wörter " * 20_000 + "</p></article>", ("lange Wörter " * 20_000).strip()),
    ("<article><div class=\"ad-free-content\"><p>Words of the body that go on for a while, as the text of a page does.</p><p>Short.</p>"
     "</div><div class='ad'>Buy this now and here</div></article>", "Words of the body that go on for a while, as the text of a page does.\nShort."),
    ("<header>Site name</header><article><header><h1>Headline</h1></header><p>Words of the body go on</p></article>",
     "Headline\nWords of the body go on"),
    ("<article><p>Intro words here</p><ul><li><a href=x>Linked item</a></li><li>Short</li></ul></article>",
     "Intro words here\nLinked item\nShort"),
    ("<p>One short paragraph.</p>", "One short paragraph."),
    ("<table><tr><td>Name</td><td>Age</td></tr><tr><td>Kim</td><td>30</td></tr></table>", "Name\nAge\nKim\n30"),
    ("<div class=related-posts><a href=a>One more story</a><a href=b>Another one</a></div><main><p>Text</p></main>", "Text"),
]


def test_tree_column_is_the_model(spark):
    """The column decides every block of the given pages, and every labelled one, as the fitted tree does."""
    from pyspark.ml.feature import VectorAssembler

    model = html_text.learned_tree(spark)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    odd = spark.createDataFrame([("x", h or "") for h, _ in PAGES], "url string, html string")
    found = (html_text.with_blocks(pages.select("url", "html").union(odd), "html")
             .select(F.explode("blocks").alias("b")).select("b", "b.*"))
    both = VectorAssembler(inputCols=list(html_text.FEATURES), outputCol="features").transform(found)
    rows_ = model.transform(both).select("prediction", html_text.tree_column(model, F.col("b")).alias("main")).collect()
    assert len(rows_) > 100 and all((r.prediction > 0.5) == r.main for r in rows_)
    table = spark.createDataFrame([tuple(map(float, r[:-1])) for r in html_text.LABELLED], [*html_text.FEATURES, "label"])
    fitted = model.transform(VectorAssembler(inputCols=list(html_text.FEATURES), outputCol="features").transform(table))
    assert fitted.where("prediction <> label").count() == 0
    used = model.featureImportances.toArray()
    assert (used > 0).sum() >= 7


def test_name_evidence():
    assert html_text.name_evidence("ad") == html_text.name_evidence("cookie-notice") == 1
    assert html_text.name_evidence("ad-free-content") < 0.4 <= html_text.name_evidence("sidebar-content") < html_text.name_evidence("related-posts")
    assert html_text.name_evidence("article-body") == html_text.name_evidence("") == 0


def test_page_texts(spark):
    pages = spark.createDataFrame([(i, f"u{i}", h, "x") for i, (h, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0], "x")],
                                  "page_id long, url string, html string, blocks string")
    got = html_text.main_texts(pages).collect()
    assert len(got) == len(PAGES) + 1
    for r in got:
        assert r.text == PAGES[r.page_id][1]
        assert r.n_chars == len(r.text)
    assert rows(html_text.main_texts(pages.where("false"))) == []


def test_a_page_without_article_tags_is_judged_by_its_blocks():
    page = ("<body><div><a href=a>Home</a> <a href=b>News</a></div><div>" + "real words of a story " * 12 + "</div><div>"
            + "more words of the same story " * 12 + "</div><div><a href=c>Imprint</a></div></body>")
    own = html_text.blocks(page)
    assert [b[1] for b in own] == [2, 60, 72, 1] and [b[2] for b in own] == [1.0, 0.0, 0.0, 1.0]


@pytest.mark.parametrize("name", [n for n in queries() if n in oracle_sql() and n.startswith(("op3_", "op8_"))])
def test_queries_with_sql(spark, data, name):
    ok, message = compare(spark, oracle(data), data, name, queries()[name], oracle_sql()[name])
    assert ok, message


def test_all_eleven_queries_are_registered():
    names = list(queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


class Walked:
    """Stands for the sorted postings: gives the function that walks them."""

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition

    def mapInArrow(self, function, _):
        return function


def test_index_lists_in_batches_of_any_size():
    walk, r = jaccard_join._lists(Walked(), 80), np.random.default_rng(0)
    names = ["shingle", "doc", "n", "pos"]
    for _ in range(100):
        size = int(r.integers(1, 60))
        columns = [r.integers(0, int(r.integers(1, 25)), size), r.integers(0, 1000, size), r.integers(5, 60, size).astype(np.int32)]
        order = np.lexsort((columns[1], columns[2], columns[0]))
        shingle, doc, n = (c[order] for c in columns)
        cuts = sorted({0, size, *r.integers(0, size + 1, int(r.integers(0, 12))).tolist()})
        batches = [pa.RecordBatch.from_arrays([pa.array(c[lo:hi]) for c in (shingle, doc, n, np.zeros(size, np.int32))], names)
                   for lo, hi in zip(cuts, cuts[1:], strict=False)]
        out = [row for b in walk(iter(batches)) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        listed = sorted((row[1], row[2], row[3]) for row in out if row[0] == 0)
        assert listed == sorted((int(s), int(d), int(m)) for s, d, m in zip(shingle, doc, n, strict=True) if (shingle == s).sum() >= 3)
        pairs, hub, size_class = set(), {}, np.floor(np.log(n) / np.log(1.25))
        for i in range(size):
            near = {hub.setdefault((shingle[i], size_class[i]), i)} | ({i - 1} if i and shingle[i - 1] == shingle[i] else set())
            pairs |= {(int(doc[j]), int(doc[i])) for j in near - {i}
                      if doc[j] != doc[i] and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j])}
        assert {(row[1], row[2]) for row in out if row[0] == 1} == pairs
