"""Line dedup, the conversation trie and whitening on awkward rows, next to brute force."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import compare, oracle
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from laurel.llm import line_dedup, prefix_trie, whitening

BLANKS = " \t\n\x0b\x0c\r"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_splitter_skeleton"])
def test_against_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    ok, message = compare(spark, oracle(folder), folder, name, queries()[name], oracle_sql()[name])
    assert ok, message


# ---- lines --------------------------------------------------------------------------------------------------------------

SHARED, OTHER = "This line is shared by many documents", "  another SHARED line of the corpus\t"
DOCS = "doc_id long, text string, pos int, line string, key string, gone string, keeper long, print long, own_id long, n_docs int"


def brute_lines(docs, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    key = lambda line: lowered(line).strip(BLANKS)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(repr, out))


def test_lines_on_awkward_rows(spark):
    long = "\n".join([SHARED, *(f"line number {i} of a very long document" for i in range(30_000)), OTHER.upper(), "end"])
    texts = [(1, f"{SHARED}\nown one\n{OTHER}"), (2, f"\t{SHARED.upper()} \r\n\n"), (3, None), (4, ""), (5, f"{SHARED}\n{SHARED}\nx"),
             (5, f"{SHARED}\ny"), (6, f"x\n{OTHER.strip()}\n"), (7, long), (7, long), (8, f"{SHARED}\n{SHARED.lower()}\nz"),
             (None, f"{SHARED}\nwithout id"), (None, f"{SHARED}\nwithout id"), (9, "short\nshort"), (10, "short"), (11, "short"),
             (12, "É" + SHARED), (13, "é" + SHARED), (14, "É" + SHARED.upper()), (15, "\n\n"), (16, "a line of copies of one id\nq"),
             (16, "a line of copies of one id\nr"), (16, "a line of copies of one id"), (17, "a line of copies of one id"),
             (18, "\xa0twenty characters\xa0"), (19, "\xa0twenty characters\xa0"), (20, "\xa0twenty characters\xa0")]
    docs = spark.createDataFrame([(i, t, 1, "l", "k", "g", 2, 3, 4, 5) for i, t in texts], DOCS)
    got = rows(line_dedup.line_dedup(docs))
    assert sorted(repr((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"])) for r in got) == brute_lines(texts)
    assert sum(r["n_dropped"] for r in got) > 10


def test_lines_with_other_limits_and_none(spark):
    texts = [(i, f"ab\ncommon\nline {i % 3}") for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = line_dedup.line_dedup(docs, min_chars=3, min_docs=10).collect()
    assert sorted(map(repr, map(tuple, got))) == brute_lines(texts, 3, 10)
    assert line_dedup.line_dedup(docs.limit(0)).collect() == []


# ---- conversations ------------------------------------------------------------------------------------------------------

def brute_trie(turns):
    """Nodes of the trie from rows (conv_id, turn, role, text) without equal turns in a conversation."""
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            own[c].append((t is not None, t, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2] if x[0] else (False, 0))] for c, v in own.items()}
    members = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append((c, d == len(whole)))
    out = {}
    for path, found in sorted(members.items(), key=lambda x: -len(x[0])):
        least = min(c for c, _ in found)
        children = [v for p, v in out.items() if len(p) == len(path) + 1 and p[:-1] == path]
        ends = ",".join(str(c) for c in sorted(c for c, e in found if e))
        out[path] = {"conv_id": least, "depth": len(path), "n_convs": len(found), "n_children": len(children),
                     "n_leaves": sum(v["n_leaves"] for v in children) if children else 1,
                     "saved_tokens": (len(found) - 1) * (len(path[-1][1]) if path else 0) + sum(v["saved_tokens"] for v in children),
                     "ends_sha256": hashlib.sha256(ends.encode()).hexdigest()}
    for path, v in out.items():
        v["parent_conv_id"] = out[path[:-1]]["conv_id"] if path else None
    return sorted((tuple(v[c] for c in prefix_trie.TRIE) for v in out.values()), key=repr)


def awkward_turns():
    turns = [(None, 0, "user", "no conversation"), (5, None, "user", "first"), (5, 1, None, "second"), (5, 2, "user", None),
             (105, 0, "", ""), (300, 7, "user", "x" * 50_000), (400, 1, "user", "y")]
    for c in range(900, 960):  # copies, far more than a shard holds
        turns += [(c, t, "user" if t % 2 else "bot", f"same {t}") for t in range(4)]
    for c in range(1000, 1030):  # shared beginnings
        turns += [(c, t, "user", f"turn {t} {c % (t + 1)}") for t in range(c % 9)]
    turns += [(c, 0, "user", "short") for c in range(1030, 1060)]  # some lose all their turns
    turns += [(2000 + c, t, "user", f"long {t}") for c in range(3) for t in range(300 + c)]  # beyond a splitter's length
    return turns


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_trie_against_brute_force(spark, shards):
    turns = awkward_turns()
    df = spark.createDataFrame([(*t, 1, "n", "p") for t in turns], "conv_id long, turn long, role string, text string, "
                               "family int, node string, path string").repartition(5)
    got = prefix_trie.conversation_trie(df, shards).select(*prefix_trie.TRIE).collect()
    assert sorted(map(tuple, got), key=repr) == brute_trie(turns)


def test_trie_of_repeated_rows_and_of_none(spark):
    turns = spark.createDataFrame([(7, 1, "user", "a")] * 20, "conv_id long, turn long, role string, text string")
    got = prefix_trie.conversation_trie(turns).collect()
    left = 20 - zlib.crc32(b"7") % 6
    assert sorted(r.depth for r in got) == list(range(left + 1)) and all(r.n_convs == 1 for r in got)
    assert prefix_trie.conversation_trie(turns.limit(0)).collect() == []


def test_copies_are_dealt_to_several_shards(spark):
    rows_ = spark.createDataFrame([(c, b"t" * 20) for c in range(4000)], "conv_id long, path binary")
    skeleton = prefix_trie.sampled_skeleton(rows_, 8)
    dealt = [skeleton.shard(b"t" * 20, c) for c in range(4000)]
    assert max(map(dealt.count, set(dealt))) < 1000 and dealt == sorted(dealt)
    assert len(skeleton.parent) == 2


# ---- whitening ----------------------------------------------------------------------------------------------------------

def numpy_whitening(x, k=16):
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    z = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, sums, values, vectors, (z ** 2).sum() / n


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_whitening_against_dense_eigenvectors(spark, name):
    folder = f"/root/testdata/{name}"
    got = queries()["op13_jacobi_davidson"](spark, folder).toPandas()
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors["embedding"]])
    n, sums, values, basis, trace = numpy_whitening(x)
    assert len(got) == 16 * len(x) and set(got["n"]) == {n}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[vectors["vec_id"]].to_numpy()
    want = ((n * x - sums) / n) @ basis / np.sqrt(values)
    sign = np.sign((wide * want).sum(axis=0))
    assert np.abs(wide * sign - want).max() < 1e-8
    assert np.allclose(got.groupby("component")["explained"].first(), values / trace, rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10
    deviation = {i: sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, sums)) for i, v in zip(vectors["vec_id"], x)}
    assert all(deviation[i] == v for i, v in zip(got["vec_id"], got["deviation"]))


def test_jacobi_davidson_restarts_and_locks():
    """A space far larger than the search space, with near and equal eigenvalues; products counted."""
    rng = np.random.default_rng(5)
    d = 400
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    spectrum = np.concatenate([[100, 50, 50, 50 - 1e-6, 20], np.linspace(10, 0, d - 5)])
    matrix = (q * spectrum) @ q.T
    calls = []
    values, vectors, turns, rest = whitening.eigenpairs(lambda b: calls.append(b.shape[1]) or matrix @ b, d, 8)
    assert np.allclose(values, spectrum[:8], atol=1e-11) and rest < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-10
    assert len(calls) < 400


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    right = np.column_stack([rng.standard_normal((30, 3)), np.zeros(30)])
    found = whitening.minres(lambda b: a @ b, right, 60, 1e-12)
    assert np.abs(a @ found - right).max() < 1e-8


def test_whitening_on_awkward_rows(spark):
    schema = "vec_id long, embedding array<float>, x string, line int, component string"
    good = [[float(i % 7), float(i % 5) / 3, float(i * i % 11)] for i in range(40)]
    inputs = [(i, v) for i, v in enumerate(good)] + [(3, good[3]), (None, good[4]), (50, None), (51, [1.0, None, 2.0]),
              (52, [1.0, float("nan"), 2.0]), (53, [1.0, float("inf"), 2.0]), (54, []), (55, [1.0]), (56, good[0])]
    df = spark.createDataFrame([(i, v, "x", 1, "c") for i, v in inputs], schema)
    usable = whitening.usable(df)
    got = whitening.whitened(usable, whitening.fit_whitening(usable)).collect()
    kept = [(i, v) for i, v in inputs if v is not None and len(v) == 3 and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept])
    n, sums, values, basis, trace = numpy_whitening(x)
    assert len(got) == 3 * len(kept) and {r.n for r in got} == {n}
    want = sorted((sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, sums)) for v in x for _ in range(3)))
    assert sorted(r.deviation for r in got) == want
    assert sum(r.vec_id is None for r in got) == 3 and sum(r.vec_id == 3 for r in got) == 6
    for rows_ in (df.limit(0), df.where("vec_id = 50"), df.where("vec_id = 1")):
        left = whitening.usable(rows_)
        assert whitening.whitened(left, whitening.fit_whitening(left)).collect() == []


def test_whitening_leaves_out_null_directions_and_holds_large_entries(spark):
    rng = np.random.default_rng(1)
    flat = rng.standard_normal((200, 3)) @ rng.standard_normal((3, 10)) * 1e3
    df = spark.createDataFrame([(i, [round(c) / 64 for c in v]) for i, v in enumerate(flat.tolist())], "vec_id long, embedding array<double>")
    model = whitening.fit_whitening(whitening.usable(df))
    assert 3 <= len(model.values) <= 10 and model.identity_error < 1e-6
    huge = spark.createDataFrame([(1, [1e15, 2.0]), (2, [-1e15, 1.0]), (3, [5.0, 1e12])], "vec_id long, embedding array<double>")
    rows_ = whitening.usable(huge)
    got = whitening.whitened(rows_, whitening.fit_whitening(rows_)).collect()
    assert {r.deviation for r in got} == {None} and all(math.isfinite(r.whitened) for r in got)
