"""Toxicity scores: boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.llm.packing import slices
from laurel.llm.tables import held_out
from laurel.session import stored

LEARNING_ROWS = 24_000  # labelled documents that a model learns from, at most
KEPT_WORDS, KEPT_STEMS, STEMS = 400, 200, (4, 5, 6)  # learned lexicon entries, and the lengths of word beginnings
HELD_ENTRIES = 200_000  # that a task counts before it hands them on
EVIDENCE = 30.0  # log-likelihood ratio that a learned entry must reach
TREES, DEPTH, LEAF, NEAR = 30, 3, 10, 5
THRESHOLD = 0.3
# Common insults, second-person words of the corpus languages, and look-alike characters.
INSULTS = frozenset("""idiot idiots stupid moron morons loser losers dumb scum trash garbage worthless pathetic disgusting
clown clowns fool fools ugly crap damn hate bastard bitch asshole shit fuck fucking jerk imbecile retard vermin filth
idiota imbécil basura estúpido imbécile connard stupide trottel dummkopf arschloch abschaum""".split())
SECOND = frozenset("""you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos
tú usted ustedes vosotros""".split())
LOOK_ALIKE = str.maketrans("01345789@$!|+", "oieastbgasiit")
FEATURES = ("words", "insults", "learned", "stems", "hits", "near_second", "second", "capitals", "shouted", "exclaimed",
            "punctuation", "repeated", "obfuscated", "disguised")


@dataclass
class Lexicon:
    words: frozenset = field(default_factory=frozenset)
    stems: frozenset = field(default_factory=frozenset)


def _core(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}<>|-_*#%&$…«»¿¡").lower()


def _word_flags(word: str, lexicon: Lexicon) -> tuple[bool, bool, bool, bool, bool, bool, bool]:
    """insult, learned word, learned stem, second person, shouted, obfuscated, disguised."""
    core = _core(word)
    insult, known, stem = core in INSULTS, core in lexicon.words, any(core[:k] in lexicon.stems for k in STEMS)
    mixed = disguised = False
    if core and not core.isalpha():
        mixed = any(c.isalpha() for c in core) and not core.replace("-", "").replace("'", "").isalpha()
        if mixed:
            plain = "".join(c for c in core.translate(LOOK_ALIKE) if c.isalpha())
            disguised = plain in INSULTS or plain in lexicon.words
    return insult, known, stem, core in SECOND, len(word) > 2 and word.isupper(), mixed, disguised


_CAPITAL = np.zeros(256, np.int64)
_CAPITAL[65:91] = 1
_PUNCTUATION = np.zeros(256, np.int64)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1


def features(texts: pa.Array, lexicon: Lexicon) -> Iterator[np.ndarray]:
    """A matrix of FEATURES for slices of whole texts, in order."""
    for _, part in slices(texts):
        rows = len(part)
        words = pc.ascii_split_whitespace(part)
        coded = words.flatten().dictionary_encode()
        flags = np.array([_word_flags(w, lexicon) for w in coded.dictionary.to_numpy(zero_copy_only=False)],
                         bool).reshape(-1, 7)
        of_word = flags[coded.indices.to_numpy(zero_copy_only=False)]
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        counts = np.diff(bounds)
        row = np.repeat(np.arange(rows), counts)

        def sums(values, weights=None):
            return np.bincount(values, weights, minlength=rows)

        per_word = [sums(row[of_word[:, k]]) for k in range(7)]
        hit = np.flatnonzero(of_word[:, 0] | of_word[:, 1] | of_word[:, 2] | of_word[:, 6])
        second = np.flatnonzero(of_word[:, 3])
        near = np.zeros(len(hit), bool)
        if len(second):
            at = np.searchsorted(second, hit)
            for k in (np.maximum(at - 1, 0), np.minimum(at, len(second) - 1)):
                near |= (np.abs(second[k] - hit) <= NEAR) & (row[second[k]] == row[hit])
        raw = np.frombuffer(part.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(part.buffers()[1], np.int64)[part.offset:part.offset + rows + 1]
        raw, ends = raw[ends[0]:ends[-1]], ends - ends[0]

        def in_bytes(marks):
            return np.diff(np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))[ends])

        size = np.maximum(np.diff(ends), 1)
        mark = _PUNCTUATION[raw]
        twice = np.zeros(len(raw), np.int64)
        twice[1:] = (mark[1:] == 1) & (raw[1:] == raw[:-1])
        n = np.maximum(counts, 1)
        hits = sums(row[hit])
        yield np.stack([np.log1p(counts), per_word[0] / n, per_word[1] / n, per_word[2] / n, np.log1p(hits),
                        sums(row[hit[near]]) / np.maximum(hits, 1), per_word[3] / n, in_bytes(_CAPITAL[raw]) / size,
                        per_word[4] / n, in_bytes(raw == 33) / size, in_bytes(mark) / size, in_bytes(twice) / size,
                        per_word[5] / n, per_word[6] / n], 1)


def _featured(docs: DataFrame, lexicon: Lexicon, extra: str) -> DataFrame:
    """The columns before the last one (the text) with the features: `extra` is their DDL."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [m for m in features(batch.column(batch.num_columns - 1), lexicon)]
            matrix = np.concatenate(found) if found else np.zeros((0, len(FEATURES)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * len(FEATURES), pa.int32()),
                                             pa.array(matrix.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*batch.schema.names[:-1], "features"])

    return docs.mapInArrow(compute, f"{extra}, features array<double>")


def learned_lexicon(labelled: DataFrame) -> Lexicon:
    """Words and word beginnings that toxic documents hold far more often than others; (toxic, text) rows come in.

    Tasks count the documents of each entry before the shuffle; an entry needs a log-likelihood ratio of EVIDENCE.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def counted() -> pa.RecordBatch:
            entries = sorted(set(seen[0]) | set(seen[1]))
            counts = [pa.array([seen[t][e] for e in entries], pa.int64()) for t in (1, 0)]
            seen[0].clear()
            seen[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), *counts], ["entry", "bad", "good"])

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cores = {_core(w) for w in (text.as_py() or "").split()}
                cores = {c for c in cores if c.isalpha()}
                seen[toxic].update({f"={c}" for c in cores} | {f"{c[:k]}" for c in cores for k in STEMS if len(c) > k})
                if len(seen[0]) + len(seen[1]) > HELD_ENTRIES:
                    yield counted()
        yield counted()

    totals = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Lexicon()
    rate = bad / (bad + good)
    n = F.col("bad") + F.col("good")
    ratio = F.col("bad") / n
    evidence = 2 * (F.col("bad") * F.log(ratio / rate)
                    + F.when(F.col("good") > 0, F.col("good") * F.log((1 - ratio) / (1 - rate))).otherwise(0))
    best = (labelled.select("toxic", "text").mapInArrow(count, "entry string, bad long, good long").groupBy("entry")
            .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
            .where((F.col("bad") >= 5) & (ratio > 3 * rate) & (ratio > 0.5)).withColumn("evidence", evidence)
            .where(F.col("evidence") >= EVIDENCE).withColumn("word", F.col("entry").startswith("=")))
    kept = {flag: [r["entry"] for r in best.where(F.col("word") == flag).orderBy(F.col("evidence").desc(), "entry")
                   .limit(limit).collect()] for flag, limit in ((True, KEPT_WORDS), (False, KEPT_STEMS))}
    return Lexicon(frozenset(w[1:] for w in kept[True]), frozenset(kept[False]))


@dataclass
class Model:
    lexicon: Lexicon
    trees: object = None
    calibration: object = None
    base: float = 0.0


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Model:
    """Learns from at most LEARNING_ROWS labelled documents (of the least hashed ids), none of them held out.

    Three quarters of them give the lexicon and grow the trees, the others calibrate. Of rows that share an id, the one
    of the least hashed text is learned from. With one label only, every score is its share.
    """
    marks = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("toxic"))
    marks = (marks.where(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
             .groupBy("_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("_id"), "_id").limit(LEARNING_ROWS))
    marked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(marks), "_id")
    one = F.min_by("text", F.xxhash64("text")).alias("text")
    labelled = stored(marked.groupBy("_id").agg(F.first("toxic").alias("toxic"), one), "labelled")
    calibrates = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(4)) == 0
    lexicon = learned_lexicon(labelled.where(~calibrates))
    rows = stored(_featured(labelled, lexicon, "_id long, toxic int")
                  .withColumn("label", F.col("toxic").cast("double")).withColumn("features", array_to_vector("features"))
                  .withColumn("calibrates", calibrates)
                  .coalesce(4).sortWithinPartitions("_id"), "features")
    grow, rest = rows.where("not calibrates"), rows.where("calibrates")
    seen = {(r["calibrates"], r["toxic"]) for r in rows.select("calibrates", "toxic").distinct().collect()}
    share = rows.agg(F.avg("label")).first()[0] or 0.0
    if not {(False, 0), (False, 1)} <= seen:
        return Model(lexicon, base=float(share))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAF, stepSize=0.3, seed=7).fit(grow)
    if not {(True, 0), (True, 1)} <= seen:
        rest = grow
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label").fit(_margins(trees, rest))
    return Model(lexicon, trees, calibration, float(share))


def _margins(trees, rows: DataFrame) -> DataFrame:
    """The trees' weighted vote (log odds) as column `margin`."""
    voted = trees.transform(rows).withColumn("margin", vector_to_array("rawPrediction")[1])
    return voted.drop("rawPrediction", "probability", "prediction")


def scored(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD), from the text alone.

    Null and empty texts are scored as texts without words. Repeated rows are scored alike, further columns are
    ignored, and no rows give no rows.
    """
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text))
    rows = _featured(rows, model.lexicon, f"doc_id {kind}, held_out boolean")
    if model.trees is None:
        rows = rows.withColumn("score", F.lit(model.base))
    else:
        rows = model.calibration.transform(_margins(model.trees, rows.withColumn("features", array_to_vector("features"))))
        rows = rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
