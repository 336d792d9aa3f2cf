"""Language identification with a string kernel: blended n-gram presence, Nystrom landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laurel.llm.shingles import chunks
from laurel.llm.tables import held_out

ORDERS = (1, 2, 3)  # n-gram lengths that the kernel blends
BUCKETS = 1 << 14  # hashed n-grams of one order
PER_LANGUAGE, SAMPLE, LANDMARKS, RIDGE = 400, 1600, 200, 1e-2  # bounds of the learning sample, and the model's size
HISTOGRAM_BITS = 16  # of the hashed ids, which tell where a language's first rows end
ROWS = 64  # texts of one matrix product
UNDETERMINED = "und"
_WIDTH = BUCKETS * len(ORDERS)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def presence(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, presence matrix, number of letters) for blocks of ROWS texts; null is empty.

    Texts are in lower case, and whatever is not a letter counts as one and the same character.
    """
    buffer = np.zeros((ROWS, _WIDTH), np.float32)
    lowered = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    for begin, text, offsets in chunks(lowered):
        points = np.frombuffer(text.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        before = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))[offsets]
        letter = _letters()[points]
        coded = np.where(letter, points, 0).astype(np.uint64)
        for lo in range(0, len(offsets) - 1, ROWS):
            bounds = before[lo:lo + ROWS + 1]
            rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            own = coded[bounds[0]:bounds[-1]]
            matrix = buffer[:len(bounds) - 1]
            matrix[:] = 0
            code = np.zeros(len(own), np.uint64)
            for k, n in enumerate(ORDERS):
                if len(own) < n:
                    break
                code = code[:len(own) - n + 1] * np.uint64(0x1F0003) + own[n - 1:]
                bucket = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)
                at = rows[:len(code)] * _WIDTH + (bucket.astype(np.int64) + k * BUCKETS)
                matrix.ravel()[at[rows[:len(code)] == rows[n - 1:]]] = 1
            counts = np.concatenate(([0], np.cumsum(letter[bounds[0]:bounds[-1]])))[bounds - bounds[0]]
            yield begin + lo, matrix, np.diff(counts)


class Model:
    """One weight per hashed n-gram and language: the landmarks' kernel rows, already multiplied out."""

    def __init__(self, languages: list[str], weights: np.ndarray, constant: np.ndarray):
        self.languages, self.weights, self.constant = languages, weights, constant

    def scores(self, matrix: np.ndarray) -> np.ndarray:
        return matrix @ self.weights / np.sqrt(np.maximum(matrix.sum(1), 1))[:, None] + self.constant


def learned(bits: np.ndarray, labels: list[str]) -> Model:
    """Kernel ridge regression, one language against the rest, on packed presence rows."""
    languages = sorted(set(labels))
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    marks = np.unpackbits(bits[np.linspace(0, len(bits) - 1, min(LANDMARKS, len(bits))).astype(int)], axis=1)
    marks = marks.astype(np.float32) / np.sqrt(np.maximum(marks.sum(1, keepdims=True, dtype=np.float32), 1))
    kernel = []
    for lo in range(0, len(bits), ROWS):
        rows = np.unpackbits(bits[lo:lo + ROWS], axis=1).astype(np.float32)
        kernel.append(rows @ marks.T / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1)))
    kernel = np.concatenate(kernel).astype(float)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])  # Nystrom: features whose products are the kernel
    features = kernel @ root
    center, mean = features.mean(0), target.mean(0)
    moved = features - center
    solved = np.linalg.solve(moved.T @ moved + RIDGE * len(bits) / 100 * np.eye(moved.shape[1]),
                             moved.T @ (target - mean))
    weights = marks.T @ (root @ solved).astype(np.float32)
    return Model(languages, weights, (mean - center @ solved).astype(np.float32))


def _first_rows(known: DataFrame) -> DataFrame:
    """(_id, _print, _lang, _rank) of the PER_LANGUAGE rows of a language that come first by hashed id, then hashed text.

    A histogram of the hashes tells below which hash so many rows lie, so only about as many rows as are wanted (and
    their share of one in HISTOGRAM) are ranked, however large a language is.
    """
    rows = known.select("_id", "_lang", F.xxhash64("_id").alias("_order"), F.xxhash64("_text").alias("_print"))
    rows = rows.withColumn("_step", F.shiftright("_order", 64 - HISTOGRAM_BITS))
    steps = rows.groupBy("_lang", "_step").agg(F.count("*").alias("_n"))  # at most 2^HISTOGRAM_BITS rows of a language
    before = Window.partitionBy("_lang").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (steps.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < PER_LANGUAGE)
            .groupBy("_lang").agg(F.max("_step").alias("_last")))
    first = rows.join(cuts, "_lang").where("_step <= _last").dropDuplicates(["_id", "_lang", "_print"])
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_order", "_print", "_id"))
    return (first.withColumn("_rank", place).where(F.col("_rank") <= PER_LANGUAGE).orderBy("_rank", "_order", "_print")
            .limit(SAMPLE).select("_id", "_print", "_lang", "_rank"))


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> Model | None:
    """Learns from at most PER_LANGUAGE documents of a language and SAMPLE in all, none of them held out.

    They are those of the least hashed ids, then hashed texts, so the sample is the same for the same documents; rows
    that share an id are told apart by their text, and each text goes with its own row's language. Of repeated rows one
    is learned from. Only presence bits (6 KB a document, SAMPLE of them at most) come to the driver.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text"),
                       held_out(doc_id).alias("_held_out"))
    known = rows.where("_lang is not null and _text is not null and _id is not null and not _held_out")
    ranked = _first_rows(known)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [row.tobytes() for _, matrix, _ in presence(batch.column(2))
                      for row in np.packbits(matrix.astype(bool), axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())],
                                             ["rank", "lang", "bits"])

    marked = known.withColumn("_print", F.xxhash64("_text")).join(F.broadcast(ranked), ["_id", "_print", "_lang"])
    texts = marked.groupBy("_rank", "_lang").agg(F.first("_text").alias("_text"))
    sample = (texts.select(F.col("_rank").cast("long"), "_lang", "_text")
              .mapInArrow(bits, "rank long, lang string, bits binary").toPandas())
    if not len(sample):
        return None
    sample = sample.sort_values(["rank", "lang", "bits"])
    return learned(np.stack([np.frombuffer(b, np.uint8) for b in sample["bits"]]), sample["lang"].tolist())


def identified(docs: DataFrame, model: Model | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1), from the whole text alone.

    Null texts and texts without any letter are `und` with score 0; so is everything if nothing could be learned.
    Repeated rows are scored alike, further columns are ignored, and no rows give no rows.
    """
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for _, matrix, letters in presence(batch.column(2)):
                if model is None:
                    names += [UNDETERMINED] * len(letters)
                    scores += [0.0] * len(letters)
                    continue
                found = model.scores(matrix)
                best = found.argmax(1)
                sure = np.clip((found.max(1) + 1) / 2, 0, 1)
                names += [model.languages[b] if k else UNDETERMINED for b, k in zip(best, letters, strict=True)]
                scores += np.where(letters > 0, sure, 0).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)[doc_id]
    return (docs.select(F.col(doc_id), held_out(doc_id).alias("held_out"), F.col(text))
            .mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double"))
