"""Packing token sequences into windows by non-negative least squares over the histogram of lengths."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laurel.operators.numbering import number_rows
from laurel.session import stored

WINDOW = 2048
STEP = 8  # lengths are planned in bins of this many tokens, so that a plan has a fixed size at any corpus size
END = 1  # the id that ends a document
REMEMBERED = 150_000  # parts of words in each of the two generations that a worker remembers
SLICE_BYTES = 4 << 20  # texts are tokenized in slices of about this size
# What the word pattern of the tokenizer file takes besides runs of letters, and what is not plain Latin.
NOT_LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\t-\r \p{L}\p{N}]+"
OTHER = r"[^\t-\r -~\x{a1}-\x{ff}]|<\|"


class WordTokens:
    """Ids of texts as 32-bit integers, the same as the tokenizer gives for each whole text.

    In texts of Latin letters only, Arrow's kernels lower the case and split the words as the tokenizer's own pattern
    does; each distinct word of a slice of texts goes to the merge model once, whose answers are remembered. Other
    texts go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in [*range(33, 127), *range(161, 256)]}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Two generations bound the memory; a word that is met again stays."""
        ids = self.young.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                ids = array("I", [t.id for t in self.model.tokenize(word.translate(self.letters))]).tobytes()
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def _latin(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parted = pc.replace_substring_regex(pc.utf8_lower(texts), NOT_LETTERS, r" \0 ")
        words = pc.ascii_split_whitespace(parted)
        coded = words.flatten().dictionary_encode()
        known = [self._word(w) if w else b"" for w in coded.dictionary.to_numpy(zero_copy_only=False)]
        sizes = np.array([len(k) for k in known], np.int64) // 4
        table = np.frombuffer(b"".join(known), "<u4")
        at = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        source = np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - lengths), lengths)
        source += np.arange(len(source))
        bounds = np.concatenate(([0], ends))
        offsets = words.offsets.to_numpy()
        return table[source], bounds[offsets - offsets[0]]

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text."""
        other = pc.match_substring_regex(texts, OTHER).to_numpy(zero_copy_only=False)
        found = [np.zeros(0, "<u4")] * len(texts)
        latin = np.flatnonzero(~other)
        if len(latin):
            ids, bounds = self._latin(texts.take(pa.array(latin)) if other.any() else texts)
            for i, row in enumerate(latin.tolist()):
                found[row] = ids[bounds[i]:bounds[i + 1]]
        for row in np.flatnonzero(other).tolist():
            found[row] = np.array(self.tokenizer.encode(texts[row].as_py(), add_special_tokens=False).ids, "<u4")
        return found


_LOADED: dict[str, WordTokens] = {}


def _tokens(path: str) -> WordTokens:
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about SLICE_BYTES each, as large strings without nulls."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield first, texts.slice(first, last - first)
        first = last


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, text: str = "text",
           doc_id: str = "doc_id") -> DataFrame:
    """Token pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens.

    A document is its ids and the end id; longer ones are cut into full windows and a rest.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokens(tokenizer)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                rows = []
                for key, ids in zip(batch.column(0).slice(first, len(texts)).to_pylist(), words.ids(texts), strict=True):
                    own = ids.tobytes() + end
                    total = len(own) // 4
                    rows += [(key, at, min(window, total - at), zlib.crc32(own[4 * at:4 * (at + window)]), total)
                             for at in range(0, total, window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return (docs.select(F.col(doc_id).cast("long"), F.col(text))
            .mapInArrow(cut, ", ".join(f"{n} long" for n in names)))


def shallow_combinations(bins: int, depth: int = 3) -> list[tuple[int, ...]]:
    """All multisets of at most `depth` bin lengths (1..bins) that fill the window exactly, longest length first."""
    found = [(bins,)]
    found += [(a, bins - a) for a in range(bins - 1, (bins + 1) // 2 - 1, -1)] if depth > 1 else []
    if depth > 2:
        found += [(a, b, bins - a - b) for a in range(bins - 2, 0, -1)
                  for b in range(min(a, bins - a - 1), 0, -1) if b >= bins - a - b]
    return found


def nonnegative_least_squares(columns: np.ndarray, target: np.ndarray, rounds: int) -> np.ndarray:
    """min |columns x - target| with x >= 0, by the active-set method on the normal equations."""
    n = columns.shape[1]
    gram_target = columns.T @ target
    x, active = np.zeros(n), np.zeros(n, bool)
    slope = gram_target.copy()
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        free = np.where(active, -np.inf, slope)
        j = int(np.argmax(free))
        if free[j] <= tolerance:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            a = columns[:, at]
            s = np.linalg.lstsq(a.T @ a, gram_target[at], rcond=1e-12)[0]
            if s.min() > 0:
                break
            bad = s <= 0
            ratio = x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-300)
            x[at] += min(1.0, ratio.min()) * (s - x[at])
            x[at[bad & (x[at] <= tolerance)]] = 0
            x[at[bad][int(np.argmin(ratio))]] = 0
            active = x > 0
            if not active.any():
                s, at = np.zeros(0), at[:0]
                break
        x[:] = 0
        x[at] = s
        slope = gram_target - columns.T @ (columns @ x)
    return x


def plan(histogram: np.ndarray, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) that use every piece of the histogram (pieces of bin length 1..) exactly once.

    Least squares gives repeats of combinations that fill a window; rounded down, they never use more pieces than there
    are. The rest is packed greedily: the longest length left, then the longest that still fits, as often as all
    lengths of that combination last. The plan's size depends on the number of bins alone.
    """
    bins = len(histogram)
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[bins - 1]:
        out.append(((bins,), int(left[bins - 1])))
        left[bins - 1] = 0
    combos = [c for c in shallow_combinations(bins, depth) if len(c) > 1 and all(left[v - 1] for v in c)]
    if combos:
        columns = np.zeros((bins, len(combos)))
        for j, c in enumerate(combos):
            for v in c:
                columns[v - 1, j] += 1
        repeats = nonnegative_least_squares(columns, left.astype(float), 3 * bins)
        for j in np.argsort(-repeats, kind="stable"):
            c = combos[j]
            need = columns[:, j].astype(np.int64)
            used = np.flatnonzero(need)
            times = min(int(round(repeats[j])), int((left[used] // need[used]).min()))
            if times > 0:
                out.append((c, times))
                left -= times * need
    while left.any():
        room, chosen = bins, np.zeros(bins, np.int64)
        while room > 0:
            fitting = np.flatnonzero(left[:room] > chosen[:room])
            if not len(fitting):
                break
            v = int(fitting[-1]) + 1
            chosen[v - 1] += 1
            room -= v
        used = np.flatnonzero(chosen)
        times = int((left[used] // chosen[used]).min())
        out.append((tuple(int(v) + 1 for v in used[::-1] for _ in range(chosen[v])), times))
        left -= times * chosen
    return out


def _intervals(chosen: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Which pieces (by rank in their bin) go to which combination: bin, first rank, first sequence, repeats, slot."""
    rows, used, sequence = [], {}, 0
    for combination, times in chosen:
        for slot, v in enumerate(combination):
            first = used.get(v, 0)
            rows.append((v, first, sequence, times, slot))
            used[v] = first + times
        sequence += times
    return pd.DataFrame(rows, columns=["bin", "first", "sequence", "times", "slot"])


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, step: int = STEP, text: str = "text",
         doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    All documents are tokenized once and cut into pieces of at most a window; the histogram of binned lengths (window /
    step rows) is solved on the driver, pieces are numbered within their bin, and their rank tells their sequence.
    A bin holds lengths up to its multiple of `step`, so a sequence never exceeds the window.

    Null text is empty: its document is the end id alone. Repeated rows and ids are packed one by one; further columns
    are ignored; no rows give no rows.
    """
    cut = stored(pieces(docs, tokenizer, window, text, doc_id)
                 .withColumn("bin", F.ceil(F.col("length") / step).cast("int")), "pieces")
    histogram = np.zeros(window // step, np.int64)
    for row in cut.groupBy("bin").count().collect():  # at most window / step rows
        histogram[row["bin"] - 1] = row["count"]
    places = _intervals(plan(histogram)).sort_values(["bin", "first"])
    by_bin = {b: part for b, part in places.groupby("bin")}
    ranked = number_rows(cut, ["bin"], [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], "_rank")

    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, ranks = batch.column("bin").to_numpy(), batch.column("_rank").to_numpy()
            sequence, slot = np.zeros(len(bins), np.int64), np.zeros(len(bins), np.int64)
            for b in np.unique(bins):
                part, rows = by_bin[b], np.flatnonzero(bins == b)
                rank = ranks[rows] - 1
                i = np.searchsorted(part["first"].to_numpy(), rank, "right") - 1
                sequence[rows] = part["sequence"].to_numpy()[i] + rank - part["first"].to_numpy()[i]
                slot[rows] = part["slot"].to_numpy()[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(slot)],
                                             names=[*kept, "sequence_id", "slot"])

    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long"
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return (ranked.mapInArrow(placed, fields)
            .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("slot"))
