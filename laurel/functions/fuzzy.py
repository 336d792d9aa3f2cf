"""Jaro similarity, the one function Spark has no built-in for, and the matching of id entries that uses it."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

# Tasks receive the functions of this module by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_SIMILARITY = 0.90
PAIRS = 1 << 18  # pairs of tokens that are compared at once
BINS = 32  # characters are counted by their code modulo this


def jaro(a: str, b: str) -> float:
    """Jaro similarity of two strings (Jaro 1989)."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    from_a = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                from_a.append(ch)
                break
    m = len(from_a)
    if m == 0:
        return 0.0
    from_b = [ch for ch, f in zip(b, free) if not f]
    swapped = sum(x != y for x, y in zip(from_a, from_b)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3.0


def can_reach(a: str, b: str, letters_a: frozenset, letters_b: frozenset, cut: float) -> bool:
    """False when lengths and letters alone keep the similarity under `cut`.

    With m matching characters the similarity is at most (m/|a| + m/|b| + 1) / 3, and a character that the other
    string does not hold cannot match.
    """
    needed = (3 * cut - 1) * len(a) * len(b) / (len(a) + len(b)) - 1e-9
    return (min(len(a), len(b)) >= needed and len(a) - len(letters_a - letters_b) >= needed
            and len(b) - len(letters_b - letters_a) >= needed)


def best_positions(entries, authors, cut: float, similar=jaro) -> list[int]:
    """The rule of `best_of_batch` for one record. For every entry (a list of tokens) the author position with the highest sum of similarities >= cut, or -1.

    Every distinct token of the authors is met once per entry token; ties go to the first author.
    """
    places: dict[str, list[int]] = {}
    for pos, tokens in enumerate(authors):
        for token in tokens:
            places.setdefault(token, []).append(pos)
    known = [(token, frozenset(token), positions) for token, positions in places.items()]
    best = []
    for entry in entries:
        score: dict[int, float] = {}
        for token in entry:
            letters = frozenset(token)
            for other, other_letters, positions in known:
                if not can_reach(token, other, letters, other_letters, cut):
                    continue
                similarity = similar(token, other)
                if similarity >= cut:
                    for pos in positions:
                        score[pos] = score.get(pos, 0.0) + similarity
        top = max(score.values(), default=0.0)
        best.append(min((p for p, s in score.items() if s >= top - 1e-12), default=-1))
    return best


@pandas_udf(T.DoubleType())
def jaro_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b):
        if pair not in seen:
            seen[pair] = None if pair[0] is None or pair[1] is None else jaro(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


class _Names:
    """The names of `;` lists in an Arrow batch, flat: row of each name, and name and text of each token.

    A blank item is no name. Commas are dropped and hyphens taken as blanks; `Name/ID` items count up to the slash.
    """

    def __init__(self, lists: pa.Array, with_ids: bool):
        names, row = self._pieces(pc.fill_null(lists, ""), ";")
        if with_ids:
            names = pc.list_element(pc.split_pattern(names, "/", max_splits=1), 0)
        names, row = self._kept(names, row, pc.utf8_trim(names, " "))
        plain = pc.utf8_trim(pc.replace_substring(pc.replace_substring(names, ",", ""), "-", " "), " ")
        tokens, name = self._pieces(plain, " ")
        self.row, (self.token, self.name) = row, self._kept(tokens, name, tokens)
        self.names = np.searchsorted(row, np.arange(len(lists) + 1))  # first name of each row, one more at the end
        self.tokens = np.searchsorted(self.name, self.names)  # first token of each row

    @staticmethod
    def _pieces(texts: pa.Array, sep: str) -> tuple[pa.Array, np.ndarray]:
        pieces = pc.split_pattern(texts, sep)
        sizes = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
        return pieces.flatten(), np.repeat(np.arange(len(texts)), sizes)

    @staticmethod
    def _kept(texts: pa.Array, of: np.ndarray, filled: pa.Array) -> tuple[pa.Array, np.ndarray]:
        keep = pc.not_equal(filled, "")
        return texts.filter(keep), of[keep.to_numpy(zero_copy_only=False)]


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, set of bins as bits, and count per bin of each word."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4") % BINS
    at = np.repeat(np.arange(len(size)), size) * BINS + codes
    counts = np.bincount(at, minlength=len(size) * BINS).reshape(-1, BINS).astype(np.int32)
    return size, (counts > 0) @ (1 << np.arange(BINS, dtype=np.int64)), counts


def _similar_pairs(left: np.ndarray, right: np.ndarray, letters, needed_share: float):
    """Which pairs of words `can_reach` the cut. The letters are told by bins, so a bound is never tighter than its own.

    At last the characters themselves are counted: no more can match than both words hold of a bin.
    """
    size, seen, counts = letters
    a, b = size[left], size[right]
    needed = needed_share * a * b / np.maximum(a + b, 1) - 1e-9
    of_a, of_b = seen[left], seen[right]
    kept = np.flatnonzero((np.minimum(a, b) >= needed) & (a - np.bitwise_count(of_a & ~of_b) >= needed)
                          & (b - np.bitwise_count(of_b & ~of_a) >= needed))
    shared = np.minimum(counts[left[kept]], counts[right[kept]]).sum(axis=1)
    return kept[shared >= needed[kept]]


def best_of_batch(entries: pa.Array, authors: pa.Array, cut: float, similar=jaro) -> tuple[np.ndarray, np.ndarray]:
    """`best_positions` of every row of a batch, and where each row's begin: all pairs of tokens, PAIRS at a time."""
    e, a = _Names(entries, True), _Names(authors, False)
    words = pa.concat_arrays([e.token, a.token]).dictionary_encode()
    word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of_entry, of_author = word[:len(e.token)], word[len(e.token):]
    letters, texts = _letters(words.dictionary), words.dictionary.to_pylist()
    row = e.row[e.name]
    met = np.diff(a.tokens)[row]  # author tokens that each entry token meets
    ends, found = np.cumsum(met), []
    lo = 0
    while lo < len(met):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        some = met[lo:hi]
        token = np.repeat(np.arange(lo, hi), some)
        other = np.arange(len(token)) - np.repeat(ends[lo:hi] - some - done, some) + a.tokens[row[token]]
        kept = _similar_pairs(of_entry[token], of_author[other], letters, 3 * cut - 1)
        token, other = token[kept], other[kept]
        pairs, which = np.unique(of_entry[token] * len(texts) + of_author[other], return_inverse=True)
        value = np.array([similar(texts[p // len(texts)], texts[p % len(texts)]) for p in pairs.tolist()], float)[which]
        good = value >= cut
        token, other = token[good], other[good]
        found.append((e.name[token], a.name[other] - a.names[row[token]], value[good]))
        lo = hi
    best = np.full(len(e.row), -1, np.int32)
    if found:
        entry, pos, value = map(np.concatenate, zip(*found))
        meeting, which = np.unique((entry << 32) | pos, return_inverse=True)  # by entry, then author
        score, entry, pos = np.bincount(which, value, len(meeting)), meeting >> 32, meeting & 0xFFFFFFFF
        top = np.zeros(len(best))
        np.maximum.at(top, entry, score)
        tied = np.flatnonzero(score >= top[entry] - 1e-12)[::-1]
        best[entry[tied]] = pos[tied]  # the first author is written last
    return best, e.names


def without_conflicts(best: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of entries with the same author the second voids the first and gets nothing; a third may take the author.

    So of an odd number of entries the last one keeps the author, and of an even number none does.
    """
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    entry = np.flatnonzero(best >= 0)
    _, which, times = np.unique((row[entry] << 32) | best[entry], return_inverse=True, return_counts=True)
    last = np.full(len(times), -1)
    np.maximum.at(last, which, entry)
    kept = last[times % 2 == 1]
    alone = np.full_like(best, -1)
    alone[kept] = best[kept]
    return alone


def best_author(entries: Column, authors: Column, cut: float = MIN_SIMILARITY, conflicts: bool = True) -> Column:
    """`;` lists of `Name/ID` entries and of authors -> array of author positions, one per entry with a name (-1: none).

    Without `conflicts`, an author belongs to one entry at most (see `without_conflicts`).
    """

    @arrow_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        similar = lru_cache(maxsize=1 << 18)(jaro)  # name words repeat across the records of a task
        for e, a in batches:
            best, starts = best_of_batch(e, a, cut, similar)
            yield pa.ListArray.from_arrays(
                pa.array(starts, pa.int32()), pa.array(best if conflicts else without_conflicts(best, starts)))

    return run(entries, authors)


def ids_by_position(chosen: Column, people: Column, ids: Column) -> Column:
    """The id whose entry chose each author position, '' where none, as a `;` list."""
    return F.array_join(
        F.transform(people, lambda _, i: F.coalesce(
            F.get(ids, F.array_position(chosen, i.cast("int")).cast("int") - 1), F.lit(""))),
        ";",
    )
