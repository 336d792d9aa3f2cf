"""Improbable-feature digests: rare byte windows of a text in chained Bloom filters, compared by bit overlap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laurel.llm.shingles import CHUNK_BYTES, chunks, mixed
from laurel.session import stored

WINDOW = 64  # bytes of a feature
CLASSES = 1000  # steps of the entropy scale
WEAK = 100  # below this class a window is nearly constant and is taken only if a text has nothing else
POPULAR = 16  # of the WINDOW neighbourhoods around a window, so many must prefer it
BITS, HASHES, PER_FILTER = 2048, 5, 160  # of one Bloom filter
CHANCE = 0.3  # share of the range above the overlap by chance that does not count as likeness
_SCALE = 1 << 20
_COUNT = np.arange(WINDOW + 2, dtype=float)
_TERM = np.rint(_COUNT * np.log2(np.maximum(_COUNT, 1)) * _SCALE).astype(np.int64)
_LETTER = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1B54A32D192ED03
_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        factor = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, 2 * CHUNK_BYTES), np.uint64(factor), np.uint64)
        steps[0] = 1
        have = _POWERS[kind] = np.cumprod(steps)
    return have[:n]


def entropy_classes(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The entropy class (0..CLASSES) of the WINDOW bytes from every byte on; -1 where the row ends before.

    The sum over byte values of c log c follows the window: one byte leaves and one comes in, and its count is a
    difference of two ranks among the places of that byte value. All sums are integers, so classes are exact.
    """
    n = len(text)
    place = np.arange(n) + WINDOW * np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))  # rows lie apart
    order = np.argsort(text, kind="stable")
    key = (text[order].astype(np.int64) << 40) + place[order]
    index = np.arange(n)
    ahead = np.empty(n, np.int64)
    ahead[order] = np.searchsorted(key, key + WINDOW) - index
    behind = np.empty(n, np.int64)
    behind[order] = index - np.searchsorted(key, key - WINDOW + 1)
    come = np.concatenate(([0], np.cumsum(_TERM[behind + 1] - _TERM[behind])))
    gone = np.concatenate(([0], np.cumsum(_TERM[ahead] - _TERM[ahead - 1])))
    first = np.repeat(offsets[:-1], np.diff(offsets))
    last = np.repeat(offsets[1:], np.diff(offsets))
    whole = index + WINDOW <= last
    end = np.minimum(index + WINDOW, n)
    total = come[end] - come[first] - (gone[index] - gone[first])
    classes = (WINDOW * 6 * _SCALE - total) * CLASSES // (WINDOW * 6 * _SCALE)
    return np.where(whole, classes, -1)


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The rank of every entropy class, rarest first, counted over all windows of all texts; weak classes last."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CLASSES + 1, np.int64)
        for batch in batches:
            for _, body, offsets in chunks(batch.column(0)):
                classes = entropy_classes(body, offsets)
                seen += np.bincount(classes[classes >= 0], minlength=CLASSES + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES + 1)), pa.array(seen)], ["class", "n"])

    rows = docs.select(text).mapInArrow(count, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(CLASSES + 1, np.int64)  # CLASSES + 1 rows
    for row in rows:
        total[row["class"]] = row["n"]
    weak = np.arange(CLASSES + 1) < WEAK
    ranks = np.empty(CLASSES + 1, np.int64)
    ranks[np.lexsort((np.arange(CLASSES + 1), total, weak))] = np.arange(CLASSES + 1)
    return ranks


@dataclass
class Profile:
    """What is kept of a text while its neighbours are compared: its bytes, the entropy classes of its windows, its digest."""

    body: np.ndarray
    classes: np.ndarray
    digest: bytes


def profiles(column: pa.Array, ranks: np.ndarray) -> list[Profile]:
    """The profile of every text; `digest` are its chained filters, BITS / 8 bytes each, and an empty text has none.

    Windows that at least POPULAR neighbourhoods prefer are features, or the one that is preferred most. A text shorter
    than a window is one feature.
    """
    out: list[Profile] = []
    for _, body, offsets in chunks(column):
        out += _profiles(body, offsets, entropy_classes(body, offsets) if len(body) else np.zeros(0, np.int64), ranks)
    return out


def _profiles(body: np.ndarray, offsets: np.ndarray, classes: np.ndarray, ranks: np.ndarray) -> list[Profile]:
    thin, ends = classes.astype(np.int16), offsets.tolist()
    return [Profile(body[a:b], thin[a:b], d) for a, b, d in zip(ends, ends[1:], _digests(body, offsets, classes, ranks))]


def digests(column: pa.Array, ranks: np.ndarray) -> list[bytes]:
    return [p.digest for p in profiles(column, ranks)]


def edited_profiles(heads: list[tuple[Profile, int]], tails: list[tuple[Profile, int]], ranks: np.ndarray) -> list[Profile]:
    """Profiles of texts that are the first bytes of one text and the first bytes of another, up to the given numbers.

    A window inside either part has the class that it has in its own text, so only the windows over the seam are
    looked at; at the end there are none that fit.
    """
    seams, bodies, classes, places = [], [], [], []
    for (head, cut), (tail, more) in zip(heads, tails, strict=True):
        body = np.concatenate((head.body[:cut], tail.body[:more]))
        own = np.concatenate((head.classes[:cut], tail.classes[:more])).astype(np.int64)
        own[max(0, len(body) - WINDOW + 1):] = -1
        first = max(0, cut - WINDOW + 1)
        places.append((first, cut))
        seams.append(body[first:cut + WINDOW - 1])
        bodies.append(body)
        classes.append(own)
    lengths = [np.concatenate(([0], np.cumsum([len(b) for b in parts]))).astype(np.int64) for parts in (seams, bodies)]
    if not lengths[1][-1]:
        return [Profile(b, c.astype(np.int16), b"") for b, c in zip(bodies, classes, strict=True)]
    over = entropy_classes(np.concatenate(seams), lengths[0]) if lengths[0][-1] else np.zeros(0, np.int64)
    for own, start, (first, cut) in zip(classes, lengths[0].tolist(), places):
        own[first:cut] = over[start:start + cut - first]
    return _profiles(np.concatenate(bodies), lengths[1], np.concatenate(classes), ranks)


def _digests(text: np.ndarray, offsets: np.ndarray, classes: np.ndarray, ranks: np.ndarray) -> list[bytes]:
    n, rows = len(text), len(offsets) - 1
    if n == 0:
        return [b""] * rows
    row = np.repeat(np.arange(rows), np.diff(offsets))
    # Rank and place in one number: the least of a neighbourhood is its rarest, leftmost window.
    value = (np.where(classes >= 0, ranks[classes], CLASSES + 1) << 40) + np.arange(n)
    least = value
    width = 1
    while width < WINDOW:
        moved = np.full(n, np.iinfo(np.int64).max)
        moved[:-width] = least[width:]
        ends = np.minimum(offsets[1:][row], n)
        moved[np.arange(n) + width >= ends] = np.iinfo(np.int64).max
        least = np.minimum(least, moved)
        width *= 2
    votes = np.bincount(least & ((1 << 40) - 1), minlength=n)
    votes[classes < 0] = 0
    chosen = votes >= POPULAR
    best = np.zeros(rows, np.int64)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    best[filled] = np.maximum.reduceat(votes, offsets[:-1][filled])
    for r in np.flatnonzero((best > 0) & (best < POPULAR)):
        chosen[offsets[r] + int(np.argmax(votes[offsets[r]:offsets[r + 1]]))] = True
    short = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < WINDOW))
    chosen[offsets[:-1][short]] = True
    at = np.flatnonzero(chosen)
    end = np.minimum(at + WINDOW, offsets[1:][row[at]])
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[text] * _powers("up", n))))
    hashed = mixed((sums[end] - sums[at]) * _powers("down", n)[at] + (end - at).astype(np.uint64))
    counts = np.bincount(row[at], minlength=rows)
    filters = -(-counts // PER_FILTER)
    base = np.cumsum(filters) - filters
    ordinal = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    slot = base[row[at]] + ordinal // PER_FILTER
    bits = np.zeros((int(filters.sum()), BITS), bool)
    for k in range(HASHES):
        bits[slot, ((hashed >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[b:b + f].tobytes() for b, f in zip(base.tolist(), filters.tolist(), strict=True)]


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: every filter of the shorter chain with its best match in the other, above what chance gives.

    Two empty digests are alike (1), an empty one is like no other (0).
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(d, np.uint8).reshape(-1, BITS // 8).view(np.uint64) for d in sorted((a, b), key=len))
    ones_x, ones_y = (np.bitwise_count(d).sum(1, dtype=np.int64) for d in (x, y))
    best = np.zeros(len(x))
    for i in range(len(x)):
        both = np.bitwise_count(x[i] & y).sum(1, dtype=np.int64)
        most = np.minimum(ones_x[i], ones_y)
        chance = ones_x[i] * ones_y / BITS
        cut = chance + CHANCE * (most - chance)
        best[i] = max(0.0, float(np.max((both - cut) / np.maximum(most - cut, 1e-9))))
    return float(min(1.0, best.mean()))


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the following text's first, or all it has."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


_FIELDS = ("kind int, part long, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, "
           "edited_fingerprint binary, near_edited double, near_next double, body binary")
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]


def _compared(ids: list, texts: list[str], own: list[Profile], ranks: np.ndarray) -> list[tuple]:
    """Result rows of all texts but the last, each with the one after it. Texts are changed in runs of CHUNK_BYTES."""
    out, at = [], 0
    while at < len(texts) - 1:
        heads, tails, size = [], [], 0
        while at + len(heads) < len(texts) - 1 and size < CHUNK_BYTES:
            i = at + len(heads)
            k = len(texts[i]) // 3
            heads.append((own[i], len(texts[i][:len(texts[i]) - k].encode())))
            tails.append((own[i + 1], len(texts[i + 1][:k].encode())))
            size += heads[-1][1] + tails[-1][1]
        for i, changed in enumerate(edited_profiles(heads, tails, ranks), at):
            out.append((0, None, ids[i], len(texts[i]), hashlib.sha256(changed.body.tobytes()).hexdigest(), own[i].digest,
                        changed.digest, likeness(own[i].digest, changed.digest), likeness(own[i].digest, own[i + 1].digest), None))
        at += len(heads)
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(),
             pa.float64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _NAMES)


def fingerprints(docs: DataFrame, ranks: np.ndarray, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The texts (compressed) are range-sorted by descending doc_id, and each task goes through its range once, holding a
    few texts; the last text of a range meets the first of the next range in a second, small step (two texts per
    task). After the smallest id comes the largest.

    Null text is empty, with an empty fingerprint. Rows without id come last; rows that share an id are ordered by
    text. Further columns are ignored; no rows give no rows.
    """
    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            body = [pack.compress((v.as_py() or "").encode()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(body, pa.binary())], ["doc_id", "body"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        ids, texts, own = [], [], []
        started = False
        for batch in batches:
            keys, bodies = batch.column(0).to_pylist(), batch.column(1)
            lo = 0
            while lo < len(keys):
                new, size = [], 0
                while lo + len(new) < len(keys) and size < CHUNK_BYTES:
                    new.append(unpack.decompress(bodies[lo + len(new)].as_py()).decode())
                    size += len(new[-1])
                own += profiles(pa.array(new, pa.large_string()), ranks)
                ids += keys[lo:lo + len(new)]
                texts += new
                lo += len(new)
                rows = _compared(ids, texts, own, ranks)
                if not started:
                    started = True
                    rows.append((1, part, ids[0], None, None, own[0].digest, None, None, None, pack.compress(texts[0].encode())))
                yield _batch(rows)
                ids, texts, own = ids[-1:], texts[-1:], own[-1:]
        if ids:
            yield _batch([(2, part, ids[0], None, None, own[0].digest, None, None, None, pack.compress(texts[0].encode()))])

    def join_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for key, body, next_body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts = [unpack.decompress(b).decode() for b in (body, next_body)]
                rows += _compared([key, None], texts, profiles(pa.array(texts, pa.large_string()), ranks), ranks)
            yield _batch(rows)

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        shrink, "doc_id long, body binary")
    order = F.col("doc_id").desc_nulls_last()
    walked = stored(slim.repartitionByRange(order).sortWithinPartitions(order, "body").mapInArrow(walk, _FIELDS), "walked")
    heads = walked.where("kind = 1").select(F.col("part").alias("next"), F.col("body").alias("next_body"))
    tasks = Window.orderBy("part")  # one row per task
    first = F.min("part").over(tasks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = (walked.where("kind = 1")
             .select("part", F.coalesce(F.lead("part").over(tasks), first).alias("next")))
    edges = (walked.where("kind = 2").join(after, "part").join(heads, "next")
             .select("doc_id", "body", "next_body").mapInArrow(join_ranges, _FIELDS))
    return (walked.where("kind = 0").union(edges)
            .select("doc_id", "n_chars", "edited_sha256", F.base64("fingerprint").alias("fingerprint"),
                    F.base64("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next"))
