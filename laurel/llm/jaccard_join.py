"""Exact Jaccard self-join of shingle sets, with set relations that skip most comparisons.

Index-level skipping: lists of the prefix index are cut into blocks by position, and a block is skipped if no entry of
it can reach the overlap. Answer-level skipping: sets that were found linked need no further comparison with each other;
for sets of different classes the overlap of two similar, already compared sets bounds theirs from both sides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.llm.components import components
from laurel.llm.shingles import shingle_sets
from laurel.llm.tables import with_ids
from laurel.session import stored

WIDTH, PERCENT = 5, 80
FREQUENT, FREQUENT_KEPT = 32, 1 << 17  # shingles met so often go last in the order; so many of them at most
COUNT_BLOCK = 1 << 21  # shingles that a task counts at once
LIST_BLOCK = 64  # entries of an index list that are skipped together
SHORT = 8  # lists up to this length are paired all at once, longer ones entry by entry
BITS = 512  # of a set's parity map
MEMBERS = 256  # sets that one group of a comparison compares with its first set


def _prefix(n, percent: int):
    """How many first elements of a set of n must hold one of any linked set's first elements."""
    return n - -(-percent * n // 100) + 1


def _index_prefix(n, percent: int):
    """The same for the smaller set of a pair."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def _needed(n, m, percent: int):
    """The least overlap of linked sets of sizes n and m."""
    return -(-percent * (n + m) // (100 + percent))


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def frequent_shingles(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent shingles of all texts, sorted, and their counts.

    Every task counts all its shingles and reports those it met more than once. The list only orders the sets' elements
    (rare ones first), so its bound, FREQUENT_KEPT, changes the time taken and never a result.
    """
    def repeated(blocks: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(blocks), return_counts=True)
        return _batch(["shingle", "n"], found[counts > 1].view(np.int64), counts[counts > 1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, held = [], 0
        for batch in batches:
            for own in shingle_sets(batch.column(0), width):
                blocks.append(own)
                held += len(own)
                if held >= COUNT_BLOCK:
                    yield repeated(blocks)
                    blocks, held = [], 0
        if held:
            yield repeated(blocks)

    top = (docs.select(text).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
           .where(F.col("n") >= FREQUENT).orderBy(F.col("n").desc(), "shingle").limit(FREQUENT_KEPT).toPandas())
    found = top["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], top["n"].to_numpy(np.int64)[order]


def described_sets(docs: DataFrame, text: str, doc_id: str, width: int, percent: int) -> DataFrame:
    """doc_id, n (set size), sig (digest of the set), prefix (rarest elements first, six bytes each), parity.

    Every element flips one bit of the parity map, so the maps of two sets differ in at most as many bits as the sets
    differ in elements.
    """
    frequent, often = frequent_shingles(docs, text, width)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, prefixes, maps = [], [], [], []
            for own in shingle_sets(batch.column(1), width):
                n = len(own)
                sizes.append(n)
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                flips = np.bincount((own & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
                maps.append(np.packbits(flips.astype(np.uint8)).tobytes())
                if n and len(frequent):
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    common = frequent[at] == own
                    last = own[common]
                    own = np.concatenate((own[~common], last[np.argsort(often[at[common]], kind="stable")]))
                first = (own[:_prefix(n, percent)] >> np.uint64(16)).astype("<u8") if n else own
                prefixes.append(first.view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            yield _batch(["doc_id", "n", "sig", "prefix", "parity"], batch.column(0), pa.array(sizes, pa.int64()),
                         *[pa.array(c, pa.binary()) for c in (digests, prefixes, maps)])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        describe, "doc_id long, n long, sig binary, prefix binary, parity binary")


def _postings(reps: DataFrame) -> DataFrame:
    """The prefix index: one row per set and prefix element."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            counts = np.array([len(p) // 6 for p in raw], np.int64)
            wide = np.zeros((int(counts.sum()), 8), np.uint8)
            wide[:, :6] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 6)
            pos = np.arange(len(wide)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield _batch(["shingle", "doc", "n", "pos"], wide.view("<i8").ravel(),
                         np.repeat(batch.column(0).to_numpy(), counts),
                         np.repeat(batch.column(1).to_numpy().astype(np.int32), counts), pos.astype(np.int32))

    return reps.select("rep", "n", "prefix").mapInArrow(explode, "shingle long, doc long, n int, pos int")


def _lists(postings: DataFrame, percent: int) -> DataFrame:
    """Entries of index lists with three or more sets (kind 0), and first pairs to compare (kind 1: x, y).

    The first pairs of a list are neighbours by size, and the first set of each size class with all others of the
    class: as many pairs as entries, enough to connect a cluster of near copies however large.
    """
    growth = np.log(100 / percent)

    def entries(rows: list[np.ndarray], same: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
        """Rows lo..hi that lie in a list of three or more; `same` has two more places at its end."""
        at = np.arange(lo, hi)
        before = np.where(at > 0, same[np.maximum(at - 1, 0)], False)
        at = at[(same[at] & (before | same[at + 1])) | (same[at + 1] & same[at + 2])]
        return [c[at] for c in rows]

    def output(listed: list[np.ndarray], pairs: np.ndarray) -> pa.RecordBatch:
        shingle, doc, n, pos = listed
        k, p = len(doc), len(pairs)
        return _batch(["kind", "x", "y", "n", "pos"], np.repeat(np.array([0, 1], np.int8), (k, p)),
                      np.concatenate((shingle, pairs[:, 0])), np.concatenate((doc, pairs[:, 1])),
                      np.concatenate((n, np.zeros(p, np.int32))), np.concatenate((pos, np.zeros(p, np.int32))))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last four rows go along: of the last two it is not known yet how their lists go on.
        rows, same, open_from, star = None, None, 0, None
        for batch in batches:
            new = [c.to_numpy() for c in batch.columns]
            if not len(new[0]):
                continue
            kept = 0
            if rows is not None:
                kept = min(4, len(rows[0]))
                open_from -= len(rows[0]) - kept
                new = [np.concatenate((c[-kept:], d)) for c, d in zip(rows, new, strict=True)]
            rows = new
            shingle, doc, n, _ = rows
            same = np.zeros(len(doc) + 2, bool)
            same[1:-2] = shingle[1:] == shingle[:-1]
            size_class = np.floor(np.log(np.maximum(n, 1)) / growth).astype(np.int64)
            begins = ~same[:-2]
            begins[1:] |= size_class[1:] != size_class[:-1]
            first = np.maximum.accumulate(np.where(begins, np.arange(len(doc)), 0))
            hub, hub_n = doc[first], n[first]
            if star is not None:  # the class of the last row before goes on
                last = kept - 1
                goes_on = (first <= last) & (np.arange(len(doc)) >= last) & (shingle == shingle[last])
                goes_on &= size_class == size_class[last]
                hub[goes_on], hub_n[goes_on] = star
            pairs = [np.zeros((0, 2), np.int64)]
            here = np.arange(max(kept, 1), len(doc))
            for a, na in ((doc[here - 1], n[here - 1]), (hub[here], hub_n[here])):
                b, nb = doc[here], n[here]
                ok = same[here] & (a != b) & (np.minimum(na, nb) * 100.0 >= np.maximum(na, nb) * float(percent))
                pairs.append(np.stack((a[ok], b[ok]), 1))
            done = max(open_from, len(doc) - 2)
            yield output(entries(rows, same, open_from, done), np.unique(np.concatenate(pairs), axis=0))
            open_from, star = done, (hub[-1], hub_n[-1])
        if rows is not None:
            yield output(entries(rows, same, open_from, len(rows[0])), np.zeros((0, 2), np.int64))

    return (postings.repartition("shingle").sortWithinPartitions("shingle", "n", "doc")
            .mapInArrow(walk, "kind byte, x long, y long, n int, pos int"))


def _crossing_pairs(lists: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets in one index list, of different classes, that may reach the overlap; not distinct.

    `marks` has (doc, root, parity) of the sets. Neighbours of a list have been compared before.
    """
    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # entries of the current list that later, larger sets may match
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy().astype(np.int64) for c in batch.columns[:5]]
            rows.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), "<u8").reshape(-1, BITS // 64))
            old = 0
            if held is not None and held[0][0] == rows[0][0]:
                fits = 100 * held[2] >= percent * rows[2][0]
                old = int(fits.sum())
                rows = [np.concatenate((h[fits], c)) for h, c in zip(held, rows, strict=True)]
            shingle, doc, n, pos, root, parity = rows
            cuts = np.concatenate(([0], np.flatnonzero(shingle[1:] != shingle[:-1]) + 1, [len(shingle)]))
            found = [_short_pairs(rows, cuts, old, percent)]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if hi - lo > SHORT and (root[lo:hi] != root[lo]).any():
                    found += _long_pairs(doc[lo:hi], n[lo:hi], pos[lo:hi], root[lo:hi], parity[lo:hi],
                                         max(0, old - lo), percent)
            pairs = np.unique(np.concatenate(found), axis=0)
            yield _batch(["a", "b"], pairs[:, 0].copy(), pairs[:, 1].copy())
            held = [c[cuts[-2]:] for c in rows]

    joined = (lists.where("kind = 0").select(F.col("x").alias("shingle"), F.col("y").alias("doc"), "n", "pos")
              .join(marks, "doc").select("shingle", "doc", "n", "pos", "root", "parity"))
    return (joined.repartition("shingle").sortWithinPartitions("shingle", "n", "doc")
            .mapInArrow(cross, "a long, b long"))


def _may_link(n, m, pos_n, pos_m, parity_n, parity_m, percent: int) -> np.ndarray:
    """Whether sets of sizes n <= m that share the elements at these positions first may be linked."""
    needed = _needed(n, m, percent)
    apart = np.bitwise_count(parity_n ^ parity_m).sum(-1, dtype=np.int64)
    return ((100 * n >= percent * m) & (pos_n < _index_prefix(n, percent)) & (np.minimum(n - pos_n, m - pos_m) >= needed)
            & (apart <= n + m - 2 * needed))


def _short_pairs(rows: list[np.ndarray], cuts: np.ndarray, old: int, percent: int) -> np.ndarray:
    """The pairs of all lists of up to SHORT entries, but for neighbours and those within the first `old` entries."""
    shingle, doc, n, pos, root, parity = rows
    sizes = np.repeat(np.diff(cuts), np.diff(cuts))
    found = [np.zeros((0, 2), np.int64)]
    for k in range(2, SHORT):
        at = np.arange(max(old, k), len(doc))
        at = at[(sizes[at] <= SHORT) & (shingle[at] == shingle[at - k]) & (root[at] != root[at - k])]
        at = at[_may_link(n[at - k], n[at], pos[at - k], pos[at], parity[at - k], parity[at], percent)]
        found.append(np.stack((doc[at - k], doc[at]), 1))
    return np.concatenate(found)


def _long_pairs(doc, n, pos, root, parity, old: int, percent: int) -> list[np.ndarray]:
    """Crossing pairs of one long list (by size): each entry from `old` on with those before it.

    The list is cut into blocks by position; a block is skipped if no entry in it can have the overlap.
    """
    order = np.argsort(pos, kind="stable")
    starts = np.arange(0, len(order), LIST_BLOCK)
    block_pos = pos[order][starts]  # the least position of a block
    block_n = np.minimum.reduceat(n[order], starts)
    block_left = np.maximum.reduceat((n - pos)[order], starts)
    found = []
    for i in range(max(old, 1), len(doc)):
        may = (block_n <= n[i]) & (np.minimum(block_left, n[i] - pos[i]) >= _needed(block_n, n[i], percent))
        may &= block_pos < _index_prefix(n[i], percent)
        if not may.any():
            continue
        j = order if may.all() else np.concatenate([order[k * LIST_BLOCK:(k + 1) * LIST_BLOCK] for k in np.flatnonzero(may)])
        j = j[(j < i) & (root[j] != root[i])]
        j = j[_may_link(n[j], n[i], pos[j], pos[i], parity[j], parity[i], percent)]
        if len(j):
            found.append(np.stack((doc[j], np.full(len(j), doc[i])), 1))
    return found


def _sets_of(docs: DataFrame, pairs: DataFrame, text: str, doc_id: str, width: int) -> DataFrame:
    """(doc, n, elements): the whole sets of the documents in `pairs` (a, b), and of few others."""
    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), width))
            yield _batch(["doc", "n", "elements"], batch.column(0), pa.array([len(own) for own in sets], pa.int64()),
                         pa.array([own.tobytes() for own in sets], pa.binary()))

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text))
    return with_ids(plain, _ends(pairs)).mapInArrow(elements, "doc long, n long, elements binary")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))


def bounds(pairs: DataFrame, sets: DataFrame, item: int) -> DataFrame:
    """(a, b, n_a, n_b, least, most): bounds of the overlap of every distinct pair (a, b).

    `sets` has (doc, n, elements): of a set of n, its first elements in the common order, `item` bytes each. Of the two
    sets, the one whose known elements end first has all its known common elements among the other's, so the overlap is
    at most the common known elements and that set's unknown ones. With whole sets both bounds are the overlap.

    The pairs of one first set are compared in groups of about MEMBERS, each with its own copy of that set, so a set
    with very many pairs spreads over tasks; a task holds one first set and a batch of others.
    """
    def unpacked(raw: bytes) -> np.ndarray:
        wide = np.zeros((len(raw) // item, 8), np.uint8)
        wide[:, :item] = np.frombuffer(raw, np.uint8).reshape(-1, item)
        return np.sort(wide.view("<u8").ravel())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, firsts = None, []
        for batch in batches:
            out = []
            for a, salt, b, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = unpacked(raw)
                if (a, salt) != group:
                    group, firsts = (a, salt), []
                if b is None:
                    firsts.append((n, own))
                    continue
                for m, first in firsts:  # more than one only where rows share an id
                    small, large = (first, own) if len(first) < len(own) else (own, first)
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    both = int((large[at] == small).sum()) if len(large) else 0
                    out.append((a, b, m, n, both, min(both + max(m - len(first), n - len(own)), m, n)))
            if out:
                yield _batch(["a", "b", "n_a", "n_b", "least", "most"],
                             *[pa.array(c, pa.int64()) for c in zip(*out, strict=True)])

    groups = (pairs.groupBy("a").agg(F.count("*").alias("_pairs"))
              .select("a", F.ceil(F.col("_pairs") / MEMBERS).alias("groups")))
    others = (pairs.join(groups, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("groups")))
              .join(sets.withColumnRenamed("doc", "b"), "b").select("a", "salt", "b", "n", "elements"))
    firsts = (groups.join(sets.withColumnRenamed("doc", "a"), "a")
              .select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt"),
                      F.lit(None).cast("long").alias("b"), "n", "elements"))
    return (firsts.union(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
            .mapInArrow(compare, "a long, b long, n_a long, n_b long, least long, most long"))


def _linked(both: Column, n: Column, m: Column, percent: int) -> Column:
    return 100 * both >= percent * (n + m - both)


def near_duplicate_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH,
                           percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents are linked if their sets of distinct `width`-word shingles (A-Z in lower case, words between ASCII
    white space) have a Jaccard similarity of at least `percent` / 100; component_id is the smallest id that links
    lead to. Equal sets are compared once. No link between different sets is lost: a pair is left out only if its sets
    are already connected, if the prefix, size or position bound excludes it, or if known overlaps decide it.

    Null, empty and blank texts have empty sets and are linked with nothing; texts with fewer words have one shingle.
    Rows without id get no component. Rows that share an id count as one node. Further columns are ignored; no rows
    give no rows.
    """
    described = stored(described_sets(docs, text, doc_id, width, percent), "sets")
    reps = stored(described.where("n > 0 and doc_id is not null").groupBy("sig")
                  .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.min_by("prefix", "doc_id").alias("prefix"),
                       F.first("parity").alias("parity")), "reps")
    lists = stored(_lists(_postings(reps), percent), "lists")
    prefixes = reps.select(F.col("rep").alias("doc"), "n", F.col("prefix").alias("elements"))

    def compared(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The bounds of all pairs by their prefixes, and the overlaps of those that may be linked."""
        rough = stored(bounds(pairs, with_ids(prefixes, _ends(pairs), "doc"), 6), "bounds")
        may = rough.where(_linked(F.col("most"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
        return rough, stored(bounds(may, _sets_of(docs, may, text, doc_id, width), 8), "overlaps")

    def links_of(exact: DataFrame) -> DataFrame:
        return exact.where(_linked(F.col("least"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")

    near = stored(lists.where("kind = 1").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
                  "near")
    rough, exact = compared(near)
    roots = stored(components(links_of(exact)), "roots")

    marks = (reps.select(F.col("rep").alias("doc"), "parity").join(roots.withColumnRenamed("node", "doc"), "doc", "left")
             .select("doc", F.coalesce("root", "doc").alias("root"), "parity"))
    crossing = stored(_crossing_pairs(lists, marks, percent)
                      .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
                      .join(near, ["a", "b"], "left_anti"), "crossing")
    decided = _derived(crossing, rough.join(exact.select("a", "b"), ["a", "b"], "left_anti").union(exact), prefixes, percent)
    _, late = compared(decided.where("not yes and not no").select("a", "b"))
    final = _rooted(roots, decided.where("yes").select("a", "b").union(links_of(late)))

    of_set = reps.select("sig", "rep")
    return (described.select("doc_id", "n", "sig").join(of_set, "sig", "left")
            .join(final.select(F.col("node").alias("rep"), "root"), "rep", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id")).alias("component_id")))


def _rooted(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links (a, b): these join whole classes, so only the classes' roots are linked."""
    of = roots.select("node", "root")
    ends = (links.join(of.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left")
            .join(of.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b", "left"))
    joined = stored(components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))), "joined")
    upper = joined.select(F.col("node").alias("root"), F.col("root").alias("upper"))
    moved = of.join(upper, "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
    return moved.union(joined.join(of, "node", "left_anti").select("node", "root"))


def _derived(pairs: DataFrame, known: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b, yes, no) for `pairs`: what the known bounds of similar sets tell of their own overlap.

    Every set has a lead: the set of the largest known overlap with it, or itself. With d = elements of a set that its
    lead may lack and e = elements of the lead that the set may lack, the overlap of a and b is at most that of their
    leads plus both d, and at least that less both e. The bounds of two leads are computed once for all their followers.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    sizes = stored(ends.join(prefixes.groupBy("doc").agg(F.max("n").alias("size")), "doc"), "sizes")
    best = (known.select(F.col("b").alias("doc"), F.struct("least", (-F.col("a")).alias("minus"), F.col("n_b").alias("n"),
                                                           F.col("n_a").alias("lead_n")).alias("best"))
            .join(ends, "doc", "left_semi").groupBy("doc").agg(F.max("best").alias("best")))
    lead = stored(sizes.join(best, "doc", "left").select(
        "doc", "size", F.coalesce(-F.col("best.minus"), F.col("doc")).alias("lead"),
        F.coalesce(F.col("best.n") - F.col("best.least"), F.lit(0)).alias("d"),
        F.coalesce(F.col("best.lead_n") - F.col("best.least"), F.lit(0)).alias("e")), "leads")
    side = [lead.select(F.col("doc").alias(x), F.col("size").alias(f"n_{x}"), F.col("lead").alias(f"l_{x}"),
                        F.col("d").alias(f"d_{x}"), F.col("e").alias(f"e_{x}")) for x in ("a", "b")]
    placed = stored(pairs.join(side[0], "a").join(side[1], "b").withColumn("p", F.least("l_a", "l_b"))
                    .withColumn("q", F.greatest("l_a", "l_b")), "placed")
    wanted = stored(placed.where("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), "wanted")
    have = known.select("a", "b", "least", "most").join(wanted, ["a", "b"], "left_semi")
    new = wanted.join(known, ["a", "b"], "left_anti")
    found = bounds(new, with_ids(prefixes, _ends(new), "doc"), 6).select("a", "b", "least", "most")
    leads = have.union(found).select(F.col("a").alias("p"), F.col("b").alias("q"), "least", "most")
    bounded = placed.join(leads, ["p", "q"], "left")
    most = F.least(F.col("most") + F.col("d_a") + F.col("d_b"), F.col("n_a"), F.col("n_b"))
    least = F.col("least") - F.col("e_a") - F.col("e_b")
    return stored(bounded.select(
        "a", "b", F.coalesce(_linked(least, F.col("n_a"), F.col("n_b"), percent), F.lit(False)).alias("yes"),
        F.coalesce(~_linked(most, F.col("n_a"), F.col("n_b"), percent), F.lit(False)).alias("no")), "decided")
