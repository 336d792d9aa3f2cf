"""SentencePiece encoding and decoding as joins: a lattice of pieces per distinct word, folded to one segmentation."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from laurel.session import stored

SPACE = "▁"
LONG = 40  # characters; longer words are segmented one by one, as a fold over their many pieces is quadratic
BLOCK_DOCS = 16_384  # documents that share one dictionary on the way back
SET = 64  # blocks that a word names in one number
EDGES = 1 << 18  # edges of lattices that are folded at once


@dataclass
class PieceTable:
    """The ordinary pieces of a model with their ids and scores, and the ids of its byte pieces."""

    pieces: list[tuple[str, int, float]]
    first_byte: int
    size: int
    merges: bool  # a merge model joins the best neighbours; otherwise the best path by the sum of scores counts
    texts: list[str]  # of every id, as hexadecimal UTF-8

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)

    @classmethod
    def load(cls, path: str, merges: bool = True) -> PieceTable:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary, texts, first_byte = [], [], 0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                first_byte = first_byte or i
                texts.append(piece[3:5])
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                texts.append("")
            else:
                ordinary.append((piece, i, model.get_score(i)))
                texts.append(piece.replace(SPACE, " ").encode().hex())
        return cls(ordinary, first_byte, model.get_piece_size(), merges, texts)


def words_of(text: str) -> Column:
    """The words of a text in order: each is a run of spaces with what follows up to the next space.

    No piece has a space after another character, so no piece crosses words.
    """
    marked = F.concat(F.lit(SPACE), F.translate(F.col(text), " ", SPACE))
    return F.when(F.length(text) > 0, F.split(marked, f"(?<=[^{SPACE}])(?={SPACE})")).otherwise(F.array().cast("array<string>"))


EDGE = ["_no", "begin", "end", "id", "score"]


def lattice(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """The edges of `words`: one row per piece that occurs in a word, with begin, end, id, score. The rows of `words` are
    distinct; their columns stand in the first row of each word, which `_no` names, and are null in its other rows.

    Substrings of bounded length are exploded and meet the piece table (a model's vocabulary, so of fixed size) in an
    equi-join that leaves the rows where they are, so a word's edges follow each other without a grouping. Characters
    without a piece have an edge without id.
    """
    begin = F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("begin")
    spans = (words.select("*", F.monotonically_increasing_id().alias("_no"))
             .select("*", begin)
             .select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("begin"))))
                     .alias("size"))
             .select("*", F.expr("substring(word, begin + 1, size)").alias("piece")))
    first = (F.col("begin") == 0) & (F.col("size") == 1)
    return (spans.join(F.broadcast(table), "piece", "left").where("id is not null or size = 1")
            .select(*[F.when(first, F.col(c)).alias(c) for c in words.columns], "_no", "begin",
                    (F.col("begin") + F.col("size")).alias("end"), "id", "score"))


def _best_path(word: np.ndarray, begin: np.ndarray, end: np.ndarray, score: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Viterbi over many words, place by place: the cuts of the best sums of scores. Characters without piece cost most;
    of equal sums the shortest last piece counts. Word `w` has the places start[w] to start[w + 1] - 1."""
    total = np.zeros(start[-1])
    back = np.zeros(start[-1], np.int64)
    order = np.lexsort((begin, word, end))
    word, begin, end, score = word[order], begin[order], end[order], np.nan_to_num(score[order], nan=-1e6)
    bounds = np.flatnonzero(np.r_[True, end[1:] != end[:-1], True])
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        w, b = word[low:high], begin[low:high]
        sums = total[start[w] + b] + score[low:high]
        heads = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        best = np.maximum.reduceat(sums, heads)
        total[start[w[heads]] + end[low]] = best
        won = sums == np.repeat(best, np.diff(np.r_[heads, len(w)]))
        back[start[w[won]] + end[low]] = b[won]  # begins rise, so the last one stays
    cut = np.zeros(start[-1], bool)
    first, at = start[:-1], start[1:] - 1
    while len(at):
        cut[at] = True
        rest = at > first
        first, at = first[rest], (first + back[at])[rest]
    return cut


def _merged(word: np.ndarray, begin: np.ndarray, end: np.ndarray, score: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Merging in many words at once: from single characters on, a word's best-scored piece that spans exactly two
    neighbours joins them. Of equal scores the first counts. Places are numbered as in `_best_path`."""
    cut = np.ones(start[-1], bool)
    left = np.flatnonzero(end - begin > 1)
    left = left[np.lexsort((end[left], begin[left], -score[left], word[left]))]
    word, low, high = word[left], start[word[left]] + begin[left], start[word[left]] + end[left]
    while len(word):
        # Only a piece whose ends are cuts can ever be joined; cuts never come back.
        open_ = cut[low] & cut[high]
        word, low, high = word[open_], low[open_], high[open_]
        rank = np.cumsum(cut)
        fits = np.flatnonzero(rank[high] - rank[low] == 2)
        fits = fits[np.r_[True, word[fits][1:] != word[fits][:-1]]] if len(fits) else fits
        cut[np.flatnonzero(cut)[rank[low[fits]]]] = False  # the one cut between the two neighbours
        going = np.zeros(len(start), bool)
        going[word[fits]] = True
        word, low, high = (a[going[word]] for a in (word, low, high))
    return cut


def _fold(edges: pa.Table, of_word: list[str], table: PieceTable) -> pa.RecordBatch:
    """The words of whole lattices with the ids of their pieces."""
    no, begin, end, ids = (edges[c].combine_chunks().fill_null(-1).to_numpy() for c in EDGE[:4])
    score = edges["score"].combine_chunks().to_numpy(zero_copy_only=False)
    if np.any(no[1:] < no[:-1]):
        raise ValueError("the edges of a word must follow each other")
    heads = np.flatnonzero(np.r_[True, no[1:] != no[:-1]])
    word = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(no)]))
    start = np.r_[0, np.cumsum(np.maximum.reduceat(end, heads) + 1)]
    cut = (_merged if table.merges else _best_path)(word, begin, end, score, start)
    rank = np.cumsum(cut)
    low, high = start[word] + begin, start[word] + end
    chosen = np.flatnonzero(cut[low] & cut[high] & (rank[high] - rank[low] == 1))
    chosen = chosen[np.argsort(low[chosen], kind="stable")]
    chosen = chosen[np.r_[True, low[chosen][1:] != low[chosen][:-1]]]
    rows = edges.select(of_word).take(pa.array(heads))
    values, sizes = ids[chosen], np.ones(len(chosen), np.int64)
    raw = np.flatnonzero(values < 0)
    if len(raw):
        texts = rows["word"].to_pylist()
        codes = [texts[word[e]][begin[e]:end[e]].encode() for e in chosen[raw]]
        sizes[raw] = [len(code) for code in codes]
        at = np.repeat(values < 0, sizes)
        values = np.repeat(values, sizes)
        values[at] = np.frombuffer(b"".join(codes), np.uint8).astype(values.dtype) + table.first_byte
    counts = np.bincount(word[chosen], weights=sizes, minlength=len(heads)).astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(values, pa.int32()))
    return pa.RecordBatch.from_arrays([*(rows[c].combine_chunks() for c in of_word), lists], [*of_word, "ids"])


def segmented(lattices: DataFrame, table: PieceTable) -> DataFrame:
    """The words with ids: the lattice folded to the ids of the word's pieces; characters without piece become bytes.

    Some EDGES edges are folded at once, whole words each.
    """
    of_word = [c for c in lattices.columns if c not in EDGE]
    fields = [*(f for f in lattices.schema.fields if f.name in of_word), StructField("ids", ArrayType(IntegerType()))]
    rule = replace(table, pieces=[], texts=[])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= EDGES:
                edges = pa.Table.from_batches(held)
                no = edges["_no"].to_numpy()
                whole = int(np.searchsorted(no, no[-1]))  # the last word may go on in the next batch
                if whole:
                    yield _fold(edges.slice(0, whole), of_word, rule)
                held = edges.slice(whole).to_batches()
        if sum(b.num_rows for b in held):
            yield _fold(pa.Table.from_batches(held), of_word, rule)

    return lattices.mapInArrow(fold, StructType(fields))


def segment(word: str, table: dict[str, tuple[int, float]], first_byte: int) -> list[int]:
    """The merge rule on one word with a heap, for words too long to fold; the same ids as the fold."""
    parts = list(word)
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            joined = parts[i] + parts[after[i]]
            if joined in table:
                heapq.heappush(heap, (-table[joined][1], i, joined))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, joined = heapq.heappop(heap)
        if parts[i] and after[i] < n and parts[i] + parts[after[i]] == joined:
            gone = after[i]
            parts[i], parts[gone], after[i] = joined, "", after[gone]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
    out: list[int] = []
    for part in parts:
        if part in table:
            out.append(table[part][0])
        else:
            out += [first_byte + b for b in part.encode()]
    return out


def best_segment(word: str, table: dict[str, tuple[int, float]], first_byte: int, longest: int) -> list[int]:
    """The best path of one word, for words too long to fold; the same ids as the fold, in time linear in the word."""
    totals, back = [0.0], [0]
    for end in range(1, len(word) + 1):
        best, start = float("-inf"), 0
        for begin in range(max(0, end - max(1, longest)), end):
            known = table.get(word[begin:end])
            if known is None and end - begin > 1:
                continue
            total = totals[begin] + (-1e6 if known is None else known[1])
            if total >= best:  # of equal sums the shortest last piece, like the fold
                best, start = total, begin
        totals.append(best)
        back.append(start)
    parts, end = [], len(word)
    while end > 0:
        parts.append(word[back[end]:end])
        end = back[end]
    out: list[int] = []
    for part in reversed(parts):
        if part in table:
            out.append(table[part][0])
        else:
            out += [first_byte + b for b in part.encode()]
    return out


def asked_words(rows: DataFrame) -> DataFrame:
    """(word, part, blocks): the distinct words of `rows` (block, body), each with the blocks that ask for it.

    `blocks` has one bit for each of the SET blocks of a part, so a word's blocks are combined where the texts are read
    and the word crosses the network once per part, however many of its blocks ask for it.
    """
    words = rows.select("block", F.explode(words_of("body")).alias("word")).where(F.length("word") <= LONG)
    return words.groupBy("word", F.floor(F.col("block") / SET).cast("int").alias("part")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, block % {SET})")).alias("blocks"))


def encode(docs: DataFrame, table: PieceTable, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, ids, as the model's own library gives them for the whole text, and text_sha256.

    Distinct words are segmented once per SET blocks, a million documents. On the way back, documents meet the ids of their words in
    blocks of about BLOCK_DOCS documents: a task holds the words of one block and streams its documents.

    Null and empty texts have no ids. Rows that share an id are encoded one by one; rows without id are, too. Further
    columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    blocks = max(1, -(-docs.count() // BLOCK_DOCS))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    known = spark.createDataFrame(table.pieces, "piece string, id int, score double")
    dictionary = segmented(lattice(asked_words(rows), known, table.longest), table)
    asking = F.filter(F.sequence(F.lit(0), F.lit(SET - 1)), lambda i: F.getbit("blocks", i) == 1)
    answers = (dictionary.select("word", "ids", "part", F.explode(asking).alias("bit"))
               .select((F.col("part") * SET + F.col("bit")).alias("block"), F.lit(None).cast("long").alias("doc_id"),
                       F.col("word").alias("body"), "ids"))
    both = answers.union(rows.select("block", "doc_id", "body", F.lit(None).cast("array<int>")))
    scores = {piece: (i, score) for piece, i, score in table.pieces}
    merges, first_byte, longest = table.merges, table.first_byte, table.longest

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words = None, {}
        for batch in batches:
            out_ids, out, digests = [], [], []
            for key, doc, body, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != block:
                    block, words = key, {}
                if ids is not None:
                    words[body] = ids
                    continue
                found: list[int] = []
                for word in _split(body):
                    own = words.get(word)
                    if own is None:
                        own = (segment(word, scores, first_byte) if merges
                               else best_segment(word, scores, first_byte, longest))
                    found += own
                out_ids.append(doc)
                out.append(found)
                digests.append(hashlib.sha256(body.encode()).hexdigest())
            if out_ids:
                yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out, pa.list_(pa.int32())),
                                                  pa.array(digests, pa.string())], ["doc_id", "ids", "text_sha256"])

    return (both.repartition("block").sortWithinPartitions("block", F.col("ids").isNull())
            .mapInArrow(assemble, "doc_id long, ids array<int>, text_sha256 string"))


def _split(text: str) -> list[str]:
    """The words of a text, like words_of."""
    if not text:
        return []
    marked = SPACE + text.replace(" ", SPACE)
    out, at = [], 0
    cut = marked.find(SPACE, 1)
    while cut > 0:
        if marked[cut - 1] != SPACE:
            out.append(marked[at:cut])
            at = cut
        cut = marked.find(SPACE, cut + 1)
    out.append(marked[at:])
    return out


def decoded(ids: Column, table: PieceTable) -> Column:
    """The text of an array of ids: the pieces' bytes one after another, without the leading space."""
    texts = F.split(F.lit(",".join(table.texts)), ",")
    code = F.array_join(F.transform(ids, lambda i: F.element_at(texts, i + 1)), "")
    return F.substring(F.decode(F.unhex(code), "utf-8"), 2, 2147483647)
