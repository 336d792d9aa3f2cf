"""Prefix trie of conversations: sorted shards between sampled splitters, and a skeleton of the splitters' own nodes.

A turn is a token of 20 bytes (digest of role and text, length of the text), a conversation the bytes of its tokens.
In byte order the members of a node are neighbours, so a shard of the range partition finishes every node of its own.
Only a prefix of a splitter can have members in several shards; these few nodes form the skeleton.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.session import stored

TOKEN = 20
SHARED_TURNS = 6  # a conversation takes fewer turns than this from the first of its hundred
FAMILY = 100
SPLITTER_TURNS = 128  # a splitter holds so many turns of a conversation at most, which bounds what is broadcast
SAMPLES_PER_SHARD = 16
TURNS_PER_SHARD = 250_000
CHUNK = 1 << 16  # bytes of ids that are sent on at once
ROWS = 5_000  # rows of an Arrow batch
NO_IDS = hashlib.sha256(b"").hexdigest()
LOCAL, PARTIAL, ENDS = 0, 1, 2
PARTS = ("kind int, node int, parent_node int, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, ends_sha256 string, shard int, chunk_no long, chunk binary")
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# ---- conversations as paths ---------------------------------------------------------------------------------------------

def turn_tokens(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, token) of every row with a conversation; null role or text is empty."""
    role, text = (F.coalesce(turns[c], F.lit("")) for c in ("role", "text"))
    named = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    return turns.where(turns["conv_id"].isNotNull()).select(
        turns["conv_id"].alias("conv_id"), turns["turn"].alias("turn"),
        F.unhex(F.concat(named, F.lpad(F.hex(F.length(text)), 8, F.lit("0")))).alias("token"))


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, tokens): the first h turns of the family's first conversation, then the own turns after the first h.

    The family of c starts at c - c % 100, h is crc32 of the decimal id, modulo 6. Turns are in order of `turn` (null
    first), equal ones in order of their digest. A family's rows lie in one task of a shuffle, so the first turns meet
    the other conversations there; what moves is 20 bytes a turn.
    """
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    tokens = turn_tokens(turns).withColumn("family", family).repartition("family")
    own = tokens.groupBy("family", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "token"))).alias("own"))
    own = own.select("family", "conv_id", F.transform("own", lambda x: x["token"]).alias("own"))
    heads = own.where("conv_id = family").select("family", F.slice("own", 1, SHARED_TURNS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS).cast("int")
    none = F.array().cast("array<binary>")
    rest = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    return own.join(heads, "family", "left").select(
        "conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), rest).alias("tokens"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of tokens to bytes, without copying them one by one."""
    for batch in batches:
        if batch.num_rows:
            paths = [b"".join(t) for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(paths, pa.binary())], names=["conv_id", "path"])


# ---- splitters and skeleton ---------------------------------------------------------------------------------------------

@dataclass
class Skeleton:
    """Splitters (path, conv_id) in order, and the trie of their paths: node 0 is the root."""

    splitters: list[tuple[bytes, float]]
    child: dict[tuple[int, bytes], int] = field(default_factory=dict)
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    chars: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        for path, _ in self.splitters:
            node = 0
            for at in range(0, len(path), TOKEN):
                token = path[at:at + TOKEN]
                if (node, token) not in self.child:
                    self.child[node, token] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                    self.chars.append(chars_of(token))
                node = self.child[node, token]

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))


def chars_of(token: bytes) -> int:
    return int.from_bytes(token[16:], "big")


def sampled_skeleton(paths: DataFrame, shards: int | None = None) -> Skeleton:
    """Splitters at even steps of a sample's turns; the sample is chosen by hashed id, so a repeated job draws it again.

    A splitter is a path and an id: copies of one conversation, however many, are split by id. A path of more than
    SPLITTER_TURNS turns is cut and goes without id, so splitters and skeleton stay below shards * SPLITTER_TURNS nodes.
    """
    spark = paths.sparkSession
    limit = SPLITTER_TURNS * TOKEN
    total = paths.agg(F.count("*").alias("n"), F.sum(F.octet_length("path")).alias("bytes")).first()
    if not total["n"]:
        return Skeleton([])
    turns = total["bytes"] // TOKEN + total["n"]
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // TURNS_PER_SHARD))
    share = min(1.0, SAMPLES_PER_SHARD * shards / total["n"])
    drawn = paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = sorted(
        (bytes(r["head"]), float("-inf") if r["size"] > limit else r["conv_id"], r["size"] // TOKEN + 1)
        for r in drawn.select("conv_id", F.substring("path", 1, limit).alias("head"),
                              F.octet_length("path").alias("size")).collect())
    if not sample:
        return Skeleton([])
    reached = np.cumsum([w for *_, w in sample])
    cuts = np.searchsorted(reached, reached[-1] * np.arange(1, shards) / shards)
    return Skeleton(sorted({sample[i][:2] for i in cuts}))


# ---- one shard ----------------------------------------------------------------------------------------------------------

def common_tokens(a: bytes, b: bytes) -> int:
    """How many tokens two paths share from the start."""
    low, high = 0, min(len(a), len(b)) // TOKEN
    if a[:high * TOKEN] == b[:high * TOKEN]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * TOKEN:mid * TOKEN] == b[low * TOKEN:mid * TOKEN]:
            low = mid
        else:
            high = mid
    return low


class ShardWalk:
    """Walks the sorted paths of a shard and gives out every node when its last member is over.

    Open nodes form a stack. A local node waits for its parent's smallest member in `waiting`, unless that parent is of
    the skeleton. A skeleton node gives out what this shard adds to it: members, local children, and the leaves and
    savings of local nodes below; and the ids that end at it, in chunks.
    """

    def __init__(self, skeleton: Skeleton) -> None:
        self.skeleton, self.out = skeleton, []
        self.start(0)

    def start(self, shard: int) -> None:
        self.shard, self.path, self.chunk_no = shard, b"", 0
        self.node, self.chars, self.n, self.least = [], [], [], []
        self.children, self.leaves, self.saved, self.ends = [], [], [], []
        self.waiting: dict[int, list[tuple]] = defaultdict(list)
        self.digest, self.chunk, self.chunk_size = None, [], 0

    def push(self, node: int, chars: int) -> None:
        self.settle()
        for column, value in ((self.node, node), (self.chars, chars), (self.n, 0), (self.least, None), (self.children, 0),
                              (self.leaves, 0), (self.saved, 0), (self.ends, None)):
            column.append(value)

    def settle(self) -> None:
        """No further path ends at the top node."""
        if self.digest is not None:
            self.ends[-1], self.digest = self.digest.hexdigest(), None
        self.flush()

    def flush(self) -> None:
        if self.chunk:
            self.out.append((ENDS, self.node[-1], *[None] * 9, self.shard, self.chunk_no, b",".join(self.chunk)))
            self.chunk, self.chunk_size, self.chunk_no = [], 0, self.chunk_no + 1

    def add(self, path: bytes, conv_id: int) -> None:
        if not self.node:
            self.push(0, 0)
        if path != self.path:
            keep = common_tokens(self.path, path)
            while len(self.node) > keep + 1:
                self.pop()
            for at in range(keep * TOKEN, len(path), TOKEN):
                token = path[at:at + TOKEN]
                above = self.node[-1]
                self.push(self.skeleton.child.get((above, token), -1) if above >= 0 else -1, chars_of(token))
            self.path = path
        self.n[-1] += 1
        if self.least[-1] is None or conv_id < self.least[-1]:
            self.least[-1] = conv_id
        name = b"%d" % conv_id
        if self.node[-1] >= 0:
            self.chunk.append(name)
            self.chunk_size += len(name) + 1
            if self.chunk_size >= CHUNK:
                self.flush()
        elif self.digest is None:
            self.digest = hashlib.sha256(name)
        else:
            self.digest.update(b"," + name)

    def pop(self) -> None:
        self.settle()
        depth = len(self.node) - 1
        node, chars, n, least, children, leaves, saved, ends = (
            c.pop() for c in (self.node, self.chars, self.n, self.least, self.children, self.leaves, self.saved, self.ends))
        if node >= 0:
            self.out.append((PARTIAL, node, None, least, depth, None, n, children, leaves, saved, None, None, None, None))
        else:
            leaves = leaves if children else 1
            saved += (n - 1) * chars
            for row in self.waiting.pop(depth + 1, ()):
                self.out.append((LOCAL, None, None, *row[:2], least, *row[2:], None, None, None))
            row = (least, depth, n, children, leaves, saved, ends or NO_IDS)
            if self.node[-1] >= 0:
                self.out.append((LOCAL, None, self.node[-1], least, depth, None, *row[2:], None, None, None))
            else:
                self.waiting[depth].append(row)
        if self.node:
            self.n[-1] += n
            self.least[-1] = least if self.least[-1] is None else min(self.least[-1], least)
            self.children[-1] += node < 0
            self.leaves[-1] += leaves
            self.saved[-1] += saved

    def close(self) -> None:
        while self.node:
            self.pop()


# ---- the trie -----------------------------------------------------------------------------------------------------------

def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every node's chunks, which come in order: one digest is held at a time."""
    node, digest = None, None
    nodes, found = [], []
    for batch in batches:
        for own, chunk in zip(batch.column("node").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
            if own != node:
                if digest is not None:
                    nodes.append(node)
                    found.append(digest.hexdigest())
                node, digest = own, hashlib.sha256(chunk)
            else:
                digest.update(b"," + chunk)
    if digest is not None:
        nodes.append(node)
        found.append(digest.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int32()), pa.array(found, pa.string())], names=["node", "ends_sha256"])


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of `paths` (conv_id, tokens); ids must be distinct. Columns: see `TRIE`.

    conv_id is the node's smallest member, parent_conv_id the parent's (root: null). Rows are dealt to the shards
    between the splitters and sorted there, so that memory holds one path and the nodes open or waiting on it. Skeleton
    nodes add up what the shards give for them; their own leaves and savings are then added to the nodes above, by
    walking the broadcast trie upwards. A skeleton node's ids run through one task as text, since SHA-256 has no parts.
    Of no paths there is no trie: no rows, not even a root.
    """
    schema = pa.schema([(f.name, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[
        f.dataType.simpleString()]) for f in paths.sparkSession.createDataFrame([], PARTS).schema])
    rows = stored(paths.mapInArrow(_joined, "conv_id long, path binary"), "paths")
    skeleton = sampled_skeleton(rows, shards)

    def placed(batches):
        for batch in batches:
            own = [skeleton.shard(p, c) for p, c in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *batch.columns], names=["shard", "conv_id", "path"])

    def finished(batches):
        walk, shard = ShardWalk(skeleton), None
        for batch in batches:
            for own, conv_id, path in zip(*(batch.column(c).to_pylist() for c in ("shard", "conv_id", "path")), strict=True):
                if own != shard:
                    walk.close()
                    walk.start(own)
                    shard = own
                walk.add(path, conv_id)
                if len(walk.out) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*walk.out, strict=True), schema, strict=True)], schema=schema)
                    walk.out.clear()
        walk.close()
        for at in range(0, len(walk.out), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*walk.out[at:at + ROWS], strict=True), schema, strict=True)], schema=schema)

    dealt = (rows.mapInArrow(placed, "shard int, conv_id long, path binary")
             .repartition(len(skeleton.splitters) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id"))
    parts = stored(dealt.mapInArrow(finished, PARTS), "trie_parts")
    spine = skeleton_nodes(parts, skeleton)
    above = spine.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("above_conv_id"))
    local = parts.where(F.col("kind") == LOCAL).join(F.broadcast(above), "parent_node", "left")  # shards * SPLITTER_TURNS rows
    local = local.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_conv_id"))
    return local.select(*TRIE).unionByName(spine.select(*TRIE))


def skeleton_nodes(parts: DataFrame, skeleton: Skeleton) -> DataFrame:
    """The skeleton's nodes (node and the columns of `TRIE`), reduced from what the shards gave."""
    spark = parts.sparkSession
    sums = parts.where(F.col("kind") == PARTIAL).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    shape = spark.createDataFrame(pa.table({
        "node": pa.array(range(len(skeleton.parent)), pa.int32()), "parent": pa.array(skeleton.parent, pa.int32()),
        "depth": pa.array(skeleton.depth, pa.int32()), "chars": pa.array(skeleton.chars, pa.int64())}))
    below = shape.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("skeleton_children"))
    nodes = stored(sums.join(shape, "node").join(below, "node", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("skeleton_children", F.lit(0))), "skeleton")
    own = nodes.select("node", (F.col("n_children") == 0).cast("long").alias("leaf"),
                       ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    parent = skeleton.parent

    def raised(batches):
        for batch in batches:
            found: dict[int, list[int]] = defaultdict(lambda: [0, 0])
            for node, leaf, saved in zip(*(batch.column(c).to_pylist() for c in ("node", "leaf", "saved")), strict=True):
                while node >= 0:
                    at = found[node]
                    at[0] += leaf
                    at[1] += saved
                    node = parent[node]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *(
                pa.array([v[i] for v in found.values()], pa.int64()) for i in (0, 1))], names=["node", "leaf", "saved"])

    raised_sums = (own.mapInArrow(raised, "node int, leaf long, saved long").groupBy("node")
                   .agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")))
    ends = (parts.where(F.col("kind") == ENDS).select("node", "shard", "chunk_no", "chunk").repartition("node")
            .sortWithinPartitions("node", "shard", "chunk_no").mapInArrow(_hashed_ends, "node int, ends_sha256 string"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(raised_sums, "node").join(ends, "node", "left").join(parents, "parent", "left").select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """The prefix trie of rebuilt conversations (see `rebuilt_paths`, `prefix_trie`), from rows (conv_id, turn, role, text).

    Rows without conv_id belong to no conversation. Null role or text is empty, a null turn comes first, equal turns of
    one conversation are in order of their digest, and repeated rows are turns of their own. A very long text is a token
    like any other; a very long conversation is one value of 20 bytes a turn. Further columns are ignored; no rows give
    no rows.
    """
    return prefix_trie(rebuilt_paths(turns), shards)
