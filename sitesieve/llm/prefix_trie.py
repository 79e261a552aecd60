"""Trie of the conversations that begin alike, from ternary search trees over dictionary-encoded turns.

A turn is its role and text; each distinct turn has a number from a dictionary. A conversation is the sequence of its numbers, cut into segments
of ``SEGMENT`` turns. The segments of a level are sorted by the node before them (``base``: its smallest member and a hash of the way to it), their numbers and the conversation, in range
partitions, and each partition is read in shards of about ``SHARD`` turns, so neither a long conversation nor a third of all conversations
being equal makes a task grow. A shard builds one ternary search tree for each base, its distinct sequences inserted median first, and walks its nodes from
the last to the first: children come after their parents, so members, leaves and savings add up without recursion.

Only nodes on the way to the first or last sequence of a shard can occur in another one: these boundary nodes carry a key (a chain of
SHA-256 over their turns) and are merged by it; everything else is final. What lies beyond a segment is a tree of its own on the next level, whose sums
are the weight of one of the segments that lead to it; only bases that at least two conversations share need one, what a single
conversation has to itself is a chain. Levels are as many as the longest *shared* beginning has segments.

A node is told by its smallest member and its depth. Rows without a conversation id belong to no conversation and are left out; null role or text is
empty; turns are ordered by ``turn`` (null first), equal ones by the hash of what they say; rows that repeat are turns that repeat. An empty table has no nodes, not even a root.
The identifiers of the conversations that end in one node are hashed in one pass, as SHA-256 needs, in pieces that shards have joined;
this is the one step that reads a group of equal conversations in order, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import numbered
from ..session import stage
from .common import text_of

#: turns of a conversation in one row
SEGMENT = 128
#: turns that a task holds as a tree at a time
SHARD = 1 << 16

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: in the contract of the query: turns taken over from the conversation that opens the hundred are fewer than this
HEAD = 6

PARTS = (
    "shard long, key string, parent_key string, conv_id long, parent_conv_id long, depth long, n long, children long, leaves long, saved long, "
    "chars long, ends_sha256 string, piece string, above array<string>"
)
_PART_TYPES = pa.schema(
    [(c, pa.int64() if c in ("shard", "conv_id", "parent_conv_id", "depth", "n", "children", "leaves", "saved", "chars") else pa.string())
     for c in (x.split()[0] for x in PARTS.split(", "))][:-1] + [("above", pa.list_(pa.string()))]
)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0 on, without gaps), digest, chars (code points of the text) of every turn."""
    role, text = text_of("role"), text_of("text")
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.sha2(said, 256)).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    placed = numbered(rows, ["conv_id"], "turn", "pos", tie=["digest", "chars"])
    return stage(placed.select("conv_id", (F.col("pos") - 1).alias("pos"), "digest", "chars"), "turns")


def lengths(placed: DataFrame) -> DataFrame:
    """conv_id, total (turns) of every conversation."""
    return placed.groupBy("conv_id").agg((F.max("pos") + 1).alias("total"))


def with_shared_heads(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations with their first ``crc32(conv_id) % 6`` turns taken from the one that opens their hundred, as turns and lengths.

    A conversation whose opener is absent just loses these turns, and may be left without any.
    """
    share = (F.crc32(F.col("conv_id").cast("string")) % HEAD).cast("long")
    opener = F.col("conv_id") - F.col("conv_id") % 100
    own_lengths = stage(lengths(placed).withColumnRenamed("total", "own"), "lengths")
    there = own_lengths.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("opener"), F.col("own").alias("there"))
    members = (
        own_lengths.withColumns({"opener": opener, "share": share})
        .join(there, "opener", "left")
        .withColumn("taken", F.least("share", F.coalesce("there", F.lit(0))))
        .withColumn("total", F.col("taken") + F.greatest(F.col("own") - F.col("share"), F.lit(0)))
    )
    members = stage(members.select("conv_id", "opener", "share", "taken", "total"), "members")
    own = placed.join(members, "conv_id").filter("pos >= share").select("conv_id", (F.col("pos") - F.col("share") + F.col("taken")).alias("pos"), "digest", "chars")
    first = placed.filter(f"conv_id % 100 = 0 AND pos < {HEAD - 1}").withColumnRenamed("conv_id", "opener")
    heads = members.filter("taken > 0").join(first, "opener").filter("pos < taken").select("conv_id", "pos", "digest", "chars")
    return own.unionByName(heads), members.select("conv_id", "total")


def segments(placed: DataFrame, members: DataFrame, size: int = SEGMENT) -> DataFrame:
    """conv_id, level, ids, chars, more (whether the conversation goes on) of every segment; a conversation without turns has an empty one."""
    dictionary = stage(placed.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")
    numbers = placed.join(dictionary, "digest").select("conv_id", F.expr(f"pos div {size}").alias("level"), F.struct("pos", "id", "chars").alias("turn"))
    rows = numbers.groupBy("conv_id", "level").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    rows = rows.join(members, "conv_id").select(
        "conv_id", "level", F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars"), (F.col("total") > (F.col("level") + 1) * size).alias("more")
    )
    none = F.array().cast("array<long>")
    bare = members.filter("total = 0").select("conv_id", F.lit(0).cast("long").alias("level"), none.alias("ids"), none.alias("chars"), F.lit(False).alias("more"))
    return stage(rows.unionByName(bare), "segments")


def _median_first(n: int) -> Iterator[int]:
    ranges = [(0, n)]
    while ranges:
        low, high = ranges.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            ranges += [(middle + 1, high), (low, middle)]


class _Trees:
    """Ternary search trees of one shard, one for each base; nodes are places in lists."""

    def __init__(self) -> None:
        self.symbol, self.low, self.high, self.below, self.up, self.depth, self.chars = [], [], [], [], [], [], []
        self.n, self.conv, self.children, self.leaves, self.saved = [], [], [], [], []
        self.ends: dict[int, list[int]] = {}

    def node(self, symbol: int | None, up: int, chars: int) -> int:
        for column, value in (
            (self.symbol, symbol), (self.low, -1), (self.high, -1), (self.below, -1), (self.up, up), (self.chars, chars),
            (self.depth, self.depth[up] + 1 if up >= 0 else 0), (self.n, 0), (self.conv, None), (self.children, 0), (self.leaves, 0), (self.saved, 0),
        ):
            column.append(value)
        return len(self.symbol) - 1

    def insert(self, root: int, ids: list[int], chars: list[int]) -> list[int]:
        """The nodes on the way of a sequence, made where missing; the root first."""
        symbol, low, high = self.symbol, self.low, self.high
        at, way = root, [root]
        for i, wanted in enumerate(ids):
            before, side, x = at, self.below, self.below[at]
            while x >= 0 and symbol[x] != wanted:
                before, side = x, low if wanted < symbol[x] else high
                x = side[x]
            if x < 0:
                x = self.node(wanted, at, chars[i])
                side[before] = x
            at = x
            way.append(x)
        return way

    def add(self, at: int, group: list[tuple]) -> None:
        """Members whose segment ends in a node, with the weights of what lies beyond."""
        self.n[at] += len(group)
        self.conv[at] = min(row[3] for row in group)
        self.ends[at] = [row[3] for row in group if not row[4]]
        for row in group:
            self.saved[at] += row[5]
            self.leaves[at] += row[6]
            self.children[at] += row[7]

    def walk(self, boundary: dict[int, str]) -> None:
        """Sums of every node over its subtree, last node first. Boundary nodes are left out of them: they are complete only after merging."""
        for x in range(len(self.symbol) - 1, -1, -1):
            up = self.up[x]
            if x not in boundary:
                self.leaves[x] += self.children[x] == 0
                self.saved[x] += (self.n[x] - 1) * self.chars[x]
            if up >= 0:
                self.children[up] += x not in boundary
                self.n[up] += self.n[x]
                self.leaves[up] += self.leaves[x]
                self.saved[up] += self.saved[x]
                self.conv[up] = self.conv[x] if self.conv[up] is None else min(self.conv[up], self.conv[x])


def _joined(convs: Iterable[int]) -> str:
    return ",".join(map(str, convs))


def shard_nodes(shard: int, rows: list[tuple]) -> list[tuple]:
    """Nodes of a shard from its sorted rows (base, ids, chars, conv_id, more, saved, leaves, children)."""
    groups: list[list[tuple]] = []
    for row in rows:
        if groups and groups[-1][0][:2] == row[:2]:
            groups[-1].append(row)
        else:
            groups.append([row])
    trees, ways, start, hangs_from = _Trees(), {}, 0, {}
    while start < len(groups):
        base, end = groups[start][0][0], start
        while end < len(groups) and groups[end][0][0] == base:
            end += 1
        root = trees.node(None, -1, 0)
        if base:
            hangs_from[root] = int(base.partition("|")[0])
        for i in _median_first(end - start):
            group = groups[start + i]
            way = trees.insert(root, group[0][1], group[0][2])
            trees.add(way[-1], group)
            if start + i in (0, len(groups) - 1):
                ways[start + i] = way
        start = end
    boundary: dict[int, str] = {}
    above: dict[int, list[str]] = {}
    for place, way in ways.items():
        key, keys = groups[place][0][0], []
        for x in way:
            if x != way[0]:
                key = hashlib.sha256(f"{key}|{trees.symbol[x]}".encode()).hexdigest()
            keys.append(key)
            boundary[x], above[x] = key, keys[:]
    trees.walk(boundary)
    out = []
    for x in range(len(trees.symbol)):
        up, key, convs = trees.up[x], boundary.get(x), trees.ends.get(x)
        ends = piece = None
        if key is None:
            ends = hashlib.sha256(_joined(convs).encode()).hexdigest() if convs else EMPTY_SHA
        elif convs:
            piece = _joined(convs)
        parent_conv = trees.conv[up] if up >= 0 and up not in boundary else None
        if up in hangs_from:
            parent_conv = hangs_from[up]
        out.append(
            (shard, key, boundary.get(up), trees.conv[x], parent_conv, trees.depth[x], trees.n[x], trees.children[x], trees.leaves[x],
             trees.saved[x], trees.chars[x], ends, piece, above.get(x))
        )
    return out


def _parts(level: DataFrame, shard: int) -> DataFrame:
    """Nodes of all shards of a level; shards are numbered in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*shard_nodes(number, held)), _PART_TYPES.types)], schema=_PART_TYPES)

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                held.append(row)
                size += len(row[1]) + 1
                if size >= shard:
                    yield closed()
                    number, held, size = number + 1, [], 0
        if held:
            yield closed()

    order = ("base", "ids", "conv_id")
    rows = level.select("base", "ids", "chars", "conv_id", "more", "saved", "leaves", "children")
    return stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, PARTS), "parts")


def _hashed_pieces(parts: DataFrame) -> DataFrame:
    """key, ends_sha256 of the boundary nodes in which conversations end: pieces in the order of their shards, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key = digest = None
        for batch in batches:
            done = []
            for key, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist()):
                if key == open_key:
                    digest.update(b"," + piece.encode())
                else:
                    if open_key is not None:
                        done.append((open_key, digest.hexdigest()))
                    open_key, digest = key, hashlib.sha256(piece.encode())
            if done:
                yield pa.RecordBatch.from_pylist([{"key": k, "ends": e} for k, e in done], pa.schema([("key", pa.string()), ("ends", pa.string())]))
        if open_key is not None:
            yield pa.RecordBatch.from_pylist([{"key": open_key, "ends": digest.hexdigest()}], pa.schema([("key", pa.string()), ("ends", pa.string())]))

    pieces = parts.filter("piece IS NOT NULL").select("key", "shard", "piece")
    return pieces.repartition("key").sortWithinPartitions("key", "shard").mapInArrow(run, "key string, ends string")


def _level_nodes(level: DataFrame, shard: int) -> DataFrame:
    """conv_id, depth (within the level), parent_conv_id, n, children, leaves, saved, ends_sha256 of the nodes of a level, roots included."""
    parts = _parts(level, shard)
    split = parts.filter("key IS NOT NULL")
    merged = stage(
        split.groupBy("key").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"),
            F.sum("saved").alias("saved"), F.max("chars").alias("chars"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"),
            F.max("parent_conv_id").alias("hangs_from"), F.first("above").alias("above"),
        ),
        "merged",
    )
    more = merged.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    merged = merged.join(more, "key", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0)))
    merged = merged.withColumns({"own": (F.col("n") - 1) * F.col("chars"), "leaf": (F.col("children") == 0).cast("long")})
    # what boundary nodes add to themselves and to the boundary nodes above
    adds = merged.select(F.explode("above").alias("key"), "own", "leaf").groupBy("key").agg(F.sum("own").alias("add_saved"), F.sum("leaf").alias("add_leaves"))
    parent = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    columns = ("conv_id", "depth", "parent_conv_id", "n", "children", "leaves", "saved", "ends_sha256")
    whole = (
        merged.join(adds, "key")
        .join(parent, "parent_key", "left")
        .join(_hashed_pieces(parts), "key", "left")
        .withColumns({
            "parent_conv_id": F.coalesce("hangs_from", "parent_conv_id"),
            "saved": F.col("saved") + F.col("add_saved"),
            "leaves": F.col("leaves") + F.col("add_leaves"),
            "ends_sha256": F.coalesce("ends", F.lit(EMPTY_SHA)),
        })
        .select(*columns)
    )
    # keyed by the shard too, so that the many children of one boundary node are spread
    known = split.select("shard", F.col("key").alias("parent_key")).join(parent, "parent_key").withColumnRenamed("parent_conv_id", "known")
    rest = (
        parts.filter("key IS NULL")
        .join(known, ["shard", "parent_key"], "left")
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "known"))
        .select(*columns)
    )
    return whole.unionByName(rest)


def nodes(placed: DataFrame, members: DataFrame, segment: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """Every node of the trie of the conversations ``members`` (conv_id, total) with the turns ``placed`` (conv_id, pos, digest, chars).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    cut = segments(placed, members, segment)
    zero = F.lit(0).cast("long")
    levels, alone = [cut.filter("level = 0").withColumn("base", F.lit(""))], []
    while True:
        beyond = F.sha2(F.concat("base", F.lit("|"), F.array_join(F.col("ids").cast("array<string>"), ",")), 256)
        reach = stage(levels[-1].filter(F.size("ids") == segment).select("conv_id", "level", "more", beyond.alias("node")), "reach")
        if reach.filter("more").isEmpty():
            break
        ends = reach.groupBy("node").agg(F.min("conv_id").alias("owner"), F.count_if("more").alias("sharing"))
        following = stage(reach.filter("more").join(ends, "node"), "following")
        alone.append(following.filter("sharing = 1").select("conv_id", "owner", F.col("level").alias("since")))
        onward = following.filter("sharing > 1")
        if onward.isEmpty():
            break
        onward = onward.select("conv_id", (F.col("level") + 1).alias("level"), F.concat(F.col("owner").cast("string"), F.lit("|"), "node").alias("base"))
        levels.append(stage(cut.join(onward, ["conv_id", "level"]), "level"))
    found, roots = [], None
    for number in range(len(levels) - 1, -1, -1):
        weights = roots
        if number < len(alone):
            single = alone[number].select("conv_id", zero.alias("saved"), F.lit(1).cast("long").alias("leaves"), F.lit(1).cast("long").alias("children"))
            weights = single if weights is None else weights.unionByName(single)
        level = levels[number]
        if weights is None:
            level = level.withColumns({"saved": zero, "leaves": zero, "children": zero})
        else:
            level = level.join(weights, "conv_id", "left").na.fill(0, ["saved", "leaves", "children"])
        made = stage(_level_nodes(level, shard), "nodes")
        roots = made.filter("depth = 0").select("conv_id", "saved", "leaves", "children")
        kept = made if number == 0 else made.filter("depth > 0")
        found.append(kept.withColumn("depth", F.col("depth") + number * segment))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    for single in alone:
        chain = cut.join(single, "conv_id").filter("level > since")
        at = chain.select("conv_id", "owner", "since", "more", F.size("ids").alias("size"), "level", F.explode(F.sequence(F.lit(1), F.size("ids"))).alias("place"))
        last = ~F.col("more") & (F.col("place") == F.col("size"))
        result = result.unionByName(
            at.select(
                "conv_id",
                (F.col("level") * segment + F.col("place")).alias("depth"),
                F.when((F.col("level") == F.col("since") + 1) & (F.col("place") == 1), F.col("owner")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
                F.lit(1).cast("long").alias("n"),
                F.when(last, 0).otherwise(1).cast("long").alias("children"),
                F.lit(1).cast("long").alias("leaves"),
                zero.alias("saved"),
                F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY_SHA)).alias("ends_sha256"),
            )
        )
    return result.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), "ends_sha256",
    )


def conversation_trie(conversations: DataFrame, segment: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """Every node of the trie of ``conversations`` (conv_id, turn, role, text) as they are."""
    placed = turns(conversations)
    return nodes(placed, lengths(placed), segment, shard)
