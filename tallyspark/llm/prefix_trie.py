"""Prefix trie of conversations by padded turn-id matrices (dealt operator 12).

A conversation is a sequence of turn ids, 128 bits of a hash of (role, text);
texts are read once and not shuffled.  Sequences are range-partitioned by (ids,
conversation), so that the members of a node stand side by side.  A shard deals
its ids small numbers in their order and lays them out as a matrix, short rows
padded with -1, in bands of ``BAND`` columns.  ``numpy.lexsort`` brings the rows
into order; a running OR over the masks "differs from the row above" marks where
a node of each depth begins, and ``reduceat`` aggregates the members and, from
the deepest depth up, the subtrees.

Only nodes on the path of a shard's first or last row can have members in
another shard.  They are *open*: they come with a hash of their path and with
sums over their closed subtrees, are merged by that hash, and their sums are
rolled up among themselves.  There are at most 2 x shards x (longest sequence)
open nodes, whatever the number of conversations; all others are final in their
shard.  A node's conversations that end there are a list of ids, for an open
node cut into one piece a shard.

A shard holds about ``SHARD_TURNS`` turns.  A conversation is one row of 16
bytes a turn, so it must fit a task without its texts.

Null ``role`` or ``text`` counts as empty.  Turns are ordered by number, null
first; equal numbers by turn id.  Turns without ``conv_id`` make one
conversation, larger than all others: it counts as a member, but its id is in
no list of ends, and a node has a null ``conv_id`` only if it is the one member.
Conversations without turns are members of the root.  An empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import arrow_batches, shuffle_partitions, written

#: Columns of a matrix, turns of a shard on average, rows of a batch on its way out.
BAND, SHARD_TURNS, OUT_ROWS = 64, 1 << 19, 1 << 15
WORD = r"[^\x20\x09-\x0D]+"
MOST = np.iinfo(np.int64).max

TRIE = ("path binary, parent_path binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, words long, ends array<long>")
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
BOUNDARY = "path binary, " + ", ".join(f"{c} long" for c in NODE)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


# --- sequences ---------------------------------------------------------------

def turn_id(role: Column, text: Column) -> Column:
    """128 bits that stand for a turn; the role's length keeps role and text apart."""
    joined = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(joined.cast("binary"), 256), 1, 32))


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """``(conv_id, ids array<binary>, words array<int>)`` of each conversation, by turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(F.col("conv_id").cast("long"), F.struct(
        F.col("turn").cast("long").alias("turn"), turn_id(role, text).alias("id"),
        F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))


def with_shared_starts(sequences: DataFrame, every: int, most: int, shared: Column) -> DataFrame:
    """Each conversation c starts with the first ``shared`` (at most ``most``) turns of conversation
    ``c - c % every`` (fewer or none if it has no more), and goes on with its own turns after its first
    ``shared``.  A remainder has its number's sign.  A null id keeps its turns."""
    c = F.col("conv_id")
    given = sequences.filter(c % every == 0).select(c.alias("__from"), *[
        F.slice(x, 1, most).alias(f"__{x}") for x in ("ids", "words")])
    own = sequences.select("conv_id", "ids", "words", (c - c % every).alias("__from"), F.coalesce(shared.cast("int"), F.lit(0)).alias("__n"))
    kept = F.greatest(F.size("ids") - F.col("__n"), F.lit(0))
    start = {x: F.coalesce(F.slice(f"__{x}", F.lit(1), F.col("__n")), F.slice(x, F.lit(1), F.when(c.isNull(), F.col("__n")).otherwise(0)))
             for x in ("ids", "words")}
    return own.join(given, "__from", "left").select("conv_id", *[
        F.concat(start[x], F.slice(x, F.col("__n") + 1, kept)).alias(x) for x in ("ids", "words")])


# --- one shard ---------------------------------------------------------------

@dataclass
class Level:
    """The nodes of one depth in order: member counts, smallest members, numbers of their turns, parents'
    places in the level above, conversations that end there (counts, ids one after another), and sums over
    closed subtrees."""
    n: np.ndarray
    conv: np.ndarray
    code: np.ndarray
    words: np.ndarray
    parent: np.ndarray
    n_ends: np.ndarray
    ends: np.ndarray
    open: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    children: np.ndarray | None = None
    leaves: np.ndarray | None = None
    saved: np.ndarray | None = None


def level_of(rows, starts, conv, known, size, depth, code, words, parent) -> Level:
    """Aggregates of the nodes that begin at ``starts`` among the ordered ``rows`` that reach ``depth``."""
    over = size[rows] == depth
    listed = over & known[rows]
    return Level(np.diff(starts, append=len(rows)), np.minimum.reduceat(conv[rows], starts), code, words, parent,
                 np.add.reduceat(over.astype(np.int64), starts), conv[rows[listed]])


def listed_ends(level: Level, known_ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(known_ends)]), pa.int32()), pa.array(level.ends, pa.int64()))


def levels(codes: np.ndarray, words: np.ndarray, size: np.ndarray, conv: np.ndarray, known: np.ndarray, band: int = BAND):
    """The levels of a shard from the root on, and for each the listed ends of its nodes.

    ``codes`` and ``words`` hold the turns of all rows one after another; ``conv`` the rows' conversations,
    ``MOST`` where ``known`` is false.
    """
    begin = np.cumsum(size) - size
    rows = np.lexsort((~known, conv))
    start = np.zeros(1, np.int64)
    out = [level_of(rows, start, conv, known, size, 0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    listed = [np.add.reduceat((size == 0) & known, start, dtype=np.int64)]
    node = np.zeros(len(size), np.int64)
    done, group = 0, np.zeros(len(rows), np.int64)
    while True:
        alive = size[rows] > done
        rows, group = rows[alive], group[alive]
        if not len(rows):
            return out, listed
        width = min(band, int(size[rows].max()) - done)
        at = np.arange(width)
        filled = at < (size[rows] - done)[:, None]
        matrix = np.full(filled.shape, -1, np.int64)
        matrix[filled] = codes[((begin[rows] + done)[:, None] + at)[filled]]
        order = np.lexsort((*matrix.T[::-1], group))  # stable: equal rows stay in the order of their conversations
        rows, group, matrix = rows[order], group[order], matrix[order]
        differs = np.ones((len(rows), width + 1), bool)
        differs[1:, 0] = group[1:] != group[:-1]
        differs[1:, 1:] = matrix[1:] != matrix[:-1]
        begins = np.logical_or.accumulate(differs, axis=1)[:, 1:]
        for j in range(width):
            here = np.flatnonzero(matrix[:, j] >= 0)
            some, depth = rows[here], done + j + 1
            first = begins[here, j]
            start = np.flatnonzero(first)
            top = some[start]
            out.append(level_of(some, start, conv, known, size, depth, matrix[here[start], j], words[begin[top] + depth - 1], node[top]))
            listed.append(np.add.reduceat((size[some] == depth) & known[some], start, dtype=np.int64))
            node[some] = np.cumsum(first) - 1
        done += width
        group = node[rows]


def mark_open(tree: list[Level]) -> list[list[tuple[int, int]]]:
    """Mark the nodes of the first and the last row; their paths as (depth, place) from the root."""
    for level in tree:
        level.open = np.zeros(len(level.n), bool)
    paths = []
    for first in (True, False):
        place, path = 0, []
        for depth, level in enumerate(tree):
            level.open[place] = True
            path.append((depth, place))
            if depth + 1 == len(tree) or first and level.n_ends[place]:
                break
            below = tree[depth + 1].parent
            a, z = np.searchsorted(below, [place, place + 1])
            if a == z:
                break
            place = int(a if first else z - 1)
        paths.append(path)
    return paths


def roll_up(tree: list[Level]) -> None:
    """Children, leaves and saved tokens of each node, those of open children left out."""
    for depth in range(len(tree) - 1, -1, -1):
        level = tree[depth]
        level.children, level.leaves, level.saved = np.zeros((3, len(level.n)), np.int64)
        childless = np.ones(len(level.n), bool)
        if depth + 1 < len(tree):
            below = tree[depth + 1]
            closed = ~below.open
            starts = np.flatnonzero(np.diff(below.parent, prepend=-1))
            to = below.parent[starts]
            childless[to] = False
            level.children[to] = np.add.reduceat(closed.astype(np.int64), starts)
            level.leaves[to] = np.add.reduceat(below.leaves * closed, starts)
            level.saved[to] = np.add.reduceat(below.saved * closed, starts)
        level.leaves += childless & ~level.open
        level.saved += np.where(level.open, 0, (level.n - 1) * level.words)


def shard_rows(ids: pa.Array, words: np.ndarray, size: np.ndarray, conv: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of ``TRIE`` for the nodes of a shard: final ones, and the shard's share of open ones."""
    known = conv.is_valid().to_numpy(zero_copy_only=False)
    number = ids.dictionary_encode()
    order = pc.array_sort_indices(number.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[number.indices.to_numpy()]
    tree, listed = levels(codes, words, size, pc.fill_null(conv, MOST).to_numpy(), known)
    hashes: dict[tuple[int, int], bytes] = {}
    for path in mark_open(tree):
        digest = b""
        for depth, place in path:
            if depth:
                turn = number.dictionary[int(order[tree[depth].code[place]])].as_py()
                digest = hashlib.blake2b(digest + turn, digest_size=16).digest()
            hashes[depth, place] = digest
    roll_up(tree)
    for depth, level in enumerate(tree):
        count = len(level.n)
        above = tree[depth - 1] if depth else None
        path, over, parent = [None] * count, [None] * count, np.full(count, MOST)
        for place in np.flatnonzero(level.open).tolist():
            path[place] = hashes[depth, place]
        if depth:
            parent = np.where(above.open[level.parent], MOST, above.conv[level.parent])
            for place in np.flatnonzero(above.open[level.parent]).tolist():
                over[place] = hashes[depth - 1, int(level.parent[place])]

        def number_or_null(x):
            return pa.array(x, pa.int64(), mask=x == MOST)

        batch = pa.RecordBatch.from_arrays(
            [pa.array(path, pa.binary()), pa.array(over, pa.binary()), number_or_null(level.conv), pa.array(np.full(count, depth)),
             number_or_null(parent), *[pa.array(x, pa.int64()) for x in (level.n, level.children, level.leaves, level.saved, level.words)],
             listed_ends(level, listed[depth])], [c.split()[0] for c in TRIE.split(", ")])
        for at in range(0, count, OUT_ROWS):
            yield batch.slice(at, OUT_ROWS)


def walk_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        conv, ids, words = (c.combine_chunks() for c in table.columns)
        size = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        yield from shard_rows(pc.list_flatten(ids), pc.list_flatten(words).to_numpy(zero_copy_only=False).astype(np.int64), size, conv)


# --- open nodes --------------------------------------------------------------

def roll_up_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged open nodes with the sums of their open descendants, and their parents' conversations."""
    nodes = {r["path"]: r for b in batches for r in b.to_pylist()}
    for r in nodes.values():
        r["inner"] = 0
    for r in sorted(nodes.values(), key=lambda r: -r["depth"]):
        if not r["n_children"] + r["inner"]:
            r["n_leaves"] += 1
        r["n_children"] += r["inner"]
        r["saved_tokens"] += (r["n_convs"] - 1) * r["words"]
        over = nodes.get(r["parent_path"])
        r["parent_conv_id"] = over and over["conv_id"]
        if over:
            over["inner"] += 1
            over["n_leaves"] += r["n_leaves"]
            over["saved_tokens"] += r["saved_tokens"]
    rows = list(nodes.values())
    if rows:
        names = [c.split()[0] for c in BOUNDARY.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64() if c != "path" else pa.binary()) for c in names], names)


@dataclass
class Trie:
    """``closed``: nodes with their ``ends``; ``open``: nodes with the hash of their ``path``; ``pieces``:
    the ends of open nodes, ``(path, ends)``, whose lists in the order of their first ids make the whole."""
    closed: DataFrame
    open: DataFrame
    pieces: DataFrame

    def nodes(self) -> DataFrame:
        """All nodes, one row each."""
        return self.closed.select(*NODE).unionByName(self.open.select(*NODE))

    def nodes_with_digests(self, to: str = "ends_sha256") -> DataFrame:
        """All nodes and the SHA-256 of the comma-joined ids of conversations that end there.

        A hash reads its list in order, so the pieces of one open node pass through one task, as a stream.
        """
        closed = self.closed.select(*NODE, F.sha2(F.array_join(F.col("ends").cast("array<string>"), ",").cast("binary"), 256).alias(to))
        pieces = self.pieces.select("path", F.col("ends")[0].alias("first"), F.array_join(F.col("ends").cast("array<string>"), ",").alias("text"))
        digests = pieces.repartition("path").sortWithinPartitions("path", "first").mapInArrow(stream_digests, "path binary, digest string")
        opened = self.open.join(digests, "path", "left").select(*NODE, F.coalesce("digest", F.lit(EMPTY_SHA256)).alias(to))
        return closed.unionByName(opened)


def stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined texts of each path; rows come in order."""
    current, digest = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([digest.hexdigest()])], ["path", "digest"])

    for batch in batches:
        for path, _, text in zip(*(c.to_pylist() for c in batch.columns)):
            if path != current:
                if digest is not None:
                    yield done()
                current, digest = path, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
    if digest is not None:
        yield done()


def prefix_trie(sequences: DataFrame) -> Trie:
    """The trie of ``sequences (conv_id, ids array<binary>, words array<int>)``, one row for each conversation."""
    spark = sequences.sparkSession
    arrow_batches(spark, 1 << 13)
    rows = written(sequences.select("conv_id", "ids", "words"), "sequences")
    turns = rows.agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(0))).first()[0]
    shards = max(shuffle_partitions(spark), -(-turns // SHARD_TURNS))
    trie = written(rows.repartitionByRange(shards, "ids", "conv_id").mapInArrow(walk_shard, TRIE), "trie")
    shares = trie.filter(F.col("path").isNotNull())
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = shares.groupBy("path", "parent_path", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), *sums)
    opened = written(merged.repartition(1).mapInArrow(roll_up_open, BOUNDARY), "open-nodes")
    inside = trie.filter(F.col("path").isNull())
    under = opened.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("__parent"))
    closed = inside.filter(F.col("parent_path").isNull()).select(*NODE, "ends").unionByName(
        inside.filter(F.col("parent_path").isNotNull()).drop("parent_conv_id").join(under, "parent_path")
        .withColumnRenamed("__parent", "parent_conv_id").select(*NODE, "ends"))
    return Trie(closed, opened, shares.filter(F.size("ends") > 0).select("path", "ends"))
