"""Alignment of two tokenizers by byte offsets (dealt operator 13).

``align`` encodes each text with a byte-level BPE file (A) and a SentencePiece
model (B).  Where tokens of both end, at the same byte, a *group* ends, and every
A token of a group is linked with every B token of it.  The work is Arrow's:

* ids are lists; their flat values and parent indices give (document, end) keys
  by a cumulative sum of token lengths that starts afresh at each document;
* an Acero hash join of both sides' (document, end) keys finds the groups;
* ``Table.group_by`` counts links by (document, pair), and documents by pair.

Each Arrow batch of documents is a *block*, one row of a written table: counts
of its documents, their distinct pairs as numbers into the block's list of
pairs, and that list with partial counts.  Spark merges the partial counts to
the corpus's, joins them back to the blocks' lists, and each block adds them up
for its documents.  So a pair is shuffled once for each block that holds it, not
for each link; neither texts nor ids are shuffled.

A group of many links counts its distinct ids first, so copies of one id in a
long stretch without a common end are not laid out pair by pair.

Null or empty texts, and those whose joined tokens differ from a space and the
text (such as texts with U+2581), have no tokens: zeros, and an empty
``groups``.  Each row gives one row and counts as a document of its own, also
repeated ones and those with a null key.  An empty table gives none.  Columns
other than key and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import arrow_batches, written
from tallyspark.llm.distinct_words import kept, packed, unpacked
from tallyspark.llm.sentencepiece_backend import MARKER, NORMAL, USER_DEFINED, read_model
from tallyspark.llm.units import Table, UnitEncoder, byte_groups, byte_letters, gather

#: Rows and bytes of a block, bytes aligned at once, units that an encoder remembers.
BLOCK_ROWS, BLOCK_BYTES, ALIGN_BYTES, REMEMBERED = 1 << 13, 8 << 20, 1 << 20, 100_000
#: Pairs of tokens laid out at once, and links of a group from which its ids are counted first.
PAIRS_AT_ONCE, MANY_LINKS = 1 << 19, 1 << 10
#: A text that starts with a space, or holds a marker or two spaces, goes through the library whole.
ODD_PIECES = f"^ |  |{MARKER}"
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


class PlainEncoder(UnitEncoder):
    """Byte-level ids; special strings are plain text."""

    most = REMEMBERED

    def __init__(self, path: str):
        super().__init__(path, specials=False)
        letter = {c: b for b, c in byte_letters().items()}
        self.tokens = token_bytes({i: bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode()
                                   for t, i in self.whole.get_vocab().items()})


class PieceEncoder(UnitEncoder):
    """SentencePiece ids, asked once for each distinct stretch between single spaces.

    No piece goes on with a marker after another character, so a space before anything but a space is a
    safe place; a model with pieces or rules of another kind reads whole texts.
    """

    most = REMEMBERED

    def __init__(self, path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table, self.old = Table(), Table()
        with open(path, "rb") as f:
            model = read_model(f.read())
        usable = [p for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)]
        self.cuts = (model.dummy_prefix and model.escape and not model.charsmap and not model.one_space
                     and not any(MARKER in p.lstrip(MARKER) for p in usable)
                     and not any(kind == USER_DEFINED for _, _, kind in model.pieces))
        self.space = self.library.piece_to_id(MARKER)
        self.tokens = token_bytes({i: bytes([int(m[1], 16)]) if self.library.is_byte(i) and (m := BYTE_PIECE.fullmatch(p))
                                   else p.replace(MARKER, " ").encode() for i, (p, _, _) in enumerate(model.pieces)})

    def _learn(self, units: list[str], slots: np.ndarray) -> None:
        rest, done = self._recall(units, slots), 0
        for group in byte_groups([units[i] for i in rest.tolist()]):
            found = self.library.encode(group, num_threads=1)
            found = [i if u else [self.space] for u, i in zip(group, found)]
            self.table.put(slots[rest[done:done + len(group)]], np.array([len(i) for i in found], np.int64),
                           np.array([x for i in found for x in i], "<u4"))
            done += len(group)

    def _cut(self, texts: pa.Array) -> pa.Array:
        """The stretches between single spaces; an empty text has none, an odd one is one."""
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, ODD_PIECES) if self.cuts else pa.array(np.ones(len(texts), bool))
        lists = pc.split_pattern(texts, " ")
        if pc.any(odd).as_py():
            alone = pa.LargeListArray.from_arrays(pa.array(range(len(texts) + 1), pa.int64()), texts).cast(lists.type)
            lists = pc.if_else(odd, alone, lists)
        return pc.if_else(pc.equal(texts, ""), pa.array([[]], lists.type)[0], lists)


def token_bytes(tokens: dict[int, bytes]):
    """All tokens' bytes one after another, and where each begins and how long it is."""
    rows = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]
    size = np.array([len(t) for t in rows], np.int64)
    return np.cumsum(size) - size, size, np.frombuffer(b"".join(rows), np.uint8)


# --- one block ---------------------------------------------------------------

def listed(counts: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64()), pa.array(ids.astype(np.int64)))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``values``, so many in each."""
    ends = np.concatenate([[0], np.cumsum(values)])
    return np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


def right_tokens(lists: pa.Array, tokens, texts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each document, whether its joined tokens are its text; ``texts`` are all bytes, ``size`` of each."""
    begin, length, data = tokens
    ids, n = pc.list_flatten(lists).to_numpy(), pc.list_value_length(lists).to_numpy()
    good = sums(length[ids], n) == size
    ids = ids[np.repeat(good, n)]
    same = gather(begin[ids], length[ids], data) == texts[np.repeat(good, size)]
    good[np.repeat(np.flatnonzero(good), size[good])[~same]] = False
    return good


def token_ends(lists: pa.Array, length: np.ndarray, name: str) -> pa.Table:
    """(document, end) keys of all tokens, and their places."""
    ids, parents = pc.list_flatten(lists).to_numpy(), pc.list_parent_indices(lists)
    ends = pc.cumulative_sum(pa.array(length[ids], pa.int64())).to_numpy()
    before = np.concatenate([[0], ends])[lists.offsets.to_numpy()[:-1]]
    return pa.table({"doc": parents, "end": ends - before[parents.to_numpy()], name: np.arange(len(ids))})


class Groups:
    """The groups of a block: of each its document, and the first token and number of tokens on both sides."""

    def __init__(self, a: pa.Array, b: pa.Array, a_tokens, b_tokens):
        left, right = token_ends(a, a_tokens[1], "a"), token_ends(b, b_tokens[1], "b")
        met = left.join(right, ["doc", "end"], join_type="inner", use_threads=False)
        self.last_a, self.last_b = np.sort(met["a"].to_numpy()), np.sort(met["b"].to_numpy())
        self.a, self.b = pc.list_flatten(a).to_numpy(), pc.list_flatten(b).to_numpy()
        self.n_a, self.n_b = np.diff(self.last_a, prepend=-1), np.diff(self.last_b, prepend=-1)
        self.first_a, self.first_b = self.last_a - self.n_a + 1, self.last_b - self.n_b + 1
        self.doc = left["doc"].to_numpy()[self.last_a]
        self.links = self.n_a * self.n_b

    def texts(self, docs: int, decimals) -> list[bytes]:
        """For each document ``a1,a2|b1;a3|b2,b3``: ids of both sides by group."""
        begin, size, data = decimals
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + np.repeat(self.first_b, self.n_a)] = self.a
        order[np.arange(len(self.b)) + np.repeat(self.last_a + 1, self.n_b)] = self.b
        out = gather(begin[order], size[order], data)  # each id with a comma
        ends = np.cumsum(size[order])
        out[ends[self.last_a + self.first_b] - 1] = ord("|")
        out[ends[self.last_b + self.last_a + 1] - 1] = ord(";")
        groups = np.bincount(self.doc, minlength=docs)
        last = np.concatenate([[0], ends[self.last_a + self.last_b + 1]])[np.concatenate([[0], np.cumsum(groups)])].tolist()
        out = out.tobytes()
        return [out[a:max(a, z - 1)] for a, z in zip(last, last[1:])]

    def _laid_out(self, some: np.ndarray) -> pa.Table:
        """All links of these groups, pair by pair."""
        links = self.links[some]
        at = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
        g = np.repeat(some, links)
        a, b = self.a[self.first_a[g] + at // self.n_b[g]], self.b[self.first_b[g] + at % self.n_b[g]]
        return pa.table({"doc": self.doc[g], "pair": a << 32 | b, "links": np.ones(len(g), np.int64)})

    def _counted(self, g: int):
        """Links of one group by distinct ids."""
        a, times_a = np.unique(self.a[self.first_a[g]:self.last_a[g] + 1], return_counts=True)
        b, times_b = np.unique(self.b[self.first_b[g]:self.last_b[g] + 1], return_counts=True)
        step = max(1, PAIRS_AT_ONCE // len(b))
        for i in range(0, len(a), step):
            pair = (a[i:i + step, None] << 32 | b).ravel()
            yield pa.table({"doc": np.full(len(pair), self.doc[g]), "pair": pair, "links": np.outer(times_a[i:i + step], times_b).ravel()})

    def pairs(self) -> pa.Table:
        """``(doc, pair, links)``: how often each document links a pair of ids; A's id stands in the upper half."""
        few = np.flatnonzero(self.links <= MANY_LINKS)
        part = np.cumsum(self.links[few]) // PAIRS_AT_ONCE
        tables = [self._laid_out(g) for g in np.split(few, np.flatnonzero(np.diff(part)) + 1)]
        for g in np.flatnonzero(self.links > MANY_LINKS).tolist():
            tables += self._counted(g)

        def merged(table):
            return table.group_by(["doc", "pair"], use_threads=False).aggregate([("links", "sum")]).rename_columns(["doc", "pair", "links"])

        return merged(pa.concat_tables(map(merged, tables))) if len(tables) > 1 else merged(tables[0])


BLOCK = ("block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
         "groups_sha256 array<string>, n_pairs array<long>, numbers binary, links binary, a array<int>, b array<int>, n array<long>")
BLOCK_NAMES = [c.split()[0] for c in BLOCK.split(", ")]


def decimals(most: int):
    """Decimal numbers below ``most``, each with a comma, in the form of ``token_bytes``."""
    return token_bytes({i: b"%d," % i for i in range(most)})


def align_texts(texts: pa.Array, a_coder: PlainEncoder, b_coder: PieceEncoder):
    """Counts, hashes of groups, and pairs of some documents."""
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
    spaced = pc.if_else(pc.equal(texts, ""), "", spaced)
    size = pc.binary_length(spaced).to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(spaced.cast(pa.large_binary()).to_pylist()), np.uint8)
    a, b = listed(*a_coder.encode(spaced)), listed(*b_coder.encode(texts))
    good = pa.array(right_tokens(a, a_coder.tokens, data, size) & right_tokens(b, b_coder.tokens, data, size))
    a, b = (pc.if_else(good, x, pa.array([[]], x.type)[0]) for x in (a, b))
    n_a, n_b = (pc.list_value_length(x).to_numpy() for x in (a, b))
    # the lists anew, without the values of those that were emptied
    a, b = listed(n_a, pc.list_flatten(a).to_numpy()), listed(n_b, pc.list_flatten(b).to_numpy())
    groups = Groups(a, b, a_coder.tokens, b_coder.tokens)
    n_groups = np.bincount(groups.doc, minlength=len(texts))
    shown = groups.texts(len(texts), kept(DecimalTable, max(len(a_coder.tokens[1]), len(b_coder.tokens[1]))).table)
    hashed = [hashlib.sha256(t).hexdigest() if n else "" for t, n in zip(shown, n_a.tolist())]
    return (n_a, n_b, n_groups, sums(groups.links, n_groups), np.array(hashed, object)), groups.pairs()


def align_block(block: int, docs: pa.Array, texts: pa.Array, a_coder: PlainEncoder, b_coder: PieceEncoder) -> pa.RecordBatch:
    """The one row of a block, aligned in slices of about ``ALIGN_BYTES``."""
    texts = texts.cast(pa.large_string())
    part = (np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) - 1) // ALIGN_BYTES
    starts = np.flatnonzero(np.diff(part, prepend=-2))
    columns, tables = [], []
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(texts)]):
        found, pairs = align_texts(texts.slice(a, z - a), a_coder, b_coder)
        columns.append(found)
        tables.append(pairs.set_column(0, "doc", pc.add(pairs["doc"], a)))
    n_a, n_b, n_groups, n_links, hashed = (np.concatenate(c) for c in zip(*columns))
    pairs = pa.concat_tables(tables)
    held = pairs.group_by("pair", use_threads=False).aggregate([("doc", "count")]).sort_by([("doc_count", "descending")])
    number = pc.index_in(pairs["pair"], held["pair"]).to_numpy().astype(np.int64)
    doc, links = pairs["doc"].to_numpy(), pairs["links"].to_numpy()
    order = np.lexsort((number, doc))
    doc, number, links = doc[order], number[order], links[order]
    same = np.diff(doc, prepend=-1) == 0
    step = number - np.where(same, np.concatenate([[0], number[:-1]])[:len(number)], 0)
    pair = held["pair"].to_numpy()
    values = [block, docs.to_pylist(), n_a, n_b, n_groups, n_links, hashed, np.bincount(doc, minlength=len(texts)),
              packed(step), packed(links), pair >> 32, pair & 0xFFFFFFFF, held["doc_count"].to_numpy()]
    kinds = {"array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
             "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[c.split()[1]]) for v, c in zip(values, BLOCK.split(", "))], BLOCK_NAMES)


class DecimalTable:
    def __init__(self, most: int):
        self.table = decimals(most)


# --- all blocks --------------------------------------------------------------

RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def add_up(blocks: pa.Table, valued: pa.Table) -> pa.Table:
    """A block's documents with the sums over their links."""
    block = blocks.to_pylist()[0]
    place = valued["pos"].to_numpy()
    count, best = np.zeros((2, len(place)), np.int64)
    count[place], best[place] = valued["n_docs"].to_numpy(), valued["best"].to_numpy(zero_copy_only=False)
    n_pairs = np.array(block["n_pairs"], np.int64)
    steps, links = np.cumsum(unpacked(block["numbers"])), unpacked(block["links"])
    before = np.concatenate([[0], steps])[np.cumsum(n_pairs) - n_pairs]
    number = steps - np.repeat(before, n_pairs)
    found = {**block, "n_best": sums(links * best[number], n_pairs), "count_sum": sums(links * count[number], n_pairs)}
    return pa.table({c.split()[0]: pa.array(found[c.split()[0]], pa.string() if c.endswith("string") else pa.int64())
                     for c in RESULT.split(", ")})


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents ``RESULT``, and the corpus's pairs ``(a, b, n_docs, best)``: how many documents link them, and
    whether no pair of the same A id is linked by more."""
    arrow_batches(docs.sparkSession, BLOCK_ROWS, BLOCK_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_coder, b_coder = kept(PlainEncoder, a_path), kept(PieceEncoder, b_path)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                yield align_block(number, batch.column(0), batch.column(1), a_coder, b_coder)
                number += 1

    narrow = docs.select(F.col(key).cast("long"), F.coalesce(F.col(text), F.lit("")))
    blocks = written(narrow.mapInArrow(run, BLOCK), "aligned")
    held = blocks.select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("pos", "p")).select("block", "pos", "p.a", "p.b", "p.n")
    counts = written(held.groupBy("a", "b").agg(F.sum("n").alias("n_docs")), "pair-counts")
    # one row for each id of A's vocabulary, whatever the corpus
    most = F.broadcast(counts.groupBy("a").agg(F.max("n_docs").alias("most")))
    pairs = counts.join(most, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
    valued = held.join(pairs, ["a", "b"]).select(F.col("block").alias("of_block"), "pos", "n_docs", "best")
    found = blocks.drop("a", "b", "n").groupBy("block").cogroup(valued.groupBy("of_block")).applyInArrow(add_up, RESULT)
    return found, pairs
