"""Token ids in grammar-compressed shard files (dealt operator 10).

A shard holds consecutive documents of at least ``SHARD`` ids together.  Its
ids are compressed by Re-Pair: in each round the most frequent pairs of
neighbouring symbols become nonterminals, and their occurrences, taken from the
left without overlap, are replaced; rounds go on until no pair is frequent
enough.  No pair reaches over a document's end, so every document is a stretch
of symbols of its own.  With the expansion length of every rule, one document,
or one id within it, is read without expanding the others.

Layout of a shard (little-endian): ``RPG1``; number of documents, rules and
symbols and the first nonterminal as uint32; then for all documents their
symbol counts and id counts (uint32), for all rules both sides and the
expansion lengths (uint32), and the symbols (uint32).  Shards are rows of a
Parquet table, written by Spark, so they lie wherever the cluster keeps files.

Texts are dealt to blocks of consecutive ``doc_id`` (one shuffle) and each task
streams through its blocks; it holds one shard and one Arrow batch.  Starts are
prefix sums in three levels: shards of a block, blocks, documents of a shard.

Null texts are empty documents (the end id only).  Equal or null ``doc_id``
(nulls first) are separate documents.  An empty table gives an empty file set.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import OrderedBlocks, arrow_batches
from tallyspark.llm.units import TOKEN_ROWS, encoder

END_ID = 2
#: Ids of a shard at least; new rules in a round at most, and the count from which a pair is worth a rule.
SHARD, ROUND_RULES, LEAST = 1 << 18, 4096, 8
MAGIC = b"RPG1"
#: Odd factor whose products' high bits serve as a hash.
MIX = np.uint64(0x9E3779B97F4A7C15)

#: Payloads are long: row groups of few shards bound what a reader of the files holds, and pages what the writer does.
ROW_GROUPS = {"parquet.block.row.count.limit": "16", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}

SHARDS = "block long, shard long, doc_ids array<long>, n_tokens long, n_symbols long, payload binary"


def repair(ids: np.ndarray, last: np.ndarray, per_round: int = ROUND_RULES, least: int = LEAST):
    """Grammar of ``ids``: symbols, whether each ends a document, rule sides and the first nonterminal.

    ``last`` marks the ids that end a document: no pair starts with one.  In the
    result no pair of neighbours occurs ``least`` times without overlap.
    """
    n = len(ids)
    base = int(ids.max()) + 1 if n else 0
    symbols, last = ids.astype(np.uint64), last.copy()
    # replaced symbols keep their places; links lead over those that went
    after, before, gone = np.arange(1, n + 1), np.arange(-1, n - 1), np.zeros(n, bool)
    last[n - 1:] = True
    sides = [np.zeros((0, 2), np.uint64)]
    rules = 0

    def pairs(at: np.ndarray) -> np.ndarray:
        return (symbols[at] << np.uint64(32)) | symbols[after[at]]

    def every_other(place: np.ndarray, kind: np.ndarray | None = None) -> np.ndarray:
        """Of occurrences that overlap (and are of one kind), every other one from the left."""
        joined = np.zeros(len(place), bool)
        joined[1:] = after[place[:-1]] == place[1:]
        if kind is not None:
            joined[1:] &= kind[1:] == kind[:-1]
        out, later = ~joined, np.flatnonzero(joined)
        # the first, third ... of the places that follow one another go, as the one before them stays
        nth = np.arange(len(later))
        head = np.diff(later, prepend=-2) != 1
        out[later[(nth - np.maximum.accumulate(np.where(head, nth, 0))) & 1 == 1]] = True
        return out

    def frequent(spots: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kinds of pair seen ``least`` times among ``found`` at ``spots``, the places of these and their kinds' numbers."""
        order = np.sort(found)
        # in ascending order, a pair seen ``least`` times equals the one ``least - 1`` places on
        reach = max(0, len(order) - least + 1)
        kinds = order[:reach][order[:reach] == order[len(order) - reach:]]
        kinds = kinds[np.flatnonzero(np.concatenate([kinds[:1] == kinds[:1], kinds[1:] != kinds[:-1]]))]
        if not len(kinds):
            return kinds, spots[:0], spots[:0]
        # a table of hashes finds most kinds, and leaves few places to search
        table = np.zeros(1 << 18, np.int32)
        table[(kinds * MIX >> np.uint64(46)).view(np.int64)] = np.arange(1, len(kinds) + 1)
        at = table[(found * MIX >> np.uint64(46)).view(np.int64)]
        few = np.flatnonzero(at)
        at, asked = at[few].astype(np.int64) - 1, found[few]
        missed = np.flatnonzero(kinds[at] != asked)
        at[missed] = np.minimum(np.searchsorted(kinds, asked[missed]), len(kinds) - 1)
        hit = kinds[at] == asked
        return kinds, spots[few[hit]], at[hit]

    # at first every symbol stands beside the next
    spots = np.flatnonzero(~last)
    kinds, place, at = frequent(spots, ((symbols[:-1] << np.uint64(32)) | symbols[1:])[~last[:-1]])
    while len(place):
        # a pair's occurrences all arise in one round and only become fewer later
        counts = np.bincount(at[every_other(place, at)], minlength=len(kinds))
        ranked = np.argsort(-counts, kind="stable")[:min(per_round, int((counts >= least).sum()))]
        stay = counts[at] >= least
        place, at = place[stay], at[stay]
        if not len(place):
            break
        while True:
            chosen = np.zeros(len(kinds), bool)
            chosen[ranked] = True
            mine = chosen[at]
            where, rule = place[mine], at[mine]
            first = every_other(where)
            where, rule = where[first], rule[first]
            # pairs that lose most occurrences to others wait; the first of a single one loses none
            used = 2 * np.bincount(rule, minlength=len(kinds)) >= least
            if used.any():
                break
            ranked = ranked[:max(1, len(ranked) // 2)]
        where, rule = where[used[rule]], rule[used[rule]]
        number = np.cumsum(used) - 1
        other = after[where]
        symbols[where] = (base + rules + number[rule]).astype(np.uint64)
        sides.append(np.stack([kinds[used] >> np.uint64(32), kinds[used] & np.uint64(0xFFFFFFFF)], 1))
        rules += int(used.sum())
        last[where] = last[other]
        gone[other] = True
        after[where] = after[other]
        right = after[where]
        inner = right < n
        before[right[inner]] = where[inner]
        # pairs beside a new symbol are new pairs; the others stand or went
        touched = np.zeros(n, bool)
        touched[where] = True
        touched[before[where][before[where] >= 0]] = True
        spots = np.flatnonzero(touched & ~last & ~gone)
        keep = ~(touched[place] | gone[place])
        place, at = place[keep], at[keep]
        fresh, there, which = frequent(spots, pairs(spots))
        held = np.bincount(at, minlength=len(kinds)) > 0
        left, at = np.flatnonzero(held), (np.cumsum(held) - 1)[at]
        place, at = np.concatenate([place, there]), np.concatenate([at, which + len(left)])
        kinds = np.concatenate([kinds[left], fresh])
        order = np.argsort(place, kind="stable")
        place, at = place[order], at[order]
    stay = np.flatnonzero(~gone)
    return symbols[stay].astype("<u4"), last[stay], np.concatenate(sides).astype("<u4"), base


def expansion_lengths(sides: np.ndarray, base: int) -> np.ndarray:
    """Number of ids of each rule; a rule's sides are ids or earlier rules."""
    # one place more, which stands for any id; 0: not known yet
    out = np.zeros(len(sides) + 1, np.int64)
    out[-1] = 1
    rule = np.where(sides >= base, sides.astype(np.int64) - base, len(sides))
    open_ = np.arange(len(sides))
    while len(open_):
        both = out[rule[open_]]
        known = both.all(axis=1)
        out[open_[known]] = both[known].sum(axis=1)
        open_ = open_[~known]
    return out[:-1].astype("<u4")


def encode_shard(ids: np.ndarray, counts: list[int]) -> bytes:
    """The file bytes of documents whose ids stand one after another in ``ids``."""
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts) - 1] = True
    symbols, ends, sides, base = repair(ids, last)
    stops = np.flatnonzero(ends) + 1
    head = MAGIC + struct.pack("<4I", len(counts), len(sides), len(symbols), base)
    parts = (np.diff(stops, prepend=0), np.array(counts), sides, expansion_lengths(sides, base), symbols)
    return head + b"".join(np.ascontiguousarray(x, "<u4").tobytes() for x in parts)


class Shard:
    """A shard's bytes, read by document."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a shard of this format")
        docs, rules, symbols, self.base = struct.unpack_from("<4I", payload, 4)
        words = np.frombuffer(payload, "<u4", offset=20)
        cut = np.cumsum([0, docs, docs, 2 * rules, rules, symbols])
        part = [words[a:b] for a, b in zip(cut[:-1], cut[1:])]
        self.doc_symbols, self.doc_ids, self.lengths, self.symbols = part[0], part[1], part[3], part[4]
        self.sides = part[2].reshape(-1, 2)
        self.starts = np.cumsum(self.doc_symbols, dtype=np.int64) - self.doc_symbols

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """All ids below some symbols: each nonterminal opens once, level by level."""
        size = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        size[rule] = self.lengths[symbols[rule] - self.base]
        out = np.empty(int(size.sum()), "<u4")
        at = np.cumsum(size) - size
        while len(symbols):
            rule = symbols >= self.base
            out[at[~rule]] = symbols[~rule]
            at, (a, b) = at[rule], self.sides[symbols[rule] - self.base].T
            size, big = np.ones(len(a), np.int64), a >= self.base
            size[big] = self.lengths[a[big] - self.base]
            symbols, at = np.concatenate([a, b]), np.concatenate([at, at + size])
        return out

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.starts[i]:self.starts[i] + self.doc_symbols[i]])

    def token(self, i: int, j: int) -> int:
        """Id ``j`` of document ``i``: descend by expansion lengths."""
        symbols = self.symbols[self.starts[i]:self.starts[i] + self.doc_symbols[i]]
        size = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        size[rule] = self.lengths[symbols[rule] - self.base]
        ends = np.cumsum(size)
        at = int(np.searchsorted(ends, j, "right"))
        s, j = int(symbols[at]), j - int(ends[at] - size[at])
        while s >= self.base:
            a, b = map(int, self.sides[s - self.base])
            left = int(self.lengths[a - self.base]) if a >= self.base else 1
            s, j = (a, j) if j < left else (b, j - left)
        return s

    def documents(self) -> Iterator[np.ndarray]:
        ends = np.cumsum(self.doc_ids, dtype=np.int64)
        flat = self.expand(self.symbols)
        return (flat[b - n:b] for b, n in zip(ends.tolist(), self.doc_ids.tolist()))


def write_shards(docs: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text",
                 end_id: int = END_ID, shard_ids: int = SHARD) -> None:
    """Encode all documents in key order and write them as shards under ``folder``."""
    arrow_batches(docs.sparkSession, TOKEN_ROWS)
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = OrderedBlocks(narrow)
    dealt = blocks.deal(narrow, blocks.order(), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        block, number = None, 0
        keys, counts, parts, held = [], [], [], 0

        def close():
            nonlocal keys, counts, parts, held, number
            payload = encode_shard(np.concatenate(parts), counts)
            out = pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int64()), "shard": pa.array([number], pa.int64()),
                "doc_ids": pa.array([keys], pa.list_(pa.int64())), "n_tokens": pa.array([held], pa.int64()),
                "n_symbols": pa.array([struct.unpack_from("<I", payload, 12)[0]], pa.int64()), "payload": pa.array([payload], pa.binary())})
            keys, counts, parts, held, number = [], [], [], 0, number + 1
            return out

        for batch in batches:
            n, flat = coder.encode(batch.column("text"))
            ends = np.cumsum(n)
            for k, b, a, z in zip(batch.column("doc_id").to_pylist(), batch.column("block").to_pylist(),
                                  (ends - n).tolist(), ends.tolist()):
                if b != block:
                    if keys:
                        yield close()
                    block, number = b, 0
                keys.append(k)
                counts.append(z - a + 1)
                parts += [flat[a:z], np.array([end_id], "<u4")]
                held += z - a + 1
                if held >= shard_ids:
                    yield close()
        if keys:
            yield close()

    dealt.mapInArrow(run, SHARDS).write.options(**ROW_GROUPS).parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the shards under ``folder``: key, place in the whole, number of ids, and their crc32."""
    arrow_batches(spark)
    shards = spark.read.schema(SHARDS).parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, s, keys, payload in zip(*(batch.column(c) for c in ("block", "shard", "doc_ids", "payload"))):
                ids = list(Shard(payload.as_py()).documents())
                n = np.array([len(x) for x in ids], np.int64)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([b.as_py()] * len(n), pa.int64()), "shard": pa.array([s.as_py()] * len(n), pa.int64()),
                    "doc_id": keys.values.cast(pa.int64()), "inner": pa.array(np.cumsum(n) - n, pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())})

    rows = shards.select("block", "shard", "doc_ids", "payload").mapInArrow(
        run, "block long, shard long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    sizes = shards.select("block", "shard", "n_tokens")
    # one row a block, and there are no more blocks than cuts
    whole = sizes.groupBy("block").agg(F.sum("n_tokens").alias("n")).select(
        "block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("block_start"))
    inside = sizes.select("block", "shard", (F.sum("n_tokens").over(Window.partitionBy("block").orderBy("shard"))
                                             - F.col("n_tokens")).alias("shard_start"))
    starts = inside.join(whole, "block").select("block", "shard", (F.col("block_start") + F.col("shard_start")).alias("begin"))
    return rows.join(starts, ["block", "shard"]).select(
        "doc_id", (F.col("begin") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
