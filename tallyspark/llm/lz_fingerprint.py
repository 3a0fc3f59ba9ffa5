"""Lempel-Ziv phrase fingerprints (dealt operator 4).

A text's UTF-8 bytes are parsed into dictionary phrases: the next phrase is the
shortest stretch that is not a phrase yet, so it is a known phrase and one more
byte.  A phrase's 64-bit hash follows from its parent's, so hashing costs
nothing per byte.  The fingerprint is the MinHash signature of the phrase set:
for each of ``PERMUTATIONS`` multiply-add permutations the smallest value, of
which 16 bits are kept and shown as four hexadecimal digits.  The likeness of
two fingerprints is their share of equal values, an estimate of the Jaccard
similarity of the phrase sets.

Equal texts have equal fingerprints.  An empty (or null) text has no phrase;
its fingerprint is all ``ffff``, alike to itself (1) and to nothing else (0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import OrderedBlocks, arrow_batches

PERMUTATIONS = 128
SEED, STEP, MASK = 0x9E3779B97F4A7C15, 0x100000001B3, (1 << 64) - 1
EMPTY = "ffff" * PERMUTATIONS
_draw = np.random.default_rng(4)
SCALE = _draw.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


class Parse:
    """A running parse: phrases so far, and the open phrase."""

    def __init__(self):
        self.child: dict[int, int] = {}  # phrase number * 256 + byte -> phrase number
        self.hashes: list[int] = [SEED]  # by phrase number; 0 is the empty phrase
        self.open, self.folded = 0, 1  # phrases before ``folded`` are in ``least``
        self.least = np.full(PERMUTATIONS, MASK, np.uint64)

    def copy(self) -> Parse:
        out = Parse.__new__(Parse)
        out.child, out.hashes, out.open = self.child.copy(), self.hashes.copy(), self.open
        out.folded, out.least = self.folded, self.least
        return out

    def feed(self, data: bytes) -> Parse:
        child, hashes, node = self.child, self.hashes, self.open
        find = child.get
        for byte in data:
            key = node << 8 | byte
            down = find(key)
            if down is None:
                child[key] = len(hashes)
                h = (hashes[node] ^ byte + 1) * STEP & MASK
                hashes.append(h ^ h >> 29)
                node = 0
            else:
                node = down
        self.open = node
        return self

    def fold(self) -> Parse:
        """Take the phrases found since the last call into the running minima."""
        h = np.array(self.hashes[self.folded:], np.uint64)
        for a in range(0, len(h), 4096):
            self.least = np.minimum(self.least, (h[None, a:a + 4096] * SCALE[:, None] + SHIFT[:, None]).min(axis=1))
        self.folded = len(self.hashes)
        return self

    def signature(self) -> np.ndarray | None:
        """The 16-bit MinHash values; None without a phrase."""
        if len(self.hashes) == 1:
            return None
        return mixed(self.fold().least).astype(np.uint16)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: minima of long texts are small, so their bits are spread over the whole word."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shown(signature: np.ndarray | None) -> str:
    return EMPTY if signature is None else signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is None and b is None)
    return float((a == b).mean())


def fingerprint(text: str | None) -> str:
    """The fingerprint of one text."""
    return shown(Parse().feed((text or "").encode()).signature())


def text_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every row, without a shuffle."""
    arrow_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t) for t in texts.to_pylist()], pa.string())

    return docs.select(F.col(key).cast("long").alias("doc_id"), prints(text).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, compared with each other and with the next document.

    The edited text has the last third of its code points replaced by the first
    as many (or all) of the next document; *next* is by descending key, and
    after the last comes the first.  Equal keys follow each other by text; null
    keys come last.  A single document is its own next.

    Rows are dealt to blocks of consecutive keys.  The first document of a
    block is also sent to the block before it (one extra row a block), so every
    document meets its next one while a task streams through a block; a task
    holds two documents and one Arrow batch.  The parse of the kept two thirds
    and its minima are shared by both texts.
    """
    arrow_batches(docs.sparkSession)
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = OrderedBlocks(narrow)
    order = blocks.order()
    # at most one row a block
    tops = sorted((r["block"], r["top"]) for r in narrow.groupBy(blocks.block().alias("block"))
                  .agg(F.max(order).alias("top")).collect())
    own = narrow.select("doc_id", "text", blocks.block().alias("block"), F.lit(False).alias("guest"))
    dealt = own
    if tops:
        host = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}
        guests = narrow.filter(order.isin(list(host)))
        to = F.create_map(*[F.lit(x) for pair in host.items() for x in pair])[order]
        dealt = own.unionByName(guests.select("doc_id", "text", to.cast("long").alias("block"), F.lit(True).alias("guest")))
    dealt = blocks.deal(dealt, F.col("guest"), order.desc(), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, before = None, None  # before: (doc_id, text, parse of its first part, signature)
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        for batch in batches:
            rows = []
            for doc, whole, b, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "block", "guest"))):
                if b == block and before is None:
                    continue  # further guests: rows that share the first one's key
                cut = len(whole) - len(whole) // 3
                part = Parse().feed(whole[:cut].encode()).fold()
                now = (part.copy() if not guest else part).feed(whole[cut:].encode()).signature()
                if b == block:
                    k, was, half, sig = before
                    tail = whole[:len(was) // 3]
                    sha = hashlib.sha256((was[:len(was) - len(was) // 3] + tail).encode()).hexdigest()
                    edited = half.feed(tail.encode()).signature()
                    rows.append((k, len(was), sha, shown(sig), shown(edited), likeness(sig, edited), likeness(sig, now)))
                before, block = None if guest else (doc, whole, part, now), b
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")
