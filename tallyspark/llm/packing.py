"""Order-preserving packing by dynamic programming (dealt operator 9).

Documents stay in ascending ``doc_id`` order.  Each block of consecutive
documents is cut into sequences of at most ``window`` tokens.  A cut may stand
at a document's end (free), at a sentence's end, or, every ``step`` tokens,
anywhere; the latter two cost a truncation penalty.  With ``p`` the cut places

    cost(j) = penalty(j) + min over i of cost(i) + overhead + padding(p_j - p_i)

where the padding is ``window - length``, or nothing if the length is a power
of two.  The first kind of transition is a sliding-window minimum of
``cost(i) + p_i``, kept in a monotone queue; the second has one candidate for
each power.  So a chunk of ``m`` places takes O(m log window).

Texts are dealt to blocks by quantiles of ``doc_id`` (one shuffle), and each
task streams through its blocks: text in, pieces out, ids never shuffled.  A
chunk closes at the first document end after ``chunk`` tokens, so a task holds
one chunk and one Arrow batch, however large the block is.

Null texts count as empty: such a document still has its end id.  Rows with
equal or null ``doc_id`` are packed one after another (nulls first), each as a
document of its own.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import OrderedBlocks, arrow_batches, process_cache
from tallyspark.llm.units import TOKEN_ROWS, encoder

WINDOW, END_ID = 2048, 1
#: Costs in tokens: a cut after a sentence, a cut elsewhere, and each sequence.
SENTENCE_COST, FREE_COST, SEQUENCE_COST = 4, 24, 32
#: Places for cuts elsewhere stand so many tokens apart; a chunk has at least so many tokens.
FREE_STEP, CHUNK = 32, 1 << 18
#: Units of a full table: fewer than elsewhere, as other stages' memory may stand beside it.
PACK_UNITS = 250_000

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_length long")


def sentence_ends(path: str) -> np.ndarray:
    """For each id, whether its token closes a sentence or holds a line feed."""
    cache, key = process_cache("units"), ("sentence_ends", path)
    if key not in cache:
        vocabulary = encoder(path).whole.get_vocab()
        out = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            out[i] = token.endswith((".", "!", "?", "Ċ"))
        cache[key] = out
    return cache[key]


def best_cuts(places: np.ndarray, costs: np.ndarray, window: int = WINDOW, overhead: float = SEQUENCE_COST) -> list[int]:
    """Ends of the sequences of a cheapest packing.

    ``places`` are ascending cut places from 0 to the number of tokens, at most
    ``window`` apart; ``costs`` their penalties.
    """
    p, c = places.tolist(), costs.tolist()
    # earlier places at the distance of a power of two, by place
    number = np.full(p[-1] + 1, -1, np.int64)
    number[places] = np.arange(len(p))
    pairs = []
    for x in (1 << k for k in range(window.bit_length()) if 1 << k < window):
        late = np.flatnonzero(places >= x)
        early = number[places[late] - x]
        pairs.append(np.stack([late, early])[:, early >= 0])
    late, early = np.concatenate(pairs, 1)
    order = np.argsort(late, kind="stable")
    powers, first = early[order].tolist(), np.searchsorted(late[order], np.arange(len(p) + 1)).tolist()
    best, back = [0.0] * len(p), [0] * len(p)
    queue: deque[int] = deque([0])
    key = [0.0] * len(p)  # best[i] + p[i]
    for j in range(1, len(p)):
        at = p[j]
        while p[queue[0]] < at - window:
            queue.popleft()
        i = queue[0]
        cost = key[i] + window - at
        for h in powers[first[j]:first[j + 1]]:
            if best[h] < cost:
                cost, i = best[h], h
        best[j], back[j] = cost + overhead + c[j], i
        k = key[j] = best[j] + at
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    ends, j = [], len(p) - 1
    while j > 0:
        ends.append(p[j])
        j = back[j]
    return ends[::-1]


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, closes: np.ndarray, step: int = FREE_STEP):
    """Cut places of a chunk and their penalties."""
    cost = np.full(len(ids) + 1, np.inf)
    cost[::step] = FREE_COST
    cost[1:][closes[np.minimum(ids, len(closes) - 1)]] = SENTENCE_COST
    cost[doc_ends] = 0
    cost[0] = cost[-1] = 0
    places = np.flatnonzero(cost < np.inf)
    return places, cost[places]


def pack_chunk(keys: list, counts: list[int], ids: np.ndarray, closes: np.ndarray, first: int, window: int):
    """Pieces of one chunk as rows of ``PIECES``, and the next sequence number."""
    doc_ends = np.cumsum(counts)
    places, costs = cut_places(ids, doc_ends, closes)
    ends = np.array(best_cuts(places, costs, window), np.int64)
    borders = np.unique(np.concatenate([[0], doc_ends, ends]))
    begins, stops = borders[:-1], borders[1:]
    doc = np.searchsorted(doc_ends, begins, "right")
    seq = np.searchsorted(ends, begins, "right")
    doc_start, seq_start = doc_ends - counts, np.concatenate([[0], ends[:-1]])
    raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
    rows = {"doc_id": [keys[d] for d in doc.tolist()], "start": begins - doc_start[doc], "length": stops - begins,
            "ids_crc32": [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begins.tolist(), stops.tolist())],
            "doc_tokens": np.asarray(counts)[doc], "sequence_id": first + seq, "offset": begins - seq_start[seq],
            "sequence_length": (ends - seq_start)[seq]}
    return rows, first + len(ends)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW,
         end_id: int = END_ID, chunk: int = CHUNK) -> DataFrame:
    """Pieces of all documents: which stretch of ids stands where in which sequence."""
    arrow_batches(docs.sparkSession, TOKEN_ROWS)
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = OrderedBlocks(narrow)
    dealt = blocks.deal(narrow, blocks.order(), F.col("text"))
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closes, coder = sentence_ends(path), encoder(path, PACK_UNITS)
        block, number = None, 0
        keys, counts, parts, held = [], [], [], 0

        def close():
            nonlocal keys, counts, parts, held, number
            rows, number = pack_chunk(keys, counts, np.concatenate(parts), closes, number, window)
            keys, counts, parts, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(rows[n], pa.int64()) for n in names], names)

        for batch in batches:
            n, flat = coder.encode(batch.column("text"))
            ends = np.cumsum(n)
            for k, b, a, z in zip(batch.column("doc_id").to_pylist(), batch.column("block").to_pylist(),
                                  (ends - n).tolist(), ends.tolist()):
                if b != block:
                    if keys:
                        yield close()
                    block, number = b, b << 32
                keys.append(k)
                counts.append(z - a + 1)
                parts += [flat[a:z], np.array([end_id], "<u4")]
                held += z - a + 1
                if held >= chunk:
                    yield close()
        if keys:
            yield close()

    return dealt.mapInArrow(run, PIECES)
