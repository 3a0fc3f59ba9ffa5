"""Byte-level BPE by a global shuffle of distinct words (dealt operator 11).

``encode_words`` works in three steps:

1. Each Arrow batch of documents is a *block*.  Its texts are exploded into
   pre-tokens (the pattern's matches), numbered within the block, the most
   frequent first; the numbers in reading order are the block's positions.  A
   word goes to the shuffle once for each block that holds it.
2. Words meet by their hash, and each distinct one is encoded once.
3. Ids go back to the blocks, where the positions put them together again.

Words, ids and positions travel in compressed columns, one row for each block
and word bucket: with one row for each occurrence the shuffle would be several
times the input.  A word of every block is one entry a block, so a frequent
word weighs nothing.  Blocks follow from the scan's splits and the session's
batch bounds alone, so tasks that run again make the same ones.

``decode_ids`` joins ids with the vocabulary's table of token bytes; the table
is bounded by the vocabulary, and ids are its row numbers.

Null texts count as empty and have no ids.  Each row gives one row, repeated
ones and those with a null key too; an empty table gives none.  A very long
text is a block of its own.  Columns other than key and text are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import arrow_batches, process_cache, shuffle_partitions
from tallyspark.llm.units import cut_units, gather

#: Texts may be cut at the safe places of ``units`` under this pattern (a fixed value of byte-level BPE).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows and bytes of a block, and distinct words that a task remembers.
BLOCK_ROWS, BLOCK_BYTES, KNOWN_WORDS = 1 << 14, 16 << 20, 1 << 20
#: Rows on their way: a block's positions, or its words or ids of one bucket.
POSITIONS, WORDS = 0, 1
TRAVEL = "slot long, block long, kind int, docs array<long>, sizes array<long>, numbers binary, lengths binary, data binary"
TRAVEL_NAMES = [c.split()[0] for c in TRAVEL.split(", ")]
TRAVEL_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]


def packed(values: np.ndarray) -> bytes:
    """Non-negative numbers below 2^32, byte planes apart, compressed."""
    return zstandard.ZstdCompressor(1).compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: base64 and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class WordEncoder:
    """The library's encoder of single pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        self.one = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})._encode_single_piece

    def encode(self, words: list[bytes], known: dict[bytes, tuple[int, ...]]) -> list[tuple[int, ...]]:
        """Ids of words; ``known`` is what a task has encoded before, and starts afresh when it is full."""
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = tuple(self.one(w))
        return [known[w] for w in words]


class TokenBytes:
    """The bytes of all tokens one after another, and where each begins."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)


def kept(kind: type, *args):
    """This worker's object of a kind, made once."""
    cache, key = process_cache("words"), (kind.__name__, *args)
    if key not in cache:
        cache[key] = kind(*args)
    return cache[key]


def row(slot: int, block: int, kind: int, docs=None, sizes=None, numbers=b"", lengths=b"", data=b"") -> tuple:
    return slot, block, kind, docs, sizes, numbers, lengths, data


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TRAVEL_TYPES)], TRAVEL_NAMES)


def explode_block(block: int, docs: pa.Array, texts: pa.Array, pattern: str, buckets: int) -> list[tuple]:
    """A block's positions and, by bucket, its distinct words."""
    if pattern == BYTE_PATTERN:
        lists = cut_units(texts)
    else:
        lists = pa.LargeListArray.from_arrays(pa.array(range(len(texts) + 1), pa.int64()), texts.cast(pa.large_string()))
    units = lists.flatten().dictionary_encode()
    words: dict[str, int] = {}
    found, sizes = [], []
    find = regex.compile(pattern).findall
    for unit in units.dictionary.to_pylist():
        cut = find(unit)
        sizes.append(len(cut))
        found += cut
    of_units = np.fromiter((words.setdefault(w, len(words)) for w in found), np.int32, len(found))
    sizes = np.array(sizes, np.int64)
    index = units.indices.to_numpy()
    positions = gather((np.cumsum(sizes) - sizes)[index], sizes[index], of_units)
    ends = np.concatenate([[0], np.cumsum(sizes[index])])
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))])
    # the most frequent words get the smallest numbers, which compress best
    order = np.argsort(-np.bincount(positions, minlength=len(words)), kind="stable")
    number = np.empty(len(words), np.int32)
    number[order] = np.arange(len(words))
    out = [row(block % buckets, block, POSITIONS, docs.to_pylist(), np.diff(ends[first]).tolist(), packed(number[positions]))]
    data = [w.encode() for w in words]
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in data), np.int64, len(data))
    dealt = np.lexsort((number, bucket))
    cuts = np.flatnonzero(np.diff(bucket[dealt])) + 1
    for part in np.split(dealt, cuts) if len(dealt) else []:
        some = [data[i] for i in part.tolist()]
        out.append(row(int(bucket[part[0]]), block, WORDS, numbers=packed(np.diff(number[part], prepend=0)),
                       lengths=packed(np.array([len(w) for w in some])), data=zstandard.ZstdCompressor(1).compress(b"".join(some))))
    return out


def encode_bucket(batch: pa.RecordBatch, coder: WordEncoder, known: dict) -> pa.RecordBatch:
    """Words of a batch replaced by their ids; positions as they are."""
    rows = []
    for slot, block, kind, docs, sizes, numbers, lengths, data in zip(*(c.to_pylist() for c in batch.columns)):
        if kind == WORDS:
            text, ends = zstandard.ZstdDecompressor().decompress(data), np.cumsum(unpacked(lengths)).tolist()
            ids = coder.encode([text[a:z] for a, z in zip([0, *ends], ends)], known)
            lengths, data = packed(np.array([len(i) for i in ids])), packed(np.array([x for i in ids for x in i], np.int64))
        rows.append(row(slot, block, kind, docs, sizes, numbers, lengths, data))
    return to_batch(rows)


def join_block(table: pa.Table) -> pa.Table:
    """A block's documents with their ids, from its positions and the ids of its words."""
    numbers, lengths, ids, where = [], [], [], None
    for _, _, kind, docs, sizes, some, lens, data in zip(*(c.to_pylist() for c in table.columns)):
        if kind == POSITIONS:
            where = docs, np.array(sizes, np.int64), unpacked(some)
        else:
            numbers.append(np.cumsum(unpacked(some)))
            lengths.append(unpacked(lens))
            ids.append(unpacked(data))
    docs, sizes, positions = where
    begin, size = np.zeros((2, sum(map(len, numbers))), np.int32)
    if numbers:
        n, each = np.concatenate(numbers), np.concatenate(lengths)
        size[n], begin[n] = each, np.cumsum(each) - each
    flat = gather(begin[positions], size[positions], np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int32))
    ends = np.concatenate([[0], np.cumsum(size[positions])])[np.concatenate([[0], np.cumsum(sizes)])]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
    return pa.table([pa.array(docs, pa.int64()), lists], ["doc_id", "ids"])


def encode_words(docs: DataFrame, path: str, pattern: str = BYTE_PATTERN, key: str = "doc_id", text: str = "text",
                 decoded: bool = False) -> DataFrame:
    """``(doc_id long, ids array<int>)`` of each row of ``docs``, by the rank file at ``path``.

    ``decoded`` adds the bytes that the ids stand for, as ``decode_ids`` does, in the same task.
    """
    spark = docs.sparkSession
    arrow_batches(spark, BLOCK_ROWS, BLOCK_BYTES)
    buckets = shuffle_partitions(spark)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                yield to_batch(explode_block(number, batch.column(0), batch.column(1), pattern, buckets))
                pa.default_memory_pool().release_unused()
                number += 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, known = kept(WordEncoder, path, pattern), {}
        for batch in batches:
            if batch.num_rows:
                yield encode_bucket(batch, coder, known)

    words = docs.select(F.col(key).cast("long"), F.coalesce(F.col(text), F.lit(""))).mapInArrow(explode, TRAVEL)
    ids = words.repartition(buckets, "slot").mapInArrow(encode, TRAVEL)

    def join(table: pa.Table) -> pa.Table:
        out = join_block(table)
        if decoded:
            out = out.append_column("decoded", decode_lists(out["ids"].chunk(0), kept(TokenBytes, path)))
        pa.default_memory_pool().release_unused()
        return out

    return ids.groupBy("block").applyInArrow(join, "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def decode_lists(lists: pa.Array, table: TokenBytes) -> pa.Array:
    """The bytes of each list of ids: ids joined with the table of token bytes, whose row numbers they are."""
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    each = table.size[flat]
    data = gather(table.begin[flat], each, table.data)
    count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(count)])]
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
    return pc.if_else(lists.is_valid(), out, None).cast(pa.binary())


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` and the bytes of its ids, from the token-byte table at ``path``; null for null ids."""

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        return decode_lists(lists, kept(TokenBytes, path))

    return encoded.withColumn(to, decode(F.col(ids)))
