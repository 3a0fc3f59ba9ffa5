"""Fuzzy line deduplication (dealt operator 3).

Lines are stretches between line feeds; white space around a line does not
count, and lines without anything else are left alone.  A line's content is its
set of ``SHINGLE``-character shingles (a shorter line is one shingle).

1. One pass over the texts gives for each distinct line of an Arrow batch a
   64-bit key and its MinHash bands (``BANDS`` bands of ``ROWS`` values, computed
   for all lines of a batch at once).  Equal lines have equal keys: copies meet
   in a partial aggregation and are one node from here on.
2. Nodes are grouped by band; bands of one node only go no further.  Buckets
   with the same members are kept once.
3. Only lines in such buckets are fetched with their text.  Buckets are cut
   into tiles, tile pairs are groups of bounded size, and inside a group every
   pair that is not joined yet is verified by exact Jaccard similarity of the
   shingle sets (at least ``SIMILARITY``).  Groups give spanning forests.
4. ``components`` (a distributed union-find) joins them.  Of all occurrences of
   the lines of a component the first one, by (doc_id, text hash, position),
   stays.

Results: ``dropped_lines`` gives per document the places of its lines that go;
``dedup_lines`` the documents without them.  A document all of whose lines go
keeps an empty text.  Null texts have no line and stay null.  A document is a
distinct (doc_id, text): rows that share a ``doc_id``, or have none, are cleaned
each for itself, in the order of their texts' 64-bit hashes; equal rows are one
document and stay equal; a null ``doc_id`` comes first.  Empty tables give no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import NULL_KEY, arrow_batches, components, local_roots, process_cache, written

SHINGLE, SIMILARITY = 7, 0.8
#: A pair at the threshold shares a band with probability 0.99, one of similarity 0.9 with 0.99999.
BANDS, ROWS = 12, 5
#: Lines of a tile, and characters hashed at once: what a core's cache holds.
TILE, CHARS = 2048, 1 << 16
#: Characters of the small groups that are verified at once.
GROUP_CHARS = 1 << 18
_draw = np.random.default_rng(3)
SCALE = _draw.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFT = _draw.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32)
POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(SHINGLE)], np.uint64)
#: White space around lines, for Python and for Spark's trim.
SPACE = " \t\r\x0b\x0c"
#: One match for each line that holds anything else.
CONTENT = r"[^ \t\r\x0b\x0c\n][^\n]*"


def row_hash(text: str) -> Column:
    """Tells texts with the same ``doc_id`` apart."""
    return F.xxhash64(F.col(text))


def line_key(line: str) -> int:
    """Spark's ``xxhash64`` of the line."""
    key = xxhash.xxh64_intdigest(line.encode(), 42)
    return key - (1 << 64) if key >> 63 else key


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of the lines, one line after another, and the lines' first places."""
    sizes = np.array([max(len(x), SHINGLE) for x in lines], np.int64)
    starts = np.cumsum(sizes) - sizes
    chars = np.frombuffer("".join([x.ljust(SHINGLE, "\0") for x in lines]).encode("utf-32-le"), "<u4").astype(np.uint64)
    chars += np.uint64(1)
    n = len(chars) - SHINGLE + 1
    h = chars[:n] * POWERS[0]
    one = np.empty_like(h)
    for i in range(1, SHINGLE):
        h += np.multiply(chars[i:n + i], POWERS[i], out=one)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    counts = sizes - SHINGLE + 1
    keep = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return h[keep], np.cumsum(counts) - counts


def band_keys(lines: list[str]) -> np.ndarray:
    """For each line the 64-bit keys of its bands."""
    if not lines:
        return np.zeros((0, BANDS), np.int64)
    hashes, starts = shingle_hashes(lines)
    low = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    out = np.empty((len(lines), BANDS), np.uint64)
    value = np.empty_like(low)
    for band in range(BANDS):
        key = np.full(len(lines), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            np.multiply(low, SCALE[k], out=value)
            value += SHIFT[k]
            key = (key ^ np.minimum.reduceat(value, starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        out[:, band] = key
    return out.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted arrays of distinct values."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def near_first(lines: list[str], first: np.ndarray, similarity: float) -> np.ndarray:
    """For each line whether it is near the first line of its group, for many groups at once.

    ``first`` is the number of the group's first line; groups come one after another.
    """
    hashes, starts = shingle_hashes(lines)
    line = np.repeat(np.arange(len(lines)), np.diff(np.append(starts, len(hashes))))
    number = np.cumsum(first == np.arange(len(lines))) - 1
    order = np.argsort(hashes)
    hashes = hashes[order]
    value = np.zeros(len(hashes), np.int64)  # number of the hash
    np.cumsum(hashes[1:] != hashes[:-1], out=value[1:])
    # distinct hashes of the lines, by hash and line, so that a group's lines with the hash follow each other
    bits = len(lines).bit_length()
    both = np.sort(value << bits | line[order])
    both = both[np.append(True, both[1:] != both[:-1])]
    value, line = both >> bits, both & ((1 << bits) - 1)
    group = number[line]
    run = np.ones(len(line), bool)  # first of its group and hash
    run[1:] = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
    begins = line[run]
    shared = (begins == first[begins])[np.cumsum(run) - 1]
    size = np.bincount(line, minlength=len(lines))
    common = np.bincount(line[shared], minlength=len(lines))
    return common / (size + size[first] - common) >= similarity


def linked_groups(groups: list[tuple[list[int], list[str], list[int]]], similarity: float) -> list[tuple[int, int]]:
    """Links ``(node, node)`` of groups ``(nodes, lines, tiles)`` whose pairs of at least ``similarity`` are joined.

    Groups of one tile are compared with their first line at once; where a line
    is not near it, the group's other pairs are verified one by one.
    """
    out, single = [], []
    for nodes, lines, tiles in groups:
        tile = np.array(tiles)
        if tile.min() == tile.max():
            single.append((nodes, lines, tile))
        else:
            out += [(nodes[i], nodes[r]) for i, r in enumerate(verified_links(lines, tile, similarity)) if i != r]
    if not single:
        return out
    sizes = np.array([len(nodes) for nodes, _, _ in single])
    starts = np.cumsum(sizes) - sizes
    near = near_first([x for _, lines, _ in single for x in lines], np.repeat(starts, sizes), similarity)
    for (nodes, lines, tile), start, whole in zip(single, starts.tolist(), np.logical_and.reduceat(near, starts).tolist()):
        if whole:
            out += [(x, nodes[0]) for x in nodes[1:]]
        elif len(lines) > 2:
            root = [0 if x else i for i, x in enumerate(near[start:start + len(nodes)].tolist())]
            out += [(nodes[i], nodes[r]) for i, r in enumerate(verified_links(lines, tile, similarity, root)) if i != r]
    return out


def verified_links(lines: list[str], tile: np.ndarray, similarity: float, root: list[int] | None = None) -> list[int]:
    """Smallest member of each line's set, joining pairs of at least ``similarity``.

    With two tiles, pairs inside one of them are left to other groups.  Pairs
    that are joined already, or in ``root``, need no verification.
    """
    sets = []
    for start in range(0, len(lines), 256):
        part = lines[start:start + 256]
        hashes, at = shingle_hashes(part)
        for x in np.split(hashes, at[1:]):
            x.sort()
            sets.append(x[np.append(True, x[1:] != x[:-1])])
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    root = root or list(range(len(lines)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    two = tile.min() != tile.max()
    ordered = size[order]
    for k, i in enumerate(order.tolist()):
        # larger sets up to the size from which the similarity cannot be reached
        stop = np.searchsorted(ordered, size[i] / similarity + 1e-9, "right")
        for j in order[k + 1:stop].tolist():
            if two and tile[i] == tile[j]:
                continue
            a, b = find(i), find(j)
            if a != b and jaccard(sets[i], sets[j]) >= similarity:
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(lines))]


def occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc_id, row, pos, line, bands)`` of each line, ``row`` being its text's hash; bands only where a batch sees the line first."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_cache("lines")  # nothing is kept, nor what the worker kept before
        for batch in batches:
            ids, rows, places, numbers, first = [], [], [], [], {}
            for doc, row, whole in zip(*(c.to_pylist() for c in batch.columns)):
                for pos, line in enumerate(whole.split("\n")):
                    if line := line.strip(SPACE):
                        ids.append(doc)
                        rows.append(row)
                        places.append(pos)
                        numbers.append(first.setdefault(line, len(first)))
            distinct, bands, start = list(first), [np.zeros((0, BANDS), np.int64)], 0
            while start < len(distinct):
                size, stop = 0, start
                while stop < len(distinct) and (stop == start or size < CHARS):
                    size += len(distinct[stop])
                    stop += 1
                bands.append(band_keys(distinct[start:stop]))
                start = stop
            number = np.array(numbers, np.int64)
            # numbers were given in the order of first places
            fresh = np.diff(np.maximum.accumulate(number), prepend=-1) > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(places, pa.int32()),
                 pa.array(np.array([line_key(x) for x in distinct], np.int64)[number]),
                 pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(fresh * BANDS)), pa.int32()), pa.array(np.concatenate(bands).ravel()),
                                          mask=pa.array(~fresh))],
                ["doc_id", "row", "pos", "line", "bands"])

    return keyed(docs, key, text).mapInArrow(run, "doc_id long, row long, pos int, line long, bands array<long>")


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc_id, row, text)`` of the rows with a text."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("doc_id"), row_hash(text).alias("row"),
                       F.col(text).alias("text")).filter("text is not null")


def line_components(docs: DataFrame, seen: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    """``(line, root)`` of all lines that have a near copy, roots among them."""
    member = (seen.filter("bands is not null").select("line", F.explode("bands").alias("band")))
    # one row a band: how many nodes and which set of them, without gathering them
    bucket = (member.groupBy("band").agg(F.min("line").alias("low"), F.max("line").alias("high")).filter("low < high")
              .select("band"))
    inside = member.join(bucket, "band").distinct()
    inside = written(inside, "buckets")
    content = inside.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.hash("line").cast("long")).alias("s"),
                                         F.bit_xor(F.xxhash64("line")).alias("x"))
    distinct = content.groupBy("n", "s", "x").agg(F.min("band").alias("band")).select("band", "n")
    tiled = (inside.join(distinct, "band")
             .withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
             .withColumn("tile", F.pmod(F.xxhash64("line"), F.col("tiles")).cast("int"))
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("line", "band", "tile", F.least("tile", "with").alias("low"), F.greatest("tile", "with").alias("high")))
    tiled = written(tiled, "tiles")
    # the text of each line that is needed, from one of the occurrences that a batch saw first
    wanted = (seen.filter("bands is not null").select("line", "doc_id", "row", "pos").join(tiled.select("line").distinct(), "line")
              .groupBy("line").agg(F.min(F.struct("doc_id", "row", "pos")).alias("at")).select("line", "at.*"))
    places = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("line", "pos")).alias("want"))
    # the wanted places are the small side: hashing them spares a sort of the texts
    texts = (keyed(docs, key, text).join(places.hint("shuffle_hash"), ["doc_id", "row"])
             .select(F.split(F.col("text"), "\n", -1).alias("all"), F.explode("want").alias("w"))
             .select("w.line", F.trim(F.expr("get(all, w.pos)"), F.lit(SPACE)).alias("text"))
             .filter(F.xxhash64("text") == F.col("line"))
             .groupBy("line").agg(F.max("text").alias("text")))
    names = ["band", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a group is a run of rows; its last rows may come with the next batch
        group, lines, nodes, tiles, waiting, chars = None, [], [], [], [], 0

        def links() -> pa.RecordBatch:
            found = linked_groups(waiting, similarity)
            waiting.clear()
            u, v = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            for at, line, text, tile in zip(zip(*(batch.column(n).to_pylist() for n in names)),
                                            *(batch.column(n).to_pylist() for n in ("line", "text", "tile"))):
                if at != group:
                    if len(lines) > 1:
                        waiting.append((nodes, lines, tiles))
                        chars += sum(map(len, lines))
                        if chars >= GROUP_CHARS:
                            yield links()
                            chars = 0
                    group, lines, nodes, tiles = at, [], [], []
                lines.append(text)
                nodes.append(line)
                tiles.append(tile)
        if len(lines) > 1:
            waiting.append((nodes, lines, tiles))
        if waiting:
            yield links()

    grouped = tiled.join(texts, "line").select("line", "tile", "text", *names).repartition(*names).sortWithinPartitions(*names)
    edges = grouped.mapInArrow(run, "u long, v long")
    linked = components(edges).select(F.col("node").alias("line"), "root")
    return linked.unionByName(linked.select(F.col("root").alias("line"), "root").distinct())


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id`` (nulls as ``NULL_KEY``), ``row`` (``row_hash``) and ``dropped``, the ascending places of lines that have an earlier near copy."""
    seen = written(occurrences(docs, key, text), "lines")
    roots = line_components(docs, seen, key, text, similarity)
    place = F.struct("doc_id", "row", "pos")
    # one row a line, then one a component: a join meets written tables only, so that hot lines and roots can be split
    lines = seen.groupBy("line").agg(F.count("*").alias("n"), F.min(place).alias("first")).join(roots, "line", "left")
    lines = written(lines.select("line", "root", "n", "first").filter("n > 1 or root is not null"), "firsts")
    near = lines.filter("root is not null")
    first = written(near.groupBy("root").agg(F.min("first").alias("first")), "roots")
    begins = written(lines.filter("root is null").select("line", "first")
                     .unionByName(near.select("line", "root").join(first, "root").select("line", "first")), "begins")
    gone = seen.select("line", "doc_id", "row", "pos").join(begins, "line").filter(place > F.col("first"))
    return gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def with_dropped(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows``, which have ``__id`` and ``__row_hash``, with their ``__dropped`` places or null."""
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row_hash"), F.col("dropped").alias("__dropped"))
    return rows.join(gone, ["__id", "__row_hash"], "left")


def dedup_report(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per document: ``n_lines`` with content, ``n_dropped`` and the ``dropped`` places; texts are not shuffled for it."""
    gone = dropped_lines(docs, key, text, similarity)
    whole = docs.select(F.col(key).cast("long").alias("doc_id"), row_hash(text).alias("__row_hash"),
                        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(CONTENT)).cast("long").alias("n_lines"))
    return (with_dropped(whole.withColumn("__id", F.coalesce("doc_id", F.lit(NULL_KEY))), gone)
            .select("doc_id", "n_lines", F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"),
                    F.coalesce("__dropped", F.array().cast("array<int>")).alias("dropped")))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the later near copies of lines taken out of their texts."""
    gone = dropped_lines(docs, key, text, similarity)
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("__id"),
                       row_hash(text).alias("__row_hash"))
    rows = with_dropped(rows, gone)
    lines = F.filter(F.split(F.col(f"__row.{text}"), "\n", -1), lambda x, i: ~F.array_contains("__dropped", i))
    clean = F.when(F.col("__dropped").isNull(), F.col(f"__row.{text}")).otherwise(F.array_join(lines, "\n"))
    return rows.select(*[clean.alias(text) if c == text else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
