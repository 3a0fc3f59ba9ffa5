"""SimHash near-duplicates by tiled exact comparison (dealt operator 7).

Fingerprint: words are stretches of bytes other than 0x20 and 0x09-0x0D after
A-Z became a-z; shingles are ``width`` words joined by spaces, repeats
included; fewer words make one shingle, no word gives fingerprint 0.  A bit is
1 if more than half of the shingles' XXH64 (seed 42) have it.

Links: two fingerprints link if at most ``radius`` bits differ.  Copies share
a fingerprint and are one node.  Of ``radius + 1`` bands of bits, linked
fingerprints agree in one at least, so each band's value deals the nodes to
buckets, and only buckets with two nodes or more go on.  A bucket is cut into
tiles of about ``TILE`` nodes; every pair of tiles is one task-sized group,
however large the bucket.  Inside, fingerprints are sorted by population count
and compared in sub-tiles with numpy exclusive-or and bit counts; sub-tile
pairs whose counts differ by more than the radius are skipped.  A group gives
the links of a spanning forest, not all its pairs, and ``components`` joins the
forests.

Null texts count as empty.  Rows that share a ``doc_id`` each give a row; a
null ``doc_id`` never names a component unless all its members are null.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import NULL_KEY, arrow_batches, components, local_roots, written

WIDTH, RADIUS, SEED = 3, 2, 42
#: Nodes of a tile, and of a sub-tile that is compared at once.
TILE, SUBTILE = 8192, 1024


def simhash(data: bytes, width: int = WIDTH) -> int:
    """64-bit fingerprint of UTF-8 bytes."""
    import xxhash
    words = data.lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    text, hashed = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - width + 1
    if n <= 1:
        hashes = [hashed(text, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        begins = ends - size
        hashes = [hashed(text[a:b], SEED) for a, b in zip(begins[:n].tolist(), ends[width - 1:].tolist())]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def print_udf(width: int):
    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash((t or "").encode(), width) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return prints


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id`` and the fingerprint ``fp`` as a signed long."""
    arrow_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), print_udf(width)(text).alias("fp"))


def tile_links(fps: np.ndarray, other: np.ndarray | None, radius: int) -> Iterator[tuple[int, int]]:
    """Links between two tiles (or inside one), as places in ``concatenate([fps, other])``."""
    def sub(values: np.ndarray, first: int):
        counts = np.bitwise_count(values).astype(np.int64)
        order = np.argsort(counts, kind="stable")
        for a in range(0, len(order), SUBTILE):
            at = order[a:a + SUBTILE]
            yield at + first, values[at], counts[at[0]], counts[at[-1]]

    left = list(sub(fps, 0))
    right = left if other is None else list(sub(other, len(fps)))
    for i, (at, x, low, high) in enumerate(left):
        for to, y, least, most in right[i:] if other is None else right:
            if least - high > radius or low - most > radius:
                continue
            a, b = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            for u, v in zip(at[a].tolist(), to[b].tolist()):
                if u != v:
                    yield u, v


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(u, v)`` that join all linked fingerprints of ``nodes (fp)``, which are distinct."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    keys = [F.struct(F.lit(i).alias("band"),
                     F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    banded = nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.band", "k.value")
    sizes = banded.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    dealt = (banded.join(sizes, ["band", "value"])
             .withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("fp", "band", "value", "tile", F.least("tile", "with").alias("low"), F.greatest("tile", "with").alias("high")))

    def run(table: pa.Table) -> pa.Table:
        fps, tile = table.column("fp").to_numpy().view(np.uint64), table.column("tile").to_numpy()
        first = tile == table.column("low")[0].as_py()
        alone = table.column("low")[0] == table.column("high")[0]
        both = fps if alone else np.concatenate([fps[first], fps[~first]])
        root = np.array(local_roots(len(both), tile_links(fps, None, radius) if alone else
                                    tile_links(fps[first], fps[~first], radius)), np.int64)
        own = np.flatnonzero(root != np.arange(len(both)))
        node = both.view(np.int64)
        return pa.table({"u": node[own], "v": node[root[own]]}, pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return dealt.groupBy("band", "value", "low", "high").applyInArrow(run, "u long, v long")


def print_groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, component_id)`` of each fingerprint of ``prints (doc_id, fp)``."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    joined = components(links(nodes.select("fp"), radius))
    rooted = (nodes.join(joined, nodes["fp"] == joined["node"], "left")
              .select("fp", "doc_id", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                radius: int = RADIUS) -> DataFrame:
    """``doc_id``, hexadecimal ``fingerprint`` and ``component_id`` (the smallest ``doc_id`` reachable) of each row."""
    prints = written(fingerprints(docs, key, text, width), "simhash")
    return prints.join(print_groups(prints, radius), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose key is their group's smallest; of rows with the same key and fingerprint one.

    A row without a key stays only where its whole group has none.  Rows travel as
    one struct, so that columns of any name come back as they were.
    """
    arrow_batches(docs.sparkSession)
    # a key alone does not tell rows apart: the fingerprint goes along with its row
    rows = written(docs.select(F.struct(*docs.columns).alias("__row"),
                               F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("__key"),
                               print_udf(width)(text).alias("__fp")), "simhash")
    prints = rows.select(F.col(f"__row.`{key}`").cast("long").alias("doc_id"), F.col("__fp").alias("fp"))
    stay = (prints.join(print_groups(prints, radius), "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("fp").alias("__fp"), F.coalesce("doc_id", F.lit(NULL_KEY)).alias("__key")).distinct())
    names = ["__fp", "__key"]
    return rows.join(stay, names, "left_semi").dropDuplicates(names).select("__row.*")
