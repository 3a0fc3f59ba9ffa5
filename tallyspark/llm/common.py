"""Helpers shared by the operators of this subpackage.

* ``arrow_batches`` keeps Arrow batches small in rows and bytes.
* ``OrderedBlocks`` deals rows into consecutive key ranges, so that one task
  sees a whole range in key order without any global sort on one task.
* ``written`` cuts lineage with a Parquet table in the shared checkpoint
  folder, which survives the loss of executors.
* ``components`` is a distributed union-find on an edge table.
* ``process_cache`` keeps one operator's models and vocabularies between tasks of one worker.
"""

from __future__ import annotations

import sys
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import checkpoint_dir

#: Rows and bytes of one Arrow batch that is handed to a Python worker.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: Key of rows whose ``doc_id`` is null: they sort before every other row.
NULL_KEY = -(1 << 63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches of the session: whole texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def process_cache(owner: str) -> dict:
    """A dictionary that lives until the Python worker process serves another ``owner``.

    Spark hands a worker from one job to the next; what an operator kept in it would
    otherwise stay beside all that later ones load.
    """
    name = "_tallyspark_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    module = sys.modules[name]
    if getattr(module, "owner", None) != owner:
        module.owner, module.kept = owner, {}
        pa.default_memory_pool().release_unused()
    return module.kept


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class OrderedBlocks:
    """Consecutive ranges ("blocks") of an integer key, equal in rows.

    The cuts are quantiles of the narrow key column, so the result does not
    depend on sampling or task retries.  Only the cuts reach the driver: at
    most ``per_partition`` times the shuffle partitions.  Equal keys always
    share a block; null keys sort first.
    """

    def __init__(self, df: DataFrame, key: str = "doc_id", per_partition: int = 4):
        spark = df.sparkSession
        self.key, self.partitions = key, shuffle_partitions(spark)
        wanted = self.partitions * per_partition
        steps = [i / wanted for i in range(1, wanted)]
        row = df.agg(F.percentile_approx(F.col(key), steps, 10 * wanted).alias("q")).first()
        self.cuts = sorted(set(row["q"] or []))

    def order(self) -> Column:
        return F.coalesce(F.col(self.key).cast("long"), F.lit(NULL_KEY))

    def block(self) -> Column:
        """Number of cuts below the key, as a balanced tree of comparisons."""
        key = self.order()

        def tree(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(key <= F.lit(self.cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

        return tree(0, len(self.cuts)).cast("long")

    def deal(self, df: DataFrame, *order: Column) -> DataFrame:
        """Shuffle rows to their blocks (``block`` column), sorted inside."""
        out = df if "block" in df.columns else df.withColumn("block", self.block())
        return out.repartition(self.partitions, "block").sortWithinPartitions("block", *order)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges (u long, v long)``.

    Alternating large-star and small-star steps: every step is a grouped
    minimum and a join on the node.  The minima are written first, as Spark splits
    a node with very many links only where shuffles are right below the join, and
    small ones are broadcast by their size; no component is ever gathered.  Returns ``(node, root)``
    for every node with a link to another one; root is the smallest node.
    """
    def down(df: DataFrame) -> DataFrame:
        return df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())

    cur = written(down(edges), "edges")
    seen = mark(cur)
    while seen[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(written(low, "minima"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), "stars")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(low, "u")
        cur = written(down(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                           .unionByName(small.select("u", F.col("m").alias("v")))), "edges")
        now = mark(cur)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))


def local_roots(n: int, links) -> list[int]:
    """Union-find over ``range(n)``: the smallest member of each one's set."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
