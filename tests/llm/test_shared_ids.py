"""Rows that share a ``doc_id``, or have none, with texts of their own."""

import collections
import zlib

from helpers import awkward
from pyspark.sql import functions as F

from tallyspark.llm import simhash
from tallyspark.llm.queries import held_out

A = "the first text has words of its own that no other row of the table holds anywhere at all"
B = "quite another passage stands here and it speaks about rivers mountains and the long way home"


def test_op7_one_key_on_two_texts(spark):
    """Unrelated texts of one key both stay."""
    got = simhash.keep_one(awkward(spark, [(1, A, "en"), (1, B, "en"), (1, B, "en"), (None, A + " x y z", "en")]))
    texts = collections.Counter((r["doc_id"], r["text"]) for r in got.collect() if r["doc_id"] is not None)
    assert texts == {(1, A): 1, (1, B): 1}


def test_op7_a_copy_does_not_stay_for_its_key(spark):
    """Row (2, A) is a copy of row (1, A); that (2, B) stays does not keep it."""
    got = simhash.keep_one(awkward(spark, [(1, A, "en"), (2, A, "en"), (2, B, "en")])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, A), (2, B)]


def test_columns_named_like_the_helpers_come_back(spark):
    docs = awkward(spark, [(1, A, "en"), (2, A, "en"), (None, B, "en")])
    docs = docs.withColumn("__key", F.lit("k")).withColumn("__fp", F.lit(7)).withColumn("__row", F.lit(0.5))
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["__key"], r["__fp"], r["__row"]) for r in got.collect()) == [
        (0, "k", 7, 0.5), (1, "k", 7, 0.5)]


def test_held_out_is_never_null(spark):
    rows = spark.createDataFrame([(1,), (None,), (5,)], "doc_id long").select("doc_id", held_out().alias("h")).collect()
    assert {r["doc_id"]: r["h"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in (1, 5)} | {None: False}
