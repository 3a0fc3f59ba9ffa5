"""A corpus pipeline of five stages, each calling one operator of ``tallyspark.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``.  Labels are read from ``sf_dir``.  Null
texts count as empty and fail the quality rules; extra columns are kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import line_dedup, packing, quality, simhash, toxicity
from tallyspark.llm.common import documents, labels, written
from tallyspark.llm.queries import BYTE_BPE, held_out


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's toxicity threshold."""
    rows, model = toxicity.fit_scored(docs, labels(spark, sf_dir), allowed=~held_out(), column="__score")
    return rows.filter(F.col("__score") < toxicity.threshold(model, F.col("lang"))).drop("__score")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs, labels(spark, sf_dir))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that have an earlier near copy; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in packed sequences."""
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [("toxicity", reject_toxic), ("quality_rules", reject_low_quality), ("line_dedup", drop_repeated_lines),
          ("simhash_near_dedup", drop_near_copies), ("packing", pack_sequences)]

#: Training and tokenizing can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
