"""Token counts of whole texts (dealt operator 6).

Arrow batches of texts go to the Python workers, which return lengths only: no
id ever travels back.  A batch is cut again into calls of about 1 MiB, so one
call holds neither a thousand short texts nor a heap of long ones, and long
texts are cut at safe boundaries first (see ``units``).  No shuffle: the scan's
splits, which Spark balances by bytes, stay where they are.

Null texts count as empty: 0 bytes, 0 tokens.  Every row gives one row, also
repeated ones; extra columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import arrow_batches
from tallyspark.llm.units import TOKEN_ROWS, encoder


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 limit: int = 1024) -> DataFrame:
    """``keep`` columns, ``n_bytes``, ``n_tokens`` and ``over_limit`` of each row."""
    arrow_batches(docs.sparkSession, TOKEN_ROWS)

    @F.arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        return pa.array(encoder(path).encode(texts, False)[0], pa.int64())

    whole = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return whole.select(*keep, F.octet_length("__text").cast("long").alias("n_bytes"),
                        n_tokens("__text").alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
