"""Conversation transcripts (C6): append turns, replay in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import checkpoint_dir

# Texts of turns that the library itself writes; callers pass their own.
DEFAULT_GREETING = "Escribe tu pregunta para empezar la conversación."
FAILURE_PREFIX = "Sin respuesta por un error: "

# Turns per first-level chunk when a transcript is rendered (bounds the size of
# every collect_list; see ``replay``).
REPLAY_CHUNK = 1024
#: Bytes of a conversation that may stand in one row.
REPLAY_BYTES = 64 * 1024 * 1024


def start_sessions(conv_ids: DataFrame, greeting: str = DEFAULT_GREETING) -> DataFrame:
    """One assistant greeting as turn 0 of every conversation id."""
    return conv_ids.select("conv_id").distinct().select(
        "conv_id", F.lit(0).cast("bigint").alias("turn"), F.lit("assistant").alias("role"),
        F.lit(greeting).alias("text"))


def append_turns(transcript: DataFrame, new_turns: DataFrame, order_col: str = "seq") -> DataFrame:
    """Append ``new_turns (conv_id, <order_col>, role, text)`` after the last turn
    of each conversation: ``turn = max(turn) + row_number()`` in ``order_col``
    order (a conversation not seen before starts at 0).  Returns the whole
    transcript ``(conv_id, turn, role, text)``.

    One way for every orderable type: rows are range-partitioned on
    (conversation, order, role, text), so Spark's sampled boundaries cut a hot
    conversation over many tasks however dense its order column is; rows are
    numbered inside (partition, conversation), and prefix sums of the counts of
    those pieces -- one row each -- give the offsets.  The numbered table is
    checkpointed, as both uses must see the same pieces.  Rows that are equal in
    all four columns are interchangeable.  Turns without a conversation are one
    conversation of their own.
    """
    last = transcript.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    order = [F.col(order_col), F.col("role"), F.col("text")]
    spark = new_turns.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (new_turns.select("conv_id", order_col, "role", "text").repartitionByRange(n_parts, F.col("conv_id"), *order)
              .withColumn("_piece", F.spark_partition_id()))
    w = Window.partitionBy("_piece", "conv_id").orderBy(*order)
    checkpoint_dir(spark)
    numbered = ranged.withColumn("_pos", F.row_number().over(w)).checkpoint(eager=True)
    sizes = numbered.groupBy("conv_id", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .join(last.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
               .select(F.col("conv_id").alias("_conv"), F.col("_piece").alias("_of"), (F.coalesce(F.col("_last"), F.lit(-1)) + F.col("_off")).alias("_start")))
    added = (numbered.join(offsets, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_piece") == F.col("_of")))
             .select("conv_id", (F.col("_start") + F.col("_pos")).cast("bigint").alias("turn"), "role", "text"))
    return transcript.select("conv_id", F.col("turn").cast("bigint"), "role", "text").unionByName(added)


def failure_turn(conv_id_df: DataFrame, error_col: str = "error", order_col: str = "seq") -> DataFrame:
    """An assistant turn recording a failed answer, ready for ``append_turns``:
    ``(conv_id, <order_col>, role, text)`` (the order column is carried over
    when the input has it)."""
    keep = [F.col(order_col)] if order_col in conv_id_df.columns else []
    return conv_id_df.select("conv_id", *keep, F.lit("assistant").alias("role"),
                             F.concat(F.lit(FAILURE_PREFIX), F.col(error_col)).alias("text"))


def replay(transcript: DataFrame, sep: str = "\n", chunked: bool = True) -> DataFrame:
    """Render each conversation as ``role: text`` lines in turn order.

    ``chunked=False``: ``(conv_id, n_turns, transcript)``, one row per
    conversation, for conversations known to be short.  Two levels, so that no single ``collect_list`` holds more
    than ``REPLAY_CHUNK`` lines: turns are first joined per (conversation,
    chunk), then the chunks per conversation.  The result row still holds the
    whole conversation, so bytes are counted first: a conversation beyond
    ``REPLAY_BYTES`` is an error before any chunks are gathered.

    ``chunked=True`` (default): ``(conv_id, chunk, n_turns, transcript)``, one row per
    (conversation, block of ``REPLAY_CHUNK`` turns) -- every group and every
    row is bounded, however long a conversation is; reading the rows in
    ``chunk`` order replays it.

    Every turn is a line: a null role or text is empty, turns without a number
    come first, and turns without a conversation are one of their own.
    """
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    chunks = (transcript
              .select("conv_id", "turn", line.alias("line"), F.floor(F.col("turn") / REPLAY_CHUNK).alias("_chunk"))
              .groupBy("conv_id", "_chunk")
              .agg(F.count(F.lit(1)).alias("_n"),
                   F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))),
                                            lambda x: x["line"]), sep).alias("_text")))
    if chunked:
        return chunks.select("conv_id", F.col("_chunk").alias("chunk"), F.col("_n").alias("n_turns"),
                             F.col("_text").alias("transcript"))
    sizes = chunks.groupBy("conv_id").agg(F.sum(F.octet_length("_text") + F.lit(len(sep.encode()))).alias("bytes"))
    most = sizes.agg(F.coalesce(F.max("bytes"), F.lit(0)).alias("most")).scalar()
    error = F.concat(F.lit("a conversation holds "), most.cast("string"), F.lit(f" bytes, at most {REPLAY_BYTES} go in one row: replay it chunked"))
    whole = chunks.withColumn("_text", F.when(most <= REPLAY_BYTES, F.col("_text")).otherwise(F.raise_error(error).cast("string")))
    return (whole.groupBy("conv_id")
            .agg(F.sum("_n").alias("n_turns"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_text"))),
                                          lambda x: x["_text"]), sep).alias("transcript")))
