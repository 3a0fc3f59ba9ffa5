"""Named queries over the test tables: ``name -> (spark, sf_dir) -> DataFrame``.

Each entry reads whole tables from ``sf_dir`` (no sampling, no id subsets) and
composes the library operators.  Doubles that come out of order-dependent
sums, ``pow`` or ``product`` are rounded (6 decimals) so that the DuckDB
oracle in ``plans.oracle`` can compare them; values computed by a single IEEE
operation in both engines are left as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import backtest, kpi, ledger, neighbours, periods, retrieval, transcripts, vectors
from tallyspark.sources import prices as src
from tallyspark.session import checkpoint_dir
from tallyspark.sources.text import append_corpus, read_text_files, write_text_files

Query = Callable[[SparkSession, str], DataFrame]

# Plan parameters used by the registered queries.
SCAN_START, SCAN_END = "1996-01-01", "1998-01-01"
FALLBACK_START = "1997-01-01"
SCAN_KEYS = [1, 7, 42, 150]
RANGE_START, RANGE_END, RANGE_AMOUNT, RANGE_ANNUAL = "1996-03-15", "2000-06-01", 2500.0, 0.04
SMALL_CORPUS_K = 50
ROUND = 6
MONEY_ROUND = 3  # money columns reach 1e6+: fewer decimals keep float noise off the last digit


def _r(c: str, d: int = ROUND):
    return F.round(F.col(c), d).alias(c)


def _monthly(spark, sf):
    return periods.first_per_period(src.lineitem_prices(spark, sf), unit="month")


def _cpi(spark, sf):
    return ledger.prepare_cpi(src.orders_cpi(spark, sf))


def _ledger_cpi(spark, sf):
    return ledger.dca_ledger_cpi(_monthly(spark, sf), _cpi(spark, sf), prepared=True)


def _ledger_fixed(spark, sf):
    return ledger.dca_ledger_fixed_rate(_monthly(spark, sf))


def _user_questions(spark, sf):
    return retrieval.questions_from_conversations(spark.read.parquet(f"{sf}/conversations.parquet"))


def _documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def _benchmark(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id"), "text")


# --- sources ---------------------------------------------------------------

def q_price_scan(spark, sf):
    return src.lineitem_prices(spark, sf, start=SCAN_START, end=SCAN_END).select("series_key", "ts", "price")


def q_fallback_source(spark, sf):
    df = src.with_fallback(spark,
                           primary=lambda: spark.read.parquet(f"{sf}/prices.parquet"),
                           backup=lambda: src.lineitem_prices(spark, sf),
                           start=FALLBACK_START, origin="origin")
    return df.select("series_key", "ts", "price")


def q_corpus_append(spark, sf):
    docs = _documents(spark, sf).select(F.lit("documents").alias("origin"), "doc_id", "text")
    bench = _benchmark(spark, sf).select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("doc_id"), "text")
    return append_corpus(docs, bench)


def q_price_scan_keys(spark, sf):
    return src.lineitem_prices(spark, sf, keys=SCAN_KEYS).select("series_key", "ts", "price")


RECENT_FEED, NO_FEED = "2001-01-01", "2005-01-01"


def q_fallback_by_series(spark, sf):
    """Series with a price in the recent feed come from there, all others from the longer table."""
    return src.fallback_by_series(spark, lambda: src.lineitem_prices(spark, sf, start=RECENT_FEED),
                                  lambda: src.lineitem_prices(spark, sf), start=FALLBACK_START).select("series_key", "ts", "price", "origin")


def q_fallback_empty_primary(spark, sf):
    """The primary exists and has no rows."""
    df = src.with_fallback(spark, lambda: src.lineitem_prices(spark, sf, start=NO_FEED), lambda: src.lineitem_prices(spark, sf),
                           start=FALLBACK_START, origin="origin")
    return df.select("series_key", "ts", "price", "origin")


def q_fallback_primary(spark, sf):
    """The primary has rows: nothing of the backup is used."""
    df = src.with_fallback(spark, lambda: src.lineitem_prices(spark, sf, start=RECENT_FEED), lambda: src.lineitem_prices(spark, sf),
                           start=FALLBACK_START, origin="origin")
    return df.select("series_key", "ts", "price", "origin")


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def q_csv_prices(spark, sf):
    """Prices written as CSV and read back."""
    path = _folder(spark, "prices-csv")
    prices = src.lineitem_prices(spark, sf).select("series_key", F.col("ts").cast("string").alias("Date"), F.col("price").alias("Close"))
    prices.write.option("header", True).csv(path)
    return src.read_price_csv(spark, path, series_col="series_key", malformed="malformed")


def q_csv_cpi_fill(spark, sf):
    """The price index written as CSV and read back, joined to the ledgers' periods."""
    path = _folder(spark, "cpi-csv")
    src.orders_cpi(spark, sf).select(F.col("period").alias("Date"), F.col("cpi").alias("IPC")).write.option("header", True).csv(path)
    j = ledger.with_cpi(_monthly(spark, sf), ledger.prepare_cpi(src.read_cpi_csv(spark, path)), prepared=True)
    return j.select("series_key", "period", "cpi_raw", "cpi")


def q_text_files(spark, sf):
    """One text file for each document, read back beside files of another kind."""
    path = _folder(spark, "texts")
    write_text_files(_documents(spark, sf), path)
    _benchmark(spark, sf).withColumn("doc_id", F.lit(-1)).write.mode("append").partitionBy("doc_id").json(path)
    return read_text_files(spark, path).select("doc_id", "text")


# --- periods ---------------------------------------------------------------

def q_date_spine(spark, sf):
    return periods.date_spine(src.lineitem_prices(spark, sf), unit="month")


def q_period_first_month(spark, sf):
    return _monthly(spark, sf)


def q_period_first_week(spark, sf):
    return periods.first_per_period(src.events_prices(spark, sf), unit="week", unique_ts=True)


def q_period_first_day(spark, sf):
    return periods.first_per_period(src.events_prices(spark, sf), unit="day", unique_ts=True)


# --- ledgers ---------------------------------------------------------------

def q_cum_units_gappy(spark, sf):
    led = ledger.dca_ledger_cpi(_monthly(spark, sf), None)
    return led.select("series_key", "period", "price", "units", _r("units_cum"))


def q_nominal_ladder(spark, sf):
    m = _monthly(spark, sf)
    return m.select("series_key", "period",
                    F.row_number().over(ledger.series_window()).cast("bigint").alias("n_periods"),
                    ledger.nominal_ladder(ledger.LIBRARY_AMOUNT).alias("nominal"))


def q_ffill_bfill(spark, sf):
    m = _monthly(spark, sf)
    return m.select("series_key", "period", "price", ledger.ffill_bfill("price").alias("price_filled"))


def q_cpi_left_join_fill(spark, sf):
    j = ledger.with_cpi(_monthly(spark, sf), _cpi(spark, sf), prepared=True)
    return j.select("series_key", "period", "cpi_raw", "cpi")


def q_cpi_now(spark, sf):
    j = ledger.with_cpi(_monthly(spark, sf), _cpi(spark, sf), prepared=True)
    return j.select("series_key", "period", "cpi", "cpi_now")


def q_real_contributions(spark, sf):
    return _ledger_cpi(spark, sf).select("series_key", "period", "real_contrib", _r("real_cum", MONEY_ROUND))


def q_dca_cpi(spark, sf):
    led = _ledger_cpi(spark, sf)
    return led.select("series_key", "period", "price", "units", _r("units_cum"), _r("value", MONEY_ROUND), "nominal",
                      "cpi", "real_contrib", _r("real_cum", MONEY_ROUND))


def q_dca_cpi_brand(spark, sf):
    m = periods.first_per_period_rollup(src.lineitem_prices(spark, sf), src.part_brands(spark, sf))
    led = ledger.dca_ledger_cpi(m, _cpi(spark, sf), prepared=True)
    return led.select("series_key", "period", "price", "units", _r("units_cum"), _r("value", MONEY_ROUND), "nominal",
                      "cpi", "real_contrib", _r("real_cum", MONEY_ROUND))


def q_dca_fixed_rate(spark, sf):
    return _ledger_fixed(spark, sf).select("series_key", "period", "nominal", _r("real", MONEY_ROUND), _r("value", MONEY_ROUND))


def q_dca_fixed_rate_week(spark, sf):
    m = periods.first_per_period(src.events_prices(spark, sf), unit="week", unique_ts=True)
    led = ledger.dca_ledger_fixed_rate(m, unit="week")
    return led.select("series_key", "period", "nominal", _r("real", MONEY_ROUND), _r("value", MONEY_ROUND))


def q_total_units(spark, sf):
    return ledger.total_units(_monthly(spark, sf)).select("series_key", _r("total_units"))


def q_purchasing_power_decay(spark, sf):
    d = ledger.purchasing_power_decay(_ledger_cpi(spark, sf))
    return d.select("series_key", "period", "nominal", _r("inflation", 9), _r("decay", 9), _r("real", MONEY_ROUND))


# --- KPIs and metrics -------------------------------------------------------

def q_kpi_snapshot(spark, sf):
    s = kpi.kpi_snapshot(_ledger_fixed(spark, sf))
    return s.select("series_key", "period", "nominal", _r("real", MONEY_ROUND), _r("value", MONEY_ROUND), _r("devaluation_pct"), _r("roi_pct"))


def q_kpi_labels(spark, sf):
    return kpi.kpi_labels(kpi.kpi_snapshot(_ledger_fixed(spark, sf)))


def q_state_metrics(spark, sf):
    m = kpi.state_metrics(_ledger_fixed(spark, sf))
    return m.select("series_key", "total_invested", _r("portfolio_peak", MONEY_ROUND))


def q_state_metrics_absent(spark, sf):
    """A ledger without its value column counts as 0."""
    return kpi.state_metrics(_ledger_fixed(spark, sf).drop("value"))


def q_metrics_text(spark, sf):
    return kpi.metrics_text(kpi.state_metrics(_ledger_fixed(spark, sf)))


# --- vectors and retrieval ---------------------------------------------------

def q_hash_embed(spark, sf):
    return vectors.hash_embed_sparse(_documents(spark, sf))


def _embeddings(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")


def _knn_graph(spark, sf, metric):
    e = _embeddings(spark, sf)
    return neighbours.knn_graph(e, k=neighbours.DEFAULT_K, metric=metric, key="vec_id", dim=64, question_key="q_id")


def q_knn_l2_top2(spark, sf):
    return _knn_graph(spark, sf, "l2")


def q_knn_cosine_top2(spark, sf):
    return _knn_graph(spark, sf, "cosine")


def _question_vectors(spark, sf):
    q = _user_questions(spark, sf)
    e = vectors.hash_embed(q.select(F.struct("conv_id", "turn").alias("_qk"), "text"), id_col="_qk")
    return e.select(F.col("_qk.conv_id").alias("conv_id"), F.col("_qk.turn").alias("turn"), "embedding")


def q_knn_appended(spark, sf):
    """Neighbours of all questions after the benchmark was added to the written index: only what was added is searched."""
    path, before, vectors_of = _folder(spark, "index"), _folder(spark, "neighbours"), _folder(spark, "question-vectors")
    retrieval.write_index(_documents(spark, sf), path)
    # written, as both searches read them, and a task that embeds and blocks at once holds two workers
    _question_vectors(spark, sf).write.parquet(vectors_of)
    asked = spark.read.parquet(vectors_of)
    neighbours.knn(asked, spark.read.parquet(path), q_keys=["conv_id", "turn"], mark="mark").write.parquet(before)
    more = _benchmark(spark, sf).select((-1 - F.col("item_id")).alias("doc_id"), "text")
    retrieval.write_index(more, path, mode="append")
    found = neighbours.knn_appended(spark.read.parquet(before), asked, retrieval.index_of(more), q_keys=["conv_id", "turn"], mark="mark")
    return found.select("conv_id", "turn", "rank", "doc_id", "dist")


def _length_encoder(texts):
    """A deterministic stand-in for a model: counts of some characters, and one."""
    import numpy as np
    import pyarrow.compute as pc
    return np.stack([*[pc.count_substring(texts, c).to_numpy() for c in "aeiou "], np.ones(len(texts))], axis=1)


def q_encode_hook(spark, sf):
    """Vectors of an encoder given by the caller."""
    v = vectors.encode_with(_documents(spark, sf), _length_encoder, 7)
    return v.select("doc_id", F.posexplode("embedding").alias("place", "value")).select(
        "doc_id", F.col("place").cast("bigint").alias("place"), F.round(F.col("value").cast("double"), 5).alias("value"))


def q_knn_small_corpus(spark, sf):
    idx = retrieval.index_of(_benchmark(spark, sf), d_key="item_id")
    return vectors.knn(_question_vectors(spark, sf), idx, k=SMALL_CORPUS_K, q_keys=["conv_id", "turn"],
                       d_key="item_id")


def q_context_concat(spark, sf):
    ctx = retrieval.retrieve_context(_user_questions(spark, sf), _benchmark(spark, sf), d_key="item_id")
    return ctx.select("conv_id", "turn", "context")


def q_doc_retrieval(spark, sf):
    return retrieval.retrieve_context(_user_questions(spark, sf), _documents(spark, sf))


def q_rag_prompts(spark, sf):
    ctx = retrieval.retrieve_context(_user_questions(spark, sf), _documents(spark, sf))
    state = kpi.metrics_text(kpi.state_metrics(_ledger_fixed(spark, sf), key=None), key=None)
    return retrieval.rag_prompts(ctx, state)


def q_doc_retrieval_blocks(spark, sf):
    """The same retrieval with the questions cut into several blocks."""
    return retrieval.retrieve_context(_user_questions(spark, sf), _documents(spark, sf), question_blocks=3)


def q_doc_retrieval_appended(spark, sf):
    """Retrieval over a corpus appended to itself: still k fragments a question."""
    docs = _documents(spark, sf)
    return retrieval.retrieve_context(_user_questions(spark, sf), append_corpus(docs, docs))


def q_rag_prompts_by_session(spark, sf):
    """Each conversation has a portfolio of its own: the series with its number."""
    ctx = retrieval.retrieve_context(_user_questions(spark, sf), _documents(spark, sf))
    state = kpi.metrics_text(kpi.state_metrics(_ledger_fixed(spark, sf)))
    state = state.select(F.col("series_key").cast("bigint").alias("conv_id"), "metrics_text")
    return retrieval.rag_prompts(ctx, state, state_keys=["conv_id"])


# --- plans -------------------------------------------------------------------

def _snapshot(df, key):
    return df.select(key, "period", "nominal", _r("real", MONEY_ROUND), _r("value", MONEY_ROUND), _r("devaluation_pct"), _r("roi_pct"))


def q_backtest_range(spark, sf):
    """One plan for every series: scan of a range, ledger, snapshot."""
    m = periods.first_per_period(src.lineitem_prices(spark, sf, start=RANGE_START, end=RANGE_END))
    led = ledger.dca_ledger_fixed_rate(m, RANGE_AMOUNT, RANGE_ANNUAL)
    return _snapshot(kpi.kpi_snapshot(led), "series_key")


def q_plan_batch(spark, sf):
    """A plan for every customer, on the part with the customer's number, with terms of its own."""
    n = F.col("c_custkey")
    plans = spark.read.parquet(f"{sf}/customer.parquet").select(
        n.alias("plan_id"), n.cast("string").alias("series_key"), (500.0 + 500.0 * (n % 20)).alias("amount"),
        F.add_months(F.lit("1995-06-01").cast("date"), (n % 24).cast("int")).alias("start"),
        F.add_months(F.lit("1998-06-01").cast("date"), (n % 24).cast("int")).alias("end"), ((n % 10) / 100.0).alias("annual"))
    return _snapshot(backtest.backtest(plans, src.lineitem_prices(spark, sf)), "plan_id")


def q_plan_batch_week(spark, sf):
    """A weekly plan for every customer on the events of a user, which starts and ends at any hour."""
    n = F.col("c_custkey")
    begin = F.timestamp_add("HOUR", (n % 450).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    plans = spark.read.parquet(f"{sf}/customer.parquet").select(
        n.alias("plan_id"), (n % 150).cast("string").alias("series_key"), (100.0 + 10.0 * (n % 7)).alias("amount"),
        begin.alias("start"), F.timestamp_add("HOUR", (100 + n % 300).cast("int"), begin).alias("end"), ((n % 10) / 100.0).alias("annual"))
    return _snapshot(backtest.backtest(plans, src.events_prices(spark, sf), unit="week", unique_ts=True), "plan_id")


def q_kpi_labels_plus(spark, sf):
    """Labels in the reference's own form, with a plus before every ROI."""
    return kpi.kpi_labels(kpi.kpi_snapshot(_ledger_fixed(spark, sf)), roi_sign="always_plus")


# --- transcripts -------------------------------------------------------------

def q_transcript_append(spark, sf):
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    sessions = transcripts.start_sessions(conv)
    return transcripts.append_turns(sessions, conv.withColumnRenamed("turn", "seq"), order_col="seq")


def q_transcript_replay(spark, sf):
    return transcripts.replay(spark.read.parquet(f"{sf}/conversations.parquet"), chunked=False)


def q_transcript_replay_chunks(spark, sf):
    return transcripts.replay(spark.read.parquet(f"{sf}/conversations.parquet"), chunked=True)


QUERIES: dict[str, Query] = {
    "price_scan": q_price_scan,
    "price_scan_keys": q_price_scan_keys,
    "backtest_range": q_backtest_range,
    "plan_batch": q_plan_batch,
    "plan_batch_week": q_plan_batch_week,
    "fallback_by_series": q_fallback_by_series,
    "fallback_empty_primary": q_fallback_empty_primary,
    "fallback_primary": q_fallback_primary,
    "csv_prices": q_csv_prices,
    "csv_cpi_fill": q_csv_cpi_fill,
    "text_files": q_text_files,
    "knn_appended": q_knn_appended,
    "encode_hook": q_encode_hook,
    "state_metrics_absent": q_state_metrics_absent,
    "kpi_labels_plus": q_kpi_labels_plus,
    "doc_retrieval_blocks": q_doc_retrieval_blocks,
    "doc_retrieval_appended": q_doc_retrieval_appended,
    "rag_prompts_by_session": q_rag_prompts_by_session,
    "fallback_source": q_fallback_source,
    "corpus_append": q_corpus_append,
    "date_spine": q_date_spine,
    "period_first_month": q_period_first_month,
    "period_first_week": q_period_first_week,
    "period_first_day": q_period_first_day,
    "cum_units_gappy": q_cum_units_gappy,
    "nominal_ladder": q_nominal_ladder,
    "ffill_bfill": q_ffill_bfill,
    "cpi_left_join_fill": q_cpi_left_join_fill,
    "cpi_now": q_cpi_now,
    "real_contributions": q_real_contributions,
    "dca_cpi": q_dca_cpi,
    "dca_cpi_brand": q_dca_cpi_brand,
    "dca_fixed_rate": q_dca_fixed_rate,
    "dca_fixed_rate_week": q_dca_fixed_rate_week,
    "total_units": q_total_units,
    "purchasing_power_decay": q_purchasing_power_decay,
    "kpi_snapshot": q_kpi_snapshot,
    "kpi_labels": q_kpi_labels,
    "state_metrics": q_state_metrics,
    "metrics_text": q_metrics_text,
    "hash_embed": q_hash_embed,
    "knn_l2_top2": q_knn_l2_top2,
    "knn_cosine_top2": q_knn_cosine_top2,
    "knn_small_corpus": q_knn_small_corpus,
    "context_concat": q_context_concat,
    "doc_retrieval": q_doc_retrieval,
    "rag_prompts": q_rag_prompts,
    "transcript_append": q_transcript_append,
    "transcript_replay": q_transcript_replay,
    "transcript_replay_chunks": q_transcript_replay_chunks,
}
