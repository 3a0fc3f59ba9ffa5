"""Plan shapes and hot keys: results stay whole and exact when one key holds a third of the rows."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import SF0001
from tallyspark.operators import ledger, periods, vectors
from tallyspark.sources import prices as src


def test_hot_key_ledger_equals_pandas(spark):
    rng = np.random.default_rng(7)
    n = 30_000
    keys = np.where(rng.random(n) < 1 / 3, "HOT", rng.integers(0, 200, n).astype(str))
    ts = pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 3 * 365 * 24 * 3600, n), unit="s")
    price = np.where(rng.random(n) < 0.05, np.nan, rng.uniform(1, 100, n))
    pdf = pd.DataFrame({"series_key": keys, "ts": ts, "price": price})
    df = spark.createDataFrame(pdf, src.PRICE_SCHEMA).withColumn("price", F.when(~F.isnan("price"), F.col("price")))
    got = ledger.dca_ledger_cpi(periods.first_per_period(df).repartition(7), None, amount=10.0).toPandas()
    hot = pdf[pdf.series_key == "HOT"].sort_values(["ts", "price"]).set_index("ts")[["price"]]
    m = hot.resample("MS").first()
    units_cum = (10.0 / m["price"]).cumsum()
    g = got[got.series_key == "HOT"].sort_values("period")
    assert len(g) == len(m)
    assert np.allclose(g["units_cum"].to_numpy(dtype=float), units_cum.to_numpy(), equal_nan=True, rtol=1e-12)
    assert got.groupby("series_key").size().sum() == len(got)


def test_rollup_equals_direct_grouping(spark):
    p = src.lineitem_prices(spark, SF0001)
    brands = src.part_brands(spark, SF0001)
    rolled = periods.first_per_period_rollup(p, brands).toPandas()
    direct_in = p.join(brands, "series_key").drop("series_key").withColumnRenamed("group_key", "series_key")
    direct = periods.first_per_period(direct_in).toPandas()
    a = rolled.sort_values(["series_key", "period"]).reset_index(drop=True)
    b = direct.sort_values(["series_key", "period"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b[a.columns])


def test_ledger_windows_share_one_exchange(spark):
    led = ledger.dca_ledger_cpi(periods.first_per_period(src.lineitem_prices(spark, SF0001)), None)
    plan = led._jdf.queryExecution().executedPlan().toString()
    # one exchange for the (key, period) partial aggregate, one by key for every window
    assert plan.count("Exchange hashpartitioning") == 2


def test_encoder_hook(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "")], "doc_id long, text string")

    def enc(texts):
        return np.stack([[len(t.as_py()), 1.0, 0.0] for t in texts])

    got = {r["doc_id"]: list(r["embedding"]) for r in vectors.encode_with(docs, enc, dim=3).collect()}
    n = np.sqrt(10.0)
    assert np.allclose(got[1], [3 / n, 1 / n, 0.0]) and np.allclose(got[2], [0.0, 1.0, 0.0])


def test_month_spine_spans_gaps(spark):
    df = spark.createDataFrame([("a", dt.datetime(2023, 11, 5), 1.0), ("a", dt.datetime(2024, 2, 1), 2.0)],
                               src.PRICE_SCHEMA)
    got = [r["period"] for r in periods.date_spine(df).orderBy("period").collect()]
    assert got == [dt.date(2023, 11, 1), dt.date(2023, 12, 1), dt.date(2024, 1, 1), dt.date(2024, 2, 1)]


def test_retrieval_never_shuffles_the_corpus(spark):
    """Vectors travel once, as whole blocks dealt round robin; what is hashed or sorted afterwards are
    candidates, and no document goes by its id while the neighbours fit a broadcast."""
    from tallyspark.operators import retrieval
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text")
    qs = retrieval.questions_from_conversations(spark.read.parquet(f"{SF0001}/conversations.parquet"))
    ctx = retrieval.retrieve_context(qs, docs)
    plan = ctx._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "MapInArrow" in plan
    assert "Exchange hashpartitioning(doc_id" not in plan and "Exchange rangepartitioning" not in plan
    assert not [x for x in plan.split("\n") if "Sort [" in x and "vectors" in x]
    assert ctx.count() == qs.count()


def test_cpi_ledger_exchanges(spark):
    """Flagship plan: the partial first-price aggregate by (key, period), one
    exchange by key shared by every window, and one for the price index."""
    cpi = ledger.prepare_cpi(src.orders_cpi(spark, SF0001))
    led = ledger.dca_ledger_cpi(periods.first_per_period(src.lineitem_prices(spark, SF0001)), cpi, prepared=True)
    assert led.count() > 0
    plan = led._jdf.queryExecution().executedPlan().toString()
    # two for the ledger, one for the index: its check of periods shares the exchange of its own aggregate
    assert plan.count("Exchange hashpartitioning") == 3
    assert "Window" in plan


def test_unique_timestamps_need_no_sort_aggregate(spark):
    for unit in ("week", "day"):
        plan = periods.first_per_period(src.events_prices(spark, SF0001), unit=unit, unique_ts=True)
        assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()


def test_building_a_ledger_or_a_retrieval_launches_few_jobs(spark):
    """Schema reads aside, a ledger launches none.  A retrieval writes its questions and both sides' blocks
    and counts the blocks, however many questions there are and into how many blocks they are cut."""
    from tallyspark.operators import retrieval
    prices, cpi = src.lineitem_prices(spark, SF0001), src.orders_cpi(spark, SF0001)
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text")
    qs = retrieval.questions_from_conversations(spark.read.parquet(f"{SF0001}/conversations.parquet"))
    tracker = spark.sparkContext.statusTracker()

    def jobs(build):
        spark.sparkContext.setJobGroup(build.__name__, "")
        build()
        return len(tracker.getJobIdsForGroup(build.__name__))

    def build_ledger():
        ledger.dca_ledger_cpi(periods.first_per_period(prices), cpi)

    def build_retrieval():
        retrieval.retrieve_context(qs, docs)

    def build_few():
        retrieval.retrieve_context(qs.limit(3), docs)

    def build_in_blocks():
        retrieval.retrieve_context(qs, docs, question_blocks=7)

    assert jobs(build_ledger) == 0
    # three writes, and one count for each side, whose exchange is a job of its own
    assert jobs(build_retrieval) <= 7
    assert jobs(build_few) <= 8 and jobs(build_in_blocks) <= 8
