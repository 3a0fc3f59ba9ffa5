"""Periods, fills and the two ledgers on the edge fixtures (FIXTURES.md section 3)."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF0001, cpi_df, prices_df
from tallyspark.operators import kpi, ledger, periods
from tallyspark.sources import prices as src

GAPPY = [("2024-03-09", 30.0), ("2024-01-05", 11.0), ("2024-01-03", None), ("2024-01-03", 10.0),
         ("2024-05-02", None), ("2024-05-04", 50.0)]


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("series_key", "period").collect()]


def close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= tol * max(1.0, abs(b))


def test_first_per_month_gaps_unsorted_leading_null(spark):
    m = periods.first_per_period(prices_df(spark, GAPPY))
    got = rows(m, "period", "price")
    assert [p for p, _ in got] == [dt.date(2024, i, 1) for i in range(1, 6)]
    assert [x for _, x in got] == [10.0, None, 30.0, None, 50.0]


def test_cpi_ledger_gappy(spark):
    led = ledger.dca_ledger_cpi(periods.first_per_period(prices_df(spark, GAPPY)), None, amount=100.0)
    got = rows(led, "units_cum", "value", "nominal", "cpi", "real_cum")
    expect_units = [10.0, None, 10.0 + 100 / 30, None, 10.0 + 100 / 30 + 2.0]
    expect_value = [100.0, None, (10.0 + 100 / 30) * 30, None, (10.0 + 100 / 30 + 2.0) * 50]
    for (u, v, n, c, r), eu, ev, en in zip(got, expect_units, expect_value, [100.0 * i for i in range(1, 6)]):
        assert close(u, eu) and close(v, ev) and n == en
        assert c is None and r is None  # no index -> index columns NULL


def test_fixed_rate_ledger_fills_prices(spark):
    led = ledger.dca_ledger_fixed_rate(periods.first_per_period(prices_df(spark, GAPPY)), amount=100.0,
                                       detail=True)
    got = rows(led, "price_filled", "n", "nominal", "real")
    assert [g[0] for g in got] == [10.0, 10.0, 30.0, 30.0, 50.0]
    r = (1.05) ** (1 / 12) - 1
    for p, n, nom, real in got:
        assert close(real, nom / (1 + r) ** n, 1e-12)


def test_first_month_all_null(spark):
    df = prices_df(spark, [("2024-01-10", None), ("2024-02-10", 20.0)])
    m = periods.first_per_period(df)
    c1 = rows(ledger.dca_ledger_cpi(m, None, amount=100.0), "period", "value", "nominal")
    assert c1[0] == (dt.date(2024, 1, 1), None, 100.0)
    c2 = rows(ledger.dca_ledger_fixed_rate(m, amount=100.0, detail=True), "period", "price_filled", "units")
    assert c2[0] == (dt.date(2024, 1, 1), 20.0, 5.0)


def test_zero_price_is_missing(spark):
    df = prices_df(spark, [("2024-01-02", 10.0), ("2024-02-02", 0.0), ("2024-03-02", 20.0)])
    led = ledger.dca_ledger_cpi(periods.first_per_period(df), None, amount=100.0)
    assert [u for (u,) in rows(led, "units")] == [10.0, None, 5.0]
    assert [u for (u,) in rows(led, "units_cum")] == [10.0, None, 15.0]


def test_month_boundary_in_a_time_zone(spark):
    # instants in UTC that are 31 Jan 23:30 and 1 Feb 00:30 in Mexico City
    df = spark.createDataFrame([("s", dt.datetime(2024, 2, 1, 5, 30), 1.0), ("s", dt.datetime(2024, 2, 1, 6, 30), 2.0)],
                               "series_key string, ts timestamp_ntz, price double")
    local = df.withColumn("ts", src.to_naive(F.col("ts"), "America/Mexico_City"))
    got = rows(periods.first_per_period(local), "period", "price")
    assert got == [(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 2, 1), 2.0)]


def test_cpi_gap_filled_both_ways(spark):
    df = prices_df(spark, [("2024-01-02", 10.0), ("2024-02-02", 10.0), ("2024-03-02", 10.0), ("2024-04-02", 10.0)])
    led = ledger.dca_ledger_cpi(periods.first_per_period(df), cpi_df(spark, [("2024-03-01", 120.0)]), amount=100.0)
    got = rows(led, "cpi", "real_contrib", "real_cum", "nominal")
    assert [g[0] for g in got] == [120.0] * 4
    assert [g[1] for g in got] == [100.0] * 4
    assert [g[2] for g in got] == [g[3] for g in got]


def test_cpi_newer_than_ledger(spark):
    df = prices_df(spark, [("2024-01-02", 10.0), ("2024-05-02", 10.0)])
    cpi = cpi_df(spark, [("2024-01-01", 100.0), ("2024-03-01", 110.0), ("2024-07-01", 200.0)])
    led = ledger.with_cpi(periods.first_per_period(df), cpi)
    got = rows(led, "cpi", "cpi_now")
    assert [g[0] for g in got] == [100.0, 100.0, 110.0, 110.0, 110.0]
    assert {g[1] for g in got} == {110.0}  # the last ledger period's value, not July's


def test_duplicate_cpi_period_rejected(spark):
    df = prices_df(spark, [("2024-03-02", 10.0)])
    cpi = cpi_df(spark, [("2024-03-01", 100.0), ("2024-03-01", 101.0)])
    with pytest.raises(Exception, match="duplicate periods"):
        ledger.dca_ledger_cpi(periods.first_per_period(df), cpi).collect()


def test_infinite_price_does_not_win_the_peak(spark):
    """As pandas: units 0 at infinity, 0 * inf is NaN, and max skips it."""
    from tallyspark.operators import kpi
    df = prices_df(spark, [("2024-01-02", float("inf")), ("2024-02-02", 2.0)])
    led = ledger.dca_ledger_fixed_rate(periods.first_per_period(df))
    assert kpi.state_metrics(led).first()["portfolio_peak"] == 2000.0


def test_plan_batch_equals_single_runs(spark):
    import datetime as dt
    from tallyspark.operators import backtest
    from tallyspark.sources import prices as src
    prices = src.lineitem_prices(spark, "/root/testdata/sf0.001")
    rows = [(1, "7", 500.0, dt.datetime(1996, 2, 10), dt.datetime(1999, 1, 1), 0.03), (2, "7", 900.0, dt.datetime(1995, 1, 1), dt.datetime(2001, 1, 1), 0.0),
            (3, "none", 900.0, dt.datetime(1995, 1, 1), dt.datetime(2001, 1, 1), 0.0)]
    schema = "plan_id long, series_key string, amount double, start timestamp_ntz, end timestamp_ntz, annual double"
    got = {r["plan_id"]: r for r in backtest.backtest(spark.createDataFrame(rows, schema), prices).collect()}
    assert set(got) == {1, 2}
    for plan, key, amount, start, end, annual in rows[:2]:
        one = prices.where((F.col("series_key") == key) & (F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
        want = kpi_row(ledger.dca_ledger_fixed_rate(periods.first_per_period(one), amount, annual))
        assert all(math.isclose(got[plan][c], want[c], rel_tol=1e-12) for c in ("nominal", "real", "value"))
    bad = spark.createDataFrame([(9, "7", 1.0, dt.datetime(2000, 1, 1), dt.datetime(2000, 1, 1), 0.0)], schema)
    with pytest.raises(Exception, match="start must be before end"):
        backtest.backtest(bad, prices).collect()


def kpi_row(led):
    from tallyspark.operators import kpi
    return kpi.kpi_snapshot(led).first()


def test_empty_cpi_table(spark):
    df = prices_df(spark, [("2024-03-02", 10.0)])
    led = ledger.dca_ledger_cpi(periods.first_per_period(df), cpi_df(spark, []))
    (r,) = led.collect()
    assert r["cpi"] is None and r["real_cum"] is None and r["nominal"] == 1000.0


def test_empty_prices_keep_schema(spark):
    led = ledger.dca_ledger_cpi(periods.first_per_period(src.empty_prices(spark)), None)
    assert led.count() == 0
    assert led.columns == ["series_key", "period", "price", "units", "units_cum", "value", "nominal",
                           "cpi", "real_contrib", "real_cum"]


def test_amount_zero_gives_zero_percentages(spark):
    df = prices_df(spark, [("2024-01-02", 10.0), ("2024-02-02", 12.0)])
    snap = kpi.kpi_snapshot(ledger.dca_ledger_fixed_rate(periods.first_per_period(df), amount=0.0))
    (r,) = snap.collect()
    assert r["devaluation_pct"] == 0.0 and r["roi_pct"] == 0.0


def test_start_not_before_end(spark):
    with pytest.raises(ValueError):
        src.lineitem_prices(spark, SF0001, start="2024-02-01", end="2024-01-01")


def test_week_and_day_periods(spark):
    df = prices_df(spark, [("2024-01-03 10:00:00", 1.0), ("2024-01-17 09:00:00", 3.0), ("2024-01-16 08:00:00", 2.0)])
    wk = rows(periods.first_per_period(df, unit="week"), "period", "price")
    assert wk == [(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 1, 8), None), (dt.date(2024, 1, 15), 2.0)]
    day = rows(periods.first_per_period(df, unit="day"), "period", "price")
    assert len(day) == 15 and day[0] == (dt.date(2024, 1, 3), 1.0) and day[-1] == (dt.date(2024, 1, 17), 3.0)


def test_purchasing_power_decay(spark):
    df = prices_df(spark, [("2024-01-02", 10.0), ("2024-02-02", 10.0), ("2024-03-02", 10.0)])
    cpi = cpi_df(spark, [("2024-01-01", 100.0), ("2024-02-01", 110.0), ("2024-03-01", 121.0)])
    d = ledger.purchasing_power_decay(ledger.dca_ledger_cpi(periods.first_per_period(df), cpi, amount=100.0))
    got = rows(d, "inflation", "decay", "real")
    assert close(got[0][1], 1.0) and close(got[1][0], 0.1) and close(got[2][1], 0.81)
    assert close(got[2][2], 300 * 0.81)


# --- cross-check against a pandas re-implementation of the reference semantics ---

def pandas_cpi_ledger(p: pd.DataFrame, amount: float) -> pd.DataFrame:
    out = []
    for key, g in p.groupby("series_key"):
        s = g.sort_values(["ts", "tie1", "tie2", "price"]).set_index("ts")[["price"]]
        m = s.resample("MS").first()
        m["units"] = amount / m["price"]
        m["units_cum"] = m["units"].cumsum()
        m["value"] = m["units_cum"] * m["price"]
        m["nominal"] = (pd.Series(1.0, index=m.index) * amount).cumsum()
        m["series_key"] = key
        out.append(m.reset_index())
    return pd.concat(out)


def test_cpi_ledger_equals_pandas_on_lineitem(spark):
    p = src.lineitem_prices(spark, SF0001)
    led = ledger.dca_ledger_cpi(periods.first_per_period(p), None).toPandas()
    ref = pandas_cpi_ledger(p.toPandas(), 1000.0)
    ref["period"] = ref["ts"].dt.date
    merged = led.merge(ref, on=["series_key", "period"], suffixes=("", "_pd"), how="outer", indicator=True)
    assert (merged["_merge"] == "both").all()
    for c in ["price", "units", "units_cum", "value", "nominal"]:
        a, b = merged[c], merged[c + "_pd"]
        assert ((a.isna() & b.isna()) | ((a - b).abs() <= 1e-9 * b.abs().clip(lower=1))).all(), c


def test_invariants(spark):
    p = src.lineitem_prices(spark, SF0001)
    m = periods.first_per_period(p)
    led = ledger.dca_ledger_cpi(m, None)
    pdf = led.toPandas()
    n = pdf.groupby("series_key")["period"].transform("count")
    last = pdf.sort_values("period").groupby("series_key").tail(1)
    assert (last["nominal"] == 1000.0 * n[last.index]).all()
    tot = ledger.total_units(m).toPandas().set_index("series_key")["total_units"]
    has_price = last[last["units_cum"].notna()]
    assert all(math.isclose(u, tot[k], rel_tol=1e-12) for k, u in zip(has_price["series_key"], has_price["units_cum"]))
    # prices x 2 -> units / 2
    led2 = ledger.dca_ledger_cpi(periods.first_per_period(p.withColumn("price", F.col("price") * 2)), None).toPandas()
    j = pdf.merge(led2, on=["series_key", "period"])
    ok = j["units_x"].isna() | ((j["units_x"] / 2 - j["units_y"]).abs() <= 1e-12 * j["units_x"].abs())
    assert ok.all()


def test_cpi_off_month_start_needs_normalising(spark):
    df = prices_df(spark, [("2024-01-02", 10.0), ("2024-02-02", 10.0)])
    cpi = cpi_df(spark, [("2024-01-15", 100.0), ("2024-02-15", float("nan"))])
    exact = ledger.with_cpi(periods.first_per_period(df), cpi)
    assert [r["cpi"] for r in exact.collect()] == [None, None]  # mid-month rows never match
    norm = ledger.with_cpi(periods.first_per_period(df), ledger.prepare_cpi(cpi, normalise_periods=True),
                           prepared=True)
    assert [r["cpi"] for r in norm.orderBy("period").collect()] == [100.0, 100.0]  # NaN -> NULL -> filled
