"""Property test: both ledgers equal a pandas computation written the reference's way
(``resample('MS').first()``, ``cumsum``, ``ffill().bfill()``) on random gappy series --
NULL prices, several observations per day, empty months, unsorted input.  Zero prices are
drawn too: the Spark ledgers treat them as missing (documented deviation), so the pandas side
maps 0 to NaN *after* the first-price pick, as ``try_divide`` does."""

import datetime as dt

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyspark.functions.rates import periodic_rate
from tallyspark.operators import ledger, periods
from tallyspark.sources.prices import PRICE_SCHEMA

DAY0 = dt.datetime(2023, 1, 1)
obs = st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 400), st.integers(0, 3),
                st.one_of(st.none(), st.just(0.0), st.floats(0.5, 1e5, allow_nan=False)))


def pandas_ledgers(pdf: pd.DataFrame, a_cpi: float, a_fix: float, r: float) -> pd.DataFrame:
    out = []
    for key, g in pdf.groupby("series_key"):
        s = g.sort_values(["ts", "price"], na_position="last").set_index("ts")["price"].astype(float)
        m = s.resample("MS").first()
        price = m.replace(0.0, np.nan)
        units = a_cpi / price
        led = pd.DataFrame({"price": m, "units_cum": units.cumsum(), "nominal": a_cpi * np.arange(1, len(m) + 1)})
        led["value"] = led["units_cum"] * m
        led.loc[units.isna(), ["units_cum", "value"]] = np.nan
        pf = m.ffill().bfill().replace(0.0, np.nan)
        fu = (a_fix / pf).cumsum()
        led["fix_nominal"] = a_fix * np.arange(1, len(m) + 1)
        led["fix_value"] = np.where(pf.isna(), np.nan, fu * pf)
        led["fix_real"] = led["fix_nominal"] / (1 + r) ** np.arange(len(m))
        led["series_key"] = key
        out.append(led.reset_index().rename(columns={"ts": "period"}))
    res = pd.concat(out)
    res["period"] = res["period"].dt.date
    return res


def same(a: pd.Series, b: pd.Series) -> bool:
    a, b = a.astype(float).to_numpy(), b.astype(float).to_numpy()
    return bool(np.all((np.isnan(a) & np.isnan(b)) | (np.abs(a - b) <= 1e-9 * np.maximum(1.0, np.abs(b)))))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(obs, min_size=1, max_size=40))
def test_ledgers_equal_pandas(spark, rows):
    data = [(k, DAY0 + dt.timedelta(days=d, hours=h), p) for k, d, h, p in rows]
    df = spark.createDataFrame(data, PRICE_SCHEMA)
    m = periods.first_per_period(df)
    c1 = ledger.dca_ledger_cpi(m, None, amount=1000.0).toPandas()
    c2 = ledger.dca_ledger_fixed_rate(m, amount=2000.0).toPandas()
    want = pandas_ledgers(pd.DataFrame(data, columns=["series_key", "ts", "price"]), 1000.0, 2000.0,
                          periodic_rate(ledger.APP_ANNUAL_INFLATION))
    got = c1.merge(c2, on=["series_key", "period"], suffixes=("", "_fix"))
    j = got.merge(want, on=["series_key", "period"], how="outer", suffixes=("", "_pd"), indicator=True)
    assert (j["_merge"] == "both").all() and len(j) == len(want)
    for mine, theirs in [("price", "price_pd"), ("units_cum", "units_cum_pd"), ("value", "value_pd"),
                         ("nominal", "nominal_pd"), ("nominal_fix", "fix_nominal"), ("value_fix", "fix_value"),
                         ("real", "fix_real")]:
        assert same(j[mine], j[theirs]), mine


vec = st.lists(st.integers(-3, 3), min_size=4, max_size=4)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(vec, min_size=1, max_size=25), st.lists(vec, min_size=1, max_size=6), st.integers(1, 30),
       st.sampled_from(["l2", "cosine"]), st.booleans())
def test_knn_equals_brute_force_with_ties(spark, corpus, questions, k, metric, blocked):
    """Small integer vectors give many exact duplicates and exact distance ties;
    k may exceed the corpus.  Rank order is (distance rounded to 9 places, id)."""
    from tallyspark.operators import vectors
    corpus = [c for c in corpus if any(v != 0 for v in c)] or [[1, 0, 0, 0]]
    questions = [q for q in questions if any(v != 0 for v in q)] or [[0, 1, 0, 0]]
    cdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(corpus)],
                                "doc_id long, embedding array<float>")
    qdf = spark.createDataFrame([(100 + i, [float(x) for x in v]) for i, v in enumerate(questions)],
                                "q_id long, embedding array<float>")
    kw = {"question_blocks": 3} if blocked else {}
    got = vectors.knn(qdf, cdf, k=k, metric=metric, dim=4, **kw).toPandas()
    for qi, q in enumerate(questions):
        a = np.asarray(q, float)
        ds = []
        for ci, c in enumerate(corpus):
            b = np.asarray(c, float)
            d = ((a - b) ** 2).sum() if metric == "l2" else 1 - a @ b / np.sqrt((a @ a) * (b @ b))
            ds.append((round(max(d, 0.0), 9), ci))
        want = [ci for _, ci in sorted(ds)[:k]]
        g = got[got["q_id"] == 100 + qi].sort_values("rank")
        assert g["doc_id"].tolist() == want
        assert g["rank"].tolist() == list(range(1, len(want) + 1))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["u1", "u2"]), st.integers(0, 60 * 24), st.integers(0, 59),
                          st.one_of(st.none(), st.floats(1, 1e4, allow_nan=False))), min_size=1, max_size=40),
       st.sampled_from(["week", "day"]))
def test_week_and_day_periods_equal_pandas(spark, rows, unit):
    """A2: first non-null price per week (weeks start Monday) or per day, empty
    periods inside a series' span included -- against pandas ``resample``."""
    data = [(k, DAY0 + dt.timedelta(hours=h, minutes=m), p) for k, h, m, p in rows]
    got = periods.first_per_period(spark.createDataFrame(data, PRICE_SCHEMA), unit=unit).toPandas()
    rule = {"week": "W-MON", "day": "D"}[unit]
    want = []
    for key, g in pd.DataFrame(data, columns=["series_key", "ts", "price"]).groupby("series_key"):
        s = g.sort_values(["ts", "price"], na_position="last").set_index("ts")["price"].astype(float)
        r = s.resample(rule, label="left", closed="left").first() if unit == "week" else s.resample(rule).first()
        want.append(pd.DataFrame({"series_key": key, "period": r.index.date, "price": r.to_numpy()}))
    want = pd.concat(want)
    j = got.merge(want, on=["series_key", "period"], how="outer", suffixes=("", "_pd"), indicator=True)
    assert (j["_merge"] == "both").all() and len(j) == len(want)
    assert same(j["price"], j["price_pd"])
    if unit == "week":
        assert all(p.weekday() == 0 for p in got["period"])


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.just("s"), st.integers(0, 400), st.integers(0, 3),
                          st.one_of(st.none(), st.floats(0.5, 1e5, allow_nan=False))), min_size=1, max_size=30),
       st.dictionaries(st.integers(-3, 18), st.one_of(st.just(float("nan")), st.floats(50, 150)), max_size=10))
def test_cpi_ledger_equals_pandas(spark, rows, cpi_months):
    """C1 with an index: exact-period left join, ffill then bfill, "CPI now" =
    filled value of the last ledger period, real = amount * cpi / cpi_now, running
    sum.  CPI rows may sit outside the price span, be NaN, or be missing."""
    from pyspark.sql import types as PT
    data = [(k, DAY0 + dt.timedelta(days=d, hours=h), p) for k, d, h, p in rows]
    cpi_rows = [((pd.Timestamp(DAY0) + pd.DateOffset(months=mo)).date(), v) for mo, v in sorted(cpi_months.items())]
    cpi_schema = PT.StructType([PT.StructField("period", PT.DateType()), PT.StructField("cpi", PT.DoubleType())])
    cpi = spark.createDataFrame(cpi_rows, cpi_schema)
    got = ledger.dca_ledger_cpi(periods.first_per_period(spark.createDataFrame(data, PRICE_SCHEMA)), cpi,
                                amount=1000.0).toPandas().sort_values("period").reset_index(drop=True)
    s = (pd.DataFrame(data, columns=["series_key", "ts", "price"]).sort_values(["ts", "price"], na_position="last")
         .set_index("ts")["price"].astype(float))
    m = s.resample("MS").first().to_frame("price")
    ipc = pd.DataFrame({"IPC": [v for _, v in cpi_rows]}, index=pd.DatetimeIndex([pd.Timestamp(p) for p, _ in cpi_rows]))
    j = m.join(ipc, how="left") if len(ipc) else m.assign(IPC=np.nan)
    j["IPC"] = j["IPC"].ffill().bfill()
    now = j["IPC"].iloc[-1]
    j["real_contrib"] = 1000.0 * (j["IPC"] / now)
    j["real_cum"] = j["real_contrib"].cumsum()
    assert len(got) == len(j)
    assert same(got["cpi"], j["IPC"])
    assert same(got["real_contrib"], j["real_contrib"])
    assert same(got["real_cum"], j["real_cum"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(50, 150)), min_size=1, max_size=24))
def test_purchasing_power_decay_equals_running_product(spark, cpis):
    """real = nominal * prod(1 - i_t), i_t = cpi_t / cpi_{t-1} - 1 on the filled index, i_0 = 0."""
    from pyspark.sql import types as PT
    months = [(pd.Timestamp(DAY0) + pd.DateOffset(months=i)).to_pydatetime() for i in range(len(cpis))]
    prices = spark.createDataFrame([("s", t, 10.0) for t in months], PRICE_SCHEMA)
    cpi_schema = PT.StructType([PT.StructField("period", PT.DateType()), PT.StructField("cpi", PT.DoubleType())])
    cpi = spark.createDataFrame([(t.date(), v) for t, v in zip(months, cpis) if v is not None], cpi_schema)
    led = ledger.dca_ledger_cpi(periods.first_per_period(prices), cpi, amount=1000.0)
    got = ledger.purchasing_power_decay(led).toPandas().sort_values("period").reset_index(drop=True)
    filled = pd.Series(cpis, dtype=float).ffill().bfill()
    i = (filled / filled.shift(1) - 1).fillna(0.0)
    decay = (1 - i).cumprod()
    nominal = 1000.0 * np.arange(1, len(cpis) + 1)
    assert same(got["inflation"], i) and same(got["decay"], decay)
    assert same(got["real"], nominal * decay)
