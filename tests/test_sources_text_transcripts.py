"""Sources (S2-S5, S7), KPI text (F5-F8) and transcripts."""

import os

import pytest

from pyspark.sql import functions as F

from conftest import SF0001
from tallyspark.functions import text as T
from tallyspark.operators import kpi, transcripts
from tallyspark.sources import prices as src
from tallyspark.sources.text import append_corpus, read_text_dir


def test_text_directory_only_txt(spark, tmpdir_path):
    files = {"a.txt": "línea uno\nlínea dos\n", "b.md": "no", "E.TXT": "no"}
    for n, t in files.items():
        with open(os.path.join(tmpdir_path, n), "w", encoding="utf-8") as f:
            f.write(t)
    os.makedirs(os.path.join(tmpdir_path, "sub"))
    with open(os.path.join(tmpdir_path, "sub", "c.txt"), "w") as f:
        f.write("no")
    got = read_text_dir(spark, tmpdir_path).collect()
    assert len(got) == 1 and got[0]["doc_id"].endswith("/a.txt") and got[0]["text"] == files["a.txt"]


def test_missing_text_directory_is_empty(spark, tmpdir_path):
    assert read_text_dir(spark, os.path.join(tmpdir_path, "nope")).count() == 0


def test_csv_blank_and_nan_are_null(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "prices.csv")
    with open(p, "w") as f:
        f.write("Date,Close\n2024-01-02,10.5\n2024-01-03,\n2024-01-04,NaN\n")
    got = sorted(src.read_price_csv(spark, p).collect(), key=lambda r: r["ts"])
    assert [r["price"] for r in got] == [10.5, None, None]


def test_cpi_csv(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "cpi.csv")
    with open(p, "w") as f:
        f.write("Date,IPC\n2010-01-01,72.5\n2010-02-01,73.0\n")
    got = src.read_cpi_csv(spark, p).orderBy("period").collect()
    assert [r["cpi"] for r in got] == [72.5, 73.0]


def test_fallback_chain(spark, tmpdir_path):
    missing = os.path.join(tmpdir_path, "missing.parquet")
    # primary missing -> backup trimmed to start
    df = src.with_fallback(spark, lambda: spark.read.parquet(missing),
                           lambda: src.lineitem_prices(spark, SF0001), start="1999-01-01")
    assert df.count() > 0 and df.agg(F.min("ts")).first()[0].year >= 1999
    # primary empty -> backup
    df = src.with_fallback(spark, lambda: src.empty_prices(spark), lambda: src.lineitem_prices(spark, SF0001))
    assert df.count() > 0
    # backup missing too -> typed empty frame
    df = src.with_fallback(spark, lambda: spark.read.parquet(missing), lambda: spark.read.parquet(missing))
    assert df.count() == 0 and df.schema == src.PRICE_SCHEMA
    # the source used is visible, and other failures are not swallowed
    df = src.with_fallback(spark, lambda: spark.read.parquet(missing), lambda: src.empty_prices(spark), origin="origin")
    assert "origin" in df.columns

    def broken():
        raise OSError("disk")
    with pytest.raises(OSError):
        src.with_fallback(spark, broken, lambda: src.empty_prices(spark))


def test_price_scan_pushes_filters(spark):
    df = src.lineitem_prices(spark, SF0001, start="1996-01-01", end="1997-01-01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "l_shipdate" in plan
    assert "l_discount" not in plan.split("ReadSchema")[1].split("\n")[0]
    keyed = src.lineitem_prices(spark, SF0001, keys=["1", 7])
    assert "In(l_partkey, [1,7])" in keyed._jdf.queryExecution().executedPlan().toString()
    assert {r["series_key"] for r in keyed.select("series_key").distinct().collect()} == {"1", "7"}
    rows = [(r["series_key"], r["ts"]) for r in src.in_time_order(keyed).collect()]
    assert rows == sorted(rows)


def test_corpus_append_duplicates(spark):
    a = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert append_corpus(append_corpus(a, a), a).count() == 3


def test_kpi_text(spark):
    snap = spark.createDataFrame([("s", 2000000.4, 1800000.5, 1500000.0, -10.04, -25.05),
                                  ("t", 999.5, 950.0, 1200.0, 0.15, 20.049)],
                                 "series_key string, nominal double, real double, value double, "
                                 "devaluation_pct double, roi_pct double")
    got = {r["series_key"]: r for r in kpi.kpi_labels(snap).collect()}
    assert got["s"]["nominal_text"] == "$2,000,000" and got["s"]["real_text"] == "$1,800,001"
    assert got["s"]["devaluation_text"] == "-10.0%" + T.DEVALUATION_SUFFIX
    assert got["s"]["roi_text"] == "-25.1%" + T.ROI_SUFFIX  # a loss is not shown as "+-"
    assert got["t"]["nominal_text"] == "$1,000" and got["t"]["roi_text"] == "+20.0%" + T.ROI_SUFFIX
    assert got["t"]["devaluation_text"] == "0.2%" + T.DEVALUATION_SUFFIX
    ref = {r["series_key"]: r["roi_text"] for r in kpi.kpi_labels(snap, roi_sign="always_plus").collect()}
    assert ref == {"s": "+-25.1%" + T.ROI_SUFFIX, "t": "+20.0%" + T.ROI_SUFFIX}  # the reference's label


def test_state_metrics_absent_column_is_zero(spark):
    led = spark.createDataFrame([("s", 1.0), ("s", 5.0)], "series_key string, other double")
    txt = kpi.metrics_text(kpi.state_metrics(led)).first()["metrics_text"]
    assert txt.startswith("Total Invertido (DCA): 0.00 MXN\nValor de la Cartera Hoy: 0.00 MXN\nNOTA:")
    assert kpi.state_metrics(None) is None


def test_transcript_append_and_replay(spark):
    conv = spark.createDataFrame([(1, 0, "user", "hola"), (1, 1, "assistant", "¿qué tal?")],
                                 "conv_id long, turn long, role string, text string")
    new = spark.createDataFrame([(1, 2, "user", "otra"), (1, 1, "user", "pregunta"), (2, 0, "user", "nuevo")],
                                "conv_id long, seq long, role string, text string")
    out = transcripts.append_turns(conv, new).orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["turn"], r["text"]) for r in out] == [
        (1, 0, "hola"), (1, 1, "¿qué tal?"), (1, 2, "pregunta"), (1, 3, "otra"), (2, 0, "nuevo")]
    rep = {r["conv_id"]: r for r in transcripts.replay(transcripts.append_turns(conv, new), chunked=False).collect()}
    assert rep[1]["n_turns"] == 4
    assert rep[1]["transcript"] == "user: hola\nassistant: ¿qué tal?\nuser: pregunta\nuser: otra"
    greet = transcripts.start_sessions(conv).first()
    assert greet["turn"] == 0 and greet["role"] == "assistant"


def test_replay_long_conversation_chunks(spark):
    n = transcripts.REPLAY_CHUNK * 2 + 5
    conv = spark.range(n).select(F.lit(9).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    r = transcripts.replay(conv, chunked=False).first()
    assert r["n_turns"] == n
    assert r["transcript"].split("\n") == [f"user: {i}" for i in range(n)]
    parts = transcripts.replay(conv, chunked=True).orderBy("chunk").collect()
    assert [p["chunk"] for p in parts] == [0, 1, 2]
    assert [p["n_turns"] for p in parts] == [transcripts.REPLAY_CHUNK, transcripts.REPLAY_CHUNK, 5]
    assert "\n".join(p["transcript"] for p in parts) == r["transcript"]  # chunk order replays the conversation


def test_append_turns_chunked_equals_window(spark):
    conv = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")],
                                 "conv_id long, turn long, role string, text string")
    new_rows = [(1, s, "user", f"m{s}") for s in (9, 2, 3, 15, 4, 11)] + [(2, s, "user", f"n{s}") for s in (5, 1)]
    new = spark.createDataFrame(new_rows, "conv_id long, seq long, role string, text string")
    chunked = transcripts.append_turns(conv, new).orderBy("conv_id", "turn").collect()
    plain = transcripts.append_turns(conv, new.withColumn("seq", F.col("seq").cast("double"))) \
        .orderBy("conv_id", "turn").collect()
    assert chunked == plain
    assert [r["text"] for r in chunked if r["conv_id"] == 1] == ["a", "b", "m2", "m3", "m4", "m9", "m11", "m15"]
    assert [(r["turn"], r["text"]) for r in chunked if r["conv_id"] == 2] == [(0, "n1"), (1, "n5")]


def test_append_turns_hot_conversation_timestamp_order(spark):
    """One conversation holds most new turns, ordered by a timestamp: numbering
    equals a plain per-conversation sort, with ties broken by (role, text)."""
    import datetime as dt
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(3)
    n = 3000
    conv_ids = np.where(rng.random(n) < 0.6, 1, rng.integers(2, 40, n))
    base = dt.datetime(2024, 1, 1)
    ts = [base + dt.timedelta(seconds=int(x)) for x in rng.integers(0, 500, n)]  # many exact ties
    rows = [(int(c), t, "user" if i % 3 else "assistant", f"m{i}") for i, (c, t) in enumerate(zip(conv_ids, ts))]
    new = spark.createDataFrame(rows, "conv_id long, seq timestamp_ntz, role string, text string")
    old = spark.createDataFrame([(1, 0, "assistant", "hola"), (1, 1, "user", "x")],
                                "conv_id long, turn long, role string, text string")
    got = transcripts.append_turns(old, new).toPandas()
    pdf = pd.DataFrame(rows, columns=["conv_id", "seq", "role", "text"]).sort_values(["conv_id", "seq", "role", "text"])
    pdf["turn"] = pdf.groupby("conv_id").cumcount() + np.where(pdf["conv_id"] == 1, 2, 0)
    want = sorted(map(tuple, pdf[["conv_id", "turn", "role", "text"]].itertuples(index=False)))
    added = got[~got["text"].isin(["hola", "x"])][["conv_id", "turn", "role", "text"]]
    assert sorted(map(tuple, added.itertuples(index=False))) == want


@pytest.mark.parametrize("kind", ["dense", "epoch", "equal"])
def test_append_turns_any_order_column(spark, kind):
    """A third of all turns in one conversation, whatever its order column looks like."""
    n = 900
    seq = {"dense": lambda i: i, "epoch": lambda i: 1_700_000_000_000 + 7919 * i, "equal": lambda i: 5}[kind]
    rows = [(1 if i % 3 == 0 else i, seq(i), "user", f"m{i:04d}") for i in range(n)]
    new = spark.createDataFrame(rows, "conv_id long, seq long, role string, text string")
    old = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["text"]): r["turn"] for r in transcripts.append_turns(old, new).collect()}
    hot = [f"m{i:04d}" for i in range(0, n, 3)] + ["m0001"]
    want = sorted(hot, key=lambda t: (seq(int(t[1:])), t))
    assert [got[1, t] for t in want] == list(range(len(want))) and len(got) == n


def test_failed_answer_is_appended_as_assistant_turn(spark):
    conv = transcripts.start_sessions(spark.createDataFrame([(5,)], "conv_id long"))
    asked = transcripts.append_turns(conv, spark.createDataFrame([(5, 1, "user", "¿qué es DCA?")],
                                                                 "conv_id long, seq long, role string, text string"))
    err = spark.createDataFrame([(5, 2, "timeout")], "conv_id long, seq long, error string")
    out = transcripts.append_turns(asked, transcripts.failure_turn(err)).orderBy("turn").collect()
    assert [(r["turn"], r["role"]) for r in out] == [(0, "assistant"), (1, "user"), (2, "assistant")]
    assert out[2]["text"] == transcripts.FAILURE_PREFIX + "timeout"
