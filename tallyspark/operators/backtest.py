"""Many investment plans over many price series in one run.

A plan is a row ``(plan_id, series_key, amount, start, end, annual)``: who buys
what, how much per period, in which half-open range of time, and at which
annual inflation.  Plans never meet ticks:

1. Ticks are reduced once to *atoms*, one row for each series and day: the
   first price, and the first tick of any kind.  This is a partial aggregate in
   the scan's tasks; raw ticks are not shuffled.  Where plans may start within a
   day, such a day is cut at the distinct starts that fall into it.
2. Distinct starts are laid among the atoms of their (series, period), and a
   running minimum from the period's end gives each start, and each whole
   period, its first price and its first tick.
3. Plans take their own start's row, and join the periods of their series.

A period of a plan is the stretch from ``max(start, period start)`` to
``min(end, next period)``.  The first price from the lower end on is the
stretch's if it lies before the upper end, and otherwise the stretch has none;
the same holds for the first tick, which decides whether the period counts.  So
ends need no cuts.  The joined rows are the plans' own ledgers, and a popular
series is a hot key on aggregated rows only, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.kpi import kpi_snapshot
from tallyspark.operators.ledger import dca_ledger_fixed_rate
from tallyspark.operators.periods import period_start, spine_fill

PLAN_COLUMNS = ("plan_id", "series_key", "amount", "start", "end", "annual")


def checked_plans(plans: DataFrame) -> DataFrame:
    """P7 inside the plan: a row whose start is not before its end raises an error."""
    bad = F.raise_error(F.concat(F.lit("start must be before end in plan "), F.col("plan_id").cast("string")))
    start, end = F.col("start").cast("timestamp_ntz"), F.col("end").cast("timestamp_ntz")
    return plans.select("plan_id", "series_key", F.col("amount").cast("double").alias("amount"),
                        F.when(start < end, start).otherwise(bad.cast("timestamp_ntz")).alias("start"), end.alias("end"),
                        F.col("annual").cast("double").alias("annual"))


def atoms(prices: DataFrame, starts: DataFrame | None, unit: str = "month", unique_ts: bool = False) -> DataFrame:
    """Ticks by series and day, and by the ``starts (series_key, at)`` that cut a day:
    ``(series_key, period, at, first struct<ts, ..., price>, seen)``."""
    ties = [] if unique_ts else [c for c in ("tie1", "tie2") if c in prices.columns]
    order = F.when(F.col("price").isNotNull(), F.struct("ts", *ties, "price"))
    ticks = prices.select("series_key", F.col("ts").cast("date").alias("day"), "ts", order.alias("first"))
    at = F.col("day").cast("timestamp_ntz")
    if starts is not None:
        cut_days = (starts.where(F.col("at") > F.col("at").cast("date").cast("timestamp_ntz"))
                    .groupBy("series_key", F.col("at").cast("date").alias("day")).agg(F.collect_set("at").alias("cuts")))
        ticks = ticks.join(cut_days, ["series_key", "day"], "left")
        at = F.coalesce(F.array_max(F.filter("cuts", lambda c: c <= F.col("ts"))), at)
    return (ticks.groupBy("series_key", period_start(F.col("day").cast("timestamp_ntz"), unit).alias("period"), at.alias("at"))
            .agg(F.min("first").alias("first"), F.min("ts").alias("seen")))


def plan_periods(plans: DataFrame, prices: DataFrame, unit: str = "month", unique_ts: bool = False) -> DataFrame:
    """First price of each period of each plan that has a tick, with the plan's terms:
    ``(plan_id, amount, annual, period, price)``.  ``plans`` are checked plans."""
    starts = plans.select("series_key", F.col("start").alias("at")).where(F.col("series_key").isNotNull()).distinct()
    within_days = any(f.name == "start" and not isinstance(f.dataType, T.DateType) for f in plans.schema.fields)
    days = atoms(prices, starts if within_days else None, unit, unique_ts)
    # a start is a row without ticks; from the period's end, peers included
    marks = starts.select("series_key", period_start(F.col("at"), unit).alias("period"), "at", F.lit(True).alias("mark"))
    rows = days.withColumn("mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    onward = Window.partitionBy("series_key", "period").orderBy(F.col("at").desc())
    looked = rows.select("series_key", "period", "at", "mark", F.min("first").over(onward).alias("first"), F.min("seen").over(onward).alias("seen"))
    own = looked.where("mark").select("series_key", F.col("at").alias("start"), F.col("first").alias("own_first"), F.col("seen").alias("own_seen"))
    whole = days.groupBy("series_key", "period").agg(F.min("first").alias("first"), F.min("seen").alias("seen"))
    met = (plans.withColumn("start", F.col("start").cast("timestamp_ntz")).join(own, ["series_key", "start"]).join(whole, "series_key"))
    begins = period_start(F.col("start"), unit)
    first = F.when(F.col("period") == begins, F.col("own_first")).otherwise(F.col("first"))
    seen = F.when(F.col("period") == begins, F.col("own_seen")).otherwise(F.col("seen"))
    return (met.where((F.col("period") >= begins) & (seen < F.col("end")))
            .select("plan_id", "amount", "annual", "period", F.when(first["ts"] < F.col("end"), first["price"]).alias("price")))


def plan_ledgers(plans: DataFrame, prices: DataFrame, unit: str = "month", unique_ts: bool = False) -> DataFrame:
    """C2 ledger of every plan: ``(plan_id, period, nominal, real, value)``; a plan without prices has no rows.

    ``plan_id`` tells plans apart and may be null once.  A null series has no prices.  NaN prices are
    expected to be NULL already, as ``price_scan`` makes them.  A ``start`` of type date needs no cuts
    within days.
    """
    dates = isinstance(plans.schema["start"].dataType, T.DateType)
    checked = checked_plans(plans)
    if dates:
        checked = checked.withColumn("start", F.col("start").cast("date"))
    firsts = spine_fill(plan_periods(checked, prices, unit, unique_ts), unit=unit, key="plan_id", keep=("amount", "annual"))
    return dca_ledger_fixed_rate(firsts, F.col("amount"), F.col("annual"), unit, key="plan_id")


def backtest(plans: DataFrame, prices: DataFrame, unit: str = "month", unique_ts: bool = False) -> DataFrame:
    """KPI snapshot of every plan: its last period, sums, and the two percentages."""
    return kpi_snapshot(plan_ledgers(plans, prices, unit, unique_ts), key="plan_id")
