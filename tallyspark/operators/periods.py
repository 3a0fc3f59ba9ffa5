"""Periods: first observation per period (A1, A2) on a gap-free calendar.

Plan shape, per series key:

1. ``groupBy(series_key, period)`` with ``min_by(price, struct(ts, ties...))``
   restricted to non-null prices -- or by the bare timestamp, as a hash
   aggregate, where the caller knows it to be unique.  This is a partial (map-side) aggregate, so
   raw ticks never cross the shuffle -- only one row per (key, period, map
   partition) -- and a hot key is spread over its periods, not one task.
2. One window stage partitioned by ``series_key`` over the *aggregated*
   periods: ``lead(period)`` tells how many empty periods follow each
   observed one, and ``explode(sequence(...))`` fills them in.  That is the
   calendar spine without a join.  Its bounds come from all rows, null-price
   rows included (they still form a group, with a NULL first price).

Later windows (ledgers) use the same ``partitionBy(series_key)``, so Spark
reuses this hash partitioning: no further exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNITS = ("month", "week", "day")


def period_start(ts: Column, unit: str = "month") -> Column:
    """Start of the period containing ``ts`` as a ``date`` (weeks start Monday)."""
    if unit == "month":
        return F.trunc(ts, "month")
    if unit == "week":
        return F.date_trunc("week", ts).cast("date")
    if unit == "day":
        return ts.cast("date")
    raise ValueError(f"unit must be one of {UNITS}, got {unit!r}")


def _step(unit: str) -> Column:
    return F.expr({"month": "INTERVAL 1 MONTH", "week": "INTERVAL 7 DAYS", "day": "INTERVAL 1 DAY"}[unit])


def _prev_period(p: Column, unit: str) -> Column:
    if unit == "month":
        return F.add_months(p, -1)
    return F.date_sub(p, 7 if unit == "week" else 1)


def first_per_period(prices: DataFrame, unit: str = "month", key: str = "series_key",
                     ts: str = "ts", price: str = "price",
                     ties: Sequence[str] | None = None, fill_gaps: bool = True, unique_ts: bool = False) -> DataFrame:
    """A1/A2 (+S6): ``(series_key, period date, price double)``.

    ``price`` is the earliest non-null price of the period, ordered by
    ``(ts, *ties, price)``; periods inside a series' span that have no
    observation appear with a NULL price (``fill_gaps``).

    ``unique_ts`` is the caller's word that no two prices of a key share a
    timestamp: the ordering is then one fixed-width value and Spark plans a
    hash aggregate, where a struct needs every map task to sort its ticks.
    """
    if ties is None:
        ties = [c for c in ("tie1", "tie2") if c in prices.columns]
    p = F.col(price)
    order = F.when(p.isNotNull(), F.col(ts) if unique_ts else F.struct(F.col(ts), *[F.col(c) for c in ties], p))
    firsts = (prices
              .select(F.col(key), period_start(F.col(ts), unit).alias("period"), F.col(ts), p.alias(price),
                      *[F.col(c) for c in ties])
              .groupBy(key, "period")
              .agg(F.min_by(p, order).alias("price")))
    if not fill_gaps:
        return firsts
    return spine_fill(firsts, unit=unit, key=key)


def first_per_period_rollup(prices: DataFrame, mapping: DataFrame, unit: str = "month",
                            from_key: str = "series_key", to_key: str = "group_key",
                            ts: str = "ts", price: str = "price",
                            ties: Sequence[str] | None = None) -> DataFrame:
    """A1 for *groups* of series (e.g. parts -> brands): first non-null price per
    (group, period) over all member series.

    The minimum of the ordering struct is associative, so ticks are first
    reduced per (series, period) -- a partial aggregate -- and only those rows
    are joined to ``mapping (from_key, to_key)`` and reduced again per (group,
    period).  The join never sees raw ticks.  Output ``(series_key, period,
    price)`` with ``series_key`` = the group key, gaps filled.
    """
    if ties is None:
        ties = [c for c in ("tie1", "tie2") if c in prices.columns]
    p = F.col(price)
    order = F.when(p.isNotNull(), F.struct(F.col(ts), *[F.col(c) for c in ties], p))
    per_series = (prices.select(F.col(from_key), period_start(F.col(ts), unit).alias("period"), order.alias("_o"))
                  .groupBy(from_key, "period").agg(F.min("_o").alias("_o")))
    grouped = (per_series.join(mapping.select(from_key, to_key), from_key)
               .groupBy(F.col(to_key).alias("series_key"), "period").agg(F.min("_o").alias("_o")))
    return spine_fill(grouped.select("series_key", "period", F.col("_o")[price].alias("price")), unit=unit)


def spine_fill(periods: DataFrame, unit: str = "month", key: str = "series_key", keep: Sequence[str] = ()) -> DataFrame:
    """S6 on an aggregated ``(key, period, *values)`` table: insert every missing
    period between a series' first and last period, value columns NULL, those
    in ``keep`` as in the period before."""
    values = [c for c in periods.columns if c not in (key, "period")]
    w = Window.partitionBy(key).orderBy("period")
    with_next = periods.withColumn("_next", F.lead("period").over(w))
    last_in_run = F.coalesce(_prev_period(F.col("_next"), unit), F.col("period"))
    exploded = with_next.select(
        F.col(key), *[F.col(v) for v in values],
        F.posexplode(F.sequence(F.col("period"), last_in_run, _step(unit))).alias("_pos", "period"))
    return exploded.select(F.col(key), F.col("period"),
                           *[F.col(v) if v in keep else F.when(F.col("_pos") == 0, F.col(v)).alias(v) for v in values])


def date_spine(prices: DataFrame, unit: str = "month", key: str = "series_key", ts: str = "ts") -> DataFrame:
    """S6 on its own: every period from each series' first to last observation,
    both ends included.  ``(series_key, period)``."""
    bounds = (prices.groupBy(key)
              .agg(F.min(period_start(F.col(ts), unit)).alias("lo"), F.max(period_start(F.col(ts), unit)).alias("hi")))
    return bounds.select(F.col(key), F.explode(F.sequence("lo", "hi", _step(unit))).alias("period"))
