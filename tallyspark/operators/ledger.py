"""DCA ledgers (C1, C2) and their building blocks.

Input is the period table from ``periods.first_per_period``:
``(series_key, period, price)`` with NULL prices on empty periods.  All
windows share ``partitionBy(series_key).orderBy(period)``, so the whole ledger
is one exchange (inherited from the period fill) and one sort; Spark puts
window expressions with the same spec in one operator and stacks dependent
ones without re-sorting.  Windows see periods, never raw ticks, so even a key
holding a third of all ticks has only a few thousand rows here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.rates import discount, periodic_rate
from tallyspark.operators.fill import ffill_bfill, running, series_window, whole

# Defaults of the two reference calculations.
LIBRARY_AMOUNT = 1000.0      # per-period contribution of the CPI ledger
APP_AMOUNT = 2000.0          # per-period contribution of the fixed-rate ledger
APP_ANNUAL_INFLATION = 0.05  # annual inflation of the fixed-rate ledger


def masked_cumsum(c: str, key: str = "series_key") -> Column:
    """Running sum that is NULL on rows where ``c`` is NULL (pandas
    ``cumsum`` semantics), and continues after them."""
    return F.when(F.col(c).isNotNull(), F.sum(F.col(c)).over(running(key)))


def number(x: float | Column) -> Column:
    """A parameter that is the same for all rows, or a column of its own."""
    return x if isinstance(x, Column) else F.lit(float(x))


def nominal_ladder(amount: float | Column, key: str = "series_key") -> Column:
    """``amount * period number``; every period counts, empty ones too."""
    return number(amount) * F.row_number().over(series_window(key)).cast("double")


def period_index(key: str = "series_key") -> Column:
    """0, 1, 2, ... per series."""
    return (F.row_number().over(series_window(key)) - 1).cast("bigint")


def prepare_cpi(cpi: DataFrame, normalise_periods: bool = False, unit: str = "month") -> DataFrame:
    """A ``(period, cpi)`` table with one row per period, checked inside the plan.

    As in the reference, index rows join only on the exact period start; with
    ``normalise_periods`` their dates are first truncated to the period start
    (off by default).  NaN values become NULL.  Periods must be unique (a
    duplicate would fan ledger rows out *after* the running sums): a second row
    for a period raises an error when the plan runs.  No job runs here, and the
    join strategy is left to Spark, which knows the table's bytes.
    """
    from tallyspark.functions.nulls import nan_to_null
    from tallyspark.operators.periods import period_start
    period = F.col("period").cast("date")
    if normalise_periods:
        period = period_start(period, unit)
    checked = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("price-index table has duplicate periods")).cast("double"))
    return (cpi.select(period.alias("period"), nan_to_null(F.col("cpi").cast("double")).alias("cpi"))
            .where(F.col("period").isNotNull())
            .groupBy("period").agg(checked.otherwise(F.max("cpi")).alias("cpi")))


def with_cpi(periods: DataFrame, cpi: DataFrame | None, key: str = "series_key",
             prepared: bool = False) -> DataFrame:
    """J1 + W4/W5 + W7: attach ``cpi_raw`` (exact period match), ``cpi``
    (forward- then back-filled along the series) and ``cpi_now`` (the filled
    value of the series' last period -- not the newest index row)."""
    if cpi is None:
        return periods.withColumns({"cpi_raw": F.lit(None).cast("double"),
                                    "cpi": F.lit(None).cast("double"),
                                    "cpi_now": F.lit(None).cast("double")})
    if not prepared:
        cpi = prepare_cpi(cpi)
    j = periods.join(cpi.withColumnRenamed("cpi", "cpi_raw"), "period", "left")
    return j.withColumns({
        "cpi": ffill_bfill("cpi_raw", key),
        "cpi_now": F.last(F.col("cpi_raw"), ignorenulls=True).over(whole(key)),
    })


def dca_ledger_cpi(periods: DataFrame, cpi: DataFrame | None = None, amount: float = LIBRARY_AMOUNT,
                   key: str = "series_key", prepared: bool = False) -> DataFrame:
    """The library ledger.

    Gaps are **not** filled: ``units``/``units_cum``/``value`` are NULL on empty
    periods while ``nominal`` keeps accruing.  With an index,
    ``real_contrib = amount * cpi / cpi_now`` and ``real_cum`` is its running
    sum; without one the index columns are NULL (fixed schema).  A zero price
    counts as missing (``try_divide``), where the reference would give inf.
    """
    a = F.lit(float(amount))
    led = periods.select(F.col(key), F.col("period"), F.col("price"),
                         F.try_divide(a, F.col("price")).alias("units"))
    led = led.withColumns({"units_cum": masked_cumsum("units", key),
                           "nominal": nominal_ladder(amount, key)})
    led = led.withColumn("value", F.col("units_cum") * F.col("price"))
    led = with_cpi(led, cpi, key, prepared=prepared)
    led = led.withColumn("real_contrib", a * F.try_divide(F.col("cpi"), F.col("cpi_now")))
    led = led.withColumn("real_cum", masked_cumsum("real_contrib", key))
    return led.select(key, "period", "price", "units", "units_cum", "value", "nominal",
                      "cpi", "real_contrib", "real_cum")


def dca_ledger_fixed_rate(periods: DataFrame, amount: float | Column = APP_AMOUNT,
                          annual_inflation: float | Column = APP_ANNUAL_INFLATION, unit: str = "month",
                          key: str = "series_key", detail: bool = False) -> DataFrame:
    """The dashboard ledger.

    Prices **are** forward- then back-filled, so every period buys;
    ``real = nominal / (1 + r)^n`` with ``r`` the per-period rate of
    ``annual_inflation`` and ``n`` the period index from 0.  Both parameters
    may be columns of ``periods`` (one value per key), so many plans run at once.
    """
    r = periodic_rate(annual_inflation, unit)
    led = periods.select(F.col(key), F.col("period"), F.col("price"), number(amount).alias("_amount"),
                         (r if isinstance(r, Column) else F.lit(r)).alias("_rate"),
                         ffill_bfill("price", key).alias("price_filled"),
                         nominal_ladder(amount, key).alias("nominal"),
                         period_index(key).alias("n"))
    led = led.withColumn("units", F.try_divide(F.col("_amount"), F.col("price_filled")))
    led = led.withColumn("units_cum", masked_cumsum("units", key))
    led = led.withColumns({"value": F.col("units_cum") * F.col("price_filled"),
                           "real": discount(F.col("nominal"), F.col("_rate"), F.col("n"))})
    if detail:
        return led.select(key, "period", "price", "price_filled", "n", "units", "units_cum",
                          "nominal", "real", "value")
    return led.select(key, "period", "nominal", "real", "value")


def total_units(periods: DataFrame, amount: float = LIBRARY_AMOUNT, key: str = "series_key") -> DataFrame:
    """A3: closed-form total ``sum(amount / price)`` over the periods that have
    a price.  ``(series_key, total_units)``."""
    return (periods.groupBy(key)
            .agg(F.sum(F.try_divide(F.lit(float(amount)), F.col("price"))).alias("total_units")))


def purchasing_power_decay(ledger: DataFrame, key: str = "series_key") -> DataFrame:
    """``V_real = V_nominal * prod(1 - i_t)`` with ``i_t = cpi_t / cpi_{t-1} - 1``
    (0 on the first period) taken from the filled index of a C1 ledger."""
    w = series_window(key)
    i_t = F.coalesce(F.try_divide(F.col("cpi"), F.lag("cpi").over(w)) - 1.0, F.lit(0.0))
    d = ledger.select(key, "period", "nominal", "cpi", i_t.alias("inflation"))
    d = d.withColumn("decay", F.product(1.0 - F.col("inflation")).over(running(key)))
    return d.select(key, "period", "nominal", "inflation", "decay",
                    (F.col("nominal") * F.col("decay")).alias("real"))
