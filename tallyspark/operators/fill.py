"""Forward / backward fill along a series."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def series_window(key: str = "series_key", order: str = "period"):
    return Window.partitionBy(key).orderBy(order)


def running(key: str = "series_key", order: str = "period"):
    return series_window(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole(key: str = "series_key", order: str = "period"):
    return series_window(key, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def ffill(c: str, key: str = "series_key", order: str = "period") -> Column:
    """Last non-null value so far."""
    return F.last(F.col(c), ignorenulls=True).over(running(key, order))


def ffill_bfill(c: str, key: str = "series_key", order: str = "period") -> Column:
    """W4 then W5: forward fill, then back-fill what is left.

    After a forward fill only the leading gap is still empty, and there the
    next non-null value is the series' *first* non-null value.  So the
    back-fill is ``first(ignorenulls)`` over the whole partition -- computed
    once per partition -- instead of a ``CURRENT ROW .. UNBOUNDED FOLLOWING``
    frame, which Spark re-aggregates for every row (quadratic in the number of
    periods of a series)."""
    return F.coalesce(ffill(c, key, order),
                      F.first(F.col(c), ignorenulls=True).over(whole(key, order)))
