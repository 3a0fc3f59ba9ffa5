"""Price and price-index sources.

The canonical price table is ``(series_key string, ts timestamp_ntz, price
double)`` plus optional tie-break columns.  Reading stays lazy and declarative
so that Catalyst pushes the key/date predicates into the Parquet scan and
prunes every column the plan does not use.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.nulls import nan_to_null

PRICE_SCHEMA = T.StructType([
    T.StructField("series_key", T.StringType(), True),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("price", T.DoubleType(), True),
])

CPI_SCHEMA = T.StructType([
    T.StructField("period", T.DateType(), True),
    T.StructField("cpi", T.DoubleType(), True),
])


def _lit_ts(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, _dt.datetime):
        return F.lit(x).cast("timestamp_ntz")
    if isinstance(x, _dt.date):
        return F.lit(x).cast("timestamp_ntz")
    return F.lit(str(x)).cast("timestamp_ntz")


def to_naive(ts: Column, zone: str | None = None) -> Column:
    """Drop a time zone keeping wall-clock time.

    ``ts`` is an instant (``timestamp``) or a zone-less ``timestamp_ntz``; with
    ``zone`` the instant is first rendered as wall-clock time in that zone.
    """
    if zone is None:
        return ts.cast("timestamp_ntz")
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def check_range(start, end) -> None:
    """A plan's start must be before its end."""
    if start is not None and end is not None:
        a = _dt.date.fromisoformat(str(start)[:10]) if not isinstance(start, _dt.date) else start
        b = _dt.date.fromisoformat(str(end)[:10]) if not isinstance(end, _dt.date) else end
        if isinstance(a, _dt.datetime) or isinstance(b, _dt.datetime):
            a = a if isinstance(a, _dt.datetime) else _dt.datetime.combine(a, _dt.time())
            b = b if isinstance(b, _dt.datetime) else _dt.datetime.combine(b, _dt.time())
        if a >= b:
            raise ValueError(f"start ({start}) must be before end ({end})")


def price_scan(df: DataFrame, key: Column | str, ts: Column | str, price: Column | str,
               start=None, end=None, keys: Sequence[str] | None = None,
               extra: Sequence[Column | str] = ()) -> DataFrame:
    """Project a source onto the price schema and filter it.

    The date range is half-open ``[start, end)``, ``end`` optional.  Filters are
    written on the source columns -- keys are cast to the key column's type, not
    the column to text -- so that they reach the Parquet reader as
    ``PushedFilters``; NaN prices become NULL.
    """
    if not isinstance(start, Column) and not isinstance(end, Column):
        check_range(start, end)
    k = F.col(key) if isinstance(key, str) else key
    t = F.col(ts) if isinstance(ts, str) else ts
    p = F.col(price) if isinstance(price, str) else price
    out = df
    if start is not None:
        out = out.where(t >= _lit_ts(start))
    if end is not None:
        out = out.where(t < _lit_ts(end))
    if keys is not None:
        kind = df.select(k.alias("k")).schema["k"].dataType
        out = out.where(k.isin([F.lit(str(x)).cast(kind) for x in keys]) if keys else F.lit(False))
    cols = [k.cast("string").alias("series_key"), t.cast("timestamp_ntz").alias("ts"),
            nan_to_null(p.cast("double")).alias("price")]
    cols += [F.col(c) if isinstance(c, str) else c for c in extra]
    return out.select(*cols)


def in_time_order(prices: DataFrame, key: str = "series_key", ts: str = "ts") -> DataFrame:
    """Rows ascending by key and time (a range-partitioned global sort, for output only)."""
    return prices.orderBy(key, ts)


CORRUPT = "_corrupt_record"
#: Rows with bad cells: keep them with NULLs, or fail.
ON_BAD = ("null", "error")


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header as text cells, without inference, and the raw line of a row with too few or too many
    cells in ``_corrupt_record``."""
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    # without column pruning, as a row's cells are counted only where all are parsed
    return (spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .option("columnPruning", False).schema(schema).csv(path))


def _cell(name: str, kind: str) -> tuple[Column, Column]:
    """A cell's value, and whether it is filled with something that is not of that kind."""
    text = F.trim(F.col(name))
    value = text.try_cast(kind)
    return value, text.isNotNull() & (text != "") & value.isNull()


def _typed(raw: DataFrame, cells: dict[str, tuple[str, str]], malformed: str | None, on_bad: str, keep: Sequence[Column] = ()) -> DataFrame:
    if on_bad not in ON_BAD:
        raise ValueError(f"on_bad must be one of {ON_BAD}, got {on_bad!r}")
    read = {out: _cell(name, kind) for out, (name, kind) in cells.items()}
    bad = F.col(CORRUPT).isNotNull()
    for _, wrong in read.values():
        bad = bad | wrong
    values = {out: nan_to_null(v) if cells[out][1] == "double" else v for out, (v, _) in read.items()}
    if on_bad == "error":
        fail = F.raise_error(F.concat(F.lit("malformed CSV row: "), F.coalesce(CORRUPT, F.concat_ws(",", *[name for name, _ in cells.values()]))))
        values = {out: F.when(bad, fail.cast(cells[out][1])).otherwise(v) for out, v in values.items()}
    flag = [bad.alias(malformed)] if malformed else []
    return raw.select(*keep, *[v.alias(out) for out, v in values.items()], *flag)


def read_price_csv(spark: SparkSession, path: str, series_key: str = "default", date_col: str = "Date", price_col: str = "Close",
                   series_col: str | None = None, malformed: str | None = None, on_bad: str = "null") -> DataFrame:
    """A price CSV with a parsed date column (``Date,Close,...``).

    All columns are read as text and cast, without inference.  Blank cells and the text ``NaN`` come out
    as NULL.  A cell that is no date or no number, and a row with too few or too many cells, is malformed:
    its bad cells are NULL and the column named by ``malformed`` says so, or with ``on_bad="error"`` the
    query fails.  The series is one for the whole file, or the column ``series_col``.
    """
    key = F.col(series_col) if series_col else F.lit(series_key)
    return _typed(_read_csv(spark, path), {"ts": (date_col, "timestamp_ntz"), "price": (price_col, "double")}, malformed, on_bad,
                  [key.alias("series_key")])


def read_cpi_csv(spark: SparkSession, path: str, date_col: str = "Date", value_col: str = "IPC",
                 malformed: str | None = None, on_bad: str = "null") -> DataFrame:
    """The price-index table ``Date,IPC`` -> ``(period date, cpi double)``; bad cells as in ``read_price_csv``."""
    return _typed(_read_csv(spark, path), {"period": (date_col, "date"), "cpi": (value_col, "double")}, malformed, on_bad)


def empty_prices(spark: SparkSession) -> DataFrame:
    """Typed empty price table (the reference returns an untyped empty frame)."""
    return spark.createDataFrame([], PRICE_SCHEMA)


def with_fallback(spark: SparkSession, primary: Callable[[], DataFrame],
                  backup: Callable[[], DataFrame], start=None,
                  empty: Callable[[], DataFrame] | None = None, origin: str | None = None) -> DataFrame:
    """S3: primary source; when it is missing **or** has no rows the backup trimmed
    to ``start``; when the backup is missing too, a typed empty frame.

    Missing means that Spark cannot analyse the source (no such path or table,
    no schema): any other failure is raised, so a passing read error never
    swaps the data set.  ``origin`` names a column that tells which source was
    used (``primary`` or ``backup``).  The emptiness probe of the primary is a
    LIMIT 1 job.
    """
    def told(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(origin, F.lit(name)) if origin else df

    try:
        df = primary()
        if not df.isEmpty():
            return told(df, "primary")
    except AnalysisException:
        pass
    try:
        df = backup()
    except AnalysisException:
        return told((empty or (lambda: empty_prices(spark)))(), "empty")
    return told(df.where(F.col("ts") >= _lit_ts(start)) if start is not None else df, "backup")


def fallback_by_series(spark: SparkSession, primary: Callable[[], DataFrame], backup: Callable[[], DataFrame], start=None,
                       origin: str = "origin") -> DataFrame:
    """S3 for many series: each series comes from the primary if it has a row there, and else from the backup,
    trimmed to ``start``.

    The column ``origin`` tells which, series by series.  A source that Spark cannot analyse has no rows.
    The backup's rows meet one row for each series of the primary, in a left anti join; the null series
    counts as one.  No job runs here.
    """
    def source(read: Callable[[], DataFrame]) -> DataFrame | None:
        try:
            return read()
        except AnalysisException:
            return None

    first, second = source(primary), source(backup)
    if second is not None and start is not None:
        second = second.where(F.col("ts") >= _lit_ts(start))
    if first is not None and second is not None:
        served = first.select(F.col("series_key").alias("__served")).distinct()
        second = second.join(served, F.col("series_key").eqNullSafe(F.col("__served")), "left_anti")
    told = [df.withColumn(origin, F.lit(name)) for df, name in ((first, "primary"), (second, "backup")) if df is not None]
    if not told:
        return empty_prices(spark).withColumn(origin, F.lit("empty"))
    return told[0].unionByName(told[1], allowMissingColumns=True) if len(told) == 2 else told[0]


# ---------------------------------------------------------------------------
# Stand-in series on the driver-generated test tables
# ---------------------------------------------------------------------------

def lineitem_prices(spark: SparkSession, sf_dir: str, start=None, end=None, keys=None) -> DataFrame:
    """Monthly-priced instruments: one series per ``l_partkey``; unit price
    ``l_extendedprice / l_quantity`` at ``l_shipdate``.  Tie columns
    ``(l_orderkey, l_linenumber)`` make the "first observation" deterministic."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return price_scan(li, "l_partkey", "l_shipdate",
                      F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")),
                      start=start, end=end, keys=keys,
                      extra=[F.col("l_orderkey").alias("tie1"), F.col("l_linenumber").cast("bigint").alias("tie2")])


def part_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series grouping for the dense stand-in: part key -> brand
    ``(series_key, group_key)``, keyed like ``lineitem_prices``."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").cast("string").alias("series_key"), F.col("p_brand").alias("group_key"))


def events_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day/week-priced instruments: one series per ``events.user_id``, price
    ``value`` at ``ts`` (every ``ts`` is distinct, so no tie columns)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return price_scan(ev, "user_id", "ts", "value")


def orders_cpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price-index stand-in: a *quarterly* index, the average order total in
    thousands per quarter of ``o_orderdate``, stamped on the quarter's first
    day.  Monthly ledgers therefore meet it only every third month and have to
    fill the rest, like a CPI published late or sparsely.  Rounded to 6
    decimals so the value does not depend on summation order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return (o.groupBy(F.trunc(F.col("o_orderdate"), "quarter").alias("period"))
             .agg(F.round(F.avg("o_totalprice") / 1000.0, 6).alias("cpi")))
