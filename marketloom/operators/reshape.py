"""Long and wide form, calendar completion, fills, returns, month ends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import rounding
from marketloom.functions.windows import series, so_far, whole_series


def wide_to_long(
    df: DataFrame,
    id_cols: Sequence[str],
    value_cols: Sequence[str] | None = None,
    key: str = "ticker",
    value: str = "value",
    drop_missing: bool = False,
) -> DataFrame:
    """One row per (id, column)."""
    if value_cols is None:
        value_cols = [c for c in df.columns if c not in set(id_cols)]
    out = df.unpivot(list(id_cols), list(value_cols), key, value)
    return out.where(F.col(value).isNotNull()) if drop_missing else out


def long_to_wide(df: DataFrame, tickers: Sequence[str], value: str, index: str = "date") -> DataFrame:
    """One column per ticker, in the given order."""
    return df.groupBy(index).pivot("ticker", list(tickers)).agg(F.max(value)).select(index, *[F.col(f"`{t}`") for t in tickers])


def date_set(df: DataFrame, key: str = "date") -> DataFrame:
    """Distinct dates, to be broadcast: the values of a DATE column are bounded
    by the calendar (a few thousand rows for decades of days, a few million for
    every date there is), so this is safe at any data size."""
    return F.broadcast(df.select(F.to_date(key).alias(key)).distinct())


def densify(prices: DataFrame, values: Sequence[str] = ("close",), keep: Sequence[str] = ()) -> DataFrame:
    """Give every ticker a row on every date on which any ticker has a price.

    Each row is stretched over the gap up to the ticker's next date (the first
    one also backwards to the calendar start, the last one forwards to its
    end). The calendar enters as one value, an array of its days, in which a
    stretched day finds itself by position: no grid of tickers x dates and no set
    of dates is joined, and the result stays partitioned by ticker, so the windows
    that follow need no further shuffle. ``keep`` names
    columns that depend on the ticker alone. Two rows of a ticker and date raise an
    error: reduce raw records first, as ``read_prices`` does.
    """
    # A row without a date or ticker cannot be placed; saying so here also
    # gives every use of the input the same plan (joins later on would add the
    # same filters to some of them), so its shuffle is computed once.
    prices = prices.where(F.col("date").isNotNull() & F.col("ticker").isNotNull())
    calendar = trading_calendar(prices.where(F.col(values[0]).isNotNull()))
    by_date = series()
    following = F.lead("date").over(by_date)
    twice = F.raise_error(F.concat(F.lit("several prices of one day for "), F.col("ticker"))).cast("date")
    ends = prices.select(
        "ticker", "date", *values, *keep, F.lag("date").over(by_date).isNull().alias("_first"),
        F.when(following == F.col("date"), twice).otherwise(F.date_sub(following, 1)).alias("_to"),
    )
    # the calendar is a column, so that the plan computes it once; it is no part of a shuffle
    start, end = F.get("_calendar", F.lit(0)), F.try_element_at("_calendar", F.lit(-1))
    first_day = F.when(F.col("_first"), start).otherwise(F.greatest("date", start))
    last_day = F.least(F.coalesce("_to", end), end)
    # a row outside the traded range covers no day of it
    days = F.when(first_day <= last_day, F.sequence(first_day, last_day))
    stretched = ends.withColumn("_calendar", calendar).select("ticker", "date", *values, *keep, "_calendar", F.explode(days).alias("_day"))
    # null-safe: else the optimizer asks for a calendar in a place of its own
    stretched = stretched.where(F.get("_calendar", F.datediff("_day", start)).eqNullSafe(F.col("_day")))
    own = F.col("_day") == F.col("date")
    return stretched.select("ticker", F.col("_day").alias("date"), *[F.when(own, F.col(v)).alias(v) for v in values], *keep)


def trading_calendar(traded: DataFrame) -> Column:
    """The dates of a table as one value: every day from the first to the last date in
    order, NULL in place of those that don't occur. Bounded by the calendar."""
    found = traded.agg(F.min("date").alias("start"), F.max("date").alias("end"), F.collect_set("date").alias("dates"))
    days = F.transform(F.sequence("start", "end"), lambda day: F.when(F.array_contains("dates", day), day))
    return found.select(days).scalar()


def select_price_field(prices: DataFrame, output: str = "price") -> DataFrame:
    """Adjusted close for tickers that have the field at all, else close."""
    has_adjusted = F.max(F.col("adj_close").isNotNull()).over(Window.partitionBy("ticker"))
    return prices.select(
        "ticker", "date", F.when(has_adjusted, F.col("adj_close")).otherwise(F.col("close")).alias(output)
    )


def fill_forward_back(df: DataFrame, col: str, back: bool = True) -> DataFrame:
    """Last known value; before the first one, the first known value.

    The backward fill looks ahead in time (it repeats the first price before
    listing); ``back=False`` leaves those rows NULL. After the forward fill
    only rows before the first known value are open, so the backward fill is
    one value per ticker and needs no frame per row.
    """
    filled = F.last(col, ignorenulls=True).over(so_far())
    if back:
        filled = F.coalesce(filled, F.first(col, ignorenulls=True).over(whole_series()))
    return df.withColumn(col, filled)


def change_ratio(price: Column | str, keys: str | Sequence[str] = "ticker", order: str = "date") -> Column:
    price = F.col(price) if isinstance(price, str) else price
    return F.try_divide(price, F.lag(price).over(series(keys, order)))


def log_return(
    df: DataFrame, price: str = "close", output: str = "log_return", fill: float | None = None, order: str = "date"
) -> DataFrame:
    """ln(p / previous p); ``fill`` replaces NULL (0.0 in the daily features)."""
    value = F.ln(change_ratio(price, order=order))
    if fill is not None:
        value = F.coalesce(value, F.lit(fill))
    return df.withColumn(output, value)


def pct_change(df: DataFrame, price: str = "close", output: str = "pct_change", order: str = "date") -> DataFrame:
    return df.withColumn(output, change_ratio(price, order=order) - 1)


def drop_incomplete_dates(df: DataFrame, col: str, order: str = "date") -> DataFrame:
    """Keep the dates on which no ticker misses ``col``."""
    complete = df.groupBy(order).agg(F.count(F.when(F.col(col).isNull(), 1)).alias("_missing"))
    return df.join(date_set(complete.where("_missing = 0"), order), order, "left_semi").select(*df.columns)


def month_end_price(df: DataFrame, price: str = "close", digits: int | None = 2) -> DataFrame:
    """Last known price of each calendar month, labelled by the month end."""
    last = F.max_by(price, "date")
    known = df.where(F.col(price).isNotNull())
    out = known.groupBy("ticker", F.last_day("date").alias("month_end")).agg(last.alias("price"))
    return out if digits is None else out.withColumn("price", rounding("price", digits))


def monthly_log_return(monthly: DataFrame, digits: int | None = 2) -> DataFrame:
    """Log return between consecutive month ends. The first month is dropped, and so
    is one that follows a month without a price: its return would span two."""
    before = F.lag("month_end").over(series(order="month_end"))
    value = F.when(before == F.last_day(F.add_months("month_end", -1)), F.ln(change_ratio("price", order="month_end")))
    out = monthly.withColumn("log_return", value).where(F.col("log_return").isNotNull())
    return out if digits is None else out.withColumn("log_return", rounding("log_return", digits))


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.fill(0.0, list(cols))


def reindex_to(df: DataFrame, spine: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the spine, with NULL where ``df`` has none."""
    return spine.select(*keys).join(df, list(keys), "left")


def align_dates(left: DataFrame, right: DataFrame, key: str = "date") -> tuple[DataFrame, DataFrame]:
    """Both frames reduced to their common dates."""
    return left.join(date_set(right, key), key, "left_semi"), right.join(date_set(left, key), key, "left_semi")


def split_by_date(df: DataFrame, ranges: dict[str, tuple[str, str]], date: str = "date") -> DataFrame:
    """Adds ``split`` by inclusive date ranges and drops rows in none."""
    label = F.lit(None).cast("string")
    for name, (first, last) in reversed(list(ranges.items())):
        inside = F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
        label = F.when(inside, name).otherwise(label)
    return df.withColumn("split", label).where(F.col("split").isNotNull())


def min_history(df: DataFrame, years: float = 5.0) -> DataFrame:
    """Tickers whose first and last date lie at least ``years`` apart."""
    span = df.groupBy("ticker").agg(F.datediff(F.max("date"), F.min("date")).alias("_days"))
    return df.join(span.where(F.col("_days") >= years * 365.25).select("ticker"), "ticker", "left_semi")


def normalized_price(df: DataFrame, price: str = "price", order: str = "date") -> DataFrame:
    """Price relative to the ticker's first row (NULL if that row has none)."""
    return df.withColumn("normalized_price", F.try_divide(F.col(price), F.first(price).over(so_far(order=order))))


def attach_company(df: DataFrame, assets: DataFrame) -> DataFrame:
    """Company name by ticker; Spark broadcasts the asset table while it fits
    the broadcast threshold and sort-merges beyond."""
    return df.join(assets.select("ticker", "company"), "ticker", "left")
