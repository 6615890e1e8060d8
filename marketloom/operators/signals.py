"""Oscillators, bands, moving averages, trade signals and asset summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import gain_loss
from marketloom.functions.windows import rolling_avg, rolling_std, series, so_far
from marketloom.operators.indicators import cumulative_growth
from marketloom.operators.reshape import pct_change


def add_rsi(df: DataFrame, price: str = "close", n: int = 14, output: str = "rsi") -> DataFrame:
    """Relative strength from simple means of gains and losses over n changes.

    No losses give 100, no change at all gives NULL.
    """
    change = df.withColumn("_change", F.col(price) - F.lag(price).over(series()))
    gain, loss = gain_loss("_change")
    parts = change.withColumn("_gain", gain).withColumn("_loss", loss)
    up, down = rolling_avg("_gain", n), rolling_avg("_loss", n)
    means = parts.withColumn("_up", up).withColumn("_down", down)
    return means.withColumn(output, F.try_divide(F.lit(100.0) * F.col("_up"), F.col("_up") + F.col("_down"))).drop(
        "_change", "_gain", "_loss", "_up", "_down"
    )


#: Rows of a block of the exponential means. Within one, weights span less than a
#: double's range for every span from 2 on.
BLOCK = 256


def with_ema(df: DataFrame, value: str, span: int, output: str) -> DataFrame:
    """Adds the exponential mean of a column without NULLs, per ticker.

    A mean is a running sum of values weighted by powers of 1 - alpha. It runs
    within blocks of rows, so that the powers stay in range, and each block starts
    from what the blocks before it end in, folded over their short list. All windows
    share one exchange on ticker.
    """
    alpha = 2.0 / (span + 1)
    rest = 1.0 - alpha
    if rest == 0.0:
        return df.withColumn(output, F.col(value).cast("double"))
    row, block, at = "_row", "_block", "_at"
    rows = df.withColumn(row, F.row_number().over(series()) - 1)
    rows = rows.withColumn(block, F.floor(F.col(row) / BLOCK)).withColumn(at, F.col(row) % BLOCK)
    share = F.when(F.col(row) == 0, F.col(value)).otherwise(F.col(value) * alpha)
    inside = so_far(["ticker", block])
    power = F.pow(F.lit(rest), F.col(at))
    rows = rows.withColumn("_own", power * F.sum(share / power).over(inside))
    ends = F.collect_list(F.when(F.col(at) == BLOCK - 1, F.col("_own"))).over(series().rowsBetween(Window.unboundedPreceding, -1))
    start = F.aggregate(ends, F.lit(0.0), lambda held, end: held * rest**BLOCK + end)
    return rows.withColumn(output, F.col("_own") + power * rest * start).drop(row, block, at, "_own")


def ema(df: DataFrame, span: int, price: str = "close", output: str = "ema") -> DataFrame:
    """Exponential mean with alpha = 2 / (span + 1), seeded with the first value."""
    known = df.where(F.col(price).isNotNull()).select("ticker", "date", price)
    return with_ema(known, price, span, output)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, price: str = "close") -> DataFrame:
    """Fast minus slow exponential mean, and its own exponential mean."""
    known = df.where(F.col(price).isNotNull()).select("ticker", "date", price)
    both = with_ema(with_ema(known, price, fast, "_fast"), price, slow, "_slow")
    line = both.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return with_ema(line, "macd", signal, "signal")


def sma(price: str = "close", n: int = 50) -> Column:
    return rolling_avg(price, n)


def bollinger(price: str = "close", n: int = 20, k: float = 2.0) -> tuple[Column, Column, Column]:
    """Middle, upper and lower band."""
    middle = rolling_avg(price, n)
    width = rolling_std(price, n) * F.lit(k)
    return middle, middle + width, middle - width


def trade_signals(df: DataFrame) -> DataFrame:
    """buy: rsi < 30 and macd > signal; sell: rsi > 70 and macd < signal;
    missing values compare false."""
    buy = (F.col("rsi") < 30) & (F.col("macd") > F.col("signal"))
    sell = (F.col("rsi") > 70) & (F.col("macd") < F.col("signal"))
    return df.withColumn("buy_signal", F.coalesce(buy, F.lit(False))).withColumn(
        "sell_signal", F.coalesce(sell, F.lit(False))
    )


def signal_table(prices: DataFrame, price: str = "close") -> DataFrame:
    """All indicators and signals per (ticker, date); rows without a price drop out."""
    base = macd(prices, price=price)
    middle, upper, lower = bollinger(price)
    table = add_rsi(base, price).select(
        "ticker", "date", price, "rsi", "macd", "signal",
        middle.alias("sma20"), upper.alias("upper_band"), lower.alias("lower_band"), sma(price).alias("sma50"),
    )
    return trade_signals(table)


def risk_return_summary(prices: DataFrame, price: str = "close", periods: int = 252) -> DataFrame:
    """Total return at the last row and annualised volatility, per ticker."""
    changed = pct_change(prices, price, "_r")
    grown = changed.withColumn("_growth", cumulative_growth("_r", order="date"))
    last = F.max_by("_growth", "date")
    return grown.groupBy("ticker").agg(
        (last - 1).alias("total_return"),
        (F.stddev_samp("_r") * F.sqrt(F.lit(float(periods)))).alias("volatility"),
    )


def sell_candidates(summary: DataFrame) -> DataFrame:
    """Negative total return, or volatility above the median of all assets."""
    middle = summary.agg(F.median("volatility")).scalar()
    return summary.where((F.col("total_return") < 0) | (F.col("volatility") > middle))


def total_return(prices: DataFrame, price: str = "price", order: str = "date") -> DataFrame:
    """First to last known price per ticker."""
    known = prices.where(F.col(price).isNotNull())
    ends = known.groupBy("ticker").agg(F.min_by(price, order).alias("_a"), F.max_by(price, order).alias("_b"))
    return ends.select("ticker", F.try_divide(F.col("_b") - F.col("_a"), F.col("_a")).alias("total_return"))


def best_worst(returns: DataFrame) -> DataFrame:
    """Assets with the highest and the lowest total return, in one row."""
    r = F.col("total_return")
    return returns.agg(
        F.max_by("ticker", r).alias("best"), F.max(r).alias("best_return"),
        F.min_by("ticker", r).alias("worst"), F.min(r).alias("worst_return"),
    )
