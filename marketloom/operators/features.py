"""Daily feature table: returns, moving averages, rolling risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.scalars import rounding
from marketloom.functions.windows import rolling_avg, rolling_std, series, trailing
from marketloom.operators.reshape import densify, log_return

SHARPE_EPS = 1e-8
# The names of the features.
DAILY_COLUMNS = [
    "log_return", "sma10", "sma30", "volatility_10",
    "log_return_mean_60", "log_return_std_60", "sharpe_60",
    "log_return_mean_120", "log_return_std_120", "sharpe_120",
]


def sma_ratio(price: str, n: int) -> Column:
    """Moving average relative to the current price, minus one."""
    return F.try_divide(rolling_avg(price, n), F.col(price)) - 1


def rolling_mean(value: str, n: int) -> Column:
    return rolling_avg(value, n)


def rolling_deviation(value: str, n: int) -> Column:
    return rolling_std(value, n)


def rolling_sharpe(df: DataFrame, value: str, n: int, output: str = "sharpe", eps: float = SHARPE_EPS) -> DataFrame:
    """Mean over (std + eps), not annualised."""
    return df.withColumn(output, rolling_mean(value, n) / (rolling_deviation(value, n) + F.lit(eps)))


def daily_features(
    prices: DataFrame, price: str = "close", digits: int | None = 4, listed_only: bool = False, dense: bool = False
) -> DataFrame:
    """Ten features per (date, ticker), rounded, NULL then replaced by 0.

    The calendar is the union of all tickers' dates, and missing returns count
    as 0 before the rolling statistics, also before listing; ``listed_only``
    keeps only rows with a price. ``dense=True`` says the input already has a
    row per ticker and date. One exchange on ticker serves all windows.
    """
    grid = prices if dense else densify(prices, [price])
    if listed_only:
        grid = grid.where(F.col(price).isNotNull())
    base = log_return(grid, price, fill=0.0)
    # Every frame is evaluated once under a name of its own; the ratios follow
    # in a projection. Returns are never NULL after the fill, so the row number
    # stands in for the count of values in their frames.
    r = F.col("log_return")
    sums = [F.row_number().over(series()).alias("_row")]
    for n in (10, 30):
        sums += [F.sum(price).over(trailing(n)).alias(f"_p{n}"), F.count(price).over(trailing(n)).alias(f"_c{n}")]
    for n in (10, 60, 120):
        sums += [F.sum(r).over(trailing(n)).alias(f"_s{n}"), F.stddev_samp(r).over(trailing(n)).alias(f"_d{n}")]
    framed = base.select("date", "ticker", price, "log_return", *sums)

    def ratio(n: int) -> Column:
        mean = F.when(F.col(f"_c{n}") == n, F.col(f"_p{n}") / n)
        return F.try_divide(mean, F.col(price)) - 1

    def mean(n: int) -> Column:
        return F.when(F.col("_row") >= n, F.col(f"_s{n}") / n)

    def std(n: int) -> Column:
        return F.when(F.col("_row") >= n, F.col(f"_d{n}"))

    table = framed.select(
        "date",
        "ticker",
        "log_return",
        ratio(10).alias("sma10"),
        ratio(30).alias("sma30"),
        std(10).alias("volatility_10"),
        *[c.alias(f"log_return_{name}_{n}") for n in (60, 120) for name, c in (("mean", mean(n)), ("std", std(n)))],
        *[(mean(n) / (std(n) + F.lit(SHARPE_EPS))).alias(f"sharpe_{n}") for n in (60, 120)],
    )
    finish = [
        F.coalesce(F.col(c) if digits is None else rounding(c, digits), F.lit(0.0)).alias(c) for c in DAILY_COLUMNS
    ]
    return table.select("date", "ticker", *finish)
