"""Monthly risk indicators, min-max scaling and the text feature vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import rounding
from marketloom.functions.windows import rolling, so_far
from marketloom.operators.correlation import pair_index, rolling_pair_corr
from marketloom.operators.reshape import align_dates

# The names of the indicators.
INDICATORS = ["sharpe", "sortino", "calmar", "volatility", "max_drawdown"]


def rolling_annual_mean(value: str, n: int = 21, periods: int = 252, order: str = "month_end") -> Column:
    return rolling(F.avg, value, n, order=order) * F.lit(float(periods))


def rolling_annual_vol(value: str, n: int = 21, periods: int = 252, order: str = "month_end") -> Column:
    return rolling(F.stddev_samp, value, n, order=order) * F.sqrt(F.lit(float(periods)))


def ratio_or_zero(top: Column | str, bottom: Column | str) -> Column:
    """top / bottom, 0 where bottom is 0, NULL where either is NULL."""
    top = F.col(top) if isinstance(top, str) else top
    bottom = F.col(bottom) if isinstance(bottom, str) else bottom
    return F.when(bottom == 0, F.lit(0.0)).otherwise(F.try_divide(top, bottom))


def sharpe(mean: Column | str, vol: Column | str, zero_guard: bool = True) -> Column:
    """Mean over volatility; zero volatility gives 0 (NULL without the guard)."""
    if zero_guard:
        return ratio_or_zero(mean, vol)
    mean = F.col(mean) if isinstance(mean, str) else mean
    return F.try_divide(mean, F.col(vol) if isinstance(vol, str) else vol)


def downside_vol(value: str, n: int = 21, periods: int = 252, order: str = "month_end") -> Column:
    """Volatility over the last n negative observations, on negative rows only.

    The sign joins the partition key, so the trailing frame counts negative
    rows; data that is already partitioned by ticker is not shuffled again.
    """
    negative = F.coalesce(F.col(value) < 0, F.lit(False))
    frame = Window.partitionBy("ticker", negative).orderBy(order).rowsBetween(-(n - 1), 0)
    full = negative & (F.count(F.col(value)).over(frame) == n)
    return F.when(full, F.stddev_samp(value).over(frame)) * F.sqrt(F.lit(float(periods)))


def sortino(mean: str, downside: str, vol: str | None) -> Column:
    """Mean over downside volatility, or over total volatility where there is
    none (``vol=None`` leaves those rows NULL)."""
    base = F.col(downside) if vol is None else F.coalesce(F.col(downside), F.col(vol))
    return ratio_or_zero(mean, base)


def cumulative_growth(value: Column | str, keys: str | Sequence[str] = "ticker", order: str = "month_end") -> Column:
    """Running product of (1 + value); negative factors are fine, NULL is skipped
    (and yields NULL on its own row)."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNotNull(), F.product(F.lit(1.0) + value).over(so_far(keys, order)))


def rolling_drawdown(growth: str, n: int = 21, order: str = "month_end") -> Column:
    """Distance below the peak of the trailing n rows."""
    peak = rolling(F.max, growth, n, order=order)
    return F.try_divide(F.col(growth) - peak, peak)


def rolling_max_drawdown(drawdown: str, n: int = 21, order: str = "month_end") -> Column:
    return rolling(F.min, drawdown, n, order=order)


def calmar(mean: Column | str, max_drawdown: Column | str) -> Column:
    down = F.col(max_drawdown) if isinstance(max_drawdown, str) else max_drawdown
    return ratio_or_zero(mean, F.abs(down))


def indicator_table(
    returns: DataFrame, n: int = 21, periods: int = 252, value: str = "log_return", order: str = "month_end"
) -> DataFrame:
    """Un-normalised indicators, one row per (ticker, month): all windows share
    one exchange on ticker."""
    keep = ["ticker", order, value]
    base = returns.where(F.col(value).isNotNull()).select(
        *keep,
        rolling_annual_mean(value, n, periods, order).alias("mean_return"),
        rolling_annual_vol(value, n, periods, order).alias("volatility"),
        cumulative_growth(value, order=order).alias("growth"),
    )
    down = base.withColumn("_drawdown", rolling_drawdown("growth", n, order))
    worst = down.withColumn("_worst", rolling_max_drawdown("_drawdown", n, order))
    side = worst.withColumn("_downside", downside_vol(value, n, periods, order))
    return side.select(
        *keep,
        "mean_return",
        "growth",
        sharpe("mean_return", "volatility").alias("sharpe"),
        sortino("mean_return", "_downside", "volatility").alias("sortino"),
        calmar("mean_return", "_worst").alias("calmar"),
        "volatility",
        F.abs("_worst").alias("max_drawdown"),
        F.col("_drawdown").alias("drawdown"),
        F.col("_downside").alias("downside_vol"),
    )


def minmax_normalize(
    df: DataFrame,
    keys: str | Sequence[str],
    value: str = "value",
    constant: float | None = 0.5,
    fit: Column | None = None,
) -> DataFrame:
    """Scale to [0, 1] per key; a constant key becomes ``constant``, NULL 0.

    The fit uses every row, future ones included, unless ``fit`` names the
    training rows. A key is one feature: its rows are bounded by the calendar.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    whole = Window.partitionBy(*keys)
    fitted = F.col(value) if fit is None else F.when(fit, F.col(value))
    low, high = F.min(fitted).over(whole), F.max(fitted).over(whole)
    scaled = F.try_divide(F.col(value) - low, high - low)
    if constant is not None:
        scaled = F.when(high - low == 0, F.lit(constant)).otherwise(scaled)
    return df.withColumn(value, F.coalesce(scaled, F.lit(0.0)))


def risk_indicators(
    returns: DataFrame, n: int = 21, periods: int = 252, digits: int | None = 4, block: int = 32,
    constant: float | None = 0.5, assets: DataFrame | None = None,
) -> DataFrame:
    """Five indicators per asset and one correlation per asset pair, scaled.

    Input: dense monthly returns (ticker, asset_order, month_end, log_return).
    Output: long (month_end, feature, value), features named
    ``{ticker}_{indicator}`` and ``corr_{j}``.
    """
    table = indicator_table(returns, n, periods)
    per_asset = table.unpivot(["ticker", "month_end"], INDICATORS, "indicator", "value").select(
        "month_end", F.concat_ws("_", "ticker", "indicator").alias("feature"), "value"
    )
    listed = returns if assets is None else assets
    n_assets = (listed.agg(F.max("asset_order")).scalar() + 1).cast("bigint")
    pairs = rolling_pair_corr(returns, n, block=block, assets=assets).select(
        "month_end",
        F.concat(F.lit("corr_"), pair_index(F.col("i").cast("bigint"), F.col("k"), n_assets)).alias("feature"),
        F.col("corr").alias("value"),
    )
    scaled = minmax_normalize(per_asset.unionByName(pairs), "feature", constant=constant)
    return scaled if digits is None else scaled.withColumn("value", rounding("value", digits))


def nlp_features(sentiment: DataFrame, volatility: DataFrame, constant: float | None = 0.5) -> DataFrame:
    """Volatilities then sentiments in asset order, per date, scaled again.

    Both inputs: (date, asset_order, value). Dates in only one input drop out.
    Output: (date, feature_idx, value).
    """
    n_assets = (volatility.agg(F.max("asset_order")).scalar() + 1).cast("int")
    volatility, sentiment = align_dates(volatility, sentiment)
    vol = volatility.select(
        "date", F.col("asset_order").cast("int").alias("feature_idx"), "value"
    )
    sent = sentiment.select(
        "date", (F.col("asset_order") + n_assets).cast("int").alias("feature_idx"), "value"
    )
    return minmax_normalize(vol.unionByName(sent), "feature_idx", constant=constant)
