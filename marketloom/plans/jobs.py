"""The four jobs a user runs: features, risk, sentiment validation, backtest.

Each is one lazy plan; nothing is collected between the steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from marketloom.functions.scalars import NEGATIVE_WORDS, POSITIVE_WORDS
from marketloom.operators import indicators, portfolio, reshape, sentiment, validation
from marketloom.operators.features import daily_features
from marketloom.schemas import SOURCES


def daily_feature_job(prices: DataFrame) -> DataFrame:
    """Daily prices to the ten-column feature table."""
    return daily_features(prices)


def monthly_prices(prices: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Adjusted (or plain) close, calendar completed, filled, rounded, and
    reduced to month ends."""
    field = reshape.select_price_field(prices, "close") if "adj_close" in prices.columns else prices
    filled = reshape.fill_forward_back(reshape.densify(field, ["close"]), "close")
    return reshape.month_end_price(filled)


def monthly_risk_job(prices: DataFrame, n: int = 21, periods: int = 252) -> DataFrame:
    """Month-end price, return, trailing volatility and Sharpe ratio per asset."""
    returns = reshape.monthly_log_return(monthly_prices(prices))
    mean = indicators.rolling_annual_mean("log_return", n, periods)
    vol = indicators.rolling_annual_vol("log_return", n, periods)
    measured = returns.select("ticker", "month_end", "price", "log_return", mean.alias("mean_return"), vol.alias("volatility"))
    return measured.withColumn("sharpe", indicators.sharpe("mean_return", "volatility"))


def monthly_indicator_job(prices: DataFrame, assets: DataFrame, digits: int | None = 4) -> DataFrame:
    """All scaled risk indicators and pair correlations, long form."""
    returns = reshape.monthly_log_return(monthly_prices(prices))
    ordered = returns.join(assets.select("ticker", "asset_order"), "ticker")
    return indicators.risk_indicators(ordered, digits=digits, assets=assets)


def monthly_sentiment_job(
    articles: DataFrame,
    sources: Sequence[str] = SOURCES,
    mode: str = "count",
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
) -> DataFrame:
    """Articles to the monthly table with source columns and weighted score:
    one map-side scoring pass and one aggregate."""
    scored = sentiment.with_lexicon(articles, "headline", positive, negative)
    return sentiment.weighted_sentiment(sentiment.merge_sources(scored, sources), mode, sources)


def sentiment_validation_job(monthly: DataFrame, daily_returns: DataFrame, extended: bool = False) -> DataFrame:
    """Monthly sentiment against monthly returns: correlations and p-values."""
    merged = validation.join_sentiment_returns(monthly, validation.monthly_returns(daily_returns))
    return validation.validation_summary(merged, extended=extended)


def backtest_job(weights: DataFrame, prices: DataFrame, benchmark: str | None = None) -> DataFrame:
    """Weights and dense prices to metrics and the gap to the benchmarks. The weights
    are read once and the prices twice, for the portfolios and for the benchmarks."""
    curve = portfolio.equity_curve(portfolio.portfolio_returns(portfolio.normalize_weights(weights), prices))
    metrics = portfolio.performance_metrics(curve)
    return portfolio.against_benchmarks(metrics, portfolio.benchmark_metrics(prices, benchmark))
