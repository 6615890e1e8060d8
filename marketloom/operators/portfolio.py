"""Weights and prices to returns, curves, metrics, rewards and benchmarks.

A portfolio has one row per date, so a window partition by portfolio is bounded
by the calendar; the large axis is the number of portfolios.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import clip
from marketloom.functions.windows import rolling, series, so_far

# The initial capital and the weights of the reward.
CAPITAL = 100_000.0
REWARD = {"roi": 1.0, "drawdown": 2.0, "volatility": 0.5}


def normalize_weights(weights: DataFrame, eps: float = 0.0, keys: Sequence[str] = ("portfolio_id", "date")) -> DataFrame:
    """Clip to [0, 1] and divide by the sum per vector (+ eps). All-zero
    vectors give NULL without eps."""
    clipped = clip("weight", 0.0, 1.0)
    total = F.sum(clipped).over(Window.partitionBy(*keys))
    return weights.withColumn("weight", F.try_divide(clipped, total + F.lit(eps)))


def period_log_returns(prices: DataFrame, price: str = "price") -> DataFrame:
    """Forward log return of every (ticker, date) to the next date; missing
    prices give 0. The last date has no return and drops out.

    Input: a dense price table (every ticker on every date).
    """
    order = series()
    value = F.ln(F.try_divide(F.lead(price).over(order), F.col(price)))
    return prices.select(
        "ticker", "date", F.lead("date").over(order).alias("next_date"), F.coalesce(value, F.lit(0.0)).alias("log_return")
    ).where(F.col("next_date").isNotNull())


def with_next_date(weights: DataFrame) -> DataFrame:
    """Adds ``next_date``, the portfolio's next weight date; NULL on the last one."""
    after = F.lead("date").over(series("portfolio_id"))
    own_date = Window.partitionBy("portfolio_id", "date")
    return weights.withColumn("_after", F.when(after > F.col("date"), after)).withColumn("next_date", F.max("_after").over(own_date)).drop("_after")


def portfolio_returns(weights: DataFrame, prices: DataFrame, price: str = "price") -> DataFrame:
    """exp(sum of weight x log return) - 1 per (portfolio, weight date), held until
    the portfolio's next weight date. A missing price of an asset counts as no
    change; a period drops out if one of its ends is in no row of the price table.

    Each weight becomes two rows, one for either end of its period, so that one join
    finds both prices: weights and prices are read once each.
    """
    held = with_next_date(weights.select("portfolio_id", "date", "ticker", "weight")).where(F.col("next_date").isNotNull())
    ends = F.inline(F.array(F.struct(F.col("date").alias("_at"), F.lit(True).alias("_opens")), F.struct(F.col("next_date").alias("_at"), F.lit(False).alias("_opens"))))
    legs = held.select("portfolio_id", "date", "next_date", "ticker", "weight", ends)
    known = prices.select("ticker", F.col("date").alias("_at"), F.col(price).alias("_price"), F.lit(1).alias("_known"))
    opens = F.col("_opens")
    both = legs.join(known, ["ticker", "_at"], "left").groupBy("portfolio_id", "date", "next_date", "ticker").agg(
        F.sum(F.when(opens, F.col("weight"))).alias("weight"), F.max(F.when(opens, F.col("_price"))).alias("_open"), F.max(F.when(~opens, F.col("_price"))).alias("_close"),
        F.count(F.when(opens, F.col("_known"))).alias("_n"), F.count(F.when(~opens, F.col("_known"))).alias("_m"),
    )
    change = F.coalesce(F.ln(F.try_divide("_close", "_open")), F.lit(0.0))
    out = both.groupBy("portfolio_id", "date", "next_date").agg(
        (F.exp(F.sum(F.col("weight") * change)) - 1).alias("ret"), F.sum("_n").alias("_n"), F.sum("_m").alias("_m")
    )
    return out.where("_n > 0 AND _m > 0").drop("_n", "_m")


def equity_curve(returns: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """Value after each period, with the initial capital as first row.

    Output: (portfolio_id, date, ret, value); the first row has no return.
    """
    own = F.struct(F.col("next_date").alias("date"), F.col("ret"))
    start = F.struct(F.col("date"), F.lit(None).cast("double").alias("ret"))
    is_first = F.lag("date").over(series("portfolio_id")).isNull()
    rows = returns.withColumn("_first", is_first).select(
        "portfolio_id", F.inline(F.when(F.col("_first"), F.array(start, own)).otherwise(F.array(own)))
    )
    growth = F.product(F.coalesce(F.lit(1.0) + F.col("ret"), F.lit(1.0))).over(so_far("portfolio_id"))
    return rows.select("portfolio_id", "date", "ret", (growth * F.lit(capital)).alias("value"))


def with_drawdown(curve: DataFrame) -> DataFrame:
    """Distance below the highest value so far (0 or negative)."""
    peak = F.max("value").over(so_far("portfolio_id"))
    return curve.withColumn("drawdown", F.try_divide(F.col("value") - peak, peak))


def _sharpe(mean: Column, std: Column, periods: int) -> Column:
    scale = F.sqrt(F.lit(float(periods)))
    return F.when(std > 0, F.try_divide(mean, std) * scale).otherwise(F.lit(0.0))


def performance_metrics(curve: DataFrame, periods: int = 12) -> DataFrame:
    """Total and annualised return, Sharpe ratio, volatility, drawdown and final
    value per portfolio."""
    mean, std = F.avg("ret"), F.stddev_samp("ret")
    out = with_drawdown(curve).groupBy("portfolio_id").agg(
        F.count("ret").alias("n_periods"),
        F.min_by("value", "date").alias("_start"),
        F.max_by("value", "date").alias("final_value"),
        _sharpe(mean, std, periods).alias("sharpe_ratio"),
        (std * F.sqrt(F.lit(float(periods)))).alias("volatility"),
        F.abs(F.min("drawdown")).alias("max_drawdown"),
    )
    total = out.withColumn("total_return", F.try_divide(F.col("final_value") - F.col("_start"), F.col("_start")))
    yearly = F.pow(F.lit(1.0) + F.col("total_return"), F.try_divide(F.lit(float(periods)), F.col("n_periods"))) - 1
    return total.select(
        "portfolio_id", "n_periods", "total_return", yearly.alias("annualized_return"), "sharpe_ratio", "volatility",
        "max_drawdown", "final_value",
    )


def episode_metrics(curve: DataFrame, periods: int = 252) -> DataFrame:
    """The episode variant: returns from consecutive values, scaled by 252.

    A portfolio with its initial row only has no metrics and drops out.
    """
    value = F.col("value")
    stepped = with_drawdown(curve).withColumn(
        "_r", F.try_divide(value, F.lag("value").over(series("portfolio_id"))) - 1
    )
    mean, std = F.avg("_r"), F.stddev_samp("_r")
    out = stepped.groupBy("portfolio_id").agg(
        F.count("_r").alias("_n"), F.min_by("value", "date").alias("_start"), F.max_by("value", "date").alias("final_value"),
        _sharpe(mean, std, periods).alias("sharpe_ratio"), F.abs(F.min("drawdown")).alias("max_drawdown"),
        (std * F.sqrt(F.lit(float(periods)))).alias("volatility"),
    ).where(F.col("_n") > 0)
    return out.select(
        "portfolio_id", F.try_divide(F.col("final_value") - F.col("_start"), F.col("_start")).alias("total_return"),
        "sharpe_ratio", "max_drawdown", "volatility", "final_value",
    )


def reward_series(
    curve: DataFrame, roi: float = REWARD["roi"], drawdown: float = REWARD["drawdown"],
    volatility: float = REWARD["volatility"], n: int = 20,
) -> DataFrame:
    """Per-step reward: return, minus the worst drawdown so far, minus the
    spread of the last n returns (0 until there are n)."""
    key = "portfolio_id"
    down = with_drawdown(curve)
    parts = down.select(
        key, "date", "ret",
        F.abs(F.min("drawdown").over(so_far(key))).alias("max_drawdown"),
        F.coalesce(rolling(F.stddev_samp, "ret", n, key), F.lit(0.0)).alias("recent_volatility"),
    ).where(F.col("ret").isNotNull())
    reward = (
        F.lit(roi) * F.col("ret") - F.lit(drawdown) * F.col("max_drawdown") - F.lit(volatility) * F.col("recent_volatility")
    )
    return parts.withColumn("reward", reward)


def equal_weight_returns(prices: DataFrame, price: str = "price", name: str = "Equal-Weighted") -> DataFrame:
    """Portfolio returns with weight 1/N on every date of the dense price table;
    a missing return counts as 0 and keeps its share."""
    forward = period_log_returns(prices, price)
    return forward.groupBy("date", "next_date").agg((F.exp(F.avg("log_return")) - 1).alias("ret")).select(
        F.lit(name).alias("portfolio_id"), "date", "next_date", "ret"
    )


def return_metrics(returns: DataFrame, total: Column, periods: int = 12, value: str = "ret") -> DataFrame:
    """Annualised return, Sharpe ratio and volatility from a return column;
    ``total`` is the aggregate for the total return."""
    mean, std = F.avg(value), F.stddev_samp(value)
    out = returns.groupBy("portfolio_id").agg(
        F.count(value).alias("n_periods"), total.alias("total_return"), _sharpe(mean, std, periods).alias("sharpe_ratio"),
        (std * F.sqrt(F.lit(float(periods)))).alias("volatility"),
    )
    yearly = F.pow(F.lit(1.0) + F.col("total_return"), F.try_divide(F.lit(float(periods)), F.col("n_periods"))) - 1
    return out.select("portfolio_id", "total_return", yearly.alias("annualized_return"), "sharpe_ratio", "volatility")


def equal_weight_benchmark(prices: DataFrame, price: str = "price", periods: int = 12) -> DataFrame:
    returns = equal_weight_returns(prices, price)
    return return_metrics(returns, F.product(F.lit(1.0) + F.col("ret")) - 1, periods)


def backward_log_returns(prices: DataFrame, ticker: str, price: str = "price") -> DataFrame:
    """Log returns of one asset, missing ones dropped."""
    own = prices.where(F.col("ticker") == ticker)
    value = F.ln(F.try_divide(F.col(price), F.lag(price).over(series())))
    return own.select(F.concat("ticker", F.lit(" Buy & Hold")).alias("portfolio_id"), "date", value.alias("ret")).where(
        F.col("ret").isNotNull()
    )


def buy_and_hold(prices: DataFrame, ticker: str, price: str = "price", periods: int = 12) -> DataFrame:
    """One-asset benchmark: Sharpe ratio and volatility of the log returns, the
    total from their exponential. No row when the asset is absent."""
    returns = backward_log_returns(prices, ticker, price)
    return return_metrics(returns, F.exp(F.sum("ret")) - 1, periods)


def benchmark_metrics(prices: DataFrame, ticker: str | None = None, price: str = "price", periods: int = 12, name: str = "Equal-Weighted") -> DataFrame:
    """``equal_weight_benchmark`` and, if a ticker is given, ``buy_and_hold`` of it,
    from one pass over the dense price table."""
    order = series()
    forward = F.coalesce(F.ln(F.try_divide(F.lead(price).over(order), F.col(price))), F.lit(0.0))
    steps = prices.select("ticker", "date", F.lead("date").over(order).isNotNull().alias("_goes_on"), forward.alias("_forward"), F.ln(F.try_divide(F.col(price), F.lag(price).over(order))).alias("_backward"))
    even = F.when(F.col("_goes_on"), F.struct(F.lit(name).alias("portfolio_id"), F.lit(True).alias("_even"), F.col("_forward").alias("_log")))
    own = F.when((F.col("ticker") == F.lit(ticker)) & F.col("_backward").isNotNull(), F.struct(F.concat("ticker", F.lit(" Buy & Hold")).alias("portfolio_id"), F.lit(False).alias("_even"), F.col("_backward").alias("_log")))
    rows = steps.select("date", F.explode(F.filter(F.array(even, own), lambda x: x.isNotNull())).alias("_r")).select("date", "_r.*")
    mean = F.avg("_log")
    returns = rows.groupBy("portfolio_id", "_even", "date").agg(F.when(F.col("_even"), F.exp(mean) - 1).otherwise(mean).alias("ret"))
    total = F.when(F.first("_even"), F.product(F.lit(1.0) + F.col("ret")) - 1).otherwise(F.exp(F.sum("ret")) - 1)
    return return_metrics(returns, total, periods)


def against_benchmarks(metrics: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """``metrics`` with a row for each benchmark: excess annualised return and Sharpe
    improvement over it; one row with NULLs if there is none.

    Every portfolio meets every benchmark, which is the result itself. The join
    has a key for it: portfolios are dealt to as many groups as there are shuffle
    partitions, and each group gets its own copy of the benchmarks.
    """
    groups = int(metrics.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = metrics.withColumn("_group", F.pmod(F.xxhash64("portfolio_id"), F.lit(groups)).cast("int"))
    other = benchmarks.select(
        F.col("portfolio_id").alias("benchmark"), F.col("annualized_return").alias("_a"), F.col("sharpe_ratio").alias("_s"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"),
    )
    return dealt.join(other, "_group", "left").select(
        *metrics.columns, "benchmark", (F.col("annualized_return") - F.col("_a")).alias("excess_return"),
        (F.col("sharpe_ratio") - F.col("_s")).alias("sharpe_improvement"),
    )


def compare_to_benchmarks(metrics: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Excess annualised return and Sharpe improvement over each benchmark."""
    out = against_benchmarks(metrics, benchmarks).where(F.col("benchmark").isNotNull())
    return out.select("portfolio_id", "benchmark", "excess_return", "sharpe_improvement")


def rolling_sharpe_ratio(returns: DataFrame, n: int = 12, value: str = "ret") -> DataFrame:
    """Trailing mean / std x sqrt(n periods), NULL until n returns exist."""
    mean, std = rolling(F.avg, value, n, "portfolio_id"), rolling(F.stddev_samp, value, n, "portfolio_id")
    return returns.withColumn("rolling_sharpe", F.try_divide(mean, std) * F.sqrt(F.lit(float(n))))


def drawdown_series(curve: DataFrame) -> DataFrame:
    return with_drawdown(curve).select("portfolio_id", "date", "value", "drawdown")


def recent_weights(weights: DataFrame, n: int = 12) -> DataFrame:
    """Weights of the last n dates of each portfolio. The dates are ranked, not
    the weights."""
    dates = weights.select("portfolio_id", "date").distinct()
    ranked = dates.withColumn("_rank", F.row_number().over(Window.partitionBy("portfolio_id").orderBy(F.desc("date"))))
    recent = ranked.where(F.col("_rank") <= n).select("portfolio_id", "date")
    return weights.join(recent, ["portfolio_id", "date"], "left_semi").select(*weights.columns)


def benchmark_curve(returns: DataFrame, capital: float = CAPITAL, value: str = "ret") -> DataFrame:
    """Capital x running product of (1 + return); no initial row."""
    growth = F.product(F.lit(1.0) + F.col(value)).over(so_far("portfolio_id"))
    return returns.select("portfolio_id", "date", (growth * F.lit(capital)).alias("value"))


# The metrics of an episode.
METRICS = ["total_return", "sharpe_ratio", "max_drawdown", "volatility", "final_value"]


def average_agent_metrics(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("agent").agg(*[F.avg(m).alias(m) for m in METRICS])


def median_run(runs: DataFrame) -> DataFrame:
    """The run with the median reward per agent (the upper one of an even
    number), ties by seed. Input: one row per (agent, seed)."""
    own = Window.partitionBy("agent")
    ranked = runs.withColumn("_rank", F.row_number().over(own.orderBy("reward", "seed"))).withColumn(
        "_n", F.count(F.lit(1)).over(own)
    )
    return ranked.where(F.col("_rank") == F.floor(F.col("_n") / 2) + 1).select("agent", "seed", "reward")


def fallback_allocation(weights: DataFrame, grid: DataFrame) -> DataFrame:
    """Weights on the whole (agent, date, ticker) grid; a vector with any cell
    missing becomes equal weights."""
    keys = ["agent", "date", "ticker"]
    own = Window.partitionBy("agent", "date")
    full = grid.join(weights.select(*keys, "weight"), keys, "left")
    complete = F.count("weight").over(own) == F.count(F.lit(1)).over(own)
    equal = F.lit(1.0) / F.count(F.lit(1)).over(own)
    return full.withColumn("weight", F.when(complete, F.col("weight")).otherwise(equal))


def stack_allocations(weights: DataFrame, modality: str | None = None) -> DataFrame:
    """One vector per date: all agents' weights in agent, then asset order.

    ``modality`` keeps the agents whose name contains it. A vector has a slot for
    each agent and asset on every date; a missing weight is 0.
    """
    chosen = weights if modality is None else weights.where(F.col("agent").contains(modality))
    agents = chosen.agg(F.array_sort(F.collect_set("agent_order"))).scalar()
    assets = (chosen.agg(F.max("asset_order")).scalar() + 1).cast("int")
    cells = F.map_from_entries(F.collect_list(F.struct(F.struct("agent_order", "asset_order").alias("at"), "weight")))
    rows = chosen.groupBy("date").agg(cells.alias("_cells")).withColumn("_agents", agents).withColumn("_slots", F.sequence(F.lit(0), assets - 1))
    kind = chosen.schema["asset_order"].dataType.simpleString()

    def slot(agent: Column, asset: Column) -> Column:
        at = F.struct(agent.alias("agent_order"), asset.cast(kind).alias("asset_order"))
        return F.coalesce(F.try_element_at("_cells", at), F.lit(0.0))

    vector = F.flatten(F.transform("_agents", lambda g: F.transform("_slots", lambda k: slot(g, k))))
    return rows.select("date", vector.alias("allocation"))


def observation_vectors(
    features: DataFrame, sentiment: DataFrame | None = None, width: int | None = None, technical_width: int | None = None
) -> DataFrame:
    """One FLOAT vector per date: technical features, then sentiment features.

    Inputs: (date, position, value). Every position has its slot on every date; a
    missing or NULL value is 0. The widths are the numbers of positions by default.
    """

    def vector(df: DataFrame, size: int | None) -> DataFrame:
        slots = F.lit(size) if size is not None else (df.agg(F.max("position")).scalar() + 1).cast("int")
        cells = F.map_from_entries(F.collect_list(F.struct(F.col("position").cast("int").alias("at"), "value")))
        rows = df.groupBy("date").agg(cells.alias("_cells")).withColumn("_slots", F.sequence(F.lit(0), slots - 1))
        return rows.select("date", F.transform("_slots", lambda p: F.coalesce(F.try_element_at("_cells", p), F.lit(0.0)).cast("float")).alias("_v"))

    technical = vector(features, technical_width).select("date", F.col("_v").alias("_t"))
    if sentiment is None:
        return technical.select("date", F.col("_t").alias("observation"))
    size = F.lit(width) if width is not None else (sentiment.agg(F.max("position")).scalar() + 1).cast("int")
    joined = technical.join(vector(sentiment, width).select("date", F.col("_v").alias("_s")), "date", "left")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    return joined.select("date", F.concat("_t", F.coalesce("_s", zeros)).alias("observation"))
