"""Operators the plans describe and the code never had: momentum, recency and
decay weighting, turnover cost, tail risk, bootstrap, recovery, monitoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.stats import safe_corr
from marketloom.functions.windows import rolling, series, so_far
from marketloom.operators.portfolio import with_drawdown


def momentum(prices: DataFrame, k: int = 3, price: str = "price", order: str = "month_end") -> DataFrame:
    """Price change over the last k rows."""
    past = F.lag(price, k).over(series(order=order))
    return prices.withColumn(f"momentum_{k}", F.try_divide(F.col(price), past) - 1)


def sentiment_zscore(monthly: DataFrame, value: str = "sentiment_weighted") -> DataFrame:
    """Distance from the asset's own mean in its own standard deviations."""
    own = Window.partitionBy("ticker")
    score = F.try_divide(F.col(value) - F.avg(value).over(own), F.stddev_samp(value).over(own))
    return monthly.withColumn("zscore", score)


def recency_weighted_sentiment(df: DataFrame, half_life_days: float = 7.0) -> DataFrame:
    """Monthly mean in which an article's weight decays with its distance from
    the month end: exp(-age / half_life_days)."""
    age = F.datediff(F.last_day("date"), F.col("date"))
    weight = F.exp(-age / F.lit(half_life_days))
    scored = df.where(F.col("sentiment_score").isNotNull())
    return scored.groupBy("ticker", "month").agg(
        F.try_divide(F.sum(weight * F.col("sentiment_score")), F.sum(weight)).alias("sentiment_recency")
    )


def decayed_fill(df: DataFrame, value: str, decay: float = 0.9, position: str = "position") -> DataFrame:
    """Forward fill that shrinks with the number of rows since the last value.

    Input: one row per (ticker, position) with consecutive positions.
    """
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("p"), F.col(value).alias("v")))
    last = F.last(known, ignorenulls=True).over(so_far(order=position))
    marked = df.withColumn("_last", last)
    gap = F.col(position) - F.col("_last.p")
    return marked.withColumn(f"{value}_filled", F.col("_last.v") * F.pow(F.lit(decay), gap)).drop("_last")


def turnover(weights: DataFrame, cost: float = 0.001) -> DataFrame:
    """Sum of absolute weight changes per (portfolio, date) and its cost; the
    first date buys from nothing."""
    before = F.lag("weight").over(series(["portfolio_id", "ticker"]))
    moved = weights.withColumn("_move", F.abs(F.col("weight") - F.coalesce(before, F.lit(0.0))))
    return moved.groupBy("portfolio_id", "date").agg(
        F.sum("_move").alias("turnover"), (F.sum("_move") * F.lit(cost)).alias("cost")
    )


def tail_risk(returns: DataFrame, alpha: float = 0.05, value: str = "ret", key: str = "portfolio_id") -> DataFrame:
    """Historical value at risk (interpolated percentile) and the mean return at
    or below it."""
    own = Window.partitionBy(key)
    marked = returns.where(F.col(value).isNotNull()).select(
        key, value, F.percentile(value, F.lit(alpha)).over(own).alias("_var")
    )
    return marked.groupBy(key).agg(
        F.max("_var").alias("var"), F.avg(F.when(F.col(value) <= F.col("_var"), F.col(value))).alias("cvar")
    )


def bootstrap_corr(
    merged: DataFrame, replicates: int = 200, seed: int = 42, x: str = "sentiment_weighted", y: str = "monthly_return"
) -> DataFrame:
    """Spread of the correlation under resampling of an asset's months.

    Every replicate draws as many months as the asset has; the draw is a digest
    of (replicate, slot, seed), so it depends neither on partitioning nor on
    the engine. An asset has one row per month, so its rows fit one short array,
    and all replicates are computed inside it: what leaves the asset's row is one
    number a replicate. Output:
    (ticker, n, corr, corr_mean, corr_low, corr_high, share_positive).
    """
    pairs = merged.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    per_asset = pairs.groupBy("ticker").agg(
        F.array_sort(F.collect_list(F.struct(F.col("month"), F.col(x).alias("x"), F.col(y).alias("y")))).alias("_rows"),
        F.count(F.lit(1)).alias("n"),
        safe_corr(x, y).alias("corr"),
    )

    def drawn(rep: Column, slot: Column) -> Column:
        digest = F.md5(F.concat_ws("-", rep.cast("string"), slot.cast("string"), F.lit(str(seed))))
        return F.get("_rows", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.col("n")).cast("int"))

    def replicate(rep: Column) -> Column:
        """The draws of a replicate, bound to a name so that they are made once."""
        draws = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda slot: drawn(rep, slot))
        return F.transform(F.array(draws), _array_corr)[0]

    per_rep = per_asset.select("ticker", "n", "corr", F.explode(F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), replicate)).alias("r"))
    return per_rep.groupBy("ticker", "n", "corr").agg(
        F.avg("r").alias("corr_mean"), F.percentile("r", F.lit(0.025)).alias("corr_low"),
        F.percentile("r", F.lit(0.975)).alias("corr_high"), F.avg((F.col("r") > 0).cast("double")).alias("share_positive"),
    )


def _array_corr(draws: Column) -> Column:
    """Pearson r of an array of (x, y): NULL on zero variance. Sums of distances from
    the first element, corrected for its distance from the mean."""
    n = F.size(draws).cast("double")
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("x", "y", "xx", "yy", "xy")))

    def add(acc: Column, d: Column) -> Column:
        p, q = d["x"] - draws[0]["x"], d["y"] - draws[0]["y"]
        return F.struct((acc["x"] + p).alias("x"), (acc["y"] + q).alias("y"), (acc["xx"] + p * p).alias("xx"), (acc["yy"] + q * q).alias("yy"), (acc["xy"] + p * q).alias("xy"))

    def finish(acc: Column) -> Column:
        sxx, syy, sxy = acc["xx"] - acc["x"] * acc["x"] / n, acc["yy"] - acc["y"] * acc["y"] / n, acc["xy"] - acc["x"] * acc["y"] / n
        return F.when((sxx > 0) & (syy > 0), F.least(F.greatest(sxy / (F.sqrt(sxx) * F.sqrt(syy)), F.lit(-1.0)), F.lit(1.0)))

    return F.aggregate(draws, zero, add, finish)


def inverse_vol_weights(prices: DataFrame, n: int = 12, value: str = "log_return", name: str = "Inverse-Volatility") -> DataFrame:
    """Weights proportional to 1 / trailing volatility per date; dates on which
    no asset has a positive volatility drop out."""
    vol = prices.withColumn("_vol", rolling(F.stddev_samp, value, n))
    inverse = F.try_divide(F.lit(1.0), F.col("_vol"))
    raw = vol.select("ticker", "date", inverse.alias("_inv")).where(F.col("_inv").isNotNull())
    total = F.sum("_inv").over(Window.partitionBy("date"))
    return raw.select(F.lit(name).alias("portfolio_id"), "date", "ticker", (F.col("_inv") / total).alias("weight"))


def drawdown_recovery(curve: DataFrame) -> DataFrame:
    """Spells below the previous peak: start, end, length in rows, depth, and
    whether the peak was regained."""
    key = "portfolio_id"
    under = with_drawdown(curve).withColumn("_under", F.col("drawdown") < 0)
    starts = under.withColumn(
        "_start", (F.col("_under") & ~F.coalesce(F.lag("_under").over(series(key)), F.lit(False))).cast("int")
    ).withColumn("_last", F.lead("date").over(series(key)).isNull())
    spells = starts.withColumn("spell", F.sum("_start").over(so_far(key))).where(F.col("_under"))
    return spells.groupBy(key, "spell").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).alias("periods"),
        F.min("drawdown").alias("depth"), (~F.max("_last")).alias("recovered"),
    )


def quality_monitor(
    monthly: DataFrame, value: str = "sentiment_weighted", low: float = -1.0, high: float = 1.0, z: float = 3.0
) -> DataFrame:
    """Missing months, out-of-range values and outliers per asset.

    Output: (ticker, month, issue, value). Missing months lie between an
    asset's first and last month and are found from the gap to the next row.
    """
    own = Window.partitionBy("ticker")
    dated = monthly.select("ticker", "month", F.col(value).alias("value"), F.to_date(F.concat("month", F.lit("-01"))).alias("_d"))
    marked = dated.select(
        "*",
        F.lead("_d").over(own.orderBy("_d")).alias("_next"),
        F.avg("value").over(own).alias("_mean"),
        F.stddev_samp("value").over(own).alias("_std"),
    )
    gap = F.sequence(F.add_months("_d", 1), F.add_months("_next", -1), F.expr("INTERVAL 1 MONTH"))
    gap = F.when(F.col("_next") > F.add_months("_d", 1), gap)
    missing = F.transform(
        F.coalesce(gap, F.array().cast("array<date>")),
        lambda d: F.struct(
            F.date_format(d, "yyyy-MM").alias("month"), F.lit("missing_month").alias("issue"), F.lit(None).cast("double").alias("value")
        ),
    )

    def flag(condition: Column, issue: str) -> Column:
        return F.when(condition, F.struct("month", F.lit(issue).alias("issue"), "value"))

    far = F.abs(F.try_divide(F.col("value") - F.col("_mean"), F.col("_std"))) > z
    found = F.array(flag(~F.col("value").between(low, high), "out_of_range"), flag(far, "outlier"))
    issues = F.concat(missing, F.filter(found, lambda f: f.isNotNull()))
    return marked.select("ticker", F.inline(issues))
