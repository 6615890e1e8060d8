"""Does sentiment go with returns? Correlations, p-values, source quality.

Article-level statistics against returns are computed from sums per (source,
ticker, month) taken before the join, so the join sees one row per group
however many articles a source or an asset has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import significance_label, strength_bucket
from marketloom.functions.stats import pearson_pvalue, safe_corr
from marketloom.functions.windows import series

EPS = 1e-10
MIN_MONTHS = 3


def monthly_returns(daily: DataFrame, value: str = "log_return") -> DataFrame:
    """Sum of the known daily log returns per (ticker, month)."""
    known = daily.where(F.col(value).isNotNull())
    return known.groupBy("ticker", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.sum(value).alias("monthly_return")
    )


def join_sentiment_returns(sentiment: DataFrame, returns: DataFrame) -> DataFrame:
    return sentiment.join(returns, ["ticker", "month"], "inner")


def validate_current(merged: DataFrame, value: str = "sentiment_weighted") -> DataFrame:
    """Same-month correlation and p-value; assets with under 3 months drop out."""
    out = merged.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("data_points"), safe_corr(value, "monthly_return").alias("current_corr")
    )
    kept = out.where(F.col("data_points") >= MIN_MONTHS)
    return kept.withColumn("current_p", pearson_pvalue("current_corr", "data_points"))


def with_next_return(merged: DataFrame) -> DataFrame:
    """Return of the next month that exists for the asset."""
    return merged.withColumn("next_return", F.lead("monthly_return").over(series("ticker", "month")))


def validate_lagged(merged: DataFrame, value: str = "sentiment_weighted") -> DataFrame:
    """Next-month correlation and p-value; NULL below 3 complete pairs."""
    pair = F.col(value).isNotNull() & F.col("next_return").isNotNull()
    out = with_next_return(merged).groupBy("ticker").agg(
        F.count(F.when(pair, 1)).alias("lagged_points"), safe_corr(value, "next_return").alias("_r")
    )
    enough = F.when(F.col("lagged_points") >= MIN_MONTHS, F.col("_r"))
    return out.select("ticker", "lagged_points", enough.alias("lagged_corr")).withColumn(
        "lagged_p", pearson_pvalue("lagged_corr", "lagged_points")
    )


def validation_summary(
    merged: DataFrame, value: str = "sentiment_weighted", extended: bool = False, assets: DataFrame | None = None
) -> DataFrame:
    """Current and lagged correlation with p-values per asset, from one shuffle
    on ticker; ``extended`` adds means and spreads of both series."""
    pair = F.col(value).isNotNull() & F.col("next_return").isNotNull()
    more = [
        F.avg(value).alias("avg_sentiment"),
        F.avg("monthly_return").alias("avg_return"),
        F.stddev_samp(value).alias("sentiment_volatility"),
        F.stddev_samp("monthly_return").alias("return_volatility"),
    ]
    out = with_next_return(merged).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("data_points"),
        safe_corr(value, "monthly_return").alias("current_corr"),
        F.count(F.when(pair, 1)).alias("_pairs"),
        safe_corr(value, "next_return").alias("_lagged"),
        *(more if extended else []),
    )
    kept = out.where(F.col("data_points") >= MIN_MONTHS).withColumn(
        "lagged_corr", F.when(F.col("_pairs") >= MIN_MONTHS, F.col("_lagged"))
    )
    tested = kept.withColumn("current_p", pearson_pvalue("current_corr", "data_points")).withColumn(
        "lagged_p", pearson_pvalue("lagged_corr", "_pairs")
    )
    names = ["ticker", "data_points", "current_corr", "current_p", "lagged_corr", "lagged_p"]
    if extended:
        names += ["avg_sentiment", "avg_return", "sentiment_volatility", "return_volatility"]
    result = tested.select(*names)
    return result if assets is None else result.join(assets.select("ticker", "company"), "ticker", "left")


def validate_wide(sentiment: DataFrame, returns: DataFrame) -> DataFrame:
    """Correlation on the common dates, now and one date ahead, with a t value.

    Inputs: (date, ticker, value). The t value uses the number of common dates
    for every asset; a perfect correlation has no finite t (NULL). Both inputs
    are read once: they are stacked, not joined.
    """
    missing = F.lit(None).cast("double")
    rows = sentiment.select("ticker", F.col("date").cast("date").alias("date"), F.col("value").alias("s"), missing.alias("r"), F.lit(1).alias("is_s"), F.lit(0).alias("is_r")).unionByName(
        returns.select("ticker", F.col("date").cast("date").alias("date"), missing.alias("s"), F.col("value").alias("r"), F.lit(0).alias("is_s"), F.lit(1).alias("is_r"))
    )
    both = rows.groupBy("ticker", "date").agg(
        F.max("s").alias("s"), F.max("r").alias("r"), F.max("is_s").alias("is_s"), F.max("is_r").alias("is_r")
    )
    dates = both.groupBy("date").agg(F.max("is_s").alias("_s"), F.max("is_r").alias("_r")).where("_s = 1 AND _r = 1")
    # Distinct dates: at most a calendar's worth of rows are numbered here.
    place = dates.select(
        "date", F.row_number().over(Window.orderBy("date")).alias("_pos"), F.count(F.lit(1)).over(Window.partitionBy()).alias("sample_size")
    )
    placed = both.join(place, "date")
    by_date = series()
    follows = F.lead("_pos").over(by_date) == F.col("_pos") + 1
    pairs = placed.withColumn("next_r", F.when(follows, F.lead("r").over(by_date)))
    out = pairs.groupBy("ticker").agg(
        safe_corr("s", "r").alias("current_corr"), safe_corr("s", "next_r").alias("predictive_corr"),
        F.max("sample_size").alias("sample_size"), F.max("is_s").alias("_s"), F.max("is_r").alias("_r"),
    )
    c = F.col("current_corr")
    t = c * F.sqrt(F.try_divide((F.col("sample_size") - 2).cast("double"), F.lit(1.0) - c * c))
    return out.where("_s = 1 AND _r = 1").drop("_s", "_r").withColumn("t_stat", t)


def correlation_breakdown(summary: DataFrame, which: str = "current") -> DataFrame:
    """One row per asset with its strength bucket and significance label."""
    r, p = f"{which}_corr", f"{which}_p"
    known = summary.where(F.col(r).isNotNull()) if which == "lagged" else summary
    return known.select(
        "ticker", strength_bucket(r).alias("strength"), F.col(r).alias("corr"), F.col(p).alias("p"),
        significance_label(p).alias("significance"),
    )


def strength_counts(breakdown: DataFrame) -> DataFrame:
    """Assets per strength bucket, 0 where a bucket is empty."""
    counts = [F.count(F.when(F.col("strength") == b, 1)).alias(b) for b in ("strong", "moderate", "weak")]
    return breakdown.agg(*counts).unpivot([], ["strong", "moderate", "weak"], "strength", "n")


def article_moments(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean and sum of squared distances from the mean of the score per key,
    with partial aggregation: moments that merge without loss of digits."""
    s = F.col("sentiment_score")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count(s).alias("n"), F.avg(s).alias("mean"), (F.var_pop(s) * F.count(s)).alias("m2"),
        F.min(s).alias("low"), F.max(s).alias("high"),
    )


def source_return_stats(scored: DataFrame, returns: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Per source: rows, score spread and correlation of the article scores
    with the return of their (ticker, month). Only articles whose month has a
    return take part.

    Cells of (source, ticker, month) are merged as groups: distances within a cell are
    its own, those between cells are taken from the source's mean, which comes
    first. So the result keeps its digits whatever the level of scores and returns.
    """
    cells = article_moments(scored, ["source", "ticker", "month"])
    joined = cells.join(returns, ["ticker", "month"], "inner")
    n, m, r = F.col("n"), F.col("mean"), F.col("monthly_return")
    paired = F.when(r.isNotNull() & (n > 0), n)
    means = joined.groupBy("source").agg(
        F.try_divide(F.sum(n * m), F.sum(F.when(n > 0, n))).alias("_m"), F.try_divide(F.sum(paired * m), F.sum(paired)).alias("_x"),
        F.try_divide(F.sum(paired * r), F.sum(paired)).alias("_y"),
    )
    d, x, y = m - F.col("_m"), m - F.col("_x"), r - F.col("_y")
    # equal scores, or returns, have no spread, however their mean was rounded
    sums = joined.join(means, "source").groupBy("source").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("m2").alias("within"), F.sum(n * d).alias("d"), F.sum(n * d * d).alias("dd"),
        F.sum(paired).alias("k"), F.sum(F.when(paired.isNotNull(), F.col("m2"))).alias("paired_within"), F.sum(paired * x).alias("x"), F.sum(paired * x * x).alias("xx"),
        F.sum(paired * y).alias("y"), F.sum(paired * y * y).alias("yy"), F.sum(paired * x * y).alias("xy"),
        (F.min("low") < F.max("high")).alias("vary"),
        (F.min(F.when(paired.isNotNull(), F.col("low"))) < F.max(F.when(paired.isNotNull(), F.col("high")))).alias("x_varies"), (F.min(F.when(paired.isNotNull(), r)) < F.max(F.when(paired.isNotNull(), r))).alias("y_varies"),
    )

    def centred(square: str, a: str, b: str, count: str) -> Column:
        """Sum of products around the exact means: the first ones were rounded."""
        return F.col(square) - F.try_divide(F.col(a) * F.col(b), F.col(count))

    spread = F.when(F.col("vary"), F.greatest(F.col("within") + centred("dd", "d", "d", "n"), F.lit(0.0))).otherwise(F.lit(0.0))
    std = F.when(F.col("n") > 1, F.sqrt(F.try_divide(spread, (F.col("n") - 1).cast("double"))))
    sxx, syy = F.col("paired_within") + centred("xx", "x", "x", "k"), centred("yy", "y", "y", "k")
    r_value = F.try_divide(centred("xy", "x", "y", "k"), F.sqrt(F.greatest(sxx, F.lit(0.0))) * F.sqrt(F.greatest(syy, F.lit(0.0))))
    return sums.select(
        "source", "rows", std.alias("std"),
        F.when(F.col("x_varies") & F.col("y_varies") & r_value.isNotNull(), F.least(F.greatest(r_value, F.lit(-1.0)), F.lit(1.0))).alias("corr"),
    )


def source_return_corr(stats: DataFrame, sources: list[str]) -> DataFrame:
    """Correlation per listed source; a source without articles gets 0."""
    named = stats.agg(*[
        F.coalesce(F.max(F.when(F.col("source") == s, F.struct("corr"))), F.struct(F.lit(0.0).alias("corr"))).alias(s)
        for s in sources
    ])
    flat = named.select(*[F.col(f"{s}.corr").alias(s) for s in sources])
    return flat.unpivot([], list(sources), "source", "corr")


def optimal_source_weights(stats: DataFrame) -> DataFrame:
    """|r| x articles / spread per source, scaled to sum 1 (the window runs
    over one row per source)."""
    score = F.abs("corr") * F.col("rows") / (F.col("std") + F.lit(EPS))
    scored = stats.select("source", score.alias("score"))
    return scored.withColumn("weight", F.try_divide(F.col("score"), F.sum("score").over(Window.partitionBy())))


def source_quality_score(stats: DataFrame) -> DataFrame:
    """0.4 |r| + 0.3 share of articles + 0.3 / spread; the last term is unbounded."""
    share = F.col("rows") / F.sum("rows").over(Window.partitionBy())
    quality = F.abs("corr") * 0.4 + share * 0.3 + F.lit(0.3) / (F.col("std") + F.lit(EPS))
    return stats.select("source", quality.alias("quality_score"))


def asset_suitability(df: DataFrame, summary: DataFrame, value: str = "sentiment_score") -> DataFrame:
    """|current r| x rows / spread per asset of the summary."""
    per_asset = df.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.stddev_samp(value).alias("std"))
    joined = summary.select("ticker", "current_corr").join(per_asset, "ticker", "left")
    score = F.abs("current_corr") * F.coalesce("rows", F.lit(0)) / (F.col("std") + F.lit(EPS))
    return joined.select("ticker", score.alias("suitability"))


def top_suitable(suitability: DataFrame, k: int = 8) -> DataFrame:
    return suitability.orderBy(F.desc_nulls_last("suitability"), "ticker").limit(k)


def least_suitable(suitability: DataFrame, k: int = 5) -> DataFrame:
    return suitability.orderBy(F.asc_nulls_first("suitability"), F.desc("ticker")).limit(k)


def coverage_vs_signal(df: DataFrame, summary: DataFrame) -> DataFrame:
    """Rows per asset next to its current correlation."""
    counts = df.groupBy("ticker").agg(F.count(F.lit(1)).alias("coverage"))
    return summary.select("ticker", "current_corr").join(counts, "ticker", "left").select(
        "ticker", F.coalesce("coverage", F.lit(0).cast("bigint")).alias("coverage"), "current_corr"
    )


def signal_strength(summary: DataFrame) -> DataFrame:
    """|r| / p with the significance scatter coordinates, weakest first."""
    strength = F.abs("current_corr") / (F.col("current_p") + F.lit(EPS))
    return summary.select(
        "ticker", "current_corr", "current_p", (-F.log10("current_p")).alias("neg_log10_p"), strength.alias("signal_strength")
    ).orderBy(F.asc_nulls_last("signal_strength"), "ticker")


def significance_counts(summary: DataFrame) -> DataFrame:
    """Assets below each p threshold (cumulative) and below 0.05 in either test."""

    def below(p: Column, limit: float) -> Column:
        return F.count(F.when(p < limit, 1))

    p, q = F.col("current_p"), F.col("lagged_p")
    return summary.agg(
        below(p, 0.001).alias("p_001"), below(p, 0.01).alias("p_01"), below(p, 0.05).alias("p_05"),
        F.count(F.when(F.coalesce(p < 0.05, F.lit(False)) | F.coalesce(q < 0.05, F.lit(False)), 1)).alias("either_p_05"),
    )


def top_by_corr(summary: DataFrame, k: int = 8) -> DataFrame:
    return summary.where(F.col("current_corr").isNotNull()).orderBy(F.desc("current_corr"), "ticker").limit(k)
