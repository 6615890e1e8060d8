"""Scoring of articles and their aggregation by asset, month and source.

All aggregates over articles are decomposable, so a hot ticker or source is
reduced to one row per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import (
    NEGATIVE_WORDS,
    POSITIVE_WORDS,
    lexicon_verdict,
    rounding_stable,
    sentiment_score,
    word_hits,
)
from marketloom.schemas import SOURCES

# Source weights of the fixed scheme, and the weight of any other source.
SOURCE_WEIGHTS = {"yahoo": 0.4, "google": 0.4, "reddit": 0.2}
OTHER_SOURCE_WEIGHT = 0.1
EPS = 1e-10
# The labels of a sentiment model.
LABELS = ["positive", "negative", "neutral"]


def with_lexicon(
    df: DataFrame,
    text: str = "headline",
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
) -> DataFrame:
    """Adds label, confidence and score from the word lists, in the JVM."""
    # The lower-cased text is a column of its own, so it is computed once.
    low = df.withColumn("_low", F.lower(text))
    counted = low.withColumn("_p", word_hits("_low", positive, lowered=True)).withColumn(
        "_n", word_hits("_low", negative, lowered=True)
    )
    label, confidence = lexicon_verdict(F.col("_p"), F.col("_n"))
    judged = counted.withColumn("sentiment_label", label).withColumn("sentiment_confidence", confidence)
    scored = judged.withColumn("sentiment_score", sentiment_score("sentiment_label", "sentiment_confidence"))
    return scored.drop("_low", "_p", "_n")


Model = Callable[[list[str]], list[dict]]


def model_sentiment(
    df: DataFrame,
    text: str = "headline",
    loader: Callable[[], Model | None] | None = None,
    batch: int = 32,
    max_chars: int | None = None,
    drop_errors: bool = False,
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
) -> DataFrame:
    """Adds label, confidence and score from a pluggable text model.

    ``loader`` runs once per partition in the Python worker and returns a
    callable from a list of texts to ``{"label", "score"}`` dicts; it is fed
    ``batch`` texts at a time, cut only if a limit ``max_chars`` is given.
    Without a loader, or when it returns None or the model fails on a batch,
    the word-list score stands in; with ``drop_errors`` the failing texts are
    dropped instead.
    """
    base = with_lexicon(df, text, positive, negative)
    if loader is None:
        return base
    schema = base.schema

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loader()
        for frame in frames:
            if model is not None and len(frame):
                frame = _apply_model(frame, model)
            yield frame

    def _apply_model(frame: pd.DataFrame, model: Model) -> pd.DataFrame:
        texts = frame[text].fillna("")
        texts = texts if max_chars is None else texts.str.slice(0, max_chars)
        labels, confidences = frame["sentiment_label"].tolist(), frame["sentiment_confidence"].tolist()
        failed = []
        for start in range(0, len(frame), batch):
            chunk = texts.iloc[start : start + batch].tolist()
            try:
                for offset, result in enumerate(model(chunk)):
                    labels[start + offset], confidences[start + offset] = result["label"], float(result["score"])
            except Exception:  # noqa: BLE001 - any model error takes the documented fallback
                failed.extend(range(start, start + len(chunk)))
        sign = pd.Series(labels, index=frame.index).map({"positive": 1.0, "negative": -1.0}).fillna(0.0)
        out = frame.assign(
            sentiment_label=labels,
            sentiment_confidence=confidences,
            sentiment_score=sign * pd.Series(confidences, index=frame.index),
        )
        return out.drop(out.index[failed]) if drop_errors and failed else out

    return base.mapInPandas(score, schema)


def min_confidence(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """Keep scores of at least this confidence; off by default."""
    return df if threshold is None else df.where(F.col("sentiment_confidence") >= threshold)


def _count(count: str) -> Column:
    """rows: every article; scores: articles that carry a score."""
    return F.count(F.lit(1)) if count == "rows" else F.count("sentiment_score")


def monthly_sentiment(df: DataFrame, count: str = "rows", assets: DataFrame | None = None) -> DataFrame:
    """Mean, spread, volume and confidence per (ticker, month). A single
    article has no spread (NULL until filled)."""
    out = df.groupBy("ticker", "month").agg(
        F.avg("sentiment_score").alias("sentiment_mean"),
        F.stddev_samp("sentiment_score").alias("sentiment_std"),
        _count(count).alias("news_count"),
        F.avg("sentiment_confidence").alias("confidence_mean"),
    )
    return out if assets is None else out.join(assets.select("ticker", "company"), "ticker", "left")


def monthly_by_source(df: DataFrame, count: str = "rows") -> DataFrame:
    return df.groupBy("ticker", "month", "source").agg(
        F.avg("sentiment_score").alias("sentiment_mean"),
        _count(count).alias("news_count"),
        F.avg("sentiment_confidence").alias("confidence_mean"),
    )


def pivot_sources(by_source: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """``{source}_sentiment_mean`` and ``{source}_news_count`` columns, 0 where absent."""
    wide = by_source.groupBy("ticker", "month").pivot("source", list(sources)).agg(
        F.max("sentiment_mean").alias("sentiment_mean"), F.max("news_count").alias("news_count")
    )
    return wide.select(
        "ticker",
        "month",
        *[F.coalesce(f"{s}_sentiment_mean", F.lit(0.0)).alias(f"{s}_sentiment_mean") for s in sources],
        *[F.coalesce(f"{s}_news_count", F.lit(0).cast("bigint")).alias(f"{s}_news_count") for s in sources],
    )


def merge_sources(df: DataFrame, sources: Sequence[str] = SOURCES, count: str = "rows") -> DataFrame:
    """Overall and per-source columns in one aggregate, NULL filled with 0.

    Equal to joining the overall table with the pivot, without the second pass
    over the articles and without the join.
    """

    def of(source: str) -> tuple[Column, Column]:
        here = F.col("source") == source
        counted = F.when(here, 1) if count == "rows" else F.when(here, F.col("sentiment_score"))
        return (
            F.coalesce(F.avg(F.when(here, F.col("sentiment_score"))), F.lit(0.0)).alias(f"{source}_sentiment_mean"),
            F.count(counted).alias(f"{source}_news_count"),
        )

    return df.groupBy("ticker", "month").agg(
        F.coalesce(F.avg("sentiment_score"), F.lit(0.0)).alias("sentiment_mean"),
        F.coalesce(F.stddev_samp("sentiment_score"), F.lit(0.0)).alias("sentiment_std"),
        _count(count).alias("news_count"),
        F.coalesce(F.avg("sentiment_confidence"), F.lit(0.0)).alias("confidence_mean"),
        *[c for s in sources for c in of(s)],
    )


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def weighted_sentiment(df: DataFrame, mode: str = "count", sources: Sequence[str] = SOURCES) -> DataFrame:
    """Adds ``sentiment_weighted`` to the merged monthly table.

    count: source means weighted by article counts (the overall mean when
    there are none). equal: plain mean of the source columns, in which absent
    sources count as 0.
    """
    means = [F.col(f"{s}_sentiment_mean") for s in sources]
    counts = [F.col(f"{s}_news_count") for s in sources]
    if mode == "count":
        top = _total([m * n for m, n in zip(means, counts)])
        value = F.coalesce(F.try_divide(top, _total(counts)), F.col("sentiment_mean"))
    elif mode == "equal":
        value = _total(means) / F.lit(float(len(means)))
    else:
        raise ValueError(f"mode must be 'count' or 'equal', got {mode!r}")
    return df.withColumn("sentiment_weighted", value)


def fixed_weight_sentiment(
    df: DataFrame, weights: dict[str, float] = SOURCE_WEIGHTS, other: float = OTHER_SOURCE_WEIGHT
) -> DataFrame:
    """Monthly score with fixed source weights, normalised over the sources
    present; articles without a score are skipped."""
    means = (
        df.where(F.col("sentiment_score").isNotNull())
        .groupBy("ticker", "month", "source")
        .agg(F.avg("sentiment_score").alias("_mean"))
    )
    weight = reduce(
        lambda acc, item: F.when(F.col("source") == item[0], F.lit(item[1])).otherwise(acc),
        weights.items(),
        F.lit(other),
    )
    return means.groupBy("ticker", "month").agg(
        F.try_divide(F.sum(weight * F.col("_mean")), F.sum(weight)).alias("sentiment_weighted")
    )


def cross_asset_mean(monthly: DataFrame, value: str = "sentiment_weighted") -> DataFrame:
    return monthly.groupBy("month").agg(F.avg(value).alias(value))


def coverage(df: DataFrame, keys: Sequence[str], share: bool = False) -> DataFrame:
    """Articles per key, optionally with their percentage of the total. The
    total is a sum over the aggregated rows, whose shuffle is reused."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if not share:
        return out
    total = out.agg(F.sum("n")).scalar()
    return out.withColumn("pct", F.col("n") * 100.0 / total)


def coverage_matrix(df: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """Articles per ticker with one column per source, 0 where absent."""
    return df.groupBy("ticker").agg(*[F.count(F.when(F.col("source") == s, 1)).alias(s) for s in sources])


def label_crosstab(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    return df.groupBy("source").agg(*[F.count(F.when(F.col("sentiment_label") == v, 1)).alias(v) for v in labels])


def source_timeline(df: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """Mean score per month with one column per source, NULL where absent."""
    return df.groupBy("month").agg(
        *[F.avg(F.when(F.col("source") == s, F.col("sentiment_score"))).alias(s) for s in sources]
    )


def source_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(
        F.avg("sentiment_score").alias("mean"), F.stddev_samp("sentiment_score").alias("std")
    )


def source_column_means(monthly: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """Mean of the monthly source columns, in which zero fills count."""
    return monthly.agg(*[F.avg(f"{s}_sentiment_mean").alias(s) for s in sources])


def asset_stats(monthly: DataFrame, value: str = "sentiment_weighted", digits: int = 3) -> DataFrame:
    """Mean, spread, range, months and articles per asset, best mean first."""
    out = monthly.groupBy("ticker").agg(
        rounding_stable(F.avg(value), digits).alias("sentiment_mean"),
        rounding_stable(F.stddev_samp(value), digits).alias("sentiment_std"),
        rounding_stable(F.min(value), digits).alias("sentiment_min"),
        rounding_stable(F.max(value), digits).alias("sentiment_max"),
        F.count(value).alias("months_covered"),
        F.sum("news_count").alias("total_articles"),
    )
    return out.orderBy(F.desc("sentiment_mean"), "ticker")


def extremes(stats: DataFrame) -> DataFrame:
    """Most positive, most negative, most and least volatile asset, in one row;
    ties go to the first ticker."""

    def pick(ascending: bool, col: str) -> Column:
        size = F.col(col) if ascending else -F.col(col)
        return F.min(F.when(size.isNotNull(), F.struct(size.alias("v"), F.col("ticker").alias("t"))))["t"]

    return stats.agg(
        pick(False, "sentiment_mean").alias("most_positive"),
        pick(True, "sentiment_mean").alias("most_negative"),
        pick(False, "sentiment_std").alias("highest_volatility"),
        pick(True, "sentiment_std").alias("most_stable"),
    )


def asset_ranking(
    monthly: DataFrame, assets: DataFrame | None = None, value: str = "sentiment_weighted", digits: int = 3
) -> DataFrame:
    """Rank from 1 by rounded mean, ties by ticker. The window runs over one
    row per asset."""
    out = monthly.groupBy("ticker").agg(
        rounding_stable(F.avg(value), digits).alias("avg_sentiment"), F.sum("news_count").alias("total_articles")
    )
    ranked = out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("avg_sentiment"), "ticker")))
    if assets is not None:
        ranked = ranked.join(assets.select("ticker", "company"), "ticker", "left")
    return ranked.orderBy("rank")


def top_assets(monthly: DataFrame, k: int = 6, value: str = "sentiment_weighted") -> DataFrame:
    means = monthly.groupBy("ticker").agg(F.avg(value).alias("avg_sentiment"))
    return means.orderBy(F.desc("avg_sentiment"), "ticker").limit(k)


def monthly_trend(df: DataFrame, value: str = "sentiment_score") -> DataFrame:
    return df.groupBy("month").agg(F.avg(value).alias("mean")).orderBy("month")


def asset_stability(df: DataFrame, value: str = "sentiment_score") -> DataFrame:
    """Spread per asset, steadiest first."""
    return df.groupBy("ticker").agg(F.stddev_samp(value).alias("std")).orderBy(F.asc_nulls_last("std"), "ticker")


def news_quality_report(df: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Count, date range and mean title length per (ticker, source); requested
    pairs without articles report a count of 0."""
    out = df.groupBy("ticker", "source").agg(
        F.count(F.lit(1)).alias("article_count"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.avg(F.length("title")).alias("avg_title_length"),
    )
    if requests is None:
        return out
    filled = requests.select("ticker", "source").join(out, ["ticker", "source"], "left")
    return filled.withColumn("article_count", F.coalesce("article_count", F.lit(0).cast("bigint")))


def source_quality_share(df: DataFrame, flag: str = "is_quality_source") -> DataFrame:
    """Articles, quality articles and their percentage, in one row."""
    quality = F.count(F.when(F.col(flag), 1))
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"), quality.alias("quality"), F.try_divide(quality * 100.0, total).alias("quality_pct")
    )


def top_domains(df: DataFrame, k: int = 5) -> DataFrame:
    counts = df.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "domain").limit(k)


def subreddit_share(df: DataFrame) -> DataFrame:
    """Posts per subreddit and their percentage, largest first."""
    named = df.select(F.coalesce("subreddit", F.lit("unknown")).alias("subreddit"))
    return coverage(named, ["subreddit"], share=True).orderBy(F.desc("n"), "subreddit")


def collection_totals(df: DataFrame) -> DataFrame:
    """Counts per source, per ticker, in total, and the average per ticker.

    Output: (scope, key, value) from one grouping-sets pass. The partial
    aggregate per (source, ticker) comes first, so the expansion into grouping
    sets works on a small frame.
    """
    cells = df.groupBy("source", "ticker").agg(F.count(F.lit(1)).alias("n"))
    sets = cells.groupingSets([["source"], ["ticker"], []], "source", "ticker").agg(
        F.sum("n").alias("n"), F.grouping_id().alias("g"), F.count_distinct("ticker").alias("tickers")
    )
    scope = F.when(F.col("g") == 1, "source").when(F.col("g") == 2, "ticker").otherwise("total")
    totals = sets.select(
        scope.alias("scope"), F.coalesce("source", "ticker", F.lit("all")).alias("key"),
        F.col("n").cast("double").alias("value"), "tickers",
    )
    average = F.struct(
        F.lit("average").alias("scope"), F.lit("per_ticker").alias("key"),
        F.try_divide(F.col("value"), F.col("tickers")).alias("value"),
    )
    own = F.struct("scope", "key", "value")
    rows = F.when(F.col("scope") == "total", F.array(own, average)).otherwise(F.array(own))
    return totals.select(F.inline(rows))


def overall_mean(df: DataFrame, value: str = "sentiment_weighted") -> DataFrame:
    return df.agg(F.avg(value).alias("overall_mean"))
