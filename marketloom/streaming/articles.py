"""Streams of articles: parsing, deduplication, windows, bursts."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketloom import schemas
from marketloom.functions.scalars import headline, month_key, parse_date_flexible
from marketloom.streaming.sinks import run_available


def clean_articles(df: DataFrame) -> DataFrame:
    """The batch filters on a stream (or a batch) of article records: readable
    date, headline of at least ten characters."""
    parsed = df.select(
        "article_id", "ticker", "source",
        parse_date_flexible("published").alias("published_at"),
        "title",
        headline("title", "summary").alias("headline"),
        "sentiment_score",
    ).where(F.col("published_at").isNotNull() & (F.length("headline") >= 10))
    return parsed.withColumn("month", month_key("published_at"))


def stream_articles(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """JSON article files as they arrive, cleaned like the batch."""
    reader = spark.readStream.schema(schemas.STREAM_ARTICLES)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return clean_articles(reader.json(path))


def stream_dedup(df: DataFrame, key: str = "article_id", stamp: str = "published_at", delay: str = "48 hours") -> DataFrame:
    """First arrival per key; state is kept for ``delay`` of event time."""
    return df.withWatermark(stamp, delay).dropDuplicatesWithinWatermark([key])


def window_sentiment(df: DataFrame, size: str, slide: str | None = None, stamp: str = "published_at", value: str = "sentiment_score") -> DataFrame:
    """Mean, spread and count by ticker and event-time window (batch or stream)."""
    window = F.window(stamp, size, slide) if slide else F.window(stamp, size)
    out = df.groupBy(window.alias("w"), "ticker").agg(
        F.avg(value).alias("sentiment_mean"), F.stddev_samp(value).alias("sentiment_std"), F.count(value).alias("news_count")
    )
    return out.select(
        "ticker", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "sentiment_mean", "sentiment_std", "news_count",
    )


def stream_window_sentiment(
    df: DataFrame, size: str = "1 day", slide: str | None = None, delay: str = "1 hour", stamp: str = "published_at",
    value: str = "sentiment_score",
) -> DataFrame:
    """Windowed sentiment in append mode: a window is emitted once the
    watermark passes its end. Months are not fixed-length windows; see
    ``stream_monthly_sentiment``."""
    return window_sentiment(df.withWatermark(stamp, delay), size, slide, stamp, value)


def bursts(df: DataFrame, gap: str, stamp: str = "published_at", value: str = "sentiment_score") -> DataFrame:
    session = F.session_window(stamp, gap)
    out = df.groupBy(session.alias("w"), "ticker").agg(F.count(F.lit(1)).alias("news_count"), F.avg(value).alias("sentiment_mean"))
    return out.select("ticker", F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "news_count", "sentiment_mean")


def stream_bursts(
    df: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", stamp: str = "published_at", value: str = "sentiment_score"
) -> DataFrame:
    """Runs of articles per ticker with no pause longer than ``gap``."""
    return bursts(df.withWatermark(stamp, delay), gap, stamp, value)


MONTHS = "ticker string, month string, sentiment_mean double, sentiment_std double, news_count bigint"
_SUMS = "n bigint, mean double, m2 double"


def _month_so_far(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
    """Merges closed days into their month; emits the month when the watermark has
    passed its end, and forgets it."""
    if state.hasTimedOut:
        n, mean, m2 = state.get
        std = math.sqrt(max(m2, 0.0) / (n - 1)) if n > 1 else 0.0
        yield pd.DataFrame({"ticker": [key[0]], "month": [key[1]], "sentiment_mean": [mean], "sentiment_std": [std], "news_count": [n]})
        state.remove()
        return
    n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
    days = pd.concat(list(frames)).sort_values("window_start")
    for count, average, spread in zip(days["news_count"], days["sentiment_mean"], days["sentiment_std"]):
        if count:
            # pairwise merge of two sets' counts, means and squared distances
            total, apart = n + int(count), float(average) - mean
            m2 += (0.0 if pd.isna(spread) else float(spread) ** 2 * (count - 1)) + apart * apart * n * count / total
            mean, n = mean + apart * count / total, total
    state.update((n, mean, m2))
    year, month = map(int, key[1].split("-"))
    end = pd.Timestamp(year=year + month // 12, month=month % 12 + 1, day=1, tz="UTC")
    state.setTimeoutTimestamp(max(end.value // 1_000_000 - 1, state.getCurrentWatermarkMs() + 1))


def months_of_days(days: DataFrame) -> DataFrame:
    """Closed daily windows, as ``stream_window_sentiment`` gives them, to calendar
    months: a stream keyed by ticker and month that holds three numbers of each open
    month. A month is emitted once, when a day that ends with it or later has closed."""
    keyed = days.where("news_count > 0").withColumn("month", month_key("window_start")).withWatermark("window_end", "0 seconds")
    return keyed.groupBy("ticker", "month").applyInPandasWithState(_month_so_far, MONTHS, _SUMS, "append", GroupStateTimeout.EventTimeTimeout)


def stream_monthly_sentiment(df: DataFrame, path: str, delay: str = "1 hour", stamp: str = "published_at", value: str = "sentiment_score") -> DataFrame:
    """Sentiment by ticker and calendar month, each month once, after its end.

    Months have no fixed length and so are no windows. Two queries are chained: articles
    into daily windows, which combine in the map tasks, and the table of closed days,
    read as a stream, into months. By the definition of the batch: mean, spread (0
    for a single article) and count of the scored articles.
    """
    spark = df.sparkSession
    days = run_available(stream_window_sentiment(df, "1 day", None, delay, stamp, value), f"{path}/days")
    closed = spark.readStream.schema(days.schema).parquet(f"{path}/days/data")
    return run_available(months_of_days(closed), f"{path}/months")


__all__ = [
    "bursts", "clean_articles", "run_available", "stream_articles", "stream_bursts", "stream_dedup",
    "months_of_days", "stream_monthly_sentiment", "stream_window_sentiment", "window_sentiment",
]
