"""Streams over the driver's tables, run over what is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import tables as t
from driver_queries.tables import ARTICLES, finish, sql
from marketloom.session import shared_dir
from marketloom.streaming import articles as streams
from marketloom.streaming.features import stream_features
from marketloom.streaming.sinks import run_available

Q: dict = {}


def add(name: str, fn, spec: str, query: list[str] | str | None) -> None:
    Q[name] = (lambda spark, sf: finish(fn(spark, sf), spec), None if query is None else sql(query, spec))


def event_stream(s, d):
    """The events table as a stream of scored records per event type."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    raw = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.select(
        "event_id", F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("published_at"), F.col("value").alias("sentiment_score")
    )


def _articles(s, d):
    """Documents as JSON article files, read back as a stream."""
    path = shared_dir(s, "stream-articles")
    docs = t.articles(s, d)
    docs.select(
        F.col("article_id").cast("string").alias("article_id"), "ticker", F.unix_timestamp("published_at").cast("string").alias("published"),
        "title", "summary", "source", F.lit(None).cast("double").alias("sentiment_score"),
    ).write.json(path)
    return run_available(streams.stream_articles(s, path), shared_dir(s, "stream-out")).withColumn("headline_md5", F.md5("headline"))


add(
    "stream_articles", _articles, "article_id ticker published_at:t month headline_md5 source",
    [ARTICLES, """q AS (SELECT CAST(article_id AS VARCHAR) AS article_id, ticker, published_at, month, md5(headline) AS headline_md5, source
      FROM articles WHERE length(headline) >= 10)"""],
)


def _dedup(s, d):
    """Every event is delivered twice; one copy stays."""
    twice = event_stream(s, d).unionByName(event_stream(s, d))
    return run_available(streams.stream_dedup(twice, "event_id"), shared_dir(s, "stream-dedup"))


add(
    "stream_dedup", _dedup, "event_id ticker published_at:t sentiment_score:f6",
    "q AS (SELECT event_id, event_type AS ticker, ts AS published_at, value AS sentiment_score FROM events)",
)
# Append mode emits the windows whose end the watermark (latest event minus
# the delay) has passed.
_CLOSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)"
add(
    "stream_window_sentiment",
    lambda s, d: run_available(streams.stream_window_sentiment(event_stream(s, d)), shared_dir(s, "stream-window")),
    "ticker window_start:t window_end:t sentiment_mean:f6 sentiment_std:f6 news_count",
    f"""q AS (SELECT event_type AS ticker, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
        avg(value) AS sentiment_mean, stddev_samp(value) AS sentiment_std, count(value) AS news_count FROM events GROUP BY 1, 2, 3
        HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {_CLOSED})""",
)
add(
    "stream_window_sliding",
    lambda s, d: run_available(streams.stream_window_sentiment(event_stream(s, d), "1 day", "12 hours"), shared_dir(s, "stream-slide")),
    "ticker window_start:t window_end:t sentiment_mean:f6 news_count",
    f"""half AS (SELECT event_type AS ticker, value, date_trunc('day', ts) + CASE WHEN hour(ts) >= 12 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END AS h FROM events),
      both_windows AS (SELECT ticker, value, h AS window_start FROM half UNION ALL SELECT ticker, value, h - INTERVAL 12 HOUR FROM half),
      q AS (SELECT ticker, window_start, window_start + INTERVAL 1 DAY AS window_end, avg(value) AS sentiment_mean, count(value) AS news_count FROM both_windows GROUP BY 1, 2
        HAVING window_start + INTERVAL 1 DAY <= {_CLOSED})""",
)
add(
    "stream_bursts",
    lambda s, d: run_available(streams.stream_bursts(event_stream(s, d)), shared_dir(s, "stream-burst")),
    "ticker burst_start:t burst_end:t news_count sentiment_mean:f6",
    f"""marked AS (SELECT event_type AS ticker, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
      runs AS (SELECT *, sum(opens) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM marked),
      q AS (SELECT ticker, min(ts) AS burst_start, max(ts) + INTERVAL 30 MINUTE AS burst_end, count(*) AS news_count, avg(value) AS sentiment_mean FROM runs GROUP BY ticker, run
        HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED})""",
)


add(
    "stream_monthly_sentiment",
    lambda s, d: streams.stream_monthly_sentiment(event_months(s, d), shared_dir(s, "stream-month")),
    "ticker month sentiment_mean:f6 sentiment_std:f6 news_count",
    """spread_out AS (SELECT event_type AS ticker, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(event_id % 100 AS INTEGER)) + to_seconds(CAST(event_id % 86400 AS BIGINT)) AS moment, value FROM events),
      q AS (SELECT ticker, strftime(moment, '%Y-%m') AS month, avg(value) AS sentiment_mean, coalesce(stddev_samp(value), 0) AS sentiment_std, count(value) AS news_count
        FROM spread_out GROUP BY 1, 2 HAVING count(value) > 0
        AND date_trunc('month', min(moment)) + INTERVAL 1 MONTH <= (SELECT date_trunc('day', date_trunc('millisecond', max(moment)) - INTERVAL 1 HOUR) FROM spread_out))""",
)


def event_months(s, d):
    """The event stream spread over a hundred days, so that months come to an end."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    raw = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("event_id") % 100).cast("int"))
    at = F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + F.col("event_id") % 86400)
    return raw.select("event_id", F.col("event_type").alias("ticker"), at.alias("published_at"), F.col("value").alias("sentiment_score"))


def _features(s, d):
    """The dense price table arrives in three parts by date, each a run of its own
    that goes on from the state of the one before."""
    path, out = shared_dir(s, "stream-prices"), shared_dir(s, "stream-features")
    dense = t.dense(s, d)
    first, last = dense.agg(F.min("date"), F.max("date")).first()
    cuts = [first + (last - first) * k / 3 for k in (1, 2)]
    within = [F.col("date") <= cuts[0], (F.col("date") > cuts[0]) & (F.col("date") <= cuts[1]), F.col("date") > cuts[1]]
    for part in within:
        dense.where(part).write.mode("append").parquet(path)
        got = stream_features(s.readStream.schema("ticker string, date date, close double").parquet(path), out)
    return got


def _feature_sql() -> tuple[str, list[str]]:
    from driver_queries.price_queries import _FEATURE_SQL, _r4

    names = list(_FEATURE_SQL)
    body = "q AS (SELECT ticker, date, " + ", ".join(f"{_r4(e)} AS {c}" for c, e in _FEATURE_SQL.items()) + " FROM daily)"
    return body, names


_body, _names = _feature_sql()
add("stream_features", _features, "ticker date:d " + " ".join(f"{c}:f4" for c in _names), [t.DAILY, _body])
