import datetime as dt
import json

import pandas as pd
from pyspark.sql import functions as F

from marketloom.operators.features import daily_features
from marketloom.operators.reshape import densify
from marketloom.streaming import articles as streams
from marketloom.streaming.features import stream_features
from marketloom.streaming.sinks import run_available
from tests.util import price_frame

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def article(i, hours, score=0.5, ticker="A", title="a long enough title"):
    stamp = (BASE + dt.timedelta(hours=hours)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {"article_id": f"a{i}", "ticker": ticker, "published": stamp, "title": title, "summary": "", "source": "yahoo", "sentiment_score": score}


def write(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_stream_equals_batch(spark, tmp_path):
    write(tmp_path / "in", "1.json", [article(i, i) for i in range(30)] + [article(99, 1, title="short"), {**article(98, 1), "published": "never"}])
    out = run_available(streams.stream_articles(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    batch = streams.clean_articles(spark.read.schema("article_id string, ticker string, published string, title string, summary string, source string, sentiment_score double").json(str(tmp_path / "in")))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect())) and out.count() == 30


def test_dedup_within_and_beyond_the_watermark(spark, tmp_path):
    source, sink = tmp_path / "in", str(tmp_path / "out")

    def run():
        return run_available(streams.stream_dedup(streams.stream_articles(spark, str(source), 1)), sink)

    write(source, "1.json", [article(1, 0), article(1, 0), article(2, 1)])
    assert run().count() == 2
    write(source, "2.json", [article(1, 2), article(3, 200)])
    assert sorted(r.article_id for r in run().collect()) == ["a1", "a2", "a3"]
    write(source, "3.json", [article(4, 3)])
    assert sorted(r.article_id for r in run().collect()) == ["a1", "a2", "a3"]


def test_windows_close_with_the_watermark(spark, tmp_path):
    rows = [article(i, i * 6, score=i / 10) for i in range(12)]
    write(tmp_path / "in", "1.json", rows)
    stream = streams.stream_articles(spark, str(tmp_path / "in"))
    got = run_available(streams.stream_window_sentiment(stream), str(tmp_path / "out")).orderBy("window_start").collect()
    batch = streams.window_sentiment(streams.clean_articles(spark.read.schema(stream_schema()).json(str(tmp_path / "in"))), "1 day").orderBy("window_start").collect()
    assert len(batch) == 3 and got == batch[:2]


def stream_schema():
    from marketloom.schemas import STREAM_ARTICLES

    return STREAM_ARTICLES


def test_bursts(spark, tmp_path):
    hours = [0, 0.2, 0.4, 5, 5.1, 50]
    write(tmp_path / "in", "1.json", [article(i, h) for i, h in enumerate(hours)])
    got = run_available(streams.stream_bursts(streams.stream_articles(spark, str(tmp_path / "in"))), str(tmp_path / "out"))
    assert [r.news_count for r in got.orderBy("burst_start").collect()] == [3, 2]


def test_stream_features_equal_batch(spark, tmp_path):
    long = price_frame(3, 140)
    dense = densify(spark.createDataFrame(long, "date date, ticker string, close double")).cache()
    days = sorted(r.date for r in dense.select("date").distinct().collect())
    cuts = [days[0], days[100], days[125], days[-1] + dt.timedelta(1)]
    for k in range(3):
        part = dense.where((F.col("date") >= F.lit(cuts[k])) & (F.col("date") < F.lit(cuts[k + 1])))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        prices = spark.readStream.schema("ticker string, date date, close double").parquet(str(tmp_path / "in"))
        got = stream_features(prices, str(tmp_path / "out"))
    expected = daily_features(dense, dense=True)
    order = ["ticker", "date"]
    pd.testing.assert_frame_equal(got.orderBy(*order).toPandas()[expected.columns], expected.orderBy(*order).toPandas())


def test_stream_features_touch_only_their_tickers(spark, tmp_path):
    """A micro-batch emits the history of its own tickers alone; idle ones expire."""
    from marketloom.streaming.features import with_history

    def arrive(rows):
        spark.createDataFrame(rows, "ticker string, date date, close double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        prices = spark.readStream.schema("ticker string, date date, close double").parquet(str(tmp_path / "in"))
        run_available(with_history(prices, "10 days", lookback=3), str(tmp_path / "out"))
        return spark.read.parquet(str(tmp_path / "out" / "data")).collect()

    day = dt.date(2024, 1, 1)
    at = lambda n: day + dt.timedelta(n)
    seen = arrive([(k, at(i), float(i)) for k in "AB" for i in range(5)])
    assert len(seen) == 10 and all(r.fresh for r in seen)
    more = arrive([("A", at(5), None)])
    new = sorted([r for r in more if r not in seen or (r.ticker == "A" and not r.fresh)], key=lambda r: (r.date, r.fresh))
    assert [(r.ticker, (r.date - day).days, r.close, r.fresh) for r in new] == [("A", 2, 2.0, False), ("A", 3, 3.0, False), ("A", 4, 4.0, False), ("A", 5, None, True)]
    # B's last row is now more than ten days behind: when it comes back, it has no history
    arrive([("A", at(40), 40.0)])
    last = arrive([("B", at(41), 41.0)])
    assert [r for r in last if r.ticker == "B" and not r.fresh] == [] and ("B", at(41), 41.0, True) in map(tuple, last)


def test_streamed_months_equal_the_batch(spark, tmp_path):
    """Month by month over three runs; the last month is still open."""
    rows = [article(i, i * 5.3, score=((i * 37) % 100) / 50 - 1, ticker="AB"[i % 2]) for i in range(420)] + [article(900, 24 * 33, ticker="C"), {**article(901, 24 * 33, ticker="D"), "sentiment_score": None}]
    rows.sort(key=lambda r: r["published"])
    for k in range(3):
        write(tmp_path / "in", f"{k}.json", rows[k * 141 : (k + 1) * 141])
        got = streams.stream_monthly_sentiment(streams.stream_articles(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    got = {(r.ticker, r.month): (r.sentiment_mean, r.sentiment_std, r.news_count) for r in got.collect()}
    clean = streams.clean_articles(spark.read.schema(stream_schema()).json(str(tmp_path / "in")))
    batch = clean.groupBy("ticker", "month").agg(F.avg("sentiment_score").alias("mean"), F.coalesce(F.stddev_samp("sentiment_score"), F.lit(0.0)).alias("std"), F.count("sentiment_score").alias("n")).where("n > 0 AND month < '2024-04'").collect()
    assert got.keys() == {(r.ticker, r.month) for r in batch} and len(got) == 7
    for r in batch:
        mean, std, n = got[r.ticker, r.month]
        assert abs(mean - r["mean"]) < 1e-12 and abs(std - r["std"]) < 1e-12 and n == r.n
