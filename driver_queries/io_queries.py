"""Readers and writers: tables derived from the driver's data are written to
the shared folder and read back through the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import tables as t
from driver_queries.tables import ARTICLES, DAILY, FILLED, FORUM, GOOGLE, MONTHLY, MONTHLY_SENTIMENT, finish, sql
from marketloom.operators import features, indicators, reshape
from marketloom.session import shared_dir
from marketloom.sources import readers, writers

Q: dict = {}


def add(name: str, fn, spec: str, query: list[str] | str | None) -> None:
    Q[name] = (lambda spark, sf: finish(fn(spark, sf), spec), None if query is None else sql(query, spec))


def _holdings(s, d, distinct: bool):
    path = shared_dir(s, "holdings")
    lots = t.load(s, d, "part").groupBy(F.col("p_brand").alias("Ticker"), "p_size").agg(F.count(F.lit(1)).alias("n"))
    lots.select("Ticker", F.concat(F.lit(" "), F.col("n").cast("string")).alias("Amount")).write.option("header", True).csv(path)
    return readers.read_holdings(s, path, distinct)


add(
    "read_holdings", lambda s, d: _holdings(s, d, True).select("ticker"), "ticker",
    [t.ASSETS, "q AS (SELECT ticker FROM assets)"],
)
add(
    "read_holdings_with_duplicates", lambda s, d: _holdings(s, d, False).groupBy("ticker").agg(F.count(F.lit(1)).alias("lots"), F.sum("amount").alias("amount")),
    "ticker lots amount:i",
    "q AS (SELECT p_brand AS ticker, count(*) AS lots, sum(n) AS amount FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1)",
)


def _prices(s, d):
    """Raw trades as a price file with several records per day and NaN marks."""
    path = shared_dir(s, "prices")
    line, part = t.load(s, d, "lineitem"), t.load(s, d, "part")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        F.to_date("l_shipdate").alias("date"), F.col("p_brand").alias("ticker"),
        F.when(F.col("l_returnflag") == "N", F.lit(float("nan"))).otherwise(unit).alias("close"), unit.alias("adj_close"),
    ).write.parquet(path)
    return readers.read_prices(s, path, one_per_day=True)


add(
    "read_prices", _prices, "ticker date:d close:f2 adj_close:f2",
    """q AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date,
        max(CASE WHEN l_returnflag <> 'N' THEN round_even(l_extendedprice / l_quantity * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE) END) AS close,
        max(round_even(l_extendedprice / l_quantity * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE)) AS adj_close
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
)


def _returns(s, d):
    path = shared_dir(s, "returns")
    writers.write_returns(t.daily(s, d).select("ticker", "date", "log_return"), path, t.TICKERS)
    return readers.read_daily_returns(s, path)


add(
    "read_daily_returns", _returns, "ticker date:d month log_return:f6",
    [DAILY, "q AS (SELECT ticker, date, strftime(date, '%Y-%m') AS month, log_return FROM daily)"],
)


def _json(s, name: str, df):
    path = shared_dir(s, name)
    df.write.json(path)
    return path


add(
    "read_yahoo_items",
    lambda s, d: readers.read_yahoo_items(s, _json(s, "yahoo", t.yahoo_items(s, d)), 1996, 2000).withColumn("headline_md5", F.md5("headline")),
    "ticker date:d month headline_md5",
    [ARTICLES, """q AS (SELECT ticker, date, month, md5(headline) AS headline_md5 FROM articles
      WHERE year(date) BETWEEN 1996 AND 2000 AND length(headline) >= 10)"""],
)
add(
    "read_google_items",
    lambda s, d: readers.read_google_items(s, _json(s, "google", t.google_items(s, d)), per_month=None, domains=t.DOMAINS),
    "ticker date:d month domain",
    [GOOGLE, """q AS (SELECT ticker, published_at AS date, strftime(published_at, '%Y-%m') AS month, domain FROM google_items
      WHERE length(title) + length(description) >= 50 AND contains(domain, 'example.com')
        AND NOT (contains(lower(title), 'you won''t believe') OR contains(lower(title), 'shocking') OR contains(lower(title), 'this one trick')
          OR contains(lower(title), 'click here') OR contains(lower(title), 'top 10')))"""],
)
add(
    "read_forum_posts",
    lambda s, d: readers.read_forum_posts(s, _json(s, "forum", t.forum_posts(s, d)), 1996, 2000, per_ticker=None).withColumn("text_md5", F.md5("headline")),
    "ticker id date:d subreddit reddit_score text_md5",
    [FORUM, "q AS (SELECT ticker, id, date, subreddit, score AS reddit_score, md5(headline) AS text_md5 FROM unique_posts)"],
)


def _snapshots(s, d):
    """Stored answers per ticker and 5,000 document ids (200 articles at most),
    one JSON array per file."""
    path = shared_dir(s, "snapshots")
    item = F.struct(
        F.col("article_id").cast("string").alias("title"), F.date_format("date", "yyyy-MM-dd").alias("date"), "source",
        F.lit("u").alias("url"),
    )
    request = F.concat_ws("_", F.lit("docs"), "ticker", F.floor(F.col("article_id") / 5000).cast("string"))
    rows = t.articles(s, d).select(request.alias("request"), item.alias("item"))
    packed = rows.groupBy("request").agg(F.to_json(F.collect_list("item")).alias("value"))
    packed.write.partitionBy("request").text(path)
    return readers.read_article_snapshots(s, path, "request")


add(
    "read_article_snapshots", _snapshots, "feed ticker tag title date source",
    [ARTICLES, """q AS (SELECT 'docs' AS feed, ticker, CAST(article_id // 5000 AS VARCHAR) AS tag, CAST(article_id AS VARCHAR) AS title,
      strftime(date, '%Y-%m-%d') AS date, source FROM articles)"""],
)


def _collected(s, d):
    from driver_queries.article_queries import _news_map

    return readers.read_collected_news(s, _json(s, "news", _news_map(s, d)))


add(
    "read_collected_news", _collected, "ticker feed date subreddit score",
    [ARTICLES, "q AS (SELECT ticker, source AS feed, strftime(date, '%Y-%m-%d') AS date, channel AS subreddit, article_id AS score FROM articles)"],
)


def _features(s, d):
    path = shared_dir(s, "features")
    writers.write_features(features.daily_features(t.prices(s, d)), path)
    return s.read.parquet(path)


_R4 = "round_even(log_return * CAST(10000 AS DOUBLE), 0) / CAST(10000 AS DOUBLE)"
add("write_features", _features, "ticker date:d log_return:f4", [DAILY, f"q AS (SELECT ticker, date, {_R4} AS log_return FROM daily)"])


def _written_prices(s, d):
    path = shared_dir(s, "wide-prices")
    writers.write_prices(t.dense(s, d), path, t.TICKERS)
    wide = s.read.csv(path, header=True)
    return reshape.wide_to_long(wide, ["date"], t.TICKERS).select(
        "ticker", F.to_date("date").alias("date"), F.col("value").cast("double").alias("close")
    )


add("write_prices", _written_prices, "ticker date:d close:f2", [FILLED, "q AS (SELECT ticker, date, coalesce(close, 0) AS close FROM dense)"])


def _sentiment(s, d):
    path = shared_dir(s, "sentiment")
    writers.write_sentiment(t.monthly_sentiment(s, d), path)
    return s.read.schema("ticker string, sentiment_weighted double, month string").parquet(path)


add("write_sentiment", _sentiment, "ticker month sentiment_weighted:f6", [MONTHLY_SENTIMENT, "q AS (SELECT * FROM monthly_sentiment)"])


def _splits(s, d):
    path = shared_dir(s, "splits")
    ranges = {"train": ("1995-01-01", "1998-12-31"), "test": ("1999-01-01", "2001-12-31")}
    prices = reshape.split_by_date(t.month_prices(s, d), ranges)
    scaled = indicators.minmax_normalize(t.monthly(s, d).select("ticker", F.col("month_end").alias("date"), F.col("price").alias("value")), "ticker")
    writers.write_splits({"prices": prices, "features": reshape.split_by_date(scaled, ranges)}, path, {"train_end": "1998-12-31"})
    p, f = s.read.parquet(f"{path}/prices"), s.read.parquet(f"{path}/features")
    return p.join(f, ["ticker", "date", "split"])


add(
    "write_splits", _splits, "ticker date:d split price:f2 value:f6",
    [MONTHLY, """q AS (SELECT ticker, month_end AS date, CASE WHEN month_end <= DATE '1998-12-31' THEN 'train' ELSE 'test' END AS split, price,
      (price - min(price) OVER (PARTITION BY ticker)) / (max(price) OVER (PARTITION BY ticker) - min(price) OVER (PARTITION BY ticker)) AS value FROM monthly)"""],
)


def _tickers(s, d):
    path = shared_dir(s, "tickers")
    writers.write_ticker_list(t.assets(s, d), path)
    return s.read.text(path).withColumnRenamed("value", "ticker")


add("write_ticker_list", _tickers, "ticker", [t.ASSETS, "q AS (SELECT ticker FROM assets)"])
