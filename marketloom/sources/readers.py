"""Scans with fixed schemas: holdings, prices, returns, news items, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom import schemas
from marketloom.functions.scalars import missing_as_null, month_key, rounding
from marketloom.operators import articles
from marketloom.operators.reshape import wide_to_long


def read_holdings(spark: SparkSession, path: str, distinct: bool = True) -> DataFrame:
    """Holdings CSV; amounts may carry leading blanks. ``distinct`` adds up the
    lots of a ticker."""
    df = spark.read.schema(schemas.HOLDINGS).csv(path, header=True, ignoreLeadingWhiteSpace=True)
    return df.groupBy("ticker").agg(F.sum("amount").cast(df.schema["amount"].dataType).alias("amount")).select(*df.columns) if distinct else df


def read_prices(
    spark: SparkSession, path: str, fmt: str = "parquet", digits: int | None = 2, one_per_day: bool = True
) -> DataFrame:
    """Daily price table (date, ticker, close, adj_close), NaN as NULL, rounded.

    ``one_per_day`` reduces several records of a (ticker, date) to the highest
    price; the time-series operators expect one row per (ticker, date).
    """
    reader = spark.read.schema(schemas.PRICES)
    df = reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)

    def clean(c: str):
        value = missing_as_null(c)
        return (value if digits is None else rounding(value, digits)).alias(c)

    df = df.select("date", "ticker", clean("close"), clean("adj_close"))
    if one_per_day:
        df = df.groupBy("date", "ticker").agg(F.max("close").alias("close"), F.max("adj_close").alias("adj_close"))
    return df


def parse_daily_returns(wide: DataFrame, label: str = "input") -> DataFrame:
    """Wide returns (a date column in any case, one column per ticker) to
    (date, month, ticker, log_return).

    Dates are read as ISO days first, then leniently in UTC; an unreadable one
    raises when the job runs.
    """
    date_col = next((c for c in wide.columns if c.lower() == "date"), None)
    if date_col is None:
        raise ValueError(f"no date column in {label}; columns are {wide.columns}")
    raw = F.col(f"`{date_col}`").cast("string")
    iso = F.try_to_timestamp(raw, F.lit("yyyy-MM-dd"))
    stamp = F.coalesce(iso, F.try_to_timestamp(raw))
    bad = F.raise_error(F.concat(F.lit("unreadable date: "), F.coalesce(raw, F.lit("NULL")))).cast("timestamp")
    checked = F.when(stamp.isNotNull(), stamp).otherwise(bad)
    tickers = [c for c in wide.columns if c != date_col]
    dated = wide.select(
        F.to_date(checked).alias("date"),
        month_key(checked).alias("month"),
        *[F.col(f"`{t}`").cast("double").alias(t) for t in tickers],
    )
    return wide_to_long(dated, ["date", "month"], tickers, value="log_return")


def read_daily_returns(spark: SparkSession, path: str) -> DataFrame:
    return parse_daily_returns(spark.read.csv(path, header=True), path)


def read_yahoo_items(spark: SparkSession, path: str, first_year: int, last_year: int | None = None, **kw) -> DataFrame:
    return articles.yahoo_articles(spark.read.schema(schemas.YAHOO_ITEMS).json(path), first_year, last_year, **kw)


def read_google_items(spark: SparkSession, path: str, **kw) -> DataFrame:
    return articles.google_articles(spark.read.schema(schemas.GOOGLE_ITEMS).json(path), **kw)


def read_forum_posts(spark: SparkSession, path: str, first_year: int, last_year: int | None = None, **kw) -> DataFrame:
    return articles.forum_articles(spark.read.schema(schemas.FORUM_POSTS).json(path), first_year, last_year, **kw)


def read_collected_news(spark: SparkSession, path: str) -> DataFrame:
    """Nested ticker -> source -> articles documents, one JSON object per line."""
    return articles.explode_news(spark.read.schema(schemas.COLLECTED_NEWS).json(path))


def read_article_snapshots(spark: SparkSession, path: str, request: str | None = None) -> DataFrame:
    """Snapshot files ``{source}_{ticker}_{tag}.json``, each one JSON array.

    One row per article with the request named by the file and the file's
    modification time; an unreadable or empty file yields no rows. Where a
    Spark job wrote the answers, ``request`` names the partition column that
    carries the same key.
    """
    schema = schemas.SNAPSHOT_ARTICLE + ", _corrupt STRING"
    reader = (
        spark.read.schema(schema if request is None else f"{schema}, {request} STRING")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
    )
    raw = reader.option("pathGlobFilter", "*.json").json(path) if request is None else reader.json(path)
    if request is None:
        name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)\\.json$", 1)
    else:
        name = F.col(request)
    named = raw.select(
        F.split(name, "_")[0].alias("feed"),
        F.regexp_extract(name, "^[^_]+_(.*)_[^_]*$", 1).alias("ticker"),
        F.regexp_extract(name, "_([^_]*)$", 1).alias("tag"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
        "title", "date", "source", "url", "_corrupt",
    )
    filled = F.coalesce(F.col("title"), F.col("date"), F.col("url")).isNotNull()
    return named.where(F.col("_corrupt").isNull() & filled).drop("_corrupt")
