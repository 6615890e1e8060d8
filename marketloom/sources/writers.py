"""Sinks. Only these functions (and the streaming ones) run a job.

Partitioned outputs go through Spark's rebalance hint: AQE merges small output
partitions and splits a hot one, so neither tiny files nor one giant task arise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators.reshape import long_to_wide


def write_features(df: DataFrame, path: str, buckets: int = 16, fmt: str = "parquet") -> None:
    """Long feature table, partitioned by a bucket of the ticker."""
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
        return
    keyed = df.withColumn("ticker_bucket", F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int"))
    keyed.hint("rebalance", F.col("ticker_bucket")).write.mode("overwrite").partitionBy("ticker_bucket").format(fmt).save(path)


def write_wide(df: DataFrame, path: str, tickers: Sequence[str], value: str, fill: float | None = None, fmt: str = "csv") -> None:
    """Wide table (one column per ticker in the given order), by date."""
    wide = long_to_wide(df, tickers, value)
    if fill is not None:
        wide = wide.na.fill(fill)
    wide.orderBy("date").write.mode("overwrite").option("header", True).format(fmt).save(path)


def write_prices(df: DataFrame, path: str, tickers: Sequence[str], value: str = "close", fmt: str = "csv") -> None:
    """Wide prices, missing ones as 0."""
    write_wide(df, path, tickers, value, fill=0.0, fmt=fmt)


def write_returns(df: DataFrame, path: str, tickers: Sequence[str], value: str = "log_return", fmt: str = "csv") -> None:
    write_wide(df, path, tickers, value, fmt=fmt)


def write_sentiment(df: DataFrame, path: str, by: str = "month", fmt: str = "parquet") -> None:
    """Monthly, detailed, combined or merged sentiment, partitioned by month."""
    df.hint("rebalance", F.col(by)).write.mode("overwrite").partitionBy(by).format(fmt).save(path)


def write_splits(tables: dict[str, DataFrame], path: str, params: dict[str, str] | None = None) -> None:
    """Tables that carry a ``split`` column, one folder per table and split,
    and the split parameters as a one-row table."""
    for name, table in tables.items():
        table.write.mode("overwrite").partitionBy("split").parquet(f"{path}/{name}")
    if params:
        spark = next(iter(tables.values())).sparkSession
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in params.items()])
        row.write.mode("overwrite").parquet(f"{path}/params")


def write_ticker_list(assets: DataFrame, path: str, order: str = "asset_order") -> None:
    """One ticker per line in asset order (the list has one line per asset)."""
    assets.orderBy(order).select("ticker").coalesce(1).write.mode("overwrite").text(path)
