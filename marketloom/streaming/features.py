"""Daily features kept up to date from a stream of prices."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketloom.operators.features import daily_features

# The longest frame holds 120 returns, the oldest of which needs one more price.
LOOKBACK = 120
#: A ticker without rows for so long, by the dates of the stream, is forgotten.
EXPIRY = "400 days"
ROWS = "ticker string, date date, close double, fresh boolean"
STATE = "days array<int>, closes array<double>"


def _with_tail(lookback: int):
    """Emits the remembered rows of a ticker and, marked as fresh, its new ones; remembers
    the last ``lookback`` of both."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        days, closes = (list(x) for x in state.get) if state.exists else ([], [])
        new = pd.concat(list(frames)).sort_values("date")
        held = len(days)
        days += [d.toordinal() for d in new["date"]]
        closes += [None if pd.isna(c) else float(c) for c in new["close"]]
        yield pd.DataFrame({
            "ticker": key[0],
            "date": [dt.date.fromordinal(d) for d in days],
            "close": pd.Series(closes, dtype="float64"),
            "fresh": [i >= held for i in range(len(days))],
        })
        state.update((days[-lookback:], closes[-lookback:]))
        last = pd.Timestamp(dt.date.fromordinal(days[-1]), tz="UTC").value // 1_000_000
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))

    return step


def with_history(prices: DataFrame, expiry: str = EXPIRY, lookback: int = LOOKBACK) -> DataFrame:
    """Each micro-batch's new rows and, of the tickers in it, the rows before them that
    the features need: (ticker, date, close, fresh).

    The state is keyed by ticker, holds ``lookback`` rows of each and is dropped
    once the stream's dates have left the ticker's last row ``expiry`` behind.
    """
    stamped = prices.select("ticker", "date", "close", F.col("date").cast("timestamp").alias("stamp")).withWatermark("stamp", expiry)
    return stamped.groupBy("ticker").applyInPandasWithState(_with_tail(lookback), ROWS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def features_of_batch(rows: DataFrame) -> DataFrame:
    """Features of the fresh rows, by the batch definition."""
    fresh = rows.where("fresh").select("ticker", "date")
    return daily_features(rows.drop("fresh"), dense=True).join(fresh, ["ticker", "date"], "left_semi")


def stream_features(prices: DataFrame, path: str, expiry: str = EXPIRY) -> DataFrame:
    """Feature rows for a price stream (ticker, date, close), in arrival order.

    A micro-batch reads and writes what its own tickers need: their last rows, from
    keyed state, and their new ones. Its output goes to a folder of its own id and is
    overwritten on a retry, so replays do not repeat rows. Rows must arrive in date
    order per ticker and be complete per date, as a daily feed is; rows older than the
    newest date by more than ``expiry`` are late and dropped.
    """
    spark = prices.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        # the state may be asked once only
        rows = batch.persist()
        features_of_batch(rows).write.mode("overwrite").parquet(f"{path}/features/batch={batch_id}")
        rows.unpersist()

    query = (
        with_history(prices, expiry).writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{path}/features").drop("batch")
