"""Pairwise correlations between assets, by blocks of assets.

The result has one value per pair of assets, so pairs cannot be avoided; what
can be avoided is joining the series to themselves. Assets are cut into blocks
of fixed size and every series is sent once per block, so each task gets the
two short series tables of one pair of blocks and computes its pairs with array
arithmetic. Rolling correlations are cut along the dates as well.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dates of one task's stretch of the time axis, and windows computed at a time.
STRETCH, WINDOW_CHUNK = 512, 64


def pair_index(i: Column, k: Column, n: Column) -> Column:
    """Position of the pair (i, k), i < k, in the row-major upper triangle."""
    return (i * n - F.floor(i * (i + 1) / 2) + (k - i - 1)).cast("int")


def _centred(z: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Distance from the mean over the last axis. The first value is taken away
    before, so that a constant series gives exact zeros. With a mask, only marked
    values count, and the others become zero."""
    if mask is None:
        shifted = z - z[..., :1]
        return shifted - shifted.mean(axis=-1, keepdims=True)
    first = np.take_along_axis(z, mask.argmax(axis=-1)[..., None], axis=-1)
    shifted = np.where(mask, z - first, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = shifted.sum(axis=-1, keepdims=True) / mask.sum(axis=-1, keepdims=True)
    return np.where(mask, shifted - mean, 0.0)


def _ratio(sxy: np.ndarray, sxx: np.ndarray, syy: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.clip(sxy / (np.sqrt(sxx) * np.sqrt(syy)), -1.0, 1.0)
    return np.where((n > 1) & (sxx > 0) & (syy > 0), r, np.nan)


def _pair_correlation(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlation of every column of x with every column of y, over the last axis.

    x is (windows, a, n), y is (windows, b, n). Series without gaps are centred once
    for all their pairs. A pair with a gap is computed over its complete rows alone,
    centred by their own means: what the other series lacks must not shift it. No
    threshold decides what varies; only a series of equal values has no correlation.
    """
    n = np.matmul((~np.isnan(x)).astype(float), np.swapaxes(~np.isnan(y), -1, -2).astype(float))
    whole_x, whole_y = ~np.isnan(x).any(axis=(0, 2)), ~np.isnan(y).any(axis=(0, 2))
    out = np.full(n.shape, np.nan)
    if whole_x.any() and whole_y.any():
        dx, dy = _centred(x[:, whole_x]), _centred(y[:, whole_y])
        sxx, syy = (dx * dx).sum(axis=-1)[:, :, None], (dy * dy).sum(axis=-1)[:, None, :]
        at = np.ix_(np.arange(len(x)), whole_x, whole_y)
        out[at] = _ratio(np.matmul(dx, np.swapaxes(dy, -1, -2)), sxx, syy, n[at])
    for i in range(x.shape[1]):
        rest = np.flatnonzero(~whole_y | (not whole_x[i]))
        for at in np.split(rest, range(8, len(rest), 8)) if len(rest) else ():
            both = ~np.isnan(x[:, i : i + 1]) & ~np.isnan(y[:, at])
            dx, dy = _centred(np.broadcast_to(x[:, i : i + 1], both.shape), both), _centred(y[:, at], both)
            out[:, i, at] = _ratio((dx * dy).sum(axis=-1), (dx * dx).sum(axis=-1), (dy * dy).sum(axis=-1), n[:, i, at])
    return out, n


def _block_job(
    df: DataFrame, value: str, date: str, block: int, work: Callable, schema: str, assets: DataFrame | None, extra: Sequence[str] = ()
) -> DataFrame:
    """Runs ``work`` on each pair of blocks of assets, within each value of ``extra``."""
    listed = df if assets is None else assets
    blocks = listed.agg(F.floor(F.max("asset_order") / block).cast("int")).scalar()
    home = F.floor(F.col("asset_order") / block).cast("int")
    spread = df.select(
        F.col(date).alias("date"),
        F.col("asset_order").cast("int").alias("asset_order"),
        F.col(value).cast("double").alias("value"),
        *extra,
        home.alias("home"),
        F.explode(F.sequence(F.lit(0), blocks)).alias("other"),
    )
    keyed = spread.select(
        "date", "asset_order", "value", *extra,
        F.least("home", "other").alias("bi"), F.greatest("home", "other").alias("bk"),
    )
    return keyed.groupBy("bi", "bk", *extra[:1]).applyInPandas(work, schema)


def _matrices(pdf: pd.DataFrame, block: int) -> tuple:
    wide = pdf.pivot(index="date", columns="asset_order", values="value").sort_index()
    orders = wide.columns.to_numpy()
    left = orders[orders // block == pdf["bi"].iat[0]]
    right = orders[orders // block == pdf["bk"].iat[0]]
    if not len(left) or not len(right):
        return None
    ii, kk = np.nonzero(left[:, None] < right[None, :])
    return wide.index.to_numpy(), wide[left].to_numpy(float), wide[right].to_numpy(float), left, right, ii, kk


def _stretches(returns: DataFrame, n: int, length: int, date: str) -> DataFrame:
    """Adds ``stretch``, the part of the time axis that a row is sent to, and
    ``position``, its place in its asset's series (from 0). The last n - 1 rows of a
    part go to the next one, too, whose first windows need them."""
    place = F.row_number().over(Window.partitionBy("asset_order").orderBy(date)) - 1
    own = F.floor(F.col("position") / length).cast("int")
    parts = F.when(F.col("position") % length > length - n, F.array(own, own + 1)).otherwise(F.array(own))
    return returns.withColumn("position", place).withColumn("stretch", F.explode(parts))


def rolling_pair_corr(
    returns: DataFrame, n: int = 21, value: str = "log_return", date: str = "month_end", block: int = 32,
    assets: DataFrame | None = None, stretch: int = STRETCH,
) -> DataFrame:
    """Correlation of every asset pair over the last n rows ending at each date.

    Input: one row per (date, asset_order), every asset on every date. Output:
    (date, i, k, corr) with i < k, one row for every date; the first value
    appears at row position n (the n rows before position n would suffice, but
    the rule starts one row later), earlier rows carry NULL. ``assets`` (with
    ``asset_order``) spares a pass over the returns to learn how many there are.

    A task gets one pair of blocks over one stretch of the dates with the n - 1 dates
    before it, so its size depends neither on the number of assets nor of dates.
    """
    length = max(stretch, n)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["stretch"].iat[0]) * length
        # by date: the stretch's own dates, after those carried over
        position = pdf.groupby("date")["position"].max().sort_index().to_numpy()
        got = _matrices(pdf, block)
        if got is None or not len(got[5]) or not (position >= first).any():
            return pd.DataFrame(columns=["date", "i", "k", "corr"], dtype=object)
        dates, a, b, left, right, ii, kk = got
        own = np.flatnonzero(position >= first)
        r = np.full((len(own), len(ii)), np.nan)
        late = np.flatnonzero(position[own] >= n)
        if len(late):
            xa = np.lib.stride_tricks.sliding_window_view(a, n, axis=0)
            xb = np.lib.stride_tricks.sliding_window_view(b, n, axis=0)
            for s in range(0, len(late), WINDOW_CHUNK):
                at = late[s : s + WINDOW_CHUNK]
                found, _ = _pair_correlation(xa[own[at] - n + 1], xb[own[at] - n + 1])
                r[at] = found[:, ii, kk]
        return pd.DataFrame({
            "date": np.repeat(dates[own], len(ii)),
            "i": np.tile(left[ii], len(own)),
            "k": np.tile(right[kk], len(own)),
            "corr": r.ravel(),
        })

    parts = _stretches(returns.select(date, "asset_order", value), n, length, date)
    out = _block_job(parts, value, date, block, work, "date date, i int, k int, corr double", assets, ["stretch", "position"])
    return out.select(F.col("date").alias(date), "i", "k", F.when(~F.isnan("corr"), F.col("corr")).alias("corr"))


def correlation_matrix(
    df: DataFrame, value: str, date: str = "date", first: int | None = None, block: int = 32,
    assets: DataFrame | None = None,
) -> DataFrame:
    """Full-history correlation of every asset pair (lower triangle as i < k).

    ``first`` restricts the matrix to the first assets in asset order.
    Output: (i, k, n_obs, corr), pairwise complete, NULL on zero variance.
    """
    if first is not None:
        df = df.where(F.col("asset_order") < first)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        got = _matrices(pdf, block)
        if got is None or not len(got[5]):
            return pd.DataFrame(columns=["i", "k", "n_obs", "corr"], dtype=object)
        _, a, b, left, right, ii, kk = got
        r, n = _pair_correlation(a.T[None], b.T[None])
        return pd.DataFrame({"i": left[ii], "k": right[kk], "n_obs": n[0, ii, kk].astype("int64"), "corr": r[0, ii, kk]})

    out = _block_job(df, value, date, block, work, "i int, k int, n_obs bigint, corr double", assets)
    return out.select("i", "k", "n_obs", F.when(~F.isnan("corr"), F.col("corr")).alias("corr"))
