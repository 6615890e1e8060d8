import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import correlation, features, indicators, profile, reshape, signals
from marketloom.plans import jobs
from tests.util import assert_wide_equal, month_ends, price_frame, wide


@pytest.fixture(scope="module")
def long():
    return price_frame()


@pytest.fixture(scope="module")
def prices(spark, long):
    return spark.createDataFrame(long, "date date, ticker string, close double").repartition(3).cache()


def pandas_of(df, value, index="date"):
    return wide(df.toPandas(), value, index)


def test_densify_is_the_union_calendar(prices, long):
    assert_wide_equal(pandas_of(reshape.densify(prices), "close"), wide(long, "close"))


def test_fill_forward_back(prices, long):
    got = reshape.fill_forward_back(reshape.densify(prices), "close")
    assert_wide_equal(pandas_of(got, "close"), wide(long, "close").ffill().bfill())
    got = reshape.fill_forward_back(reshape.densify(prices), "close", back=False)
    assert_wide_equal(pandas_of(got, "close"), wide(long, "close").ffill())


def test_daily_features(prices, long):
    w = wide(long, "close")
    r = np.log(w / w.shift(1)).fillna(0)
    expected = {"log_return": r, "sma10": w.rolling(10).mean() / w - 1, "sma30": w.rolling(30).mean() / w - 1, "volatility_10": r.rolling(10).std()}
    for n in (60, 120):
        expected[f"log_return_mean_{n}"], expected[f"log_return_std_{n}"] = r.rolling(n).mean(), r.rolling(n).std()
        expected[f"sharpe_{n}"] = r.rolling(n).mean() / (r.rolling(n).std() + 1e-8)
    got = features.daily_features(prices, digits=None).toPandas()
    for name, frame in expected.items():
        assert_wide_equal(wide(got, name), frame.fillna(0), 1e-7)
    rounded = features.daily_features(prices).toPandas()
    assert_wide_equal(wide(rounded, "sma10"), expected["sma10"].round(4).fillna(0))


def test_rolling_needs_a_full_window(spark):
    days = pd.bdate_range("2020-01-01", periods=12)
    rows = [(d.date(), "A", None if i == 3 else 5.0) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "date date, ticker string, close double")
    got = [r.m for r in df.select("date", features.rolling_mean("close", 4).alias("m")).orderBy("date").collect()]
    assert got == [None] * 7 + [5.0] * 5
    std = [r.s for r in df.select("date", features.rolling_deviation("close", 4).alias("s")).orderBy("date").collect()]
    assert std == [None] * 7 + [0.0] * 5


def test_month_ends_and_returns(prices, long):
    filled = wide(long, "close").ffill().bfill()
    expected = filled.resample("ME").last().round(2)
    monthly = jobs.monthly_prices(prices)
    assert_wide_equal(pandas_of(monthly, "price", "month_end"), expected)
    r = np.log(expected / expected.shift(1)).dropna().round(2)
    assert_wide_equal(pandas_of(reshape.monthly_log_return(monthly), "log_return", "month_end"), r)


def returns_frame(n_assets=5, n=70, seed=3):
    rng = np.random.default_rng(seed)
    data = rng.normal(0.0, 0.05, (n, n_assets)).round(2)
    data[:, 1] = np.abs(data[:, 1])
    data[:, 2] = 0.01
    return pd.DataFrame(data, index=pd.to_datetime(month_ends(n)), columns=[f"T{k}" for k in range(n_assets)])


@pytest.fixture(scope="module")
def monthly_returns(spark):
    w = returns_frame()
    rows = [(c, int(c[1:]), d.date(), float(w.loc[d, c])) for c in w.columns for d in w.index]
    return spark.createDataFrame(rows, "ticker string, asset_order int, month_end date, log_return double"), w


def reference_indicators(w, n=21):
    out = {}
    for c in w.columns:
        r = w[c]
        constant = r.rolling(n).max() == r.rolling(n).min()
        mean, vol = r.rolling(n).mean() * 252, r.rolling(n).std().mask(constant, 0.0) * np.sqrt(252)
        down = (r[r < 0].rolling(n).std() * np.sqrt(252)).reindex(r.index).fillna(vol)
        growth = (1 + r).cumprod()
        peak = growth.rolling(n).max()
        worst = ((growth - peak) / peak).rolling(n).min().abs()
        for name, bottom in (("sharpe", vol), ("sortino", down), ("calmar", worst)):
            out[f"{c}_{name}"] = pd.Series(np.where(bottom != 0, mean / bottom, 0), index=w.index)
        out[f"{c}_volatility"], out[f"{c}_max_drawdown"] = vol, worst
    frame = pd.DataFrame(out)
    j = 0
    for i in range(len(w.columns)):
        for k in range(i + 1, len(w.columns)):
            corr = w.iloc[:, i].rolling(n).corr(w.iloc[:, k])
            const = (w.iloc[:, [i, k]].rolling(n).max() == w.iloc[:, [i, k]].rolling(n).min()).any(axis=1)
            frame[f"corr_{j}"] = corr.mask(const).where(np.arange(len(w)) >= n)
            j += 1
    return frame


def scale(frame):
    lo, hi = frame.min(), frame.max()
    out = (frame - lo) / (hi - lo)
    out.loc[:, hi - lo == 0] = 0.5
    return out.fillna(0)


def test_risk_indicators_match(monthly_returns):
    df, w = monthly_returns
    expected = scale(reference_indicators(w))
    got = indicators.risk_indicators(df, digits=None, block=2).toPandas()
    got = got.pivot(index="month_end", columns="feature", values="value")
    assert set(got.columns) == set(expected.columns)
    for c in expected.columns:
        np.testing.assert_allclose(got[c].to_numpy(float), expected[c].to_numpy(float), atol=1e-7, err_msg=c)


@pytest.mark.parametrize("block", [1, 2, 3, 32])
def test_pair_correlations_do_not_depend_on_the_blocks(monthly_returns, block):
    df, w = monthly_returns
    got = correlation.rolling_pair_corr(df, 21, block=block).toPandas()
    assert len(got) == 10 * len(w) and not got.duplicated(["i", "k", "month_end"]).any()
    some = got[(got.i == 0) & (got.k == 3)].sort_values("month_end")["corr"].to_numpy(float)
    expected = w["T0"].rolling(21).corr(w["T3"]).where(np.arange(len(w)) >= 21).to_numpy()
    np.testing.assert_allclose(some, expected, atol=1e-9, equal_nan=True)
    assert got[got.i == 2]["corr"].isna().all()


@pytest.mark.parametrize("stretch", [21, 25, 40])
def test_pair_correlations_do_not_depend_on_the_stretches(monthly_returns, stretch):
    df, _ = monthly_returns
    key = ["month_end", "i", "k"]
    whole = correlation.rolling_pair_corr(df, 21).toPandas().sort_values(key)
    parts = correlation.rolling_pair_corr(df, 21, stretch=stretch).toPandas().sort_values(key)
    assert whole[key].to_numpy().tolist() == parts[key].to_numpy().tolist()
    np.testing.assert_allclose(whole["corr"].to_numpy(float), parts["corr"].to_numpy(float), atol=1e-12, equal_nan=True)


def test_pair_correlations_far_from_zero_and_with_gaps(spark):
    """Levels, gaps and outliers in rows that don't count must not hide a correlation."""
    rng = np.random.default_rng(1)
    base = rng.normal(0, 1, 60)
    x = 1e7 + base + 0.05 * rng.normal(0, 1, 60)
    y = 1e7 + base
    x[0], y[0] = 0.0, np.nan
    tiny = base * 1e-12
    frame = pd.DataFrame({0: x, 1: y, 2: np.full(60, 0.1), 3: tiny, 4: np.where(np.arange(60) % 3 == 0, np.nan, base)})
    dates = pd.date_range("2020-01-01", periods=60)
    rows = [(d.date(), int(c), None if pd.isna(frame.loc[i, c]) else float(frame.loc[i, c])) for c in frame for i, d in enumerate(dates)]
    df = spark.createDataFrame(rows, "date date, asset_order int, r double")

    def expected(a, b, first, last):
        both = frame.loc[first:last, [a, b]].dropna().astype(np.longdouble)
        p, q = (both[c] - both[c].mean() for c in (a, b))
        return np.nan if not (p != 0).any() or not (q != 0).any() else float((p * q).sum() / np.sqrt((p * p).sum() * (q * q).sum()))

    for r in correlation.correlation_matrix(df, "r", block=2).collect():
        want = np.nan if 2 in (r.i, r.k) else expected(r.i, r.k, 0, 59)
        np.testing.assert_allclose(np.nan if r["corr"] is None else r["corr"], want, atol=1e-9, equal_nan=True, err_msg=str(r))
    for r in correlation.rolling_pair_corr(df, 21, "r", "date", block=2, stretch=30).collect():
        at = (r.date - dates[0].date()).days
        want = np.nan if 2 in (r.i, r.k) or at < 21 else expected(r.i, r.k, at - 20, at)
        np.testing.assert_allclose(np.nan if r["corr"] is None else r["corr"], want, atol=1e-8, equal_nan=True, err_msg=str(r))


def test_pair_index():
    n, j, seen = 7, 0, {}
    for i in range(n):
        for k in range(i + 1, n):
            seen[(i, k)] = j
            j += 1
    assert all(i * n - i * (i + 1) // 2 + (k - i - 1) == v for (i, k), v in seen.items())


def test_correlation_matrix_is_pairwise_complete(spark, long):
    w = wide(long, "close").pct_change(fill_method=None)
    rows = [(d.date(), int(c[1:]), None if pd.isna(w.loc[d, c]) else float(w.loc[d, c])) for c in w for d in w.index]
    df = spark.createDataFrame(rows, "date date, asset_order int, r double")
    expected = w.corr().to_numpy()
    for row in correlation.correlation_matrix(df, "r", block=2).collect():
        assert abs(row["corr"] - expected[row.i, row.k]) < 1e-9
    assert correlation.correlation_matrix(df, "r", first=3).count() == 3


def test_signals(prices, long):
    got = signals.signal_table(prices).toPandas()
    for ticker, part in got.groupby("ticker"):
        p = long[long.ticker == ticker].set_index("date").close
        part = part.set_index("date").loc[p.index]
        d = p.diff()
        up, down = d.clip(lower=0).rolling(14).mean(), (-d.clip(upper=0)).rolling(14).mean()
        rsi = 100 - 100 / (1 + up / down)
        line = p.ewm(span=12, adjust=False).mean() - p.ewm(span=26, adjust=False).mean()
        signal = line.ewm(span=9, adjust=False).mean()
        mid, width = p.rolling(20).mean(), 2 * p.rolling(20).std()
        for name, want in (("rsi", rsi), ("macd", line), ("signal", signal), ("sma20", mid), ("upper_band", mid + width), ("lower_band", mid - width), ("sma50", p.rolling(50).mean())):
            np.testing.assert_allclose(part[name].to_numpy(float), want.to_numpy(float), rtol=1e-7, atol=1e-7, equal_nan=True, err_msg=name)
        assert (part.buy_signal == ((rsi < 30) & (line > signal))).all()
        assert (part.sell_signal == ((rsi > 70) & (line < signal))).all()


def test_rsi_edges(spark):
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=16)]
    rows = [(d, "up", 1.0 + i) for i, d in enumerate(days)] + [(d, "flat", 1.0) for d in days]
    df = spark.createDataFrame(rows, "date date, ticker string, close double")
    last = {r.ticker: r.rsi for r in signals.add_rsi(df).where(F.col("date") == F.lit(days[-1])).collect()}
    assert last == {"up": 100.0, "flat": None}
    first = signals.add_rsi(df).where((F.col("ticker") == "up") & F.col("rsi").isNotNull()).agg(F.min("date")).first()[0]
    assert first == days[14]


def test_summary_and_candidates(prices, long):
    w = wide(long, "close").ffill().bfill()
    r = w.pct_change(fill_method=None)
    filled = reshape.fill_forward_back(reshape.densify(prices), "close")
    got = signals.risk_return_summary(filled).toPandas().set_index("ticker").sort_index()
    np.testing.assert_allclose(got.total_return, (1 + r).cumprod().iloc[-1] - 1, rtol=1e-9)
    np.testing.assert_allclose(got.volatility, r.std() * np.sqrt(252), rtol=1e-9)
    want = got[(got.total_return < 0) | (got.volatility > got.volatility.median())]
    assert set(signals.sell_candidates(signals.risk_return_summary(filled)).toPandas().ticker) == set(want.index)


def test_price_field_is_chosen_per_ticker(spark):
    d = dt.date(2020, 1, 1)
    rows = [(d, "A", 1.0, None), (d + dt.timedelta(1), "A", 2.0, 1.9), (d, "B", 3.0, None)]
    df = spark.createDataFrame(rows, "date date, ticker string, close double, adj_close double")
    got = {(r.ticker, r.date.day): r.price for r in reshape.select_price_field(df).collect()}
    assert got == {("A", 1): None, ("A", 2): 1.9, ("B", 1): 3.0}


def test_histogram_has_numpy_bins(spark):
    values = np.random.default_rng(1).normal(size=500).round(3)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    n, edges = np.histogram(values, bins=13)
    got = profile.value_histogram(df, "x", 13, density=True).orderBy("bin").toPandas()
    assert got.n.tolist() == n.tolist()
    np.testing.assert_allclose(got.lower, edges[:-1], atol=1e-12)
    np.testing.assert_allclose(got.density, np.histogram(values, bins=13, density=True)[0], atol=1e-12)


def test_split_history_and_audit(spark, prices):
    ranges = {"train": ("2020-01-01", "2020-03-31"), "test": ("2020-04-01", "2020-12-31")}
    both = reshape.split_by_date(prices, ranges)
    assert both.count() == prices.count() and both.select("split").distinct().count() == 2
    assert reshape.min_history(prices, 0.5).select("ticker").distinct().count() == 4
    assert profile.null_audit(reshape.densify(prices)).first()["close"] == reshape.densify(prices).where("close is null").count()
    total = profile.table_profile(prices).first()
    assert total.n_assets == 5 and total.n_rows == prices.count()


def test_results_do_not_depend_on_partitioning(prices):
    a = features.daily_features(prices.repartition(1)).orderBy("ticker", "date").toPandas()
    b = features.daily_features(prices.repartition(7)).orderBy("ticker", "date").toPandas()
    pd.testing.assert_frame_equal(a, b)
