"""Cases the driver's clean tables do not hold."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom import session
from marketloom.functions import scalars, stats
from marketloom.functions.windows import rolling_std
from marketloom.operators import articles, portfolio, reshape, signals

PRICES = "ticker string, date date, close double"


def day(n: int, month: int = 1) -> dt.date:
    return dt.date(2024, month, n)


def test_rolling_std_keeps_small_spreads(spark):
    values = [100000.0 + 0.05 * (i % 2) for i in range(60)] + [7.0] * 30
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    got = [r.s for r in spark.createDataFrame(rows, PRICES).withColumn("s", rolling_std("close", 20)).orderBy("date").collect()]
    want = pd.Series(values).rolling(20).apply(lambda w: np.std(w, ddof=1)).tolist()
    np.testing.assert_allclose([np.nan if g is None else g for g in got], want, rtol=1e-6, equal_nan=True)
    assert got[-1] == 0.0


def test_densify_with_missing_prices_outside_the_traded_days(spark):
    rows = [("A", day(1), None), ("A", day(4), 1.0), ("A", day(5), 2.0), ("B", day(4), 3.0), ("B", day(5), 4.0), ("B", day(9), None), ("C", day(2), None)]
    got = sorted(map(tuple, reshape.densify(spark.createDataFrame(rows, PRICES)).collect()))
    assert got == [("A", day(4), 1.0), ("A", day(5), 2.0), ("B", day(4), 3.0), ("B", day(5), 4.0), ("C", day(4), None), ("C", day(5), None)]


def test_densify_rejects_two_prices_of_a_day(spark):
    rows = [("A", day(4), 10.0), ("A", day(4), 12.0)]
    with pytest.raises(Exception, match="several prices of one day for A"):
        reshape.densify(spark.createDataFrame(rows, PRICES)).collect()


def test_no_return_spans_a_month_without_prices(spark):
    rows = [("A", dt.date(2024, 1, 31), 1.0), ("A", dt.date(2024, 2, 29), 2.0), ("A", dt.date(2024, 4, 30), 3.0), ("A", dt.date(2024, 5, 31), 6.0)]
    df = spark.createDataFrame(rows, "ticker string, month_end date, price double")
    assert [(r.month_end.month, r.log_return) for r in reshape.monthly_log_return(df).orderBy("month_end").collect()] == [(2, 0.69), (5, 0.69)]


def test_portfolio_holds_until_the_next_weight_date(spark):
    prices = [("A", day(28, m), 100.0 * 1.1 ** (m - 1)) for m in range(1, 8)]
    weights = [("p", day(28, 1), "A", 1.0), ("p", day(28, 4), "A", 1.0)]
    df = portfolio.portfolio_returns(spark.createDataFrame(weights, "portfolio_id string, date date, ticker string, weight double"), spark.createDataFrame(prices, "ticker string, date date, price double"))
    [row] = df.collect()
    assert (row.date, row.next_date) == (day(28, 1), day(28, 4)) and row.ret == pytest.approx(0.331)
    assert portfolio.equity_curve(df).agg(F.max("value")).first()[0] == pytest.approx(133_100)


def test_vectors_keep_their_slots(spark):
    cells = [(day(1), 0, 1.0), (day(1), 2, 3.0), (day(2), 1, None)]
    df = spark.createDataFrame(cells, "date date, position int, value double")
    got = {r.date: r.observation for r in portfolio.observation_vectors(df, df.where("position = 2"), width=3).collect()}
    assert got == {day(1): [1.0, 0.0, 3.0, 0.0, 0.0, 3.0], day(2): [0.0] * 6}
    weights = [(day(1), "x", 1, 0, 0.5), (day(1), "x", 1, 2, 0.25), (day(1), "y", 5, 1, None), (day(2), "y", 5, 2, 1.0)]
    df = spark.createDataFrame(weights, "date date, agent string, agent_order int, asset_order int, weight double")
    got = {r.date: r.allocation for r in portfolio.stack_allocations(df).collect()}
    assert got == {day(1): [0.5, 0.0, 0.25, 0.0, 0.0, 0.0], day(2): [0.0, 0.0, 0.0, 0.0, 0.0, 1.0]}


@pytest.mark.parametrize("text", ["Mon, 15 Jan 2024 08:00:00 +0000", "Mon, 15 Jan 2024 08:00:00 GMT", "January 15, 2024", "01/15/2024", "15 Jan 2024", "2024/01/15", "2024-01-15"])
def test_date_spellings(spark, text):
    got = spark.createDataFrame([(text,)], "x string").select(scalars.parse_date_flexible("x").cast("date")).first()[0]
    assert got == day(15)


def test_full_months_are_skipped_in_strict_mode(spark):
    long = "A long and serious headline about markets "
    items = [("T", "2024-01", i, f"{long}{i}", "details " * 10, "https://reuters.com/x", "2024-02-10") for i in range(3)]
    items += [("T", "2024-02", i, f"{long} b{i}", "details " * 10, "https://reuters.com/x", "2024-02-11") for i in range(3)]
    df = spark.createDataFrame(items, "ticker string, query_month string, pos int, title string, description string, link string, published_date string")
    assert articles.google_articles(df, 3).count() == 3 and articles.google_articles(df).count() == 6


def test_scratch_must_be_shared_off_this_machine(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://somewhere:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(Session())


def test_p_values_of_whole_arrays():
    got = stats.two_sided_p(np.array([1.0, 0.0, 0.5, np.nan, 0.3, 0.01, 0.9]), np.array([10, 10, 10, 10, 1, 1e7, 2]))
    assert got[0] == 0.0 and got[1] == 1.0 and got[2] == pytest.approx(0.14111, abs=1e-5) and np.isnan(got[3]) and np.isnan(got[4]) and got[5] < 1e-200 and got[6] == 1.0


@pytest.mark.parametrize("span", [1, 2, 9, 26])
def test_exponential_means_over_many_blocks(spark, span):
    rng = np.random.default_rng(2)
    rows = [(t, dt.date(2000, 1, 1) + dt.timedelta(days=i), float(v)) for t, n in (("A", 1100), ("B", 256), ("C", 1)) for i, v in enumerate(np.cumsum(rng.normal(size=n)) + 50)]
    df = spark.createDataFrame([*rows, ("A", dt.date(2004, 1, 1), None)], PRICES)
    got = signals.ema(df, span).toPandas().sort_values(["ticker", "date"])
    want = got.groupby("ticker")["close"].transform(lambda x: x.ewm(span=span, adjust=False).mean())
    np.testing.assert_allclose(got["ema"], want, rtol=1e-10)
    text = signals.macd(df)._jdf.queryExecution().toString()
    assert "Python" not in text and "Pandas" not in text
