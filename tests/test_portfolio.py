import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import portfolio, research
from marketloom.plans import jobs
from tests.util import month_ends

D = month_ends(40)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(11)
    prices = pd.DataFrame(100 * np.exp(np.cumsum(rng.normal(0, 0.05, (40, 3)), axis=0)), index=D, columns=list("ABC")).round(2)
    prices.loc[D[5], "B"] = np.nan
    weights = pd.DataFrame(rng.uniform(-0.2, 1.2, (40, 3)), index=D, columns=list("ABC"))
    p = table(spark, [(t, d, None if pd.isna(prices.loc[d, t]) else float(prices.loc[d, t])) for t in prices for d in D], "ticker string, date date, price double")
    w = table(spark, [("p", d, t, float(weights.loc[d, t])) for t in weights for d in D], "portfolio_id string, date date, ticker string, weight double")
    clipped = weights.clip(0, 1)
    norm = clipped.div(clipped.sum(axis=1), axis=0)
    forward = np.log(prices.shift(-1) / prices).fillna(0).iloc[:-1]
    rets = np.exp((norm.iloc[:-1] * forward).sum(axis=1)) - 1
    values = np.concatenate([[1e5], 1e5 * (1 + rets).cumprod()])
    return prices, p, w, rets, values


def test_hand_computed_curve(spark):
    p = table(spark, [("A", D[0], 100.0), ("A", D[1], 110.0), ("A", D[2], 99.0), ("B", D[0], 50.0), ("B", D[1], 50.0), ("B", D[2], 60.0)], "ticker string, date date, price double")
    w = table(spark, [("p", d, t, 0.5) for d in D[:3] for t in "AB"], "portfolio_id string, date date, ticker string, weight double")
    got = portfolio.equity_curve(portfolio.portfolio_returns(w, p)).orderBy("date").collect()
    first, second = math.sqrt(1.1) - 1, math.sqrt(0.9 * 1.2) - 1
    assert [r.date for r in got] == D[:3] and got[0].ret is None and got[0].value == 100_000
    assert math.isclose(got[1].ret, first) and math.isclose(got[2].ret, second)
    assert math.isclose(got[2].value, 100_000 * (1 + first) * (1 + second))


def test_curve_and_metrics(world):
    prices, p, w, rets, values = world
    curve = portfolio.equity_curve(portfolio.portfolio_returns(portfolio.normalize_weights(w), p))
    got = curve.orderBy("date").toPandas()
    np.testing.assert_allclose(got.value, values, rtol=1e-12)
    m = portfolio.performance_metrics(curve).first()
    series = pd.Series(values)
    down = ((series - series.expanding().max()) / series.expanding().max()).min()
    total = values[-1] / 1e5 - 1
    assert m.n_periods == 39 and math.isclose(m.total_return, total) and math.isclose(m.max_drawdown, abs(down))
    assert math.isclose(m.annualized_return, (1 + total) ** (12 / 39) - 1)
    assert math.isclose(m.sharpe_ratio, rets.mean() / rets.std() * np.sqrt(12)) and math.isclose(m.volatility, rets.std() * np.sqrt(12))
    e = portfolio.episode_metrics(curve).first()
    assert math.isclose(e.sharpe_ratio, rets.mean() / rets.std() * np.sqrt(252), rel_tol=1e-9)


def test_rewards_switch_volatility_on_at_21_values(world):
    _, p, w, rets, values = world
    curve = portfolio.equity_curve(portfolio.portfolio_returns(portfolio.normalize_weights(w), p))
    got = portfolio.reward_series(curve).orderBy("date").toPandas()
    for k in range(1, 40):
        past = pd.Series(values[: k + 1])
        down = abs(((past - past.expanding().max()) / past.expanding().max()).min())
        vol = past.iloc[-21:].pct_change().dropna().std() if k + 1 >= 21 else 0.0
        assert math.isclose(got.reward[k - 1], rets.iloc[k - 1] - 2 * down - 0.5 * vol, abs_tol=1e-10), k


def test_benchmarks_and_comparison(world):
    prices, p, w, _, _ = world
    forward = np.log(prices.shift(-1) / prices).fillna(0).iloc[:-1]
    eq = np.exp(forward.mean(axis=1)) - 1
    got = portfolio.equal_weight_benchmark(p).first()
    assert math.isclose(got.total_return, (1 + eq).prod() - 1) and math.isclose(got.sharpe_ratio, eq.mean() / eq.std() * np.sqrt(12))
    own = np.log(prices["A"] / prices["A"].shift(1)).dropna()
    hold = portfolio.buy_and_hold(p, "A").first()
    assert math.isclose(hold.total_return, np.exp(own.sum()) - 1) and math.isclose(hold.volatility, own.std() * np.sqrt(12))
    assert portfolio.buy_and_hold(p, "nope").count() == 0
    report = jobs.backtest_job(w, p, "A").collect()
    assert {r.benchmark for r in report} == {"Equal-Weighted", "A Buy & Hold"}
    assert all(math.isclose(r.annualized_return - r.excess_return, got.annualized_return if r.benchmark == "Equal-Weighted" else hold.annualized_return) for r in report)


def test_weights(spark):
    rows = [("p", D[0], "A", 2.0), ("p", D[0], "B", -1.0), ("p", D[0], "C", 1.0), ("p", D[1], "A", 0.0), ("p", D[1], "B", -3.0)]
    w = table(spark, rows, "portfolio_id string, date date, ticker string, weight double")
    got = {(r.date, r.ticker): r.weight for r in portfolio.normalize_weights(w).collect()}
    assert got == {(D[0], "A"): 0.5, (D[0], "B"): 0.0, (D[0], "C"): 0.5, (D[1], "A"): None, (D[1], "B"): None}
    eps = {(r.date, r.ticker): r.weight for r in portfolio.normalize_weights(w, eps=1e-8).collect()}
    assert eps[(D[1], "A")] == 0.0 and 0 < 0.5 - eps[(D[0], "A")] < 1e-8


@pytest.mark.parametrize("n,expected", [(1, 0), (2, 1), (3, 1), (4, 2)])
def test_median_run(spark, n, expected):
    rows = [("PPO", s, float(s)) for s in range(n)]
    assert portfolio.median_run(table(spark, rows, "agent string, seed int, reward double")).first().seed == expected


def test_fallback_and_stacking(spark):
    agents = [("PPO_data", 0), ("SAC_nlp", 1)]
    grid = table(spark, [(a, o, D[0], t, k) for a, o in agents for k, t in enumerate("AB")], "agent string, agent_order int, date date, ticker string, asset_order int")
    weights = table(spark, [("PPO_data", D[0], "A", 0.9), ("PPO_data", D[0], "B", 0.1), ("SAC_nlp", D[0], "A", 0.7)], "agent string, date date, ticker string, weight double")
    full = portfolio.fallback_allocation(weights, grid)
    assert portfolio.stack_allocations(full).first().allocation == [0.9, 0.1, 0.5, 0.5]
    assert portfolio.stack_allocations(full, "nlp").first().allocation == [0.5, 0.5]


def test_observation_vectors(spark):
    f = table(spark, [(D[0], 1, None), (D[0], 0, 1.5), (D[1], 0, 2.0), (D[1], 1, 3.0)], "date date, position int, value double")
    s = table(spark, [(D[0], 0, 0.25)], "date date, position int, value double")
    got = {r.date: r.observation for r in portfolio.observation_vectors(f, s).collect()}
    assert got == {D[0]: [1.5, 0.0, 0.25], D[1]: [2.0, 3.0, 0.0]}
    assert portfolio.observation_vectors(f).where(F.col("date") == F.lit(D[1])).first().observation == [2.0, 3.0]


def test_recent_weights(spark):
    w = table(spark, [("p", d, t, 0.5) for d in D[:5] for t in "AB"] + [("q", D[0], "A", 1.0)], "portfolio_id string, date date, ticker string, weight double")
    got = portfolio.recent_weights(w, 2).toPandas()
    assert sorted(got[got.portfolio_id == "p"].date.unique()) == D[3:5] and len(got) == 5


def test_research_operators(spark, world):
    _, p, w, rets, values = world
    turn = research.turnover(table(spark, [("p", D[0], "A", 0.6), ("p", D[0], "B", 0.4), ("p", D[1], "A", 0.1), ("p", D[1], "B", 0.9)], "portfolio_id string, date date, ticker string, weight double"), 0.002)
    assert [(round(r.turnover, 9), round(r.cost, 9)) for r in turn.orderBy("date").collect()] == [(1.0, 0.002), (1.0, 0.002)]
    returns = portfolio.portfolio_returns(portfolio.normalize_weights(w), p)
    risk = research.tail_risk(returns).first()
    assert math.isclose(risk["var"], np.percentile(rets, 5)) and math.isclose(risk.cvar, rets[rets <= np.percentile(rets, 5)].mean())
    curve = table(spark, [("p", D[i], v) for i, v in enumerate([100.0, 90.0, 95.0, 100.0, 120.0, 110.0])], "portfolio_id string, date date, value double")
    spells = research.drawdown_recovery(curve).orderBy("start_date").collect()
    assert [(r.start_date, r.end_date, r.periods, r.recovered) for r in spells] == [(D[1], D[2], 2, True), (D[5], D[5], 1, False)]
    fill = table(spark, [("A", 0, None), ("A", 1, 0.8), ("A", 2, None), ("A", 3, None)], "ticker string, position int, v double")
    assert [r.v_filled for r in research.decayed_fill(fill, "v", 0.5).orderBy("position").collect()] == [None, 0.8, 0.4, 0.2]
    monthly = table(spark, [("A", "2024-01", 0.1), ("A", "2024-04", 1.7)], "ticker string, month string, sentiment_weighted double")
    issues = sorted((r.month, r.issue) for r in research.quality_monitor(monthly).collect())
    assert issues == [("2024-02", "missing_month"), ("2024-03", "missing_month"), ("2024-04", "out_of_range")]
    day = dt.date(2024, 1, 31)
    news = table(spark, [("A", "2024-01", day, 1.0), ("A", "2024-01", day - dt.timedelta(7), 0.0)], "ticker string, month string, date date, sentiment_score double")
    assert math.isclose(research.recency_weighted_sentiment(news).first().sentiment_recency, 1 / (1 + math.exp(-1)))


def test_bootstrap_brackets_the_point_estimate(spark):
    rng = np.random.default_rng(1)
    rows = [("A", f"{2000 + i // 12}-{i % 12 + 1:02d}", float(x), float(x + rng.normal(0, 0.5))) for i, x in enumerate(rng.normal(size=60))]
    df = table(spark, rows, "ticker string, month string, sentiment_weighted double, monthly_return double")
    a = research.bootstrap_corr(df.repartition(5)).first()
    b = research.bootstrap_corr(df.coalesce(1)).first()
    assert all(x == y or math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a, b))
    assert a.corr_low < a["corr"] < a.corr_high and a.share_positive == 1.0 and a.n == 60
