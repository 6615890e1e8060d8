import math

import numpy as np
import pandas as pd
import pytest

from marketloom.functions.stats import two_sided_p
from marketloom.operators import validation


@pytest.fixture(scope="module")
def merged_frame():
    rng = np.random.default_rng(4)
    rows = []
    for t, months in (("A", range(1, 13)), ("B", [1, 2, 4, 5, 9]), ("C", [1, 2]), ("D", [1, 2, 3]), ("K", range(1, 7))):
        for m in months:
            s = 0.3 if t == "K" else float(rng.normal())
            rows.append((t, f"2024-{m:02d}", s, 0.4 * s + float(rng.normal())))
    return pd.DataFrame(rows, columns=["ticker", "month", "sentiment_weighted", "monthly_return"])


@pytest.fixture(scope="module")
def merged(spark, merged_frame):
    return spark.createDataFrame(merged_frame).repartition(3).cache()


def test_summary(merged, merged_frame):
    got = validation.validation_summary(merged, extended=True).toPandas().set_index("ticker")
    assert set(got.index) == {"A", "B", "D", "K"}
    for t in ("A", "B", "D"):
        g = merged_frame[merged_frame.ticker == t].sort_values("month")
        r = g.sentiment_weighted.corr(g.monthly_return)
        assert math.isclose(got.current_corr[t], r, abs_tol=1e-9)
        assert math.isclose(got.current_p[t], two_sided_p(r, len(g)), abs_tol=1e-9)
        lag = g.sentiment_weighted.iloc[:-1].reset_index(drop=True).corr(g.monthly_return.iloc[1:].reset_index(drop=True))
        if len(g) - 1 >= 3:
            assert math.isclose(got.lagged_corr[t], lag, abs_tol=1e-9)
            assert math.isclose(got.lagged_p[t], two_sided_p(lag, len(g) - 1), abs_tol=1e-9)
        else:
            assert pd.isna(got.lagged_corr[t]) and pd.isna(got.lagged_p[t])
        assert math.isclose(got.return_volatility[t], g.monthly_return.std(), abs_tol=1e-9)
    assert pd.isna(got.current_corr["K"]) and pd.isna(got.current_p["K"])


def test_summary_agrees_with_its_parts(merged):
    whole = validation.validation_summary(merged).toPandas().set_index("ticker")
    current = validation.validate_current(merged).toPandas().set_index("ticker")
    lagged = validation.validate_lagged(merged).toPandas().set_index("ticker")
    for t in whole.index:
        for frame, c in ((current, "current_corr"), (current, "current_p"), (lagged, "lagged_corr"), (lagged, "lagged_p")):
            a, b = whole[c][t], frame[c][t]
            assert (pd.isna(a) and pd.isna(b)) or math.isclose(a, b, abs_tol=1e-12)


def test_wide_validation(spark):
    rng = np.random.default_rng(8)
    dates = [d.date() for d in pd.date_range("2024-01-01", periods=10, freq="D")]
    s = pd.DataFrame(rng.normal(size=(8, 3)), index=dates[:8], columns=list("ABC"))
    r = pd.DataFrame(rng.normal(size=(8, 3)), index=dates[2:], columns=list("ABD"))
    s.loc[dates[4], "A"] = np.nan
    r.loc[dates[6], "B"] = np.nan

    def long(w):
        rows = [(d, c, float(w.loc[d, c])) for d in w.index for c in w if not pd.isna(w.loc[d, c])]
        return spark.createDataFrame(rows, "date date, ticker string, value double")

    common = s.index.intersection(r.index)
    a, b = s.loc[common], r.loc[common]
    got = validation.validate_wide(long(s), long(r)).toPandas().set_index("ticker")
    assert set(got.index) == {"A", "B"} and set(got.sample_size) == {len(common)}
    for t in "AB":
        c = a[t].corr(b[t])
        assert math.isclose(got.current_corr[t], c, abs_tol=1e-9)
        assert math.isclose(got.predictive_corr[t], a[t].corr(b[t].shift(-1)), abs_tol=1e-9)
        assert math.isclose(got.t_stat[t], c * np.sqrt((len(common) - 2) / (1 - c * c)), abs_tol=1e-9)


def test_source_stats_equal_the_row_level_join(spark):
    rng = np.random.default_rng(6)
    scored = pd.DataFrame({
        "source": rng.choice(["google", "yahoo", "reddit"], 500, p=[0.7, 0.2, 0.1]), "ticker": rng.choice(list("ABC"), 500),
        "month": rng.choice([f"2024-{m:02d}" for m in range(1, 9)], 500), "sentiment_score": rng.normal(size=500).round(2),
    })
    returns = pd.DataFrame([(t, f"2024-{m:02d}", float(rng.normal())) for t in "ABC" for m in range(1, 8)], columns=["ticker", "month", "monthly_return"])
    rows = scored.merge(returns, on=["ticker", "month"])
    stats = validation.source_return_stats(spark.createDataFrame(scored), spark.createDataFrame(returns))
    got = stats.toPandas().set_index("source")
    for source, g in rows.groupby("source"):
        assert got.loc[source, "rows"] == len(g)
        assert math.isclose(got["corr"][source], g.sentiment_score.corr(g.monthly_return), abs_tol=1e-9)
        assert math.isclose(got["std"][source], g.sentiment_score.std(), abs_tol=1e-9)
    weights = validation.optimal_source_weights(stats).toPandas()
    assert math.isclose(weights.weight.sum(), 1.0)
    listed = {r.source: r["corr"] for r in validation.source_return_corr(stats, ["google", "blog"]).collect()}
    assert listed["blog"] == 0.0 and math.isclose(listed["google"], got["corr"]["google"])


def test_constant_scores_have_no_correlation(spark):
    scored = spark.createDataFrame([("google", "A", f"2024-0{m}", 0.1) for m in range(1, 8) for _ in range(3)], "source string, ticker string, month string, sentiment_score double")
    returns = spark.createDataFrame([("A", f"2024-0{m}", 0.1 * m) for m in range(1, 8)], "ticker string, month string, monthly_return double")
    row = validation.source_return_stats(scored, returns).first()
    assert row["corr"] is None and row["std"] == 0.0


def test_breakdown_counts_and_order(spark):
    rows = [("A", 30, 0.5, 0.0005, 0.31, 0.2), ("B", 30, 0.3, 0.005, None, None), ("C", 30, 0.1, 0.04, 0.05, 0.6), ("D", 30, -0.05, 0.05, -0.2, 0.01), ("E", 30, None, None, None, None)]
    summary = spark.createDataFrame(rows, "ticker string, data_points bigint, current_corr double, current_p double, lagged_corr double, lagged_p double")
    counts = {r.strength: r.n for r in validation.strength_counts(validation.correlation_breakdown(summary)).collect()}
    assert counts == {"strong": 1, "moderate": 2, "weak": 1}
    assert validation.correlation_breakdown(summary, "lagged").count() == 3
    assert tuple(validation.significance_counts(summary).first()) == (1, 2, 3, 4)
    assert [r.ticker for r in validation.signal_strength(summary).collect()] == ["D", "C", "B", "A", "E"]
    assert [r.ticker for r in validation.top_by_corr(summary, 2).collect()] == ["A", "B"]


def test_source_statistics_keep_their_digits_at_any_level(spark):
    """Scores and returns around 1e8 with a spread of 1, merged over many cells."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows, returns = [], []
    for t in range(6):
        for m in range(1, 13):
            r = 1e8 + float(rng.normal())
            returns.append((f"T{t}", f"2024-{m:02d}", r if (t, m) != (0, 1) else None))
            rows += [(s, f"T{t}", f"2024-{m:02d}", 1e8 + 0.5 * (r - 1e8) + float(rng.normal()), r if (t, m) != (0, 1) else None) for s in ("a", "b") for _ in range(int(rng.integers(1, 5)))]
    rows += [("flat", "T1", "2024-01", 0.1, returns[12][2])] * 7 + [("empty", "T1", "2024-01", None, returns[12][2])]
    scored = spark.createDataFrame([r[:4] for r in rows], "source string, ticker string, month string, sentiment_score double")
    got = {r.source: r for r in validation.source_return_stats(scored, spark.createDataFrame(returns, "ticker string, month string, monthly_return double")).collect()}
    for source in ("a", "b"):
        own = [(np.longdouble(x), y) for s, _, _, x, y in rows if s == source]
        x = np.array([v for v, _ in own]) - 100_000_000
        p = np.array([(v - 100_000_000, np.longdouble(y) - 100_000_000) for v, y in own if y is not None])
        p = p - p.mean(axis=0)
        assert abs(got[source].std - float(x.std(ddof=1))) < 1e-7
        assert abs(got[source]["corr"] - float((p[:, 0] * p[:, 1]).sum() / np.sqrt((p[:, 0] ** 2).sum() * (p[:, 1] ** 2).sum()))) < 1e-7
    assert (got["flat"].std, got["flat"]["corr"]) == (0.0, None) and (got["empty"].rows, got["empty"].std, got["empty"]["corr"]) == (1, None, None)


def test_bootstrap_makes_no_row_a_slot(spark):
    from marketloom.operators.research import bootstrap_corr

    df = spark.createDataFrame([("A", f"2024-{m:02d}", float(m % 5), float(m % 3)) for m in range(1, 13)] + [("B", "2024-01", 1.0, 1.0)], "ticker string, month string, sentiment_weighted double, monthly_return double")
    out = bootstrap_corr(df, 50)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("Generate ") == 1 and text.count("Exchange hashpartitioning(ticker") <= 2
    got = {r.ticker: r for r in out.collect()}
    assert got["A"].n == 12 and got["A"].corr_low <= got["A"].corr_mean <= got["A"].corr_high and got["B"].corr_mean is None
