import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom import schemas
from marketloom.operators import sentiment


@pytest.fixture(scope="module")
def frame():
    rng = random.Random(2)
    rows = []
    for i in range(300):
        label = rng.choice(["positive", "negative", "neutral"])
        conf = round(rng.uniform(0.5, 0.9), 2)
        score = {"positive": conf, "negative": -conf}.get(label, 0.0)
        # One ticker and one source hold most of the articles.
        ticker = "A" if rng.random() < 0.5 else rng.choice("BCD")
        source = "google" if rng.random() < 0.6 else rng.choice(["yahoo", "reddit", "blog"])
        rows.append((ticker, f"2024-{rng.randrange(1, 7):02d}", source, f"title {i}", label, conf, score))
    rows.append(("E", "2024-01", "yahoo", "single", "positive", 0.6, 0.6))
    rows.append(("E", "2024-02", "yahoo", "unscored", None, None, None))
    return pd.DataFrame(rows, columns=["ticker", "month", "source", "title", "sentiment_label", "sentiment_confidence", "sentiment_score"])


@pytest.fixture(scope="module")
def df(spark, frame):
    schema = "ticker string, month string, source string, title string, sentiment_label string, sentiment_confidence double, sentiment_score double"
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, schema).repartition(5).cache()


def keyed(df, *keys):
    return df.toPandas().set_index(list(keys)).sort_index()


def test_monthly(df, frame):
    got = keyed(sentiment.monthly_sentiment(df), "ticker", "month")
    g = frame.groupby(["ticker", "month"])
    np.testing.assert_allclose(got.sentiment_mean.astype(float), g.sentiment_score.mean(), equal_nan=True)
    np.testing.assert_allclose(got.sentiment_std.astype(float), g.sentiment_score.std(), equal_nan=True, atol=1e-12)
    assert got.news_count.tolist() == g.size().tolist()
    assert keyed(sentiment.monthly_sentiment(df, "scores"), "ticker", "month").news_count.tolist() == g.sentiment_score.count().tolist()


def test_one_pass_merge_equals_join_of_pivot(df):
    sources = ["google", "reddit", "yahoo", "blog"]
    merged = keyed(sentiment.merge_sources(df, sources), "ticker", "month")
    pivot = keyed(sentiment.pivot_sources(sentiment.monthly_by_source(df), sources), "ticker", "month")
    for c in pivot.columns:
        np.testing.assert_allclose(merged[c].astype(float), pivot[c].astype(float), atol=1e-12)


def test_count_weights_give_the_overall_mean(df):
    sources = ["google", "reddit", "yahoo", "blog"]
    scored = df.where("sentiment_score is not null")
    got = sentiment.weighted_sentiment(sentiment.merge_sources(scored, sources), "count", sources).toPandas()
    np.testing.assert_allclose(got.sentiment_weighted, got.sentiment_mean, atol=1e-12)


def test_equal_weights_count_absent_sources_as_zero(df, frame):
    got = keyed(sentiment.weighted_sentiment(sentiment.merge_sources(df), "equal"), "ticker", "month")
    means = frame.groupby(["ticker", "month", "source"]).sentiment_score.mean().unstack().reindex(columns=schemas.SOURCES).fillna(0)
    np.testing.assert_allclose(got.sentiment_weighted, means.mean(axis=1), atol=1e-12)
    with pytest.raises(ValueError):
        sentiment.weighted_sentiment(sentiment.merge_sources(df), "other")


def test_fixed_weights(df, frame):
    got = keyed(sentiment.fixed_weight_sentiment(df), "ticker", "month").sentiment_weighted
    scored = frame.dropna(subset=["sentiment_score"])
    means = scored.groupby(["ticker", "month", "source"]).sentiment_score.mean().reset_index()
    means["w"] = means.source.map({"yahoo": 0.4, "google": 0.4, "reddit": 0.2}).fillna(0.1)
    means["top"] = means.w * means.sentiment_score
    sums = means.groupby(["ticker", "month"])[["top", "w"]].sum()
    np.testing.assert_allclose(got, sums.top / sums.w, atol=1e-12)


def test_reports(df, frame):
    cover = sentiment.coverage(df, ["source"], share=True).toPandas().set_index("source")
    assert math.isclose(cover.pct.sum(), 100.0) and cover.n.to_dict() == frame.source.value_counts().to_dict()
    cross = sentiment.label_crosstab(df).toPandas().set_index("source")
    assert cross.sum().sum() == frame.sentiment_label.notna().sum()
    totals = {(r.scope, r.key): r.value for r in sentiment.collection_totals(df).collect()}
    assert totals[("total", "all")] == len(frame) and totals[("ticker", "A")] == (frame.ticker == "A").sum()
    assert math.isclose(totals[("average", "per_ticker")], len(frame) / 5)
    grid = df.sparkSession.createDataFrame([("A", "google"), ("Z", "yahoo")], "ticker string, source string")
    report = {r.ticker: r.article_count for r in sentiment.news_quality_report(df.withColumn("date", F.to_date("month", "yyyy-MM")), grid).collect()}
    assert report["Z"] == 0 and report["A"] == ((frame.ticker == "A") & (frame.source == "google")).sum()
    shares = sentiment.subreddit_share(df.select(F.when(F.col("source") != "blog", F.col("source")).alias("subreddit"))).toPandas()
    assert "unknown" in set(shares.subreddit) and math.isclose(shares.pct.sum(), 100)


def test_ranking_breaks_ties_by_ticker(spark):
    rows = [("B", "2024-01", 0.1001, 1), ("A", "2024-01", 0.0999, 2), ("C", "2024-01", 0.5, 3), ("C", "2024-02", 0.5, 1)]
    monthly = spark.createDataFrame(rows, "ticker string, month string, sentiment_weighted double, news_count bigint")
    got = [(r["rank"], r.ticker, r.avg_sentiment, r.total_articles) for r in sentiment.asset_ranking(monthly).collect()]
    assert got == [(1, "C", 0.5, 4), (2, "A", 0.1, 2), (3, "B", 0.1, 1)]
    assert [r.ticker for r in sentiment.top_assets(monthly, 2).collect()] == ["C", "B"]
    ends = sentiment.extremes(sentiment.asset_stats(monthly)).first()
    assert (ends.most_positive, ends.most_negative, ends.highest_volatility) == ("C", "A", "C")


def make_loader():
    def loader():
        def model(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("model failed")
            return [{"label": "positive", "score": min(0.99, len(t) / 1000)} for t in texts]

        return model

    return loader


def test_model_and_its_fallbacks(spark):
    loader = make_loader()
    rows = [(i, "strong growth " + "x" * i) for i in range(70)] + [(99, "boom weak"), (100, None)]
    df = spark.createDataFrame(rows, "id int, headline string").coalesce(1)
    got = {r.id: r for r in sentiment.model_sentiment(df, loader=loader, batch=1).collect()}
    assert len(got) == 72 and math.isclose(got[3].sentiment_score, 0.017)
    assert got[99].sentiment_label == "negative" and math.isclose(got[99].sentiment_score, -0.6)
    dropped = sentiment.model_sentiment(df, loader=loader, batch=1, drop_errors=True)
    assert 99 not in {r.id for r in dropped.collect()} and dropped.count() == 71
    cut = {r.id: r for r in sentiment.model_sentiment(df, loader=loader, batch=1, max_chars=10).collect()}
    assert math.isclose(cut[50].sentiment_score, 0.01)
    plain = sentiment.model_sentiment(df)
    assert plain.where("id = 1").first().sentiment_label == "positive"
    assert sentiment.model_sentiment(df, loader=lambda: None).where("id = 99").first().sentiment_label == "negative"
