"""Sentiment aggregates by asset, month and source."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import tables as t
from driver_queries.tables import ARTICLES, GOOGLE, MONTHLY_SENTIMENT, SCORED, SOURCES, finish, sql
from marketloom.functions.scalars import extract_domain, is_quality_source
from marketloom.operators import sentiment

Q: dict = {}


def add(name: str, fn, spec: str, query: list[str] | str | None) -> None:
    Q[name] = (lambda spark, sf: finish(fn(spark, sf), spec), None if query is None else sql(query, spec))


def _r3(e: str) -> str:
    fine = f"(round_even(({e}) * CAST(1e12 AS DOUBLE), 0) / CAST(1e12 AS DOUBLE))"
    return f"round_even({fine} * CAST(1000 AS DOUBLE), 0) / CAST(1000 AS DOUBLE)"


add(
    "monthly_sentiment",
    lambda s, d: sentiment.monthly_sentiment(t.scored(s, d), assets=t.assets(s, d)),
    "ticker month company sentiment_mean:f6 sentiment_std:f6 news_count confidence_mean:f6",
    [SCORED, t.ASSETS, """q AS (SELECT s.ticker, month, company, avg(sentiment_score) AS sentiment_mean, stddev_samp(sentiment_score) AS sentiment_std,
      count(*) AS news_count, avg(sentiment_confidence) AS confidence_mean FROM scored s LEFT JOIN assets a ON s.ticker = a.ticker GROUP BY 1, 2, 3)"""],
)
add(
    "monthly_by_source", lambda s, d: sentiment.monthly_by_source(t.scored(s, d)),
    "ticker month source sentiment_mean:f6 news_count confidence_mean:f6",
    [SCORED, """q AS (SELECT ticker, month, source, avg(sentiment_score) AS sentiment_mean, count(*) AS news_count,
      avg(sentiment_confidence) AS confidence_mean FROM scored GROUP BY 1, 2, 3)"""],
)
_SRC = " ".join(f"{s}_sentiment_mean:f6 {s}_news_count" for s in SOURCES)
add(
    "pivot_sources", lambda s, d: sentiment.pivot_sources(sentiment.monthly_by_source(t.scored(s, d)), SOURCES),
    f"ticker month {_SRC}", [MONTHLY_SENTIMENT, "q AS (SELECT * FROM merged_sources)"],
)
add(
    "merge_sources", lambda s, d: sentiment.merge_sources(t.scored(s, d), SOURCES),
    f"ticker month sentiment_mean:f6 sentiment_std:f6 news_count confidence_mean:f6 {_SRC}",
    [MONTHLY_SENTIMENT, "q AS (SELECT * FROM merged_sources)"],
)
add(
    "weighted_sentiment_by_count", t.monthly_sentiment, "ticker month sentiment_mean:f6 sentiment_weighted:f6",
    [MONTHLY_SENTIMENT, "q AS (SELECT * FROM monthly_sentiment)"],
)
add(
    "weighted_sentiment_equal",
    lambda s, d: sentiment.weighted_sentiment(sentiment.merge_sources(t.scored(s, d), SOURCES), "equal", SOURCES),
    "ticker month sentiment_weighted:f6",
    [MONTHLY_SENTIMENT, "q AS (SELECT ticker, month, (" + " + ".join(f"{s}_sentiment_mean" for s in SOURCES) + ") / CAST(3 AS DOUBLE) AS sentiment_weighted FROM merged_sources)"],
)
add(
    "weighted_sentiment_fixed", lambda s, d: sentiment.fixed_weight_sentiment(t.scored(s, d), {"yahoo": 0.4, "google": 0.2}),
    "ticker month sentiment_weighted:f6",
    [SCORED, """by_source AS (SELECT ticker, month, avg(sentiment_score) AS m,
        CASE source WHEN 'yahoo' THEN CAST(0.4 AS DOUBLE) WHEN 'google' THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS w FROM scored GROUP BY ticker, month, source),
      q AS (SELECT ticker, month, sum(w * m) / sum(w) AS sentiment_weighted FROM by_source GROUP BY 1, 2)"""],
)
add(
    "cross_asset_mean", lambda s, d: sentiment.cross_asset_mean(t.monthly_sentiment(s, d)), "month sentiment_weighted:f6",
    [MONTHLY_SENTIMENT, "q AS (SELECT month, avg(sentiment_weighted) AS sentiment_weighted FROM monthly_sentiment GROUP BY 1)"],
)
add(
    "coverage_by_source", lambda s, d: sentiment.coverage(t.articles(s, d), ["source"], share=True), "source n pct:f6",
    [ARTICLES, "q AS (SELECT source, count(*) AS n, count(*) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM articles) AS pct FROM articles GROUP BY 1)"],
)
add(
    "coverage_by_ticker_month_source", lambda s, d: sentiment.coverage(t.articles(s, d), ["ticker", "month", "source"]),
    "ticker month source n", [ARTICLES, "q AS (SELECT ticker, month, source, count(*) AS n FROM articles GROUP BY 1, 2, 3)"],
)
add(
    "coverage_matrix", lambda s, d: sentiment.coverage_matrix(t.articles(s, d), SOURCES), "ticker " + " ".join(SOURCES),
    [ARTICLES, "q AS (SELECT ticker, " + ", ".join(f"count(CASE WHEN source = '{s}' THEN 1 END) AS {s}" for s in SOURCES) + " FROM articles GROUP BY 1)"],
)
add(
    "label_crosstab", lambda s, d: sentiment.label_crosstab(t.scored(s, d)), "source positive negative neutral",
    [SCORED, "q AS (SELECT source, " + ", ".join(f"count(CASE WHEN sentiment_label = '{v}' THEN 1 END) AS {v}" for v in sentiment.LABELS) + " FROM scored GROUP BY 1)"],
)
add(
    "source_timeline", lambda s, d: sentiment.source_timeline(t.scored(s, d), SOURCES), "month " + " ".join(f"{s}:f6" for s in SOURCES),
    [SCORED, "q AS (SELECT month, " + ", ".join(f"avg(CASE WHEN source = '{s}' THEN sentiment_score END) AS {s}" for s in SOURCES) + " FROM scored GROUP BY 1)"],
)
add(
    "source_stats", lambda s, d: sentiment.source_stats(t.scored(s, d)), "source mean:f6 std:f6",
    [SCORED, "q AS (SELECT source, avg(sentiment_score) AS mean, stddev_samp(sentiment_score) AS std FROM scored GROUP BY 1)"],
)
add(
    "source_column_means", lambda s, d: sentiment.source_column_means(t.monthly_sentiment(s, d), SOURCES), " ".join(f"{s}:f6" for s in SOURCES),
    [MONTHLY_SENTIMENT, "q AS (SELECT " + ", ".join(f"avg({s}_sentiment_mean) AS {s}" for s in SOURCES) + " FROM monthly_sentiment)"],
)
_STATS = f"""stats AS (SELECT ticker, {_r3('avg(sentiment_weighted)')} AS sentiment_mean, {_r3('stddev_samp(sentiment_weighted)')} AS sentiment_std,
  {_r3('min(sentiment_weighted)')} AS sentiment_min, {_r3('max(sentiment_weighted)')} AS sentiment_max,
  count(sentiment_weighted) AS months_covered, sum(news_count) AS total_articles FROM monthly_sentiment GROUP BY 1)"""
add(
    "asset_stats", lambda s, d: sentiment.asset_stats(t.monthly_sentiment(s, d)),
    "ticker sentiment_mean:f3 sentiment_std:f3 sentiment_min:f3 sentiment_max:f3 months_covered total_articles:i",
    [MONTHLY_SENTIMENT, _STATS, "q AS (SELECT * FROM stats)"],
)
add(
    "extremes", lambda s, d: sentiment.extremes(sentiment.asset_stats(t.monthly_sentiment(s, d))),
    "most_positive most_negative highest_volatility most_stable",
    [MONTHLY_SENTIMENT, _STATS, """q AS (SELECT (SELECT ticker FROM stats ORDER BY sentiment_mean DESC, ticker LIMIT 1) AS most_positive,
      (SELECT ticker FROM stats ORDER BY sentiment_mean, ticker LIMIT 1) AS most_negative,
      (SELECT ticker FROM stats WHERE sentiment_std IS NOT NULL ORDER BY sentiment_std DESC, ticker LIMIT 1) AS highest_volatility,
      (SELECT ticker FROM stats WHERE sentiment_std IS NOT NULL ORDER BY sentiment_std, ticker LIMIT 1) AS most_stable)"""],
)
add(
    "asset_ranking", lambda s, d: sentiment.asset_ranking(t.monthly_sentiment(s, d), t.assets(s, d)),
    "rank:i ticker company avg_sentiment:f3 total_articles:i",
    [MONTHLY_SENTIMENT, t.ASSETS, _STATS, """q AS (SELECT row_number() OVER (ORDER BY sentiment_mean DESC, s.ticker) AS rank, s.ticker, company,
      sentiment_mean AS avg_sentiment, total_articles FROM stats s LEFT JOIN assets a ON s.ticker = a.ticker)"""],
)
add(
    "top_assets", lambda s, d: sentiment.top_assets(t.monthly_sentiment(s, d)), "ticker avg_sentiment:f6",
    [MONTHLY_SENTIMENT, "q AS (SELECT ticker, avg(sentiment_weighted) AS avg_sentiment FROM monthly_sentiment GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6)"],
)
add(
    "monthly_trend", lambda s, d: sentiment.monthly_trend(t.scored(s, d)), "month mean:f6",
    [SCORED, "q AS (SELECT month, avg(sentiment_score) AS mean FROM scored GROUP BY 1)"],
)
add(
    "asset_stability", lambda s, d: sentiment.asset_stability(t.scored(s, d)), "ticker std:f6",
    [SCORED, "q AS (SELECT ticker, stddev_samp(sentiment_score) AS std FROM scored GROUP BY 1)"],
)


def _grid(s, d):
    named = F.explode(F.array(*[F.lit(x) for x in (*SOURCES, "other")])).alias("source")
    return t.assets(s, d).select("ticker", named)


add(
    "news_quality_report", lambda s, d: sentiment.news_quality_report(t.articles(s, d), _grid(s, d)),
    "ticker source article_count first_date:d last_date:d avg_title_length:f6",
    [ARTICLES, t.ASSETS, """q AS (SELECT a.ticker, k.source, count(r.article_id) AS article_count, min(r.date) AS first_date, max(r.date) AS last_date, avg(length(r.title)) AS avg_title_length
      FROM assets a CROSS JOIN (VALUES ('google'), ('reddit'), ('yahoo'), ('other')) AS k(source)
      LEFT JOIN articles r ON r.ticker = a.ticker AND r.source = k.source GROUP BY 1, 2)"""],
)


def _flagged(s, d):
    return t.google_items(s, d).select(is_quality_source("link", t.DOMAINS).alias("is_quality_source"), extract_domain("link").alias("domain"))


add(
    "source_quality_share", lambda s, d: sentiment.source_quality_share(_flagged(s, d)), "total quality quality_pct:f6",
    [GOOGLE, """q AS (SELECT count(*) AS total, count(CASE WHEN contains(domain, 'example.com') THEN 1 END) AS quality,
      count(CASE WHEN contains(domain, 'example.com') THEN 1 END) * CAST(100 AS DOUBLE) / count(*) AS quality_pct FROM google_items)"""],
)
add(
    "top_domains", lambda s, d: sentiment.top_domains(_flagged(s, d)), "domain n",
    [GOOGLE, "q AS (SELECT domain, count(*) AS n FROM google_items GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)"],
)
add(
    "subreddit_share", lambda s, d: sentiment.subreddit_share(t.forum_posts(s, d)), "subreddit n pct:f6",
    [ARTICLES, "q AS (SELECT channel AS subreddit, count(*) AS n, count(*) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM articles) AS pct FROM articles GROUP BY 1)"],
)
add(
    "collection_totals", lambda s, d: sentiment.collection_totals(t.articles(s, d)), "scope key value:f6",
    [ARTICLES, """q AS (SELECT 'source' AS scope, source AS key, count(*) AS value FROM articles GROUP BY 2
      UNION ALL SELECT 'ticker', ticker, count(*) FROM articles GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM articles
      UNION ALL SELECT 'average', 'per_ticker', count(*) / CAST(count(DISTINCT ticker) AS DOUBLE) FROM articles)"""],
)
add(
    "overall_mean", lambda s, d: sentiment.overall_mean(t.monthly_sentiment(s, d)), "overall_mean:f6",
    [MONTHLY_SENTIMENT, "q AS (SELECT avg(sentiment_weighted) AS overall_mean FROM monthly_sentiment)"],
)
