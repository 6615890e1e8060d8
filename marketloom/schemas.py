"""Fixed schemas of the inputs. NULL means missing; NaN never enters a table."""

from __future__ import annotations

HOLDINGS = "ticker STRING, amount BIGINT"
ASSETS = "ticker STRING, company STRING, asset_order INT"
PRICES = "date DATE, ticker STRING, close DOUBLE, adj_close DOUBLE"

YAHOO_ITEMS = (
    "ticker STRING, providerPublishTime STRING, "
    "content STRUCT<title: STRING, summary: STRING, pubDate: STRING>"
)
GOOGLE_ITEMS = (
    "ticker STRING, query_month STRING, pos INT, title STRING, description STRING, "
    "link STRING, published_date STRING"
)
FORUM_POSTS = (
    "ticker STRING, term_rank INT, pos INT, id STRING, created_utc DOUBLE, score BIGINT, "
    "title STRING, selftext STRING, subreddit STRING, num_comments BIGINT"
)
SNAPSHOT_ARTICLE = "title STRING, date STRING, source STRING, url STRING"
SNAPSHOTS = (
    "ticker STRING, source STRING, start_date STRING, end_date STRING, fetched_at TIMESTAMP, "
    "articles ARRAY<STRUCT<title: STRING, date: STRING, source: STRING, url: STRING>>"
)
COLLECTED_NEWS = (
    "news MAP<STRING, MAP<STRING, ARRAY<STRUCT<title: STRING, date: STRING, source: STRING, "
    "url: STRING, subreddit: STRING, score: BIGINT, sentiment_score: DOUBLE>>>>"
)
STREAM_ARTICLES = (
    "article_id STRING, ticker STRING, published STRING, title STRING, summary STRING, "
    "source STRING, sentiment_score DOUBLE"
)

# The news sources in reporting order.
SOURCES = ["google", "reddit", "yahoo"]
