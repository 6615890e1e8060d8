"""Row-level article operations: dates, domains, quality, quotas, terms, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import tables as t
from driver_queries.tables import ARTICLES, FORUM, GOOGLE, SCORED, WEIGHTS, finish, sql
from marketloom.functions import scalars
from marketloom.operators import articles, portfolio, sentiment

Q: dict = {}


def add(name: str, fn, spec: str, query: list[str] | str | None) -> None:
    Q[name] = (lambda spark, sf: finish(fn(spark, sf), spec), None if query is None else sql(query, spec))


# -- dates, urls, text -------------------------------------------------------


def _dates(s, d):
    fallback = F.to_timestamp(F.concat("query_month", F.lit("-01")))
    return t.google_items(s, d).select(
        "ticker", "pos", scalars.parse_date_flexible("published_date", fallback).alias("published_at")
    )


add("parse_date_flexible", _dates, "ticker pos:i published_at:t", [GOOGLE, "q AS (SELECT * FROM google_items)"])
add(
    "in_year_range",
    lambda s, d: t.load(s, d, "orders").where(scalars.in_year_range("o_orderdate", 1996, 1998)).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n")
    ),
    "o_orderstatus n",
    "q AS (SELECT o_orderstatus, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1)",
)
add(
    "in_date_range",
    lambda s, d: t.articles(s, d).where(scalars.in_date_range("date", "1996-01-01", "1997-06-30")),
    "article_id date:d",
    [ARTICLES, "q AS (SELECT * FROM articles WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30')"],
)
add(
    "extract_domain",
    lambda s, d: t.load(s, d, "pages").select("page_id", scalars.extract_domain("url").alias("domain")),
    "page_id domain",
    [GOOGLE, "q AS (SELECT pos AS page_id, domain FROM google_items)"],
)

_LONG = "length(title) + length(description) >= 50"


def _phrases(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(title), '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


_CLICK = ["ththe", *scalars.CLICKBAIT_PHRASES]
_CLICK_LENIENT = ["ththe", *scalars.CLICKBAIT_LENIENT]
_QUALITY = "contains(domain, 'example.com')"
_HEADLINE = f"trim(title || ' ' || description, {t._WS})"
STRICT = f"({_LONG} AND NOT {_phrases(_CLICK)} AND {_QUALITY})"
LENIENT = f"(length({_HEADLINE}) >= 10 AND ({_QUALITY} OR ({_LONG} AND NOT {_phrases(_CLICK_LENIENT)})))"


def _quality(mode: str, phrases: list[str]):
    def run(s, d):
        good = scalars.is_quality_article("title", "description", "link", mode, t.DOMAINS, phrases)
        return t.google_items(s, d).select("pos", good.alias("quality"))

    return run


add("is_quality_article_strict", _quality("strict", _CLICK), "pos:i quality", [GOOGLE, f"q AS (SELECT pos, {STRICT} AS quality FROM google_items)"])
add("is_quality_article_lenient", _quality("lenient", _CLICK_LENIENT), "pos:i quality", [GOOGLE, f"q AS (SELECT pos, {LENIENT} AS quality FROM google_items)"])
add(
    "headline",
    lambda s, d: t.articles(s, d).where(F.length("headline") >= 10).select(
        "article_id", F.md5("headline").alias("headline_md5"), F.length("headline").cast("bigint").alias("chars")
    ),
    "article_id headline_md5 chars",
    [ARTICLES, "q AS (SELECT article_id, md5(headline) AS headline_md5, length(headline) AS chars FROM articles WHERE length(headline) >= 10)"],
)
add(
    "forum_text",
    lambda s, d: t.forum_posts(s, d).where(scalars.is_forum_post("title", "score")).select(
        "pos", F.md5(scalars.forum_text("title", "selftext", 512)).alias("text_md5")
    ),
    "pos:i text_md5",
    [FORUM, "q AS (SELECT pos, md5(substr(title || ' ' || selftext, 1, 512)) AS text_md5 FROM forum_posts WHERE score >= 2 AND length(title) >= 10)"],
)
add(
    "truncate_text",
    lambda s, d: t.load(s, d, "documents").select("doc_id", F.md5(scalars.truncate_text("text")).alias("head_md5")),
    "doc_id head_md5",
    "q AS (SELECT doc_id, md5(substr(text, 1, 512)) AS head_md5 FROM documents)",
)

# -- keys and quotas ---------------------------------------------------------

add(
    "search_terms", lambda s, d: articles.search_terms(t.assets(s, d)), "ticker term_rank:i term",
    [t.ASSETS, """q AS (SELECT ticker, 0 AS term_rank, '"' || ticker || '"' AS term FROM assets
      UNION ALL SELECT ticker, 1, '$' || ticker FROM assets UNION ALL SELECT ticker, 2, '"' || company || '"' FROM assets)"""],
)


def _mentions(s, d):
    """Articles that name an asset: quoted, as cash-tag, or by its quoted company."""
    i = F.col("article_id")
    named = F.when(i % 3 == 0, F.concat(F.lit('"'), "ticker", F.lit('"'))).when(i % 3 == 1, F.concat(F.lit("$"), "ticker")).otherwise(
        F.concat(F.lit('"Company '), "ticker", F.lit('"'))
    )
    return t.articles(s, d).select("article_id", F.concat("headline", F.lit(" ("), named, F.lit(") "), "title").alias("text"))


_MENTIONS = """mentions AS (SELECT article_id, headline || ' (' || CASE article_id % 3 WHEN 0 THEN '"' || ticker || '"' WHEN 1 THEN '$' || ticker
      ELSE '"Company ' || ticker || '"' END || ') ' || title AS text FROM articles)"""
_SEARCH = """terms AS (SELECT ticker, 0 AS term_rank, '"' || ticker || '"' AS term FROM assets
      UNION ALL SELECT ticker, 1, '$' || ticker FROM assets UNION ALL SELECT ticker, 2, '"' || company || '"' FROM assets)"""
add(
    "match_terms",
    lambda s, d: articles.match_terms(_mentions(s, d), "text", articles.search_terms(t.assets(s, d)), ["article_id"]),
    "article_id ticker term_rank:i",
    [ARTICLES, t.ASSETS, _MENTIONS, _SEARCH, "q AS (SELECT article_id, ticker, term_rank FROM mentions JOIN terms ON contains(text, term))"],
)


def _word_terms(s, d):
    """First words of the parts' names as terms of their brand: hundreds of terms, some inside longer words."""
    word = F.lower(F.regexp_extract("p_name", "^([A-Za-z]+)", 1))
    firsts = t.load(s, d, "documents").select(F.concat(F.lit("Brand#"), (F.col("doc_id") % 25 + 1).cast("string")).alias("ticker"), F.substring(F.substring_index("text", " ", 1), 1, 5).alias("term"))
    return firsts.unionByName(t.load(s, d, "part").select(F.col("p_brand").alias("ticker"), word.alias("term"))).distinct().withColumn("term_rank", F.length("term"))


add(
    "match_terms_words",
    lambda s, d: articles.match_terms(t.load(s, d, "documents"), "text", _word_terms(s, d), ["doc_id"]).groupBy("ticker", "term_rank").agg(F.count(F.lit(1)).alias("n")),
    "ticker term_rank:i n",
    """terms AS (SELECT DISTINCT ticker, term, length(term) AS term_rank FROM (
        SELECT 'Brand#' || CAST(doc_id % 25 + 1 AS VARCHAR) AS ticker, substr(CASE WHEN strpos(text, ' ') > 0 THEN substr(text, 1, strpos(text, ' ') - 1) ELSE text END, 1, 5) AS term FROM documents
        UNION ALL SELECT p_brand, lower(regexp_extract(p_name, '^([A-Za-z]+)', 1)) FROM part) WHERE length(term) > 0),
      q AS (SELECT ticker, term_rank, count(*) AS n FROM documents JOIN terms ON contains(text, term) GROUP BY 1, 2)""",
)
add(
    "dedup_first",
    lambda s, d: articles.dedup_first(
        t.forum_posts(s, d).where(
            scalars.is_forum_post("title", "score") & scalars.in_year_range(F.timestamp_seconds("created_utc"), 1996, 2000)
        ),
        ["ticker", "id"], ["term_rank", "pos"],
    ),
    "ticker id pos:i term_rank:i",
    [FORUM, "q AS (SELECT * FROM unique_posts)"],
)
add(
    "cap_per_key",
    lambda s, d: articles.cap_per_key(t.articles(s, d), ["ticker", "source"], 3, ["published_at", "article_id"]),
    "article_id ticker source",
    [ARTICLES, """q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, source ORDER BY published_at, article_id) AS rn FROM articles) WHERE rn <= 3)"""],
)
add(
    "google_articles_strict",
    lambda s, d: articles.google_articles(t.google_items(s, d), 3, "strict", t.DOMAINS),
    "ticker date:d month domain is_quality_source",
    [GOOGLE, f"""good AS (SELECT *, row_number() OVER (PARTITION BY ticker, query_month ORDER BY pos) AS rn FROM google_items
        WHERE {STRICT.replace(_phrases(_CLICK), _phrases(scalars.CLICKBAIT_PHRASES))}),
      q AS (SELECT ticker, published_at AS date, strftime(published_at, '%Y-%m') AS month, domain, true AS is_quality_source FROM good WHERE rn <= 3)"""],
)
add(
    "google_articles_lenient",
    lambda s, d: articles.google_articles(t.google_items(s, d), 3, "lenient", t.DOMAINS),
    "ticker date:d month domain is_quality_source",
    [GOOGLE, f"""good AS (SELECT *, {_QUALITY} AS quality FROM google_items
        WHERE {LENIENT.replace(_phrases(_CLICK_LENIENT), _phrases(scalars.CLICKBAIT_LENIENT))}),
      counted AS (SELECT *, coalesce(sum(CAST(quality AS INTEGER)) OVER (PARTITION BY ticker, query_month ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM good),
      q AS (SELECT ticker, published_at AS date, strftime(published_at, '%Y-%m') AS month, domain, quality AS is_quality_source FROM counted WHERE before < 3)"""],
)
add(
    "google_candidates",
    lambda s, d: articles.google_articles(t.google_items(s, d), 3, "strict", t.DOMAINS, candidates=9),
    "ticker date:d month domain is_quality_source",
    [GOOGLE, f"""seen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, query_month ORDER BY pos) AS c FROM google_items) WHERE c <= 9),
      good AS (SELECT *, row_number() OVER (PARTITION BY ticker, query_month ORDER BY pos) AS rn FROM seen
        WHERE {STRICT.replace(_phrases(_CLICK), _phrases(scalars.CLICKBAIT_PHRASES))}),
      q AS (SELECT ticker, published_at AS date, strftime(published_at, '%Y-%m') AS month, domain, true AS is_quality_source FROM good WHERE rn <= 3)"""],
)
add(
    "forum_articles",
    lambda s, d: articles.forum_articles(t.forum_posts(s, d), 1996, 2000, per_ticker=10, assets=t.assets(s, d)),
    "ticker company date:d month id subreddit reddit_score source",
    [FORUM, t.ASSETS, """q AS (SELECT p.ticker, company, date, month, id, subreddit, score AS reddit_score, 'reddit' AS source FROM (
      SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY term_rank, pos, id) AS rn FROM unique_posts) p
      LEFT JOIN assets a ON p.ticker = a.ticker WHERE rn <= 10)"""],
)
add(
    "yahoo_articles",
    lambda s, d: articles.yahoo_articles(t.yahoo_items(s, d), 1996, 2000).withColumn("headline_md5", F.md5("headline")),
    "ticker date:d month headline_md5 source",
    [ARTICLES, """q AS (SELECT ticker, date, month, md5(headline) AS headline_md5, 'yahoo' AS source FROM articles
      WHERE year(date) BETWEEN 1996 AND 2000 AND length(headline) >= 10)"""],
)
add(
    "article_record",
    lambda s, d: articles.article_record(t.articles(s, d), "feed", extras=["article_id"], assets=t.assets(s, d)).withColumn(
        "title_md5", F.md5("title")
    ),
    "article_id ticker company date:d month title_md5 source",
    [ARTICLES, t.ASSETS, """q AS (SELECT article_id, r.ticker, company, date, month, md5(title) AS title_md5, 'feed' AS source
      FROM articles r LEFT JOIN assets a ON r.ticker = a.ticker)"""],
)


def _news_map(s, d):
    """Articles packed by document into the nested ticker -> source -> list form."""
    item = F.struct(
        "title", F.date_format("date", "yyyy-MM-dd").alias("date"), "source", F.lit(None).cast("string").alias("url"),
        F.col("channel").alias("subreddit"), F.col("article_id").alias("score"), F.lit(None).cast("double").alias("sentiment_score"),
    )
    filled = F.map_from_arrays(F.array("source", F.lit("none")), F.array(F.array(item), F.filter(F.array(item), lambda x: F.lit(False))))
    return t.articles(s, d).select(F.map_from_arrays(F.array("ticker"), F.array(filled)).alias("news"))


add(
    "explode_news", lambda s, d: articles.explode_news(_news_map(s, d)), "ticker feed pos:i date source subreddit score",
    [ARTICLES, "q AS (SELECT ticker, source AS feed, 0 AS pos, strftime(date, '%Y-%m-%d') AS date, source, channel AS subreddit, article_id AS score FROM articles)"],
)


def _union(s, d):
    return articles.union_sources([
        articles.yahoo_articles(t.yahoo_items(s, d), 1996, 2000),
        articles.google_articles(t.google_items(s, d), None, "strict", t.DOMAINS),
        articles.forum_articles(t.forum_posts(s, d), 1996, 2000, per_ticker=None),
    ]).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("summary").alias("with_summary"), F.count("domain").alias("with_domain"),
        F.count("subreddit").alias("with_subreddit"),
    )


add(
    "union_sources", _union, "source n with_summary with_domain with_subreddit",
    [FORUM, GOOGLE, f"""per_source AS (
      SELECT 'yahoo' AS source, count(*) AS n, count(*) AS with_summary, 0 AS with_domain, 0 AS with_subreddit FROM articles
        WHERE year(date) BETWEEN 1996 AND 2000 AND length(headline) >= 10
      UNION ALL SELECT 'google', count(*), count(*), count(*), 0 FROM google_items WHERE {STRICT.replace(_phrases(_CLICK), _phrases(scalars.CLICKBAIT_PHRASES))}
      UNION ALL SELECT 'reddit', count(*), 0, 0, count(*) FROM unique_posts), q AS (SELECT * FROM per_source WHERE n > 0)""".replace(" 0 AS", " CAST(0 AS BIGINT) AS")],
)

# -- snapshots ---------------------------------------------------------------


def _snapshots(s, d):
    """Events as stored answers: one snapshot per event."""
    article = F.struct(
        F.lit("x").alias("title"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("url"),
    )
    e = t.load(s, d, "events")
    return e.select(
        F.col("user_id").cast("string").alias("ticker"), F.col("event_type").alias("source"), F.lit("2024-01-01").alias("start_date"),
        F.lit("2024-01-31").alias("end_date"), F.date_trunc("second", "ts").cast("timestamp").alias("fetched_at"), "event_id",
        F.when(F.col("value") >= 5, F.array(article)).otherwise(F.filter(F.array(article), lambda a: F.lit(False))).alias("articles"),
    )


_NOW = "2024-01-30 12:00:00"
for _name, _inclusive, _op in (("fresh_snapshots", True, "<="), ("fresh_snapshots_strict", False, "<")):
    add(
        _name,
        lambda s, d, inclusive=_inclusive: articles.fresh_snapshots(
            _snapshots(s, d), F.lit(_NOW).cast("timestamp"), inclusive=inclusive
        ),
        "ticker source fetched_at:t",
        [f"""snaps AS (SELECT CAST(user_id AS VARCHAR) AS ticker, event_type AS source, date_trunc('second', ts) AS fetched_at FROM events),
          q AS (SELECT ticker, source, max(fetched_at) AS fetched_at FROM snaps
                WHERE epoch_us(TIMESTAMP '{_NOW}') - epoch_us(fetched_at) {_op} 86400000000 GROUP BY 1, 2)"""],
    )


def _requests(s, d):
    users = t.load(s, d, "events").select(F.col("user_id").cast("string").alias("ticker")).distinct()
    kinds = F.explode(F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view", "refund")])).alias("source")
    return users.select("ticker", kinds, F.lit("2024-01-01").alias("start_date"), F.lit("2024-01-31").alias("end_date"))


add(
    "missing_requests", lambda s, d: articles.missing_requests(_requests(s, d), _snapshots(s, d)), "ticker source",
    """q AS (SELECT ticker, source FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS ticker FROM events)
        CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('refund')) AS k(source)
      EXCEPT SELECT CAST(user_id AS VARCHAR), event_type FROM events WHERE value >= 5)""",
)

# -- scores ------------------------------------------------------------------

add(
    "lexicon_sentiment", t.scored, "article_id sentiment_label sentiment_confidence:f6 sentiment_score:f6",
    [SCORED, "q AS (SELECT * FROM scored)"],
)
add(
    "sentiment_score",
    lambda s, d: t.load(s, d, "events").select(
        "event_id",
        scalars.sentiment_score(
            F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative").otherwise("neutral"),
            "value",
        ).alias("score"),
    ),
    "event_id score:f6",
    "q AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN value WHEN 'error' THEN -value ELSE 0 END AS score FROM events)",
)


def _loader():
    """A stand-in text model: the sign follows the parity of the text length."""

    def model(texts: list[str]) -> list[dict]:
        return [{"label": "positive" if len(x) % 2 else "negative", "score": 0.75} for x in texts]

    return model


add(
    "model_sentiment",
    lambda s, d: sentiment.model_sentiment(
        t.articles(s, d).select("article_id", "headline"), "headline", _loader, max_chars=None, positive=t.POSITIVE, negative=t.NEGATIVE
    ),
    "article_id sentiment_label sentiment_confidence:f6 sentiment_score:f6",
    [ARTICLES, """q AS (SELECT article_id, CASE WHEN length(headline) % 2 = 1 THEN 'positive' ELSE 'negative' END AS sentiment_label,
      0.75 AS sentiment_confidence, CASE WHEN length(headline) % 2 = 1 THEN 0.75 ELSE -0.75 END AS sentiment_score FROM articles)"""],
)
add(
    "min_confidence", lambda s, d: sentiment.min_confidence(t.scored(s, d), 0.6), "article_id sentiment_confidence:f6",
    [SCORED, "q AS (SELECT * FROM scored WHERE sentiment_confidence >= CAST(0.6 AS DOUBLE))"],
)
add(
    "significance_label",
    lambda s, d: t.load(s, d, "lineitem").groupBy(scalars.significance_label(F.col("l_discount") / 8).alias("label")).agg(F.count(F.lit(1)).alias("n")),
    "label n",
    """q AS (SELECT CASE WHEN l_discount / 8 < 0.001 THEN 'highly significant' WHEN l_discount / 8 < 0.01 THEN 'very significant'
      WHEN l_discount / 8 < 0.05 THEN 'significant' ELSE '--------------' END AS label, count(*) AS n FROM lineitem GROUP BY 1)""",
)
add(
    "strength_bucket",
    lambda s, d: t.load(s, d, "lineitem").groupBy(
        scalars.strength_bucket((F.col("l_quantity") - 25) / 50).alias("bucket")
    ).agg(F.count(F.lit(1)).alias("n")),
    "bucket n",
    """q AS (SELECT CASE WHEN abs((l_quantity - 25) / 50) > CAST(0.3 AS DOUBLE) THEN 'strong' WHEN abs((l_quantity - 25) / 50) >= CAST(0.1 AS DOUBLE) THEN 'moderate' ELSE 'weak' END AS bucket,
      count(*) AS n FROM lineitem GROUP BY 1)""",
)
_RULES = [("1996-01", "1997-12", -0.3), ("1999-03", "1999-04", -0.4), ("2000-01", "2001-12", 0.2)]
add(
    "regime_adjust",
    lambda s, d: t.scored(s, d).select(
        "article_id", scalars.regime_adjust("sentiment_score", "date", _RULES, "ticker", [("Brand#1", 0.5), ("Brand#2", 1.5)]).alias("adjusted")
    ),
    "article_id adjusted:f6",
    [SCORED, """q AS (SELECT article_id, greatest(least((sentiment_score + CASE WHEN month BETWEEN '1996-01' AND '1997-12' THEN CAST(-0.3 AS DOUBLE)
        WHEN month BETWEEN '1999-03' AND '1999-04' THEN CAST(-0.4 AS DOUBLE) WHEN month BETWEEN '2000-01' AND '2001-12' THEN CAST(0.2 AS DOUBLE) ELSE 0 END)
      * CASE WHEN contains(ticker, 'Brand#1') THEN CAST(0.5 AS DOUBLE) WHEN contains(ticker, 'Brand#2') THEN CAST(1.5 AS DOUBLE) ELSE 1 END, 1), -1) AS adjusted FROM scored)"""],
)
add(
    "month_key",
    lambda s, d: t.load(s, d, "orders").select(scalars.month_key("o_orderdate").alias("month")).groupBy("month").agg(
        F.count(F.lit(1)).alias("n")
    ).withColumn("month_date", scalars.month_date("month")),
    "month month_date:d n",
    "q AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS month_date, count(*) AS n FROM orders GROUP BY 1)",
)
add(
    "normalize_weights", lambda s, d: portfolio.normalize_weights(t.month_weights(s, d)), "portfolio_id date:d ticker weight:f6",
    [WEIGHTS, "q AS (SELECT * FROM normalized)"],
)
add(
    "normalize_weights_eps", lambda s, d: portfolio.normalize_weights(t.month_weights(s, d), eps=1e-8), "portfolio_id date:d ticker weight:f9",
    [WEIGHTS, """q AS (SELECT portfolio_id, date, ticker, least(greatest(weight, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))
      / (sum(least(greatest(weight, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))) OVER (PARTITION BY portfolio_id, date) + CAST(1e-8 AS DOUBLE)) AS weight FROM weights)"""],
)
