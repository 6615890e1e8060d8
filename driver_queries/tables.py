"""How the driver's tables stand in for prices, news, weights and runs, in
Spark and in SQL, and how results are finished for the comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.scalars import WHITESPACE, headline, month_key, rounding
from marketloom.operators import reshape
from marketloom.operators.sentiment import merge_sources, weighted_sentiment, with_lexicon
from marketloom.operators.validation import join_sentiment_returns, monthly_returns
from marketloom.plans.jobs import monthly_prices

# Words that occur in the driver's invented prose.
POSITIVE = ["that", "with"]
NEGATIVE = ["this", "from"]
DOMAINS = ["example.com"]
SOURCES = ["google", "reddit", "yahoo"]
TICKERS = [f"Brand#{i}" for i in range(1, 26)]
PORTFOLIOS = ["alpha", "beta", "gamma"]
AGENTS = ["PPO_data", "SAC_data", "PPO_nlp", "SAC_nlp"]


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- finishing ---------------------------------------------------------------
# A spec lists the result columns: "name" as it is, "name:f6" a double rounded
# to 6 digits, "name:d" a date or timestamp as text, "name:i" a BIGINT.
# The small offset keeps exact decimal ties away from the rounding boundary.


def _fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(p.split(":")) if ":" in p else (p, "") for p in spec.split()]


def finish(df: DataFrame, spec: str) -> DataFrame:
    def field(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind.startswith("f"):
            scale = float(10 ** int(kind[1:] or 6))
            c = F.rint(c.cast("double") * scale + 0.001) / F.lit(scale) + F.lit(0.0)
        elif kind == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "i":
            c = c.cast("bigint")
        return c.alias(name)

    return df.select(*[field(n, k) for n, k in _fields(spec)])


def sql(ctes: list[str] | str, spec: str, table: str = "q") -> str:
    def field(name: str, kind: str) -> str:
        if kind.startswith("f"):
            scale = f"1e{int(kind[1:] or 6)}"
            return f"round_even(CAST({name} AS DOUBLE) * {scale} + CAST(0.001 AS DOUBLE), 0) / {scale} + CAST(0 AS DOUBLE) AS {name}"
        if kind == "d":
            return f"strftime({name}, '%Y-%m-%d') AS {name}"
        if kind == "t":
            return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"
        if kind == "i":
            return f"CAST({name} AS BIGINT) AS {name}"
        return name

    ctes = [ctes] if isinstance(ctes, str) else list(ctes)
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT {', '.join(field(n, k) for n, k in _fields(spec))} FROM {table}"


# -- prices ------------------------------------------------------------------


def assets(spark: SparkSession, sf: str) -> DataFrame:
    brands = load(spark, sf, "part").select(F.col("p_brand").alias("ticker")).distinct()
    order = F.regexp_extract("ticker", "([0-9]+)$", 1).cast("int") - 1
    return brands.select("ticker", F.concat(F.lit("Company "), "ticker").alias("company"), order.alias("asset_order"))


ASSETS = """assets AS (
  SELECT DISTINCT p_brand AS ticker, 'Company ' || p_brand AS company,
         CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) - 1 AS asset_order FROM part)"""


def prices(spark: SparkSession, sf: str, adjusted: bool = False) -> DataFrame:
    """Highest unit price per (brand, day): one row per (ticker, date)."""
    line, part = load(spark, sf, "lineitem"), load(spark, sf, "part")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    joined = line.join(part, line["l_partkey"] == part["p_partkey"])
    aggs = [F.max(unit).alias("close")]
    if adjusted:
        even = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int") % 2 == 0
        returned = (F.col("l_returnflag") == "R") & even
        aggs.append(F.max(F.when(returned, unit * (F.lit(1.0) - F.col("l_discount")))).alias("adj_close"))
    out = joined.groupBy(F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(*aggs)
    names = ["close", "adj_close"] if adjusted else ["close"]
    return out.select("ticker", "date", *[rounding(c, 2).alias(c) for c in names])


PRICES = """prices AS (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date,
         round_even(max(l_extendedprice / l_quantity) * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE) AS close,
         round_even(max(CASE WHEN l_returnflag = 'R' AND CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) % 2 = 0
           THEN l_extendedprice / l_quantity * (CAST(1 AS DOUBLE) - l_discount) END) * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE) AS adj_close
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

DENSE = f"""{PRICES}, grid AS (
  SELECT t.ticker, c.date FROM (SELECT DISTINCT ticker FROM prices) t
  CROSS JOIN (SELECT DISTINCT date FROM prices WHERE close IS NOT NULL) c),
dense AS (SELECT ticker, date, close FROM grid LEFT JOIN prices USING (ticker, date))"""

FILLED = f"""{DENSE}, filled AS (
  SELECT ticker, date, coalesce(
    last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  ) AS close FROM dense)"""

DAILY = f"""{DENSE}, daily AS (
  SELECT ticker, date, close, coalesce(ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)), 0) AS log_return
  FROM dense)"""

MONTHLY = f"""{FILLED}, monthly AS (
  SELECT ticker, last_day(date) AS month_end,
         round_even(max_by(close, date) * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE) AS price FROM filled GROUP BY 1, 2)"""

RETURNS = f"""{MONTHLY}, returns AS (
  SELECT ticker, month_end, price, round_even(lr * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE) AS log_return FROM (
    SELECT *, ln(price / lag(price) OVER (PARTITION BY ticker ORDER BY month_end)) AS lr FROM monthly) WHERE lr IS NOT NULL)"""


def dense(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.densify(prices(spark, sf), ["close"])


def filled(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.fill_forward_back(dense(spark, sf), "close")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.log_return(dense(spark, sf), fill=0.0)


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    return monthly_prices(prices(spark, sf))


def returns(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.monthly_log_return(monthly(spark, sf))


def ordered_returns(spark: SparkSession, sf: str) -> DataFrame:
    return returns(spark, sf).join(assets(spark, sf).select("ticker", "asset_order"), "ticker")


# -- articles ----------------------------------------------------------------


def _first_line(c: Column) -> Column:
    return F.split(c, "\n", 2)[0]


def _rest(c: Column) -> Column:
    return F.coalesce(F.get(F.split(c, "\n", 2), F.lit(1)), F.lit(""))


def _stamp(c: Column) -> Column:
    """Publication second of a document: a few documents per asset and month."""
    offset = (F.floor(c / 100) * 331 + c % 20) % 2490
    day = F.date_add(F.lit("1995-01-02").cast("date"), offset.cast("int"))
    return F.unix_timestamp(day.cast("timestamp")) + c % 86400


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as articles: title = first line, headline = the whole text."""
    doc = load(spark, sf, "documents")
    text, i = F.col("text"), F.col("doc_id")
    rows = doc.select(
        F.col("doc_id").alias("article_id"),
        F.concat(F.lit("Brand#"), (i % 25 + 1).cast("string")).alias("ticker"),
        F.timestamp_seconds(_stamp(i)).alias("published_at"),
        _first_line(text).alias("title"),
        _rest(text).alias("summary"),
        F.element_at(F.array(F.lit("yahoo"), F.lit("google"), F.lit("reddit")), (F.floor(i / 2) % 3 + 1).cast("int")).alias("source"),
        F.col("source").alias("channel"),
    )
    return rows.select(
        "article_id", "ticker", F.to_date("published_at").alias("date"), month_key("published_at").alias("month"),
        "published_at", "title", "summary", headline("title", "summary").alias("headline"), "source", "channel",
    )


_WS = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)

ARTICLES = f"""articles AS (
  SELECT doc_id AS article_id, 'Brand#' || CAST(doc_id % 25 + 1 AS VARCHAR) AS ticker, CAST(published_at AS DATE) AS date,
         strftime(published_at, '%Y-%m') AS month, published_at, title, summary,
         trim(title || ' ' || summary, {_WS}) AS headline,
         CASE doc_id // 2 % 3 WHEN 0 THEN 'yahoo' WHEN 1 THEN 'google' ELSE 'reddit' END AS source, source AS channel
  FROM (SELECT doc_id, source,
          TIMESTAMP '1995-01-02 00:00:00' + to_days(CAST((doc_id // 100 * 331 + doc_id % 20) % 2490 AS INTEGER)) + to_seconds(CAST(doc_id % 86400 AS BIGINT)) AS published_at,
          CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS title,
          CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS summary
        FROM documents))"""


def word_count_sql(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({text}), '{w}') AS INTEGER)" for w in words) + ")"


SCORED = f"""{ARTICLES}, hits AS (
  SELECT *, {word_count_sql('headline', POSITIVE)} AS p, {word_count_sql('headline', NEGATIVE)} AS n FROM articles),
labelled AS (
  SELECT *, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment_label,
         CASE WHEN p <> n THEN least(CAST(0.9 AS DOUBLE), CAST(0.5 AS DOUBLE) + greatest(p, n) * CAST(0.1 AS DOUBLE)) ELSE CAST(0.5 AS DOUBLE) END AS sentiment_confidence
  FROM hits),
scored AS (
  SELECT *, CASE sentiment_label WHEN 'positive' THEN sentiment_confidence WHEN 'negative' THEN -sentiment_confidence ELSE CAST(0 AS DOUBLE) END AS sentiment_score
  FROM labelled)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return with_lexicon(articles(spark, sf), "headline", POSITIVE, NEGATIVE)


_PER_SOURCE = ", ".join(
    f"coalesce(avg(CASE WHEN source = '{s}' THEN sentiment_score END), 0) AS {s}_sentiment_mean, "
    f"count(CASE WHEN source = '{s}' THEN 1 END) AS {s}_news_count"
    for s in SOURCES
)
_WEIGHTED = (
    "("
    + " + ".join(f"{s}_sentiment_mean * {s}_news_count" for s in SOURCES)
    + ") / ("
    + " + ".join(f"{s}_news_count" for s in SOURCES)
    + ")"
)

MONTHLY_SENTIMENT = f"""{SCORED}, merged_sources AS (
  SELECT ticker, month, avg(sentiment_score) AS sentiment_mean, coalesce(stddev_samp(sentiment_score), 0) AS sentiment_std,
         count(*) AS news_count, avg(sentiment_confidence) AS confidence_mean, {_PER_SOURCE}
  FROM scored GROUP BY 1, 2),
monthly_sentiment AS (SELECT *, {_WEIGHTED} AS sentiment_weighted FROM merged_sources)"""


def monthly_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return weighted_sentiment(merge_sources(scored(spark, sf), SOURCES), "count", SOURCES)


MONTH_RETURNS = """month_returns AS (
  SELECT ticker, strftime(date, '%Y-%m') AS month, sum(log_return) AS monthly_return FROM daily
  WHERE log_return IS NOT NULL GROUP BY 1, 2)"""

MERGED = f"""{DAILY}, {MONTH_RETURNS}, {MONTHLY_SENTIMENT}, merged AS (
  SELECT s.*, r.monthly_return, lead(r.monthly_return) OVER (PARTITION BY s.ticker ORDER BY s.month) AS next_return
  FROM monthly_sentiment s JOIN month_returns r ON s.ticker = r.ticker AND s.month = r.month)"""


def month_returns(spark: SparkSession, sf: str) -> DataFrame:
    return monthly_returns(daily(spark, sf))


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return join_sentiment_returns(monthly_sentiment(spark, sf), month_returns(spark, sf))


def corr_sql(x: str, y: str) -> str:
    return f"CASE WHEN isfinite(corr({x}, {y})) THEN greatest(least(corr({x}, {y}), CAST(1 AS DOUBLE)), CAST(-1 AS DOUBLE)) END"


def p_value_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation: the closed finite series of the t
    distribution with integer degrees of freedom n - 2."""
    cos, sin, nu = f"sqrt(1 - {r} * {r})", f"abs({r})", f"({n} - 2)"
    even = (
        f"{sin} * list_sum(list_transform(range(0, CAST({nu} // 2 AS BIGINT)), "
        f"lambda k: exp(lgamma(k + CAST(0.5 AS DOUBLE)) - lgamma(CAST(k + 1 AS DOUBLE))) / sqrt(pi()) * pow({cos}, 2 * k)))"
    )
    odd = (
        f"2 / pi() * (asin({sin}) + {sin} * coalesce(list_sum(list_transform(range(0, CAST(({nu} - 1) // 2 AS BIGINT)), "
        f"lambda k: exp(lgamma(CAST(k + 1 AS DOUBLE)) - lgamma(k + CAST(1.5 AS DOUBLE))) * sqrt(pi()) / 2 * pow({cos}, 2 * k + 1))), 0))"
    )
    return f"CASE WHEN {r} IS NOT NULL THEN 1 - (CASE WHEN {nu} % 2 = 0 THEN {even} ELSE {odd} END) END"


# -- raw items ---------------------------------------------------------------


def google_items(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as search results of two query months, dates in three spellings."""
    i = F.col("page_id")
    published = (
        F.when(i % 3 == 0, (_stamp(i)).cast("string"))
        .when(i % 3 == 1, F.date_format(F.timestamp_seconds(_stamp(i)), "yyyy-MM-dd HH:mm:ss"))
        .otherwise("n/a")
    )
    return load(spark, sf, "pages").select(
        F.concat(F.lit("Brand#"), (i % 5 + 1).cast("string")).alias("ticker"),
        F.when(i % 2 == 0, "1995-01").otherwise("1995-02").alias("query_month"),
        i.cast("int").alias("pos"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.col("html").alias("description"),
        F.col("url").alias("link"),
        published.alias("published_date"),
    )


_DOC_STAMP = (
    "TIMESTAMP '1995-01-02 00:00:00' + to_days(CAST(({i} // 100 * 331 + {i} % 20) % 2490 AS INTEGER)) + to_seconds(CAST({i} % 86400 AS BIGINT))"
)

GOOGLE = f"""google_items AS (
  SELECT 'Brand#' || CAST(page_id % 5 + 1 AS VARCHAR) AS ticker,
         CASE WHEN page_id % 2 = 0 THEN '1995-01' ELSE '1995-02' END AS query_month, page_id AS pos,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html AS description, url AS link,
         CASE WHEN page_id % 3 = 2 THEN CASE WHEN page_id % 2 = 0 THEN TIMESTAMP '1995-01-01' ELSE TIMESTAMP '1995-02-01' END
              ELSE {_DOC_STAMP.format(i='page_id')} END AS published_at,
         lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS domain
  FROM pages)"""


def forum_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as forum posts; ids repeat under several search terms."""
    i = F.col("doc_id")
    return load(spark, sf, "documents").select(
        F.concat(F.lit("Brand#"), (i % 25 + 1).cast("string")).alias("ticker"),
        (i % 3).cast("int").alias("term_rank"),
        i.cast("int").alias("pos"),
        F.concat(F.lit("post"), F.floor(i / 50).cast("string")).alias("id"),
        _stamp(i).cast("double").alias("created_utc"),
        (i % 7).alias("score"),
        _first_line(F.col("text")).alias("title"),
        _rest(F.col("text")).alias("selftext"),
        F.col("source").alias("subreddit"),
        (i % 11).alias("num_comments"),
    )


FORUM = f"""{ARTICLES}, forum_posts AS (
  SELECT ticker, article_id % 3 AS term_rank, article_id AS pos, 'post' || CAST(article_id // 50 AS VARCHAR) AS id,
         date, month, article_id % 7 AS score, title, summary AS selftext, channel AS subreddit FROM articles),
good_posts AS (SELECT *, title || ' ' || selftext AS headline FROM forum_posts
               WHERE score >= 2 AND length(title) >= 10 AND year(date) BETWEEN 1996 AND 2000),
unique_posts AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, id ORDER BY term_rank, pos) AS copy FROM good_posts) WHERE copy = 1)"""


def yahoo_items(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as feed items: epoch digits, or a nested feed date."""
    i, text = F.col("doc_id"), F.col("text")
    stamp = _stamp(i)
    feed = F.date_format(F.timestamp_seconds(stamp), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return load(spark, sf, "documents").select(
        F.concat(F.lit("Brand#"), (i % 25 + 1).cast("string")).alias("ticker"),
        F.when(i % 2 == 0, stamp.cast("string")).alias("providerPublishTime"),
        F.struct(
            _first_line(text).alias("title"), _rest(text).alias("summary"), F.when(i % 2 == 1, feed).alias("pubDate")
        ).alias("content"),
    )


# -- portfolios --------------------------------------------------------------


def month_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Three portfolios with raw weights between -1/8 and 9/8 per month."""
    base = returns(spark, sf).join(assets(spark, sf), "ticker")
    month_no = F.year("month_end") * 12 + F.month("month_end")
    listed = F.array(*[F.struct(F.lit(p).alias("portfolio_id"), F.lit(k).alias("k")) for k, p in enumerate(PORTFOLIOS)])
    return base.select(
        "ticker", F.col("month_end").alias("date"), "asset_order", F.explode(listed).alias("p"), month_no.alias("m")
    ).select(
        "p.portfolio_id", "date", "ticker",
        (((F.col("asset_order") * 7 + F.col("m") * 3 + F.col("p.k") * 5) % 11 - 1) / 8.0).alias("weight"),
    )


def month_prices(spark: SparkSession, sf: str) -> DataFrame:
    return monthly(spark, sf).select("ticker", F.col("month_end").alias("date"), "price")


_WEIGHTS_VALUES = ", ".join(f"('{p}', {k})" for k, p in enumerate(PORTFOLIOS))

PORT_RETURNS = """periods AS (
  SELECT portfolio_id, date, lead(date) OVER (PARTITION BY portfolio_id ORDER BY date) AS next_date
  FROM (SELECT DISTINCT portfolio_id, date FROM normalized)),
port_returns AS (
  SELECT n.portfolio_id, n.date, p.next_date, exp(sum(weight * coalesce(ln(c.price / o.price), 0))) - 1 AS ret
  FROM normalized n JOIN periods p ON n.portfolio_id = p.portfolio_id AND n.date = p.date AND p.next_date IS NOT NULL
  LEFT JOIN monthly o ON o.ticker = n.ticker AND o.month_end = n.date
  LEFT JOIN monthly c ON c.ticker = n.ticker AND c.month_end = p.next_date
  GROUP BY 1, 2, 3 HAVING count(o.ticker) > 0 AND count(c.ticker) > 0)"""

WEIGHTS = f"""{RETURNS}, {ASSETS}, weights AS (
  SELECT portfolio_id, month_end AS date, r.ticker,
         ((asset_order * 7 + (year(month_end) * 12 + month(month_end)) * 3 + k * 5) % 11 - 1) / CAST(8 AS DOUBLE) AS weight
  FROM returns r JOIN assets a ON r.ticker = a.ticker CROSS JOIN (VALUES {_WEIGHTS_VALUES}) AS p(portfolio_id, k)),
normalized AS (
  SELECT portfolio_id, date, ticker, least(greatest(weight, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))
         / sum(least(greatest(weight, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))) OVER (PARTITION BY portfolio_id, date) AS weight
  FROM weights),
forward AS (
  SELECT * FROM (
    SELECT ticker, month_end AS date, lead(month_end) OVER (PARTITION BY ticker ORDER BY month_end) AS next_date,
           coalesce(ln(lead(price) OVER (PARTITION BY ticker ORDER BY month_end) / price), 0) AS log_return FROM monthly)
  WHERE next_date IS NOT NULL),
{PORT_RETURNS},
steps AS (
  SELECT portfolio_id, next_date AS date, ret FROM port_returns
  UNION ALL SELECT portfolio_id, min(date), CAST(NULL AS DOUBLE) FROM port_returns GROUP BY 1),
curve AS (
  SELECT portfolio_id, date, ret, product(1 + coalesce(ret, 0)) OVER (
    PARTITION BY portfolio_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100000 AS value FROM steps),
under AS (
  SELECT *, value / max(value) OVER (PARTITION BY portfolio_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown
  FROM curve)"""
