"""From raw news and forum records to one filtered article table.

The raw side is the large one, so everything up to the first aggregate is a
map-only projection or filter, and the two operations that need a key (first
occurrence, quota per key) reduce each key inside the map tasks first: a
ticker or a post id that owns a third of all rows never reaches one task whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import (
    QUALITY_DOMAINS,
    extract_domain,
    forum_text,
    headline,
    in_year_range,
    is_forum_post,
    is_quality_article,
    is_quality_source,
    month_key,
    parse_date_flexible,
)
from marketloom.functions.terms import held_terms

RECORD = ["ticker", "date", "month", "headline", "title", "source"]


def article_record(
    df: DataFrame, source: str, stamp: str = "published_at", extras: Sequence[str] = (), assets: DataFrame | None = None
) -> DataFrame:
    """The common columns of an article plus the source's own extras; date and
    month both come from the one timestamp column."""
    out = df.select(
        "ticker",
        F.to_date(stamp).alias("date"),
        month_key(stamp).alias("month"),
        "headline",
        "title",
        F.lit(source).alias("source"),
        *extras,
    )
    if assets is None:
        return out
    named = out.join(assets.select("ticker", "company"), "ticker", "left")
    return named.select("ticker", "company", "date", "month", "headline", "title", "source", *extras)


def yahoo_articles(
    items: DataFrame, first_year: int, last_year: int | None = None, assets: DataFrame | None = None
) -> DataFrame:
    """Feed items: publish time or else the nested date, year range, headline
    of at least ten characters."""
    stamp = F.coalesce("providerPublishTime", F.lit(""))
    raw = F.when(stamp.isin("", "0"), F.col("content.pubDate")).otherwise(stamp)
    title, summary = F.coalesce("content.title", F.lit("")), F.coalesce("content.summary", F.lit(""))
    parsed = items.select(
        "ticker",
        parse_date_flexible(raw).alias("published_at"),
        title.alias("title"),
        summary.alias("summary"),
        headline("content.title", "content.summary").alias("headline"),
    )
    kept = parsed.where(in_year_range("published_at", first_year, last_year) & (F.length("headline") >= 10))
    return article_record(kept, "yahoo", extras=["summary"], assets=assets)


def google_articles(
    items: DataFrame,
    per_month: int | None = None,
    mode: str = "strict",
    domains: Sequence[str] = QUALITY_DOMAINS,
    assets: DataFrame | None = None,
    candidates: int | None = None,
) -> DataFrame:
    """Search results per (ticker, query month), quality filter and monthly quota.

    ``pos`` is the position in the search result. The date falls back to the
    first day of the query month. With a quota ``per_month``, strict mode keeps the
    first accepted articles, and none of a query month whose calendar month earlier
    ones have filled already; lenient mode keeps everything up to the article that
    fills the quota of quality sources. ``candidates`` is the length of the
    search result considered at all (three times the quota at the source).
    """
    stamped = items.select(
        "ticker",
        "query_month",
        "pos",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("description", F.lit("")).alias("summary"),
        F.coalesce("link", F.lit("")).alias("link"),
        parse_date_flexible("published_date", F.to_timestamp(F.concat("query_month", F.lit("-01")))).alias("published_at"),
    )
    keys = ["ticker", "query_month"]
    if candidates is not None:
        stamped = cap_per_key(stamped, keys, candidates, ["pos"])
    accepted = stamped.where(
        is_quality_article("title", "summary", "link", mode=mode, domains=domains) & F.col("published_at").isNotNull()
    ).select(
        *keys,
        "pos",
        "title",
        "summary",
        "published_at",
        headline("title", "summary").alias("headline"),
        is_quality_source("link", domains).alias("is_quality_source"),
        extract_domain("link").alias("domain"),
    )
    if per_month is not None:
        if mode == "strict":
            accepted = cap_per_key(accepted, keys, per_month, ["pos"])
            accepted = skip_full_months(accepted.withColumn("month", month_key("published_at")), per_month).drop("month")
        else:
            accepted = until_quota(accepted, keys, "is_quality_source", per_month, "pos")
    return article_record(accepted, "google", extras=["summary", "is_quality_source", "domain"], assets=assets)


def skip_full_months(articles: DataFrame, n: int) -> DataFrame:
    """Drop the articles of a query month whose calendar month already holds
    ``n`` articles found under earlier query months of the same ticker.

    Needs ``query_month`` and ``month``. Whether a month is skipped depends on
    which earlier ones were, so the decision is sequential per ticker; it is
    taken on counts per (query month, month), at most a few per calendar month.
    """
    counts = articles.groupBy("ticker", "query_month", "month").agg(F.count(F.lit(1)).alias("n"))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, int] = {}
        skipped = []
        for query_month, rows in pdf.sort_values("query_month").groupby("query_month"):
            if held.get(query_month, 0) >= n:
                skipped.append(query_month)
                continue
            for month, found in zip(rows["month"], rows["n"]):
                held[month] = held.get(month, 0) + int(found)
        return pd.DataFrame({"ticker": pdf["ticker"].iat[0], "query_month": pd.Series(skipped, dtype=object)})

    full = counts.groupBy("ticker").applyInPandas(decide, "ticker string, query_month string")
    return articles.join(full, ["ticker", "query_month"], "left_anti").select(*articles.columns)


def forum_articles(
    posts: DataFrame,
    first_year: int,
    last_year: int | None = None,
    per_ticker: int | None = None,
    assets: DataFrame | None = None,
) -> DataFrame:
    """Forum posts: score and title filter, first hit per (ticker, id) in search
    term order, quota per ticker."""
    stamped = posts.withColumn("published_at", F.timestamp_seconds("created_utc"))
    good = stamped.where(in_year_range("published_at", first_year, last_year) & is_forum_post("title", "score")).select(
        "ticker", "term_rank", "pos", "id", "published_at", "title",
        forum_text("title", "selftext").alias("headline"), "subreddit", F.col("score").alias("reddit_score"),
    )
    unique = dedup_first(good, ["ticker", "id"], ["term_rank", "pos"])
    if per_ticker is not None:
        unique = cap_per_key(unique, ["ticker"], per_ticker, ["term_rank", "pos", "id"])
    return article_record(unique, "reddit", extras=["id", "subreddit", "reddit_score"], assets=assets)


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order.

    ``row_number() = 1`` is planned with a limit per key inside each map task,
    so at most one row per key and task crosses the shuffle, however many
    copies a key has.
    """
    return cap_per_key(df, keys, 1, order)


def cap_per_key(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str], salts: int | None = None) -> DataFrame:
    """First ``n`` rows per key in the given order.

    Two steps: first within (key, salt), which spreads a hot key over many
    tasks, then within the key on at most n x salts rows. Spark limits each
    step once more inside the map tasks for n up to its group-limit threshold.
    The salt hashes the whole row, since few values may stand in ``order``, and
    there are as many as shuffle partitions, so they grow with the cluster.
    """
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    atoms = [f"`{n}`" for n, kind in df.dtypes if "map<" not in kind and kind not in ("variant", "void")]
    salt = F.pmod(F.xxhash64(*atoms), F.lit(salts))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    spread = df.withColumn("_salt", salt)
    if n > 1:
        spread = spread.withColumn("_local", F.row_number().over(local)).where(F.col("_local") <= n)
    ranked = spread.withColumn("_rank", F.row_number().over(whole)).where(F.col("_rank") <= n)
    return ranked.select(*df.columns)


def until_quota(df: DataFrame, keys: Sequence[str], flag: str, n: int, order: str) -> DataFrame:
    """Rows up to and including the n-th flagged row of each key.

    Only the flagged rows are ranked (capped inside the map tasks); their n-th
    position is joined back as a cut-off. Keys with fewer flagged rows stay
    whole. ``order`` must be unique within a key.
    """
    flagged = cap_per_key(df.where(F.col(flag)).select(*keys, order), keys, n, [order])
    cut = flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(order).alias("_cut")).where(F.col("_n") == n)
    joined = df.join(cut.select(*keys, "_cut"), list(keys), "left")
    return joined.where(F.col("_cut").isNull() | (F.col(order) <= F.col("_cut"))).select(*df.columns)


def search_terms(assets: DataFrame) -> DataFrame:
    """Quoted ticker, cash-tag and quoted company per asset, ranked 0, 1, 2."""
    quote = F.lit('"')
    terms = F.array(
        F.concat(quote, "ticker", quote), F.concat(F.lit("$"), "ticker"), F.concat(quote, "company", quote)
    )
    return assets.select("ticker", F.posexplode(terms).alias("term_rank", "term"))


#: Letters and digits make a token; the longest key cut out of a term that has no
#: token of its own.
TOKEN, GRAM = r"[\p{L}\p{N}]", 4


def _term_keys(terms: DataFrame) -> DataFrame:
    """``terms`` with ``_kind`` and ``_key``: something that every text with the term
    must hold. Best the longest token that the term itself bounds on both sides,
    for it is then a token of the text, too; else the first characters of the term,
    told apart by whether they start inside a token."""
    bounded = F.regexp_extract_all("term", F.lit(f"(?<=[^{TOKEN[1:-1]}])({TOKEN}+)(?=[^{TOKEN[1:-1]}])"), 1)
    longest = F.array_max(F.transform(bounded, lambda x: F.struct(F.length(x).alias("n"), x.alias("token"))))["token"]
    gram = F.substring("term", 1, GRAM)
    led = F.when(F.col("term").rlike(f"^{TOKEN}"), "w").otherwise("s")
    kind = F.when(longest.isNotNull(), "t").otherwise(F.concat(led, F.length(gram).cast("string")))
    return terms.where(F.length("term") > 0).withColumn("_kind", kind).withColumn("_key", F.coalesce(longest, gram))


def _labelled(label: Column):
    return lambda x: F.struct(label, x.alias("_key"))


def _text_keys(text: str, kinds: Sequence[str]) -> Column:
    """The distinct (kind, key) of a text, of the kinds that occur in the terms; in
    one pass over the text for each of them."""
    parts = []
    for kind in kinds:
        if kind == "t":
            pattern = f"({TOKEN}+)"
        else:
            first = TOKEN if kind[0] == "w" else f"[^{TOKEN[1:-1]}]"
            pattern = f"(?s)(?=({first}.{{{int(kind[1:]) - 1}}}))"
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))
        parts.append(F.transform(found, _labelled(F.lit(kind).alias("_kind"))))
    return F.concat(*parts)


#: Bytes of distinct terms up to which they go to every task instead of being met in a shuffle.
SMALL_TERMS = 1 << 24


def match_terms(df: DataFrame, text: str, terms: DataFrame, keep: Sequence[str], small: int = SMALL_TERMS) -> DataFrame:
    """Rows whose text contains a search term, once per (ticker, term_rank, term).

    ``terms`` is a table (ticker, term, term_rank) of any size, such as
    ``search_terms`` makes. Whose a term is is added after a match, so a term of many
    tickers is looked for once a text. Distinct terms of up to ``small`` bytes are read and
    go to every task, which reads each text once for all of them (``held_terms``); nothing of
    the texts is shuffled, and the tickers are broadcast up to four times that size.
    Larger tables are indexed by one key per term, and the distinct
    keys of each text meet it in an equi-join, verified by ``contains``. There
    the texts themselves don't take part in the join: what meets is known by the text's
    hash, joined to the rows by it, so two texts of one hash do no harm. Only
    the kinds of keys that the terms have (at most nine) are read before. NULL
    and empty terms and NULL texts match nothing; a term listed twice counts once.
    """
    listed = terms.select("ticker", "term", "term_rank").distinct()
    bytes_ = F.octet_length("term") + F.lit(32)
    owner = bytes_ + F.coalesce(F.octet_length(F.col("ticker").cast("string")), F.lit(0))
    named = listed.where(F.length("term") > 0)
    by_term = named.groupBy("term")
    [size] = by_term.agg(F.sum(owner).alias("owners")).agg(F.sum(bytes_).alias("terms"), F.sum("owners").alias("owners")).collect()
    if size["terms"] is None:
        empty = [F.lit(None).cast(terms.schema[c].dataType).alias(c) for c in ("ticker", "term_rank")]
        return df.select(*keep, *empty).where(F.lit(False))
    rows = df.select(*keep, F.col(text).alias("_text")).where("_text IS NOT NULL")
    raw = F.col("term").cast("string").cast("binary").alias("_term")
    if size["terms"] <= small:
        found = [bytes(r["_term"]) for r in named.select(raw).distinct().collect()]
        owned = by_term.agg(F.collect_list(F.struct("ticker", "term_rank")).alias("_owners")).select(raw, "_owners")
        # outer, since a filter on empty arrays would find the terms a second time; the join drops the NULLs
        met = rows.select(*keep, held_terms("_text", found).alias("_terms")).select(*keep, F.explode_outer("_terms").alias("_term"))
        return met.join(F.broadcast(owned) if size["owners"] <= 4 * small else owned, "_term").select(*keep, F.inline("_owners"))
    index = _term_keys(listed)
    kinds = sorted(r["_kind"] for r in index.select("_kind").distinct().collect())
    keyed = rows.select(F.xxhash64("_text").alias("_hash"), F.inline(_text_keys("_text", kinds)))
    met = keyed.join(index.select("_kind", "_key", "term").distinct(), ["_kind", "_key"]).select("_hash", "term").distinct()
    held = rows.withColumn("_hash", F.xxhash64("_text")).join(met, "_hash").where(F.expr("contains(_text, term)")).select(*keep, "term")
    return held.join(listed, "term").select(*keep, "ticker", "term_rank")


def explode_news(df: DataFrame, news: str = "news") -> DataFrame:
    """ticker -> source -> articles maps to flat rows; empty lists vanish."""
    by_ticker = df.select(F.explode(news).alias("ticker", "_sources"))
    by_source = by_ticker.select("ticker", F.explode("_sources").alias("source_key", "_articles"))
    flat = by_source.select("ticker", "source_key", F.posexplode("_articles").alias("pos", "_a"))
    return flat.select("ticker", F.col("source_key").alias("feed"), "pos", "_a.*")


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a source lacks are NULL. No deduplication."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


SNAPSHOT_KEYS = ["ticker", "source", "start_date", "end_date"]


def fresh_snapshots(
    snapshots: DataFrame, now: Column, max_age: int = 86_400, inclusive: bool = True, keys: Sequence[str] = SNAPSHOT_KEYS
) -> DataFrame:
    """Latest snapshot per request, if it is not older than ``max_age`` seconds.

    ``inclusive`` decides whether an age of exactly ``max_age`` still counts.
    """
    age = F.unix_micros(now) - F.unix_micros("fetched_at")
    limit = F.lit(max_age * 1_000_000)
    young = snapshots.where((age <= limit) if inclusive else (age < limit))
    return cap_per_key(young.withColumn("_age", -F.unix_micros("fetched_at")), keys, 1, ["_age"]).drop("_age")


def missing_requests(requests: DataFrame, snapshots: DataFrame, keys: Sequence[str] = SNAPSHOT_KEYS) -> DataFrame:
    """Requests without a stored, non-empty answer."""
    answered = snapshots.where(F.size("articles") > 0).select(*keys).distinct()
    return requests.join(answered, list(keys), "left_anti")
