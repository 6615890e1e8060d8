"""Row-level expressions: dates, text, quality predicates, labels, rounding.

Everything here is a plain Column expression, so it stays inside whole-stage
codegen and can be pushed below shuffles by Catalyst.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Financial news domains counted as quality sources.
QUALITY_DOMAINS = [
    "bloomberg.com", "ft.com", "wsj.com", "reuters.com", "cnbc.com",
    "marketwatch.com", "barrons.com", "economist.com", "forbes.com",
    "morningstar.com", "seekingalpha.com", "investors.com", "fool.com",
    "finance.yahoo.com", "businessinsider.com", "investing.com",
]

# Phrases that mark a title as clickbait, and the one that only
# the lenient rule adds.
CLICKBAIT_PHRASES = ["you won't believe", "shocking", "this one trick", "click here", "top 10"]
CLICKBAIT_LENIENT = [*CLICKBAIT_PHRASES, "won't believe"]

# Sentiment words of the word-list scorer.
POSITIVE_WORDS = ["bullish", "strong", "beat", "upgrade", "positive", "growth"]
NEGATIVE_WORDS = ["bearish", "weak", "miss", "downgrade", "negative", "decline"]

# Market regimes as (first month, last month, shift).
REGIMES = [("2008-01", "2009-12", -0.3), ("2020-03", "2020-04", -0.4), ("2021-01", "2022-12", 0.2)]

# Ticker symbols whose simulated score the draft rescales.
COMMODITY_SCALE = [("GC=F", 0.5), ("SI=F", 0.5), ("CL=F", 1.5)]

# The characters a Python strip removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0       "
    "         　"
)
MAX_EPOCH_SECONDS = 9_223_372_036


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounding(c: Column | str, digits: int) -> Column:
    """Half-to-even rounding by scale, rint, unscale."""
    scale = float(10**digits)
    return F.rint(_col(c) * F.lit(scale)) / F.lit(scale)


def rounding_stable(c: Column | str, digits: int) -> Column:
    """Rounding of an aggregate: cut the noise of the summation order first, so
    that a tie falls the same way under every partitioning."""
    return rounding(rounding(c, 12), digits)


def missing_as_null(c: Column | str) -> Column:
    """NaN becomes NULL; used where data enters the library."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def month_key(date: Column | str) -> Column:
    return F.date_format(_col(date), "yyyy-MM")


def month_date(key: Column | str) -> Column:
    return F.to_date(F.concat(_col(key), F.lit("-01")))


def parse_date_flexible(raw: Column | str, fallback: Column | None = None) -> Column:
    """Timestamp from epoch digits, an ISO-like string or a feed date.

    Digits are epoch seconds when they fit a nanosecond timestamp; otherwise
    the standard parser, then the feed forms (``15 Jan 2024 08:00:00 GMT`` or
    ``+0000``, weekday dropped), ``15 January 2024``, ``January 15, 2024``,
    ``01/15/2024`` and ``2024/01/15``; whatever stays unparsed yields ``fallback``.
    """
    raw = _col(raw).cast("string")
    number = raw.try_cast("bigint")
    is_epoch = raw.rlike("^[0-9]+$") & number.isNotNull() & (number <= MAX_EPOCH_SECONDS)
    epoch = F.timestamp_seconds(F.when(is_epoch, number))
    feed = F.regexp_replace(raw, "^\\s*[A-Za-z]{3},\\s*", "")
    # 15/01 is no month: day-first spellings with slashes stay unread
    spellings = (
        "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "d MMMM yyyy",
        "MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy", "yyyy/M/d",
    )
    parsed = F.coalesce(epoch, F.try_to_timestamp(raw), *(F.try_to_timestamp(feed, F.lit(p)) for p in spellings))
    return parsed if fallback is None else F.coalesce(parsed, fallback)


def in_year_range(date: Column | str, first: int, last: int | None = None) -> Column:
    """Year within [first, last]; ``last`` defaults to the current year."""
    end = F.year(F.current_date()) if last is None else F.lit(last)
    return F.year(_col(date)).between(F.lit(first), end)


def in_date_range(date: Column | str, first: str, last: str) -> Column:
    return _col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def extract_domain(url: Column | str) -> Column:
    """Lower-case authority part (with port and user info); '' when there is none."""
    authority = F.regexp_extract(_col(url), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.lower(F.coalesce(authority, F.lit("")))


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles], F.lit(False))


def is_quality_source(url: Column | str, domains: Sequence[str] = QUALITY_DOMAINS) -> Column:
    """Domain contains one of the listed domains, so sub-domains match too."""
    return contains_any(extract_domain(url), domains)


def is_substantial(
    title: Column | str, desc: Column | str, phrases: Sequence[str], min_chars: int = 50
) -> Column:
    """Enough text and no clickbait phrase in the title."""
    title = F.coalesce(_col(title), F.lit(""))
    desc = F.coalesce(_col(desc), F.lit(""))
    long_enough = (F.length(title) + F.length(desc)) >= min_chars
    return long_enough & ~contains_any(F.lower(title), phrases)


def is_quality_article(
    title: Column | str,
    desc: Column | str,
    url: Column | str,
    mode: str = "strict",
    domains: Sequence[str] = QUALITY_DOMAINS,
    phrases: Sequence[str] | None = None,
    min_chars: int = 50,
) -> Column:
    """Strict: substantial AND quality domain. Lenient: a headline of ten
    characters AND (quality domain OR substantial)."""
    if mode not in ("strict", "lenient"):
        raise ValueError(f"mode must be 'strict' or 'lenient', got {mode!r}")
    if phrases is None:
        phrases = CLICKBAIT_PHRASES if mode == "strict" else CLICKBAIT_LENIENT
    quality = is_quality_source(url, domains)
    substantial = is_substantial(title, desc, phrases, min_chars)
    if mode == "strict":
        return substantial & quality
    return (F.length(headline(title, desc)) >= 10) & (quality | substantial)


def headline(title: Column | str, summary: Column | str) -> Column:
    """Title, blank, summary, stripped at both ends."""
    joined = F.concat(F.coalesce(_col(title), F.lit("")), F.lit(" "), F.coalesce(_col(summary), F.lit("")))
    return F.btrim(joined, F.lit(WHITESPACE))


def forum_text(title: Column | str, body: Column | str, limit: int | None = None) -> Column:
    """Title, blank, body, not stripped; cut only if a scoring model's ``limit`` is given."""
    joined = F.concat(F.coalesce(_col(title), F.lit("")), F.lit(" "), F.coalesce(_col(body), F.lit("")))
    return joined if limit is None else truncate_text(joined, limit)


def is_forum_post(title: Column | str, score: Column | str, min_score: int = 2, min_title: int = 10) -> Column:
    return (_col(score) >= min_score) & (F.length(_col(title)) >= min_title)


def truncate_text(text: Column | str, limit: int = 512) -> Column:
    """First ``limit`` characters."""
    return F.substring(_col(text), 1, limit)


def word_hits(text: Column | str, words: Sequence[str], lowered: bool = False) -> Column:
    """How many of the words occur as substrings; each counts once. ``lowered``
    says the text is in lower case already."""
    lowered = _col(text) if lowered else F.lower(_col(text))
    return reduce(lambda a, b: a + b, [lowered.contains(w).cast("int") for w in words], F.lit(0))


def lexicon_verdict(p: Column, n: Column) -> tuple[Column, Column]:
    """Label and confidence from the numbers of positive and negative words."""
    strength = F.least(F.lit(0.9), F.lit(0.5) + F.greatest(p, n) * F.lit(0.1))
    label = F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral")
    return label, F.when(p != n, strength).otherwise(F.lit(0.5))


def lexicon_sentiment(
    text: Column | str,
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
) -> Column:
    """STRUCT<label, confidence> from the whole text by word lists."""
    label, confidence = lexicon_verdict(word_hits(text, positive), word_hits(text, negative))
    return F.struct(label.alias("label"), confidence.alias("confidence"))


def sentiment_score(label: Column | str, confidence: Column | str) -> Column:
    """+confidence, -confidence, or 0 for any other label."""
    label, confidence = _col(label), _col(confidence)
    return F.when(label == "positive", confidence).when(label == "negative", -confidence).otherwise(F.lit(0.0))


def significance_label(p: Column | str) -> Column:
    p = _col(p)
    # The limits and labels.
    return (
        F.when(p < 0.001, "highly significant")
        .when(p < 0.01, "very significant")
        .when(p < 0.05, "significant")
        .otherwise("--------------")
    )


def strength_bucket(r: Column | str) -> Column:
    """strong above 0.3, moderate from 0.1 to 0.3, weak below; NULL in none."""
    size = F.abs(_col(r))
    return F.when(size > 0.3, "strong").when(size.between(0.1, 0.3), "moderate").when(size < 0.1, "weak")


def clip(c: Column | str, low: float, high: float) -> Column:
    """Clip that keeps NULL (greatest and least would skip it)."""
    c = _col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def regime_adjust(
    score: Column | str,
    date: Column | str,
    rules: Sequence[tuple[str, str, float]] = REGIMES,
    ticker: Column | str | None = None,
    scale: Sequence[tuple[str, float]] = (),
) -> Column:
    """Shift by market regime (first rule that matches), optionally rescale by
    ticker, clip to [-1, 1]. Rules are (first month, last month, shift)."""
    month = month_key(date)
    shift = reduce(
        lambda acc, rule: F.when(month.between(rule[0], rule[1]), F.lit(rule[2])).otherwise(acc),
        reversed(list(rules)),
        F.lit(0.0),
    )
    value = _col(score) + shift
    if ticker is not None and scale:
        factor = reduce(
            lambda acc, rule: F.when(_col(ticker).contains(rule[0]), F.lit(rule[1])).otherwise(acc),
            reversed(list(scale)),
            F.lit(1.0),
        )
        value = value * factor
    return clip(value, -1.0, 1.0)


def gain_loss(delta: Column | str) -> tuple[Column, Column]:
    """Positive and negative part of a change; NULL stays NULL in both."""
    delta = _col(delta)
    gain = F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0)))
    loss = F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0)))
    return gain, loss
