"""Sentiment against returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import tables as t
from driver_queries.tables import DAILY, MERGED, MONTH_RETURNS, SOURCES, corr_sql, finish, p_value_sql, sql
from marketloom.functions.stats import pearson_pvalue
from marketloom.operators import validation

Q: dict = {}


def add(name: str, fn, spec: str, query: list[str] | str | None) -> None:
    Q[name] = (lambda spark, sf: finish(fn(spark, sf), spec), None if query is None else sql(query, spec))


W, R, N = "sentiment_weighted", "monthly_return", "next_return"
_PAIRS = f"count(CASE WHEN {W} IS NOT NULL AND {N} IS NOT NULL THEN 1 END)"
SUMMARY = f"""{MERGED}, tested AS (
  SELECT ticker, count(*) AS data_points, {corr_sql(W, R)} AS current_corr, {_PAIRS} AS lagged_points,
    CASE WHEN {_PAIRS} >= 3 THEN {corr_sql(W, N)} END AS lagged_corr, avg({W}) AS avg_sentiment, avg({R}) AS avg_return,
    stddev_samp({W}) AS sentiment_volatility, stddev_samp({R}) AS return_volatility
  FROM merged GROUP BY 1 HAVING count(*) >= 3),
summary AS (SELECT *, {p_value_sql('current_corr', 'data_points')} AS current_p, {p_value_sql('lagged_corr', 'lagged_points')} AS lagged_p FROM tested)"""


def summary(s, d, extended: bool = False):
    return validation.validation_summary(t.merged(s, d), extended=extended)


add("monthly_returns", t.month_returns, "ticker month monthly_return:f6", [DAILY, MONTH_RETURNS, "q AS (SELECT * FROM month_returns)"])
add(
    "join_sentiment_returns", t.merged, "ticker month sentiment_weighted:f6 monthly_return:f6 news_count",
    [MERGED, "q AS (SELECT * FROM merged)"],
)
add(
    "validate_current", lambda s, d: validation.validate_current(t.merged(s, d)), "ticker data_points current_corr:f6 current_p:f6",
    [SUMMARY, "q AS (SELECT * FROM summary)"],
)
add(
    "validate_lagged", lambda s, d: validation.validate_lagged(t.merged(s, d)), "ticker lagged_points lagged_corr:f6 lagged_p:f6",
    [SUMMARY, f"""q AS (SELECT *, {p_value_sql('lagged_corr', 'lagged_points')} AS lagged_p FROM (
      SELECT ticker, {_PAIRS} AS lagged_points, CASE WHEN {_PAIRS} >= 3 THEN {corr_sql(W, N)} END AS lagged_corr FROM merged GROUP BY 1))"""],
)


def _p_values(s, d):
    """Correlation of discount and quantity per supplier, with its p-value."""
    line = t.load(s, d, "lineitem")
    per = line.groupBy("l_suppkey").agg(F.corr("l_quantity", "l_discount").alias("r"), F.count(F.lit(1)).alias("n"))
    return per.withColumn("p", pearson_pvalue("r", "n"))


add(
    "pearson_pvalue", _p_values, "l_suppkey n r:f6 p:f6",
    ["per AS (SELECT l_suppkey, corr(l_quantity, l_discount) AS r, count(*) AS n FROM lineitem GROUP BY 1)", f"q AS (SELECT *, {p_value_sql('r', 'n')} AS p FROM per)"],
)
add(
    "validation_summary", summary, "ticker data_points current_corr:f6 current_p:f6 lagged_corr:f6 lagged_p:f6",
    [SUMMARY, "q AS (SELECT * FROM summary)"],
)
add(
    "validation_summary_extended", lambda s, d: validation.validation_summary(t.merged(s, d), extended=True, assets=t.assets(s, d)),
    "ticker company data_points current_corr:f6 lagged_corr:f6 avg_sentiment:f6 avg_return:f6 sentiment_volatility:f6 return_volatility:f6",
    [SUMMARY, t.ASSETS, "q AS (SELECT s.*, company FROM summary s LEFT JOIN assets a ON s.ticker = a.ticker)"],
)


def _wide(s, d):
    month = F.to_date(F.concat("month", F.lit("-01")))
    sent = t.monthly_sentiment(s, d).select(month.alias("date"), "ticker", F.col(W).alias("value"))
    ret = t.month_returns(s, d).select(month.alias("date"), "ticker", F.col(R).alias("value"))
    return validation.validate_wide(sent, ret)


add(
    "validate_wide", _wide, "ticker sample_size current_corr:f6 predictive_corr:f6 t_stat:f4",
    [MERGED, f"""common AS (SELECT month, row_number() OVER (ORDER BY month) AS pos FROM (SELECT DISTINCT month FROM monthly_sentiment WHERE month IN (SELECT month FROM month_returns))),
      s AS (SELECT ticker, pos, sentiment_weighted AS s FROM monthly_sentiment JOIN common USING (month)),
      r AS (SELECT ticker, pos, monthly_return AS r FROM month_returns JOIN common USING (month)),
      pairs AS (SELECT s.ticker, s.s, r.r, n.r AS next_r FROM s LEFT JOIN r ON s.ticker = r.ticker AND s.pos = r.pos LEFT JOIN r n ON s.ticker = n.ticker AND s.pos + 1 = n.pos),
      stats AS (SELECT ticker, {corr_sql('s', 'r')} AS current_corr, {corr_sql('s', 'next_r')} AS predictive_corr FROM pairs GROUP BY 1),
      q AS (SELECT *, current_corr * sqrt((sample_size - 2) / nullif(1 - current_corr * current_corr, 0)) AS t_stat FROM (SELECT *, (SELECT count(*) FROM common) AS sample_size FROM stats))"""],
)

_STRENGTH = """CASE WHEN abs({r}) > CAST(0.3 AS DOUBLE) THEN 'strong' WHEN abs({r}) >= CAST(0.1 AS DOUBLE) THEN 'moderate' WHEN abs({r}) < CAST(0.1 AS DOUBLE) THEN 'weak' END"""
_LABEL = """CASE WHEN {p} < 0.001 THEN 'highly significant' WHEN {p} < 0.01 THEN 'very significant' WHEN {p} < 0.05 THEN 'significant' ELSE '--------------' END"""
for _which in ("current", "lagged"):
    _r, _p = f"{_which}_corr", f"{_which}_p"
    add(
        f"correlation_breakdown_{_which}",
        lambda s, d, which=_which: validation.correlation_breakdown(summary(s, d), which),
        "ticker strength corr:f6 p:f6 significance",
        [SUMMARY, f"""q AS (SELECT ticker, {_STRENGTH.format(r=_r)} AS strength, {_r} AS corr, {_p} AS p, {_LABEL.format(p=_p)} AS significance
          FROM summary{' WHERE lagged_corr IS NOT NULL' if _which == 'lagged' else ''})"""],
    )
add(
    "strength_counts", lambda s, d: validation.strength_counts(validation.correlation_breakdown(summary(s, d))), "strength n",
    [SUMMARY, f"""q AS (SELECT k.strength, count(b.ticker) AS n FROM (VALUES ('strong'), ('moderate'), ('weak')) AS k(strength)
      LEFT JOIN (SELECT ticker, {_STRENGTH.format(r='current_corr')} AS strength FROM summary) b ON b.strength = k.strength GROUP BY 1)"""],
)

SOURCE_STATS = f"""{MERGED}, article_returns AS (
  SELECT a.*, r.monthly_return FROM scored a JOIN month_returns r ON a.ticker = r.ticker AND a.month = r.month),
source_return AS (SELECT source, count(*) AS rows, stddev_samp(sentiment_score) AS std, {corr_sql('sentiment_score', 'monthly_return')} AS corr
  FROM article_returns GROUP BY 1)"""


def source_stats(s, d):
    return validation.source_return_stats(t.scored(s, d), t.month_returns(s, d))


add("source_return_stats", source_stats, "source rows:i std:f6 corr:f6", [SOURCE_STATS, "q AS (SELECT * FROM source_return)"])
add(
    "source_return_corr", lambda s, d: validation.source_return_corr(source_stats(s, d), [*SOURCES, "other"]), "source corr:f6",
    [SOURCE_STATS, "q AS (SELECT source, corr FROM source_return UNION ALL SELECT 'other', 0)"],
)
add(
    "optimal_source_weights", lambda s, d: validation.optimal_source_weights(source_stats(s, d)), "source score:f4 weight:f6",
    [SOURCE_STATS, """scores AS (SELECT source, abs(corr) * rows / (std + CAST(1e-10 AS DOUBLE)) AS score FROM source_return),
      q AS (SELECT source, score, score / (SELECT sum(score) FROM scores) AS weight FROM scores)"""],
)
add(
    "source_quality_score", lambda s, d: validation.source_quality_score(source_stats(s, d)), "source quality_score:f6",
    [SOURCE_STATS, """q AS (SELECT source, abs(corr) * CAST(0.4 AS DOUBLE) + rows / CAST((SELECT sum(rows) FROM source_return) AS DOUBLE) * CAST(0.3 AS DOUBLE)
      + CAST(0.3 AS DOUBLE) / (std + CAST(1e-10 AS DOUBLE)) AS quality_score FROM source_return)"""],
)
SUITABLE = f"""{SUMMARY}, per_asset AS (SELECT ticker, count(*) AS rows, stddev_samp(sentiment_score) AS std FROM scored GROUP BY 1),
suitable AS (SELECT s.ticker, abs(current_corr) * coalesce(rows, 0) / (std + CAST(1e-10 AS DOUBLE)) AS suitability FROM summary s LEFT JOIN per_asset p ON s.ticker = p.ticker)"""


def suitability(s, d):
    return validation.asset_suitability(t.scored(s, d), summary(s, d))


add("asset_suitability", suitability, "ticker suitability:f4", [SUITABLE, "q AS (SELECT * FROM suitable)"])
add(
    "top_suitable", lambda s, d: validation.top_suitable(suitability(s, d)), "ticker suitability:f4",
    [SUITABLE, "q AS (SELECT * FROM suitable ORDER BY suitability DESC NULLS LAST, ticker LIMIT 8)"],
)
add(
    "least_suitable", lambda s, d: validation.least_suitable(suitability(s, d)), "ticker suitability:f4",
    [SUITABLE, "q AS (SELECT * FROM suitable ORDER BY suitability ASC NULLS FIRST, ticker DESC LIMIT 5)"],
)
add(
    "coverage_vs_signal", lambda s, d: validation.coverage_vs_signal(t.scored(s, d), summary(s, d)), "ticker coverage current_corr:f6",
    [SUMMARY, "q AS (SELECT ticker, current_corr, (SELECT count(*) FROM scored c WHERE c.ticker = summary.ticker) AS coverage FROM summary)"],
)
add(
    "signal_strength", lambda s, d: validation.signal_strength(summary(s, d)), "ticker current_corr:f6 current_p:f6 neg_log10_p:f4 signal_strength:f2",
    [SUMMARY, "q AS (SELECT *, CASE WHEN current_p > 0 THEN -log10(current_p) END AS neg_log10_p, abs(current_corr) / (current_p + CAST(1e-10 AS DOUBLE)) AS signal_strength FROM summary)"],
)
add(
    "significance_counts", lambda s, d: validation.significance_counts(summary(s, d)), "p_001 p_01 p_05 either_p_05",
    [SUMMARY, """q AS (SELECT count(CASE WHEN current_p < 0.001 THEN 1 END) AS p_001, count(CASE WHEN current_p < 0.01 THEN 1 END) AS p_01,
      count(CASE WHEN current_p < 0.05 THEN 1 END) AS p_05, count(CASE WHEN current_p < 0.05 OR lagged_p < 0.05 THEN 1 END) AS either_p_05 FROM summary)"""],
)
add(
    "top_by_corr", lambda s, d: validation.top_by_corr(summary(s, d)), "ticker current_corr:f6",
    [SUMMARY, "q AS (SELECT * FROM summary WHERE current_corr IS NOT NULL ORDER BY current_corr DESC, ticker LIMIT 8)"],
)
