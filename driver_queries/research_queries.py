"""The planned operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import tables as t
from driver_queries.portfolio_queries import curve, returns
from driver_queries.tables import MERGED, MONTHLY, MONTHLY_SENTIMENT, RETURNS, SCORED, WEIGHTS, finish, sql
from marketloom.operators import portfolio, research

Q: dict = {}


def add(name: str, fn, spec: str, query: list[str] | str | None) -> None:
    Q[name] = (lambda spark, sf: finish(fn(spark, sf), spec), None if query is None else sql(query, spec))


for _k in (3, 6):
    add(
        f"momentum_{_k}", lambda s, d, k=_k: research.momentum(t.monthly(s, d), k), f"ticker month_end:d momentum_{_k}:f6",
        [MONTHLY, f"q AS (SELECT ticker, month_end, price / lag(price, {_k}) OVER (PARTITION BY ticker ORDER BY month_end) - 1 AS momentum_{_k} FROM monthly)"],
    )
add(
    "sentiment_zscore", lambda s, d: research.sentiment_zscore(t.monthly_sentiment(s, d)), "ticker month zscore:f6",
    [MONTHLY_SENTIMENT, """q AS (SELECT ticker, month, (sentiment_weighted - avg(sentiment_weighted) OVER w) / nullif(stddev_samp(sentiment_weighted) OVER w, 0) AS zscore
      FROM monthly_sentiment WINDOW w AS (PARTITION BY ticker))"""],
)
add(
    "recency_weighted_sentiment", lambda s, d: research.recency_weighted_sentiment(t.scored(s, d)), "ticker month sentiment_recency:f6",
    [SCORED, """q AS (SELECT ticker, month, sum(w * sentiment_score) / sum(w) AS sentiment_recency FROM (
      SELECT *, exp(-date_diff('day', date, last_day(date)) / CAST(7 AS DOUBLE)) AS w FROM scored) GROUP BY 1, 2)"""],
)


def _decay(s, d):
    """Every asset on every month, sentiment where there is some."""
    order = F.months_between("month_end", F.lit("1995-01-31").cast("date"), True).cast("int")
    spine = t.monthly(s, d).select("ticker", F.date_format("month_end", "yyyy-MM").alias("month"), order.alias("position"))
    joined = spine.join(t.monthly_sentiment(s, d).select("ticker", "month", "sentiment_weighted"), ["ticker", "month"], "left")
    return research.decayed_fill(joined, "sentiment_weighted")


add(
    "decayed_fill", _decay, "ticker month sentiment_weighted:f6 sentiment_weighted_filled:f6",
    [MONTHLY, MONTHLY_SENTIMENT, """spine AS (SELECT m.ticker, strftime(month_end, '%Y-%m') AS month, (year(month_end) - 1995) * 12 + month(month_end) - 1 AS pos FROM monthly m),
      joined AS (SELECT s.ticker, s.month, pos, sentiment_weighted, CASE WHEN sentiment_weighted IS NOT NULL THEN pos END AS known FROM spine s LEFT JOIN monthly_sentiment x ON s.ticker = x.ticker AND s.month = x.month),
      q AS (SELECT ticker, month, sentiment_weighted, last_value(sentiment_weighted IGNORE NULLS) OVER w * pow(CAST(0.9 AS DOUBLE), pos - last_value(known IGNORE NULLS) OVER w) AS sentiment_weighted_filled
        FROM joined WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""],
)
add(
    "turnover", lambda s, d: research.turnover(portfolio.normalize_weights(t.month_weights(s, d))), "portfolio_id date:d turnover:f6 cost:f9",
    [WEIGHTS, """q AS (SELECT portfolio_id, date, sum(move) AS turnover, sum(move) * CAST(0.001 AS DOUBLE) AS cost FROM (
      SELECT *, abs(weight - coalesce(lag(weight) OVER (PARTITION BY portfolio_id, ticker ORDER BY date), 0)) AS move FROM normalized) GROUP BY 1, 2)"""],
)
add(
    "tail_risk", lambda s, d: research.tail_risk(returns(s, d)), "portfolio_id var:f6 cvar:f6",
    [WEIGHTS, """v AS (SELECT portfolio_id, quantile_cont(ret, 0.05) AS var FROM port_returns GROUP BY 1),
      q AS (SELECT v.portfolio_id, var, avg(ret) AS cvar FROM v JOIN port_returns p ON v.portfolio_id = p.portfolio_id AND ret <= var GROUP BY 1, 2)"""],
)
add(
    "bootstrap_corr", lambda s, d: research.bootstrap_corr(t.merged(s, d), replicates=100),
    "ticker n corr:f6 corr_mean:f6 corr_low:f6 corr_high:f6 share_positive:f6",
    [MERGED, f"""slots AS (SELECT ticker, sentiment_weighted AS x, monthly_return AS y, row_number() OVER (PARTITION BY ticker ORDER BY month) - 1 AS slot,
        count(*) OVER (PARTITION BY ticker) AS n FROM merged WHERE sentiment_weighted IS NOT NULL AND monthly_return IS NOT NULL),
      draws AS (SELECT ticker, rep, CAST('0x' || substr(md5(rep || '-' || slot || '-42'), 1, 8) AS BIGINT) % n AS slot FROM slots CROSS JOIN (SELECT unnest(range(100)) AS rep) r),
      reps AS (SELECT d.ticker, rep, {t.corr_sql('x', 'y')} AS r FROM draws d JOIN slots s ON d.ticker = s.ticker AND d.slot = s.slot GROUP BY 1, 2),
      spread AS (SELECT ticker, avg(r) AS corr_mean, quantile_cont(r, 0.025) AS corr_low, quantile_cont(r, 0.975) AS corr_high,
        avg(CASE WHEN r > 0 THEN CAST(1 AS DOUBLE) WHEN r IS NOT NULL THEN 0 END) AS share_positive FROM reps GROUP BY 1),
      point AS (SELECT ticker, max(n) AS n, {t.corr_sql('x', 'y')} AS corr FROM slots GROUP BY 1),
      q AS (SELECT * FROM point JOIN spread USING (ticker))"""],
)
add(
    "inverse_vol_weights",
    lambda s, d: research.inverse_vol_weights(t.returns(s, d).withColumnRenamed("month_end", "date")), "portfolio_id date:d ticker weight:f6",
    [RETURNS, """vols AS (SELECT ticker, month_end AS date, CASE WHEN count(log_return) OVER w = 12 THEN 1 / nullif(stddev_samp(log_return) OVER w, 0) END AS inv
        FROM returns WINDOW w AS (PARTITION BY ticker ORDER BY month_end ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
      q AS (SELECT 'Inverse-Volatility' AS portfolio_id, date, ticker, inv / sum(inv) OVER (PARTITION BY date) AS weight FROM vols WHERE inv IS NOT NULL)"""],
)
add(
    "drawdown_recovery", lambda s, d: research.drawdown_recovery(curve(s, d)), "portfolio_id start_date:d end_date:d periods depth:f6 recovered",
    [WEIGHTS, """marked AS (SELECT *, CASE WHEN drawdown < 0 AND coalesce(lag(drawdown) OVER w, 0) >= 0 THEN 1 ELSE 0 END AS opens, lead(date) OVER w IS NULL AS is_last
        FROM under WINDOW w AS (PARTITION BY portfolio_id ORDER BY date)),
      spells AS (SELECT *, sum(opens) OVER (PARTITION BY portfolio_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spell FROM marked),
      q AS (SELECT portfolio_id, min(date) AS start_date, max(date) AS end_date, count(*) AS periods, min(drawdown) AS depth, NOT bool_or(is_last) AS recovered
        FROM spells WHERE drawdown < 0 GROUP BY portfolio_id, spell)"""],
)
add(
    "quality_monitor", lambda s, d: research.quality_monitor(t.monthly_sentiment(s, d), low=-0.5, high=0.5, z=2.0), "ticker month issue value:f6",
    [MONTHLY_SENTIMENT, """dated AS (SELECT ticker, month, sentiment_weighted AS v, CAST(month || '-01' AS DATE) AS d,
        avg(sentiment_weighted) OVER (PARTITION BY ticker) AS mu, stddev_samp(sentiment_weighted) OVER (PARTITION BY ticker) AS sd FROM monthly_sentiment),
      spans AS (SELECT ticker, min(d) AS lo, max(d) AS hi FROM dated GROUP BY 1),
      q AS (SELECT s.ticker, strftime(g.m, '%Y-%m') AS month, 'missing_month' AS issue, CAST(NULL AS DOUBLE) AS value
          FROM spans s CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)) AS m) g
          WHERE g.m BETWEEN s.lo AND s.hi AND NOT EXISTS (SELECT 1 FROM dated x WHERE x.ticker = s.ticker AND x.d = g.m)
        UNION ALL SELECT ticker, month, 'out_of_range', v FROM dated WHERE v NOT BETWEEN -0.5 AND 0.5
        UNION ALL SELECT ticker, month, 'outlier', v FROM dated WHERE abs((v - mu) / nullif(sd, 0)) > 2)"""],
)
