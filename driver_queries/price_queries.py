"""Reshape, returns, rolling features, risk indicators, signals, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import tables as t
from driver_queries.tables import DAILY, DENSE, FILLED, MONTHLY, PRICES, RETURNS, finish, sql
from marketloom.functions.scalars import gain_loss, rounding
from marketloom.functions.stats import safe_corr
from marketloom.operators import correlation, features, indicators, profile, reshape, signals
from marketloom.plans import jobs


def over(order: str = "date", part: str = "ticker") -> str:
    return f"PARTITION BY {part} ORDER BY {order}"


def roll(fn: str, col: str, n: int, order: str = "date", part: str = "ticker") -> str:
    w = f"OVER ({over(order, part)} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {w} = {n} THEN {fn}({col}) {w} END"


Q: dict = {}


def add(name: str, fn, spec: str, query: list[str] | str | None) -> None:
    Q[name] = (lambda spark, sf: finish(fn(spark, sf), spec), None if query is None else sql(query, spec))


# -- fields, calendar, fills, returns ----------------------------------------

add(
    "select_price_field",
    lambda s, d: reshape.select_price_field(t.prices(s, d, adjusted=True)),
    "ticker date:d price:f2",
    [PRICES, """q AS (SELECT ticker, date,
      CASE WHEN count(adj_close) OVER (PARTITION BY ticker) > 0 THEN adj_close ELSE close END AS price FROM prices)"""],
)
add("densify", t.dense, "ticker date:d close:f2", [DENSE, "q AS (SELECT * FROM dense)"])
add(
    "densify_untraded_edges",
    lambda s, d: reshape.densify(t.prices(s, d).withColumn("close", F.when(F.year("date").between(1993, 1996), F.col("close")))),
    "ticker date:d close:f2",
    [PRICES, """known AS (SELECT ticker, date, CASE WHEN year(date) BETWEEN 1993 AND 1996 THEN close END AS close FROM prices),
      q AS (SELECT t.ticker, c.date, k.close FROM (SELECT DISTINCT ticker FROM known) t CROSS JOIN (SELECT DISTINCT date FROM known WHERE close IS NOT NULL) c
        LEFT JOIN known k ON k.ticker = t.ticker AND k.date = c.date)"""],
)
add(
    "rolling_std_small_spread",
    lambda s, d: t.filled(s, d).withColumn("level", F.col("close") / 10000 + 100000.0).withColumn("std", features.rolling_deviation("level", 20)),
    "ticker date:d std:f4",
    [FILLED, f"""levels AS (SELECT ticker, date, close / 10000 + CAST(100000 AS DOUBLE) AS level FROM filled),
      q AS (SELECT ticker, date, {roll('stddev_samp', 'level', 20)} AS std FROM levels)"""],
)
add("fill_forward_back", t.filled, "ticker date:d close:f2", [FILLED, "q AS (SELECT * FROM filled)"])
add(
    "log_return_zero_filled", t.daily, "ticker date:d log_return:f6", [DAILY, "q AS (SELECT * FROM daily)"],
)
add(
    "log_return_complete_dates",
    lambda s, d: reshape.drop_incomplete_dates(
        reshape.log_return(reshape.fill_forward_back(t.dense(s, d), "close", back=False)), "log_return"
    ),
    "ticker date:d log_return:f6",
    [DENSE, f"""known AS (SELECT ticker, date, last_value(close IGNORE NULLS) OVER ({over()} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM dense),
      r AS (SELECT ticker, date, ln(close / lag(close) OVER ({over()})) AS log_return FROM known),
      q AS (SELECT r.* FROM r ANTI JOIN (SELECT DISTINCT date FROM r WHERE log_return IS NULL) m ON r.date = m.date)"""],
)
add(
    "pct_change",
    lambda s, d: reshape.pct_change(t.dense(s, d)),
    "ticker date:d pct_change:f6",
    [DENSE, f"q AS (SELECT ticker, date, close / lag(close) OVER ({over()}) - 1 AS pct_change FROM dense)"],
)
add(
    "long_to_wide",
    lambda s, d: reshape.long_to_wide(t.prices(s, d), t.TICKERS, "close").select(
        "date", *[F.col(f"`{x}`").alias(x.replace("#", "_")) for x in t.TICKERS]
    ),
    "date:d " + " ".join(f"{x.replace('#', '_')}:f2" for x in t.TICKERS),
    [PRICES, "q AS (SELECT date, " + ", ".join(
        f"max(CASE WHEN ticker = '{x}' THEN close END) AS {x.replace('#', '_')}" for x in t.TICKERS
    ) + " FROM prices GROUP BY 1)"],
)
add(
    "wide_to_long",
    lambda s, d: reshape.wide_to_long(
        t.load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"),
        ["l_orderkey", "l_linenumber"], key="measure",
    ),
    "l_orderkey l_linenumber measure value:f6",
    """q AS (SELECT l_orderkey, l_linenumber, 'l_quantity' AS measure, l_quantity AS value FROM lineitem
      UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem
      UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem)""",
)
add("month_end_price", t.monthly, "ticker month_end:d price:f2", [MONTHLY, "q AS (SELECT * FROM monthly)"])
add("monthly_log_return", t.returns, "ticker month_end:d price:f2 log_return:f2", [RETURNS, "q AS (SELECT * FROM returns)"])
add(
    "reindex_to",
    lambda s, d: reshape.reindex_to(
        t.prices(s, d).select("ticker", "date", "close"), t.dense(s, d), ["ticker", "date"]
    ),
    "ticker date:d close:f2",
    [DENSE, "q AS (SELECT g.ticker, g.date, p.close FROM dense g LEFT JOIN prices p ON g.ticker = p.ticker AND g.date = p.date)"],
)
add(
    "fill_zero",
    lambda s, d: reshape.fill_zero(t.dense(s, d), ["close"]),
    "ticker date:d close:f2",
    [DENSE, "q AS (SELECT ticker, date, coalesce(close, 0) AS close FROM dense)"],
)


def _aligned(s, d):
    """Both outputs, told apart by ``side``."""
    left, right = reshape.align_dates(t.prices(s, d), t.articles(s, d).select("date", "article_id"))
    return left.select(F.lit("left").alias("side"), "date", F.col("ticker").alias("key"), F.col("close").alias("value")).union(
        right.select(F.lit("right"), F.to_date("date"), F.col("article_id").cast("string"), F.lit(None).cast("double"))
    )


add(
    "align_dates", _aligned, "side date:d key value:f2",
    [PRICES, t.ARTICLES, """q AS (SELECT 'left' AS side, date, ticker AS key, close AS value FROM prices WHERE date IN (SELECT CAST(date AS DATE) FROM articles)
      UNION ALL SELECT 'right', CAST(date AS DATE), CAST(article_id AS VARCHAR), NULL FROM articles WHERE CAST(date AS DATE) IN (SELECT date FROM prices))"""],
)
add(
    "split_by_date",
    lambda s, d: reshape.split_by_date(
        t.prices(s, d), {"train": ("1995-01-01", "1998-12-31"), "test": ("1999-01-01", "2001-06-30")}
    ),
    "ticker date:d close:f2 split",
    [PRICES, """q AS (SELECT ticker, date, close, CASE WHEN date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'train' ELSE 'test' END AS split
      FROM prices WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-06-30')"""],
)
add(
    "min_history",
    lambda s, d: reshape.min_history(t.prices(s, d), years=6.8),
    "ticker date:d close:f2",
    [PRICES, """q AS (SELECT ticker, date, close FROM prices WHERE ticker IN (
      SELECT ticker FROM prices GROUP BY 1 HAVING date_diff('day', min(date), max(date)) >= 6.8 * 365.25))"""],
)
add(
    "normalized_price",
    lambda s, d: reshape.normalized_price(t.monthly(s, d), order="month_end"),
    "ticker month_end:d normalized_price:f6",
    [MONTHLY, f"q AS (SELECT ticker, month_end, price / first_value(price) OVER ({over('month_end')}) AS normalized_price FROM monthly)"],
)
add(
    "attach_company",
    lambda s, d: reshape.attach_company(t.monthly(s, d), t.assets(s, d)),
    "ticker company month_end:d price:f2",
    [MONTHLY, t.ASSETS, "q AS (SELECT m.*, company FROM monthly m LEFT JOIN assets a ON m.ticker = a.ticker)"],
)
add(
    "rounding",
    lambda s, d: t.load(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", rounding(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("r2"),
        rounding("l_extendedprice", 0).alias("r0"),
    ),
    "l_orderkey l_linenumber r2 r0",
    """q AS (SELECT l_orderkey, l_linenumber,
      round_even(l_extendedprice / l_quantity * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE) AS r2,
      round_even(l_extendedprice, 0) AS r0 FROM lineitem)""",
)

# -- daily features ----------------------------------------------------------


def _daily_column(name: str, column, expr: str) -> None:
    add(
        name,
        lambda s, d: t.daily(s, d).select("ticker", "date", column().alias("value")),
        "ticker date:d value:f6",
        [DAILY, f"q AS (SELECT ticker, date, {expr} AS value FROM daily)"],
    )


_daily_column("sma_ratio_10", lambda: features.sma_ratio("close", 10), f"({roll('avg', 'close', 10)}) / close - 1")
_daily_column("sma_ratio_30", lambda: features.sma_ratio("close", 30), f"({roll('avg', 'close', 30)}) / close - 1")
_daily_column("rolling_mean", lambda: features.rolling_mean("log_return", 60), roll("avg", "log_return", 60))
_daily_column("rolling_std", lambda: features.rolling_deviation("log_return", 10), roll("stddev_samp", "log_return", 10))
add(
    "rolling_sharpe", lambda s, d: features.rolling_sharpe(t.daily(s, d), "log_return", 120), "ticker date:d sharpe:f6",
    [DAILY, f"""q AS (SELECT ticker, date, ({roll('avg', 'log_return', 120)}) / (({roll('stddev_samp', 'log_return', 120)}) + CAST(1e-8 AS DOUBLE)) AS sharpe FROM daily)"""],
)


def _r4(e: str) -> str:
    return f"coalesce(round_even(({e}) * CAST(10000 AS DOUBLE), 0) / CAST(10000 AS DOUBLE), 0)"


_FEATURE_SQL = {
    "log_return": "log_return",
    "sma10": f"({roll('avg', 'close', 10)}) / close - 1",
    "sma30": f"({roll('avg', 'close', 30)}) / close - 1",
    "volatility_10": roll("stddev_samp", "log_return", 10),
}
for _n in (60, 120):
    _mean, _std = roll("avg", "log_return", _n), roll("stddev_samp", "log_return", _n)
    _FEATURE_SQL[f"log_return_mean_{_n}"] = _mean
    _FEATURE_SQL[f"log_return_std_{_n}"] = _std
    _FEATURE_SQL[f"sharpe_{_n}"] = f"({_mean}) / (({_std}) + CAST(1e-8 AS DOUBLE))"

add(
    "daily_features",
    lambda s, d: features.daily_features(t.prices(s, d)),
    "ticker date:d " + " ".join(f"{c}:f4" for c in features.DAILY_COLUMNS),
    [DAILY, "q AS (SELECT ticker, date, " + ", ".join(f"{_r4(e)} AS {c}" for c, e in _FEATURE_SQL.items()) + " FROM daily)"],
)

# -- monthly risk ------------------------------------------------------------

M = "month_end"
MEAN = f"({roll('avg', 'log_return', 21, M)}) * 252"
VOL = f"({roll('stddev_samp', 'log_return', 21, M)}) * sqrt(CAST(252 AS DOUBLE))"
RISK = f"""{RETURNS}, risk1 AS (
  SELECT *, {MEAN} AS mean_return, {VOL} AS volatility,
    product(1 + log_return) OVER ({over(M)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS growth FROM returns),
neg AS (SELECT ticker, month_end, ({roll('stddev_samp', 'log_return', 21, M)}) * sqrt(CAST(252 AS DOUBLE)) AS downside_vol
        FROM returns WHERE log_return < 0),
risk2 AS (SELECT r.*, downside_vol, growth / nullif({roll('max', 'growth', 21, 'r.month_end', 'r.ticker')}, 0) - 1 AS drawdown
          FROM risk1 r LEFT JOIN neg n ON r.ticker = n.ticker AND r.month_end = n.month_end),
risk3 AS (SELECT *, abs({roll('min', 'drawdown', 21, M)}) AS max_drawdown FROM risk2),
risk AS (SELECT *,
  CASE WHEN volatility = 0 THEN 0 ELSE mean_return / volatility END AS sharpe,
  CASE WHEN coalesce(downside_vol, volatility) = 0 THEN 0 ELSE mean_return / coalesce(downside_vol, volatility) END AS sortino,
  CASE WHEN max_drawdown = 0 THEN 0 ELSE mean_return / max_drawdown END AS calmar FROM risk3)"""


def _risk(name: str, *cols: str) -> None:
    spec = "ticker month_end:d " + " ".join(f"{c}:f6" for c in cols)
    add(name, lambda s, d: indicators.indicator_table(t.returns(s, d)), spec, [RISK, "q AS (SELECT * FROM risk)"])


_risk("rolling_annual", "mean_return", "volatility")
_risk("sharpe", "sharpe")
_risk("sortino", "downside_vol", "sortino")
# Growth spans many orders of magnitude: compared as sign and logarithm.
add(
    "cumulative_growth",
    lambda s, d: indicators.indicator_table(t.returns(s, d)).select(
        "ticker", "month_end", (F.signum("growth") * F.log1p(F.abs("growth"))).alias("growth_log")
    ),
    "ticker month_end:d growth_log:f6",
    [RISK, "q AS (SELECT ticker, month_end, sign(growth) * ln(1 + abs(growth)) AS growth_log FROM risk)"],
)
_risk("rolling_drawdown", "drawdown")
_risk("rolling_max_drawdown", "max_drawdown")
_risk("calmar", "calmar")
add(
    "monthly_risk",
    lambda s, d: jobs.monthly_risk_job(t.prices(s, d)),
    "ticker month_end:d price:f2 log_return:f2 mean_return:f6 volatility:f6 sharpe:f6",
    [RISK, "q AS (SELECT * FROM risk)"],
)

PAIRS = f"""{RETURNS}, {t.ASSETS}, ranked AS (
  SELECT r.ticker, month_end, log_return, asset_order,
         row_number() OVER (PARTITION BY r.ticker ORDER BY month_end) AS pos,
         (SELECT count(*) FROM assets) AS n_assets FROM returns r JOIN assets a ON r.ticker = a.ticker),
pair_windows AS (
  SELECT a.asset_order AS i, b.asset_order AS k, a.month_end, a.pos, a.n_assets,
    stddev_samp(a.log_return) OVER w AS sx, stddev_samp(b.log_return) OVER w AS sy, covar_samp(a.log_return, b.log_return) OVER w AS c
  FROM ranked a JOIN ranked b ON a.month_end = b.month_end AND a.asset_order < b.asset_order
  WINDOW w AS (PARTITION BY a.asset_order, b.asset_order ORDER BY a.month_end ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
pair_corr AS (SELECT i, k, month_end, i * n_assets - i * (i + 1) // 2 + (k - i - 1) AS j,
  CASE WHEN pos > 21 AND sx > 0 AND sy > 0 THEN c / (sx * sy) END AS corr FROM pair_windows)"""

add(
    "rolling_pair_corr",
    lambda s, d: correlation.rolling_pair_corr(t.ordered_returns(s, d), 21, block=8, assets=t.assets(s, d)),
    "i:i k:i month_end:d corr:f6",
    [PAIRS, "q AS (SELECT * FROM pair_corr)"],
)
add(
    "safe_corr",
    lambda s, d: t.load(s, d, "lineitem").groupBy("l_suppkey").agg(
        safe_corr("l_quantity", "l_extendedprice").alias("r"), safe_corr("l_quantity", F.lit(1.0)).alias("constant_r")
    ),
    "l_suppkey r:f6 constant_r:f6",
    "q AS (SELECT l_suppkey, corr(l_quantity, l_extendedprice) AS r, CAST(NULL AS DOUBLE) AS constant_r FROM lineitem GROUP BY 1)",
)

_NORM = """CASE WHEN hi - lo = 0 THEN 0.5 ELSE coalesce((value - lo) / (hi - lo), 0) END"""
add(
    "minmax_normalize",
    lambda s, d: indicators.minmax_normalize(
        t.monthly(s, d).select("ticker", "month_end", F.col("price").alias("value")), "ticker"
    ),
    "ticker month_end:d value:f6",
    [MONTHLY, f"""q AS (SELECT ticker, month_end, {_NORM} AS value FROM (
      SELECT ticker, month_end, price AS value, min(price) OVER (PARTITION BY ticker) AS lo, max(price) OVER (PARTITION BY ticker) AS hi FROM monthly))"""],
)
add(
    "minmax_normalize_training_fit",
    lambda s, d: indicators.minmax_normalize(
        t.monthly(s, d).select("ticker", "month_end", F.col("price").alias("value")), "ticker",
        fit=F.col("month_end") <= F.lit("1998-12-31").cast("date"),
    ),
    "ticker month_end:d value:f6",
    [MONTHLY, f"""q AS (SELECT ticker, month_end, {_NORM} AS value FROM (
      SELECT ticker, month_end, price AS value,
        min(price) FILTER (WHERE month_end <= DATE '1998-12-31') OVER (PARTITION BY ticker) AS lo,
        max(price) FILTER (WHERE month_end <= DATE '1998-12-31') OVER (PARTITION BY ticker) AS hi FROM monthly))"""],
)

INDICATOR_ROWS = " UNION ALL ".join(
    f"SELECT month_end, ticker || '_{c}' AS feature, {c} AS value FROM risk" for c in indicators.INDICATORS
)
_RISK_ONLY = RISK[len(RETURNS) + 2:]
_PAIRS_ONLY = PAIRS[len(RETURNS) + 2:]
SCALED = f"""{RETURNS}, {_RISK_ONLY}, {_PAIRS_ONLY}, feature_rows AS (
  {INDICATOR_ROWS} UNION ALL SELECT month_end, 'corr_' || CAST(j AS VARCHAR), corr FROM pair_corr),
bounds AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM feature_rows GROUP BY 1),
scaled AS (SELECT month_end, f.feature,
  round_even(CASE WHEN hi - lo = 0 THEN 0.5 ELSE coalesce((value - lo) / (hi - lo), 0) END * CAST(10000 AS DOUBLE), 0) / CAST(10000 AS DOUBLE) AS value
  FROM feature_rows f JOIN bounds b ON f.feature = b.feature)"""
add(
    "risk_indicators",
    lambda s, d: indicators.risk_indicators(t.ordered_returns(s, d), block=8, assets=t.assets(s, d)),
    "month_end:d feature value:f4",
    [SCALED, "q AS (SELECT * FROM scaled)"],
)


def _nlp(s, d):
    table = indicators.indicator_table(t.returns(s, d)).select("ticker", "month_end", F.col("volatility").alias("value"))
    scaled = indicators.minmax_normalize(table, "ticker").withColumn("value", rounding("value", 4))
    vol = scaled.join(t.assets(s, d), "ticker").select(F.col("month_end").alias("date"), "asset_order", "value")
    sent = t.monthly_sentiment(s, d).join(t.assets(s, d), "ticker").select(
        F.last_day(F.to_date(F.concat("month", F.lit("-01")))).alias("date"), "asset_order",
        F.col("sentiment_weighted").alias("value"),
    )
    return indicators.nlp_features(sent, vol)


add(
    "nlp_features", _nlp, "date:d feature_idx:i value:f4",
    [SCALED, t.MONTHLY_SENTIMENT, """vol_rows AS (SELECT month_end AS date, asset_order AS idx, value FROM scaled JOIN assets ON feature = ticker || '_volatility'),
      sent_rows AS (SELECT last_day(CAST(month || '-01' AS DATE)) AS date, asset_order + (SELECT count(*) FROM assets) AS idx, sentiment_weighted AS value
        FROM monthly_sentiment m JOIN assets a ON m.ticker = a.ticker),
      both_rows AS (SELECT * FROM vol_rows WHERE date IN (SELECT date FROM sent_rows) UNION ALL SELECT * FROM sent_rows WHERE date IN (SELECT date FROM vol_rows)),
      q AS (SELECT date, idx AS feature_idx, CASE WHEN hi - lo = 0 THEN 0.5 ELSE coalesce((value - lo) / (hi - lo), 0) END AS value FROM (
        SELECT *, min(value) OVER (PARTITION BY idx) AS lo, max(value) OVER (PARTITION BY idx) AS hi FROM both_rows))"""],
)

# -- signals -----------------------------------------------------------------

# First differences, gains, losses and the recursive means of the signal table.
SIG = f"""{PRICES}, listed AS (SELECT ticker, date, close, row_number() OVER ({over()}) AS rn FROM prices WHERE close IS NOT NULL),
diffs AS (SELECT *, close - lag(close) OVER ({over()}) AS d FROM listed),
moves AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS gain, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS loss FROM diffs),
rsis AS (SELECT *, {roll('avg', 'gain', 14)} AS up, {roll('avg', 'loss', 14)} AS down FROM moves),
ewm AS (
  SELECT ticker, date, rn, CAST(close AS DOUBLE) AS fast, CAST(close AS DOUBLE) AS slow, CAST(0 AS DOUBLE) AS signal FROM listed WHERE rn = 1
  UNION ALL
  SELECT l.ticker, l.date, l.rn, l.close * (CAST(2 AS DOUBLE) / 13) + e.fast * (CAST(11 AS DOUBLE) / 13), l.close * (CAST(2 AS DOUBLE) / 27) + e.slow * (CAST(25 AS DOUBLE) / 27),
    ((l.close * (CAST(2 AS DOUBLE) / 13) + e.fast * (CAST(11 AS DOUBLE) / 13)) - (l.close * (CAST(2 AS DOUBLE) / 27) + e.slow * (CAST(25 AS DOUBLE) / 27))) * CAST(0.2 AS DOUBLE) + e.signal * CAST(0.8 AS DOUBLE)
  FROM ewm e JOIN listed l ON l.ticker = e.ticker AND l.rn = e.rn + 1),
signal_table AS (
  SELECT r.ticker, r.date, r.close, CASE WHEN up + down > 0 THEN 100 * up / (up + down) END AS rsi, fast, fast - slow AS macd, signal,
    {roll('avg', 'r.close', 20, 'r.date', 'r.ticker')} AS sma20, {roll('stddev_samp', 'r.close', 20, 'r.date', 'r.ticker')} AS std20,
    {roll('avg', 'r.close', 50, 'r.date', 'r.ticker')} AS sma50
  FROM rsis r JOIN ewm e ON r.ticker = e.ticker AND r.date = e.date)"""

add("rsi", lambda s, d: signals.add_rsi(t.prices(s, d)), "ticker date:d rsi:f4", [SIG, "q AS (SELECT * FROM signal_table)"])
add(
    "gain_loss",
    lambda s, d: (lambda df: df.select("ticker", "date", *[c.alias(n) for c, n in zip(gain_loss("d"), ("gain", "loss"))]))(
        t.prices(s, d).withColumn("d", F.col("close") - F.lag("close").over(reshape.series()))
    ),
    "ticker date:d gain:f4 loss:f4",
    [SIG, "q AS (SELECT * FROM moves)"],
)
add("ema", lambda s, d: signals.ema(t.prices(s, d), 12), "ticker date:d ema:f4", [SIG, "q AS (SELECT ticker, date, fast AS ema FROM ewm)"])
add("macd", lambda s, d: signals.macd(t.prices(s, d)), "ticker date:d macd:f4 signal:f4", [SIG, "q AS (SELECT * FROM signal_table)"])


def _bands(s, d):
    mid, up, low = signals.bollinger()
    return t.prices(s, d).select("ticker", "date", mid.alias("sma20"), up.alias("upper_band"), low.alias("lower_band"))


add(
    "bollinger", _bands, "ticker date:d sma20:f4 upper_band:f4 lower_band:f4",
    [PRICES, f"""q AS (SELECT ticker, date, sma20, sma20 + 2 * std20 AS upper_band, sma20 - 2 * std20 AS lower_band FROM (
      SELECT ticker, date, {roll('avg', 'close', 20)} AS sma20, {roll('stddev_samp', 'close', 20)} AS std20 FROM prices))"""],
)
add(
    "sma", lambda s, d: t.prices(s, d).select("ticker", "date", signals.sma().alias("sma50")), "ticker date:d sma50:f4",
    [PRICES, f"q AS (SELECT ticker, date, {roll('avg', 'close', 50)} AS sma50 FROM prices)"],
)
add(
    "trade_signals", lambda s, d: signals.signal_table(t.prices(s, d)),
    "ticker date:d rsi:f4 sma50:f4 upper_band:f4 buy_signal sell_signal",
    [SIG, """q AS (SELECT *, sma20 + 2 * std20 AS upper_band, coalesce(rsi < 30 AND macd > signal, false) AS buy_signal,
      coalesce(rsi > 70 AND macd < signal, false) AS sell_signal FROM signal_table)"""],
)

SUMMARY = f"""{FILLED}, changes AS (SELECT *, close / lag(close) OVER ({over()}) - 1 AS r FROM filled),
grown AS (SELECT *, CASE WHEN r IS NOT NULL THEN product(1 + r) OVER ({over()} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS growth FROM changes),
summary AS (SELECT ticker, max_by(growth, date) - 1 AS total_return, stddev_samp(r) * sqrt(CAST(252 AS DOUBLE)) AS volatility FROM grown GROUP BY 1)"""
add(
    "risk_return_summary", lambda s, d: signals.risk_return_summary(t.filled(s, d)), "ticker total_return:f6 volatility:f6",
    [SUMMARY, "q AS (SELECT * FROM summary)"],
)
add(
    "sell_candidates", lambda s, d: signals.sell_candidates(signals.risk_return_summary(t.filled(s, d))),
    "ticker total_return:f6 volatility:f6",
    [SUMMARY, "q AS (SELECT * FROM summary WHERE total_return < 0 OR volatility > (SELECT median(volatility) FROM summary))"],
)
_CORR = t.corr_sql("a.log_return", "b.log_return")
add(
    "correlation_matrix",
    lambda s, d: correlation.correlation_matrix(
        reshape.log_return(t.dense(s, d)).join(t.assets(s, d), "ticker"), "log_return", block=8, assets=t.assets(s, d),
    ),
    "i:i k:i n_obs:i corr:f6",
    [DENSE, t.ASSETS, f"""lr AS (SELECT d.ticker, date, asset_order, ln(close / lag(close) OVER (PARTITION BY d.ticker ORDER BY date)) AS log_return
        FROM dense d JOIN assets s ON d.ticker = s.ticker),
      q AS (SELECT a.asset_order AS i, b.asset_order AS k, count(CASE WHEN a.log_return IS NOT NULL AND b.log_return IS NOT NULL THEN 1 END) AS n_obs, {_CORR} AS corr
        FROM lr a JOIN lr b ON a.date = b.date AND a.asset_order < b.asset_order GROUP BY 1, 2)"""],
)
_ENDS = "(max_by(price, month_end) - min_by(price, month_end)) / min_by(price, month_end)"
add(
    "total_return", lambda s, d: signals.total_return(t.monthly(s, d), order="month_end"), "ticker total_return:f6",
    [MONTHLY, f"q AS (SELECT ticker, {_ENDS} AS total_return FROM monthly WHERE price IS NOT NULL GROUP BY 1)"],
)
add(
    "best_worst", lambda s, d: signals.best_worst(signals.total_return(t.monthly(s, d), order="month_end")),
    "best best_return:f6 worst worst_return:f6",
    [MONTHLY, f"""tr AS (SELECT ticker, {_ENDS} AS r FROM monthly WHERE price IS NOT NULL GROUP BY 1),
      q AS (SELECT max_by(ticker, r) AS best, max(r) AS best_return, min_by(ticker, r) AS worst, min(r) AS worst_return FROM tr)"""],
)

# -- profiles ----------------------------------------------------------------

add(
    "null_audit", lambda s, d: profile.null_audit(reshape.log_return(t.dense(s, d))), "ticker date close log_return",
    [DENSE, f"""q AS (SELECT count(*) - count(ticker) AS ticker, count(*) - count(date) AS date, count(*) - count(close) AS close, count(*) - count(lr) AS log_return
      FROM (SELECT *, ln(close / lag(close) OVER ({over()})) AS lr FROM dense))"""],
)
add(
    "table_profile", lambda s, d: profile.table_profile(t.prices(s, d)), "n_rows first_date:d last_date:d n_assets",
    [PRICES, "q AS (SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT ticker) AS n_assets FROM prices)"],
)
add(
    "value_histogram", lambda s, d: profile.value_histogram(t.load(s, d, "lineitem"), "l_extendedprice", 30, density=True),
    "bin:i lower:f4 upper:f4 n density:f9",
    """ends AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS total FROM lineitem),
      counts AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / CAST(30 AS DOUBLE))), 29) AS INTEGER) AS bin, count(*) AS n FROM lineitem, ends GROUP BY 1),
      q AS (SELECT b.bin, lo + b.bin * ((hi - lo) / CAST(30 AS DOUBLE)) AS lower, lo + (b.bin + 1) * ((hi - lo) / CAST(30 AS DOUBLE)) AS upper, coalesce(n, 0) AS n,
        coalesce(n, 0) / (total * ((hi - lo) / CAST(30 AS DOUBLE))) AS density FROM ends, (SELECT unnest(range(30)) AS bin) b LEFT JOIN counts c ON b.bin = c.bin)""",
)
