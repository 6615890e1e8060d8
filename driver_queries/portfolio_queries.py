"""Portfolio returns, curves, metrics, benchmarks and allocation vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import tables as t
from driver_queries.tables import AGENTS, ASSETS, RETURNS, WEIGHTS, finish, sql
from marketloom.operators import indicators, portfolio
from marketloom.plans import jobs

Q: dict = {}


def add(name: str, fn, spec: str, query: list[str] | str | None) -> None:
    Q[name] = (lambda spark, sf: finish(fn(spark, sf), spec), None if query is None else sql(query, spec))


def returns(s, d):
    return portfolio.portfolio_returns(portfolio.normalize_weights(t.month_weights(s, d)), t.month_prices(s, d))


def curve(s, d):
    return portfolio.equity_curve(returns(s, d))


def _sharpe(value: str, periods: int) -> str:
    return f"CASE WHEN stddev_samp({value}) > 0 THEN avg({value}) / stddev_samp({value}) * sqrt(CAST({periods} AS DOUBLE)) ELSE 0 END"


add(
    "period_log_returns", lambda s, d: portfolio.period_log_returns(t.month_prices(s, d)), "ticker date:d next_date:d log_return:f6",
    [WEIGHTS, "q AS (SELECT * FROM forward)"],
)
add("portfolio_returns", returns, "portfolio_id date:d next_date:d ret:f6", [WEIGHTS, "q AS (SELECT * FROM port_returns)"])


def _quarterly(s, d):
    """Weights of every third month only: a position is held for three."""
    weights = t.month_weights(s, d).where(F.month("date") % 3 == 1)
    return portfolio.portfolio_returns(portfolio.normalize_weights(weights), t.month_prices(s, d))


QUARTERLY = WEIGHTS[: WEIGHTS.index("forward AS (")].replace("normalized AS (", "all_normalized AS (")
add(
    "portfolio_returns_quarterly", _quarterly, "portfolio_id date:d next_date:d ret:f6",
    [QUARTERLY.rstrip().rstrip(","), "normalized AS (SELECT * FROM all_normalized WHERE month(date) % 3 = 1)", t.PORT_RETURNS, "q AS (SELECT * FROM port_returns)"],
)
add("equity_curve", curve, "portfolio_id date:d ret:f6 value:f2", [WEIGHTS, "q AS (SELECT * FROM curve)"])
METRICS = f"""{WEIGHTS}, metrics AS (
  SELECT portfolio_id, count(ret) AS n_periods, max_by(value, date) / 100000 - 1 AS total_return,
    pow(max_by(value, date) / 100000, CAST(12 AS DOUBLE) / count(ret)) - 1 AS annualized_return, {_sharpe('ret', 12)} AS sharpe_ratio,
    stddev_samp(ret) * sqrt(CAST(12 AS DOUBLE)) AS volatility, abs(min(drawdown)) AS max_drawdown, max_by(value, date) AS final_value
  FROM under GROUP BY 1)"""
add(
    "performance_metrics", lambda s, d: portfolio.performance_metrics(curve(s, d)),
    "portfolio_id n_periods total_return:f6 annualized_return:f6 sharpe_ratio:f6 volatility:f6 max_drawdown:f6 final_value:f2",
    [METRICS, "q AS (SELECT * FROM metrics)"],
)
add(
    "episode_metrics", lambda s, d: portfolio.episode_metrics(curve(s, d)),
    "portfolio_id total_return:f6 sharpe_ratio:f6 max_drawdown:f6 volatility:f6 final_value:f2",
    [WEIGHTS, f"""stepped AS (SELECT *, value / lag(value) OVER (PARTITION BY portfolio_id ORDER BY date) - 1 AS r FROM under),
      q AS (SELECT portfolio_id, max_by(value, date) / 100000 - 1 AS total_return, {_sharpe('r', 252)} AS sharpe_ratio, abs(min(drawdown)) AS max_drawdown,
        stddev_samp(r) * sqrt(CAST(252 AS DOUBLE)) AS volatility, max_by(value, date) AS final_value FROM stepped GROUP BY 1)"""],
)
add(
    "reward_series", lambda s, d: portfolio.reward_series(curve(s, d)), "portfolio_id date:d reward:f6 max_drawdown:f6 recent_volatility:f6",
    [WEIGHTS, """parts AS (SELECT portfolio_id, date, ret,
        abs(min(drawdown) OVER (PARTITION BY portfolio_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS max_drawdown,
        CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w ELSE 0 END AS recent_volatility
        FROM under WINDOW w AS (PARTITION BY portfolio_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
      q AS (SELECT *, ret - 2 * max_drawdown - CAST(0.5 AS DOUBLE) * recent_volatility AS reward FROM parts WHERE ret IS NOT NULL)"""],
)
EQUAL = f"""{WEIGHTS}, equal_returns AS (SELECT date, next_date, exp(avg(log_return)) - 1 AS ret FROM forward GROUP BY 1, 2),
equal_metrics AS (SELECT 'Equal-Weighted' AS portfolio_id, product(1 + ret) - 1 AS total_return, pow(product(1 + ret), CAST(12 AS DOUBLE) / count(ret)) - 1 AS annualized_return,
  {_sharpe('ret', 12)} AS sharpe_ratio, stddev_samp(ret) * sqrt(CAST(12 AS DOUBLE)) AS volatility FROM equal_returns)"""
add(
    "equal_weight_benchmark", lambda s, d: portfolio.equal_weight_benchmark(t.month_prices(s, d)),
    "portfolio_id total_return:f6 annualized_return:f6 sharpe_ratio:f6 volatility:f6",
    [EQUAL, "q AS (SELECT * FROM equal_metrics)"],
)
HOLD = f"""hold_returns AS (SELECT * FROM (SELECT month_end AS date, ln(price / lag(price) OVER (ORDER BY month_end)) AS ret FROM monthly WHERE ticker = 'Brand#7') WHERE ret IS NOT NULL),
hold_metrics AS (SELECT 'Brand#7 Buy & Hold' AS portfolio_id, exp(sum(ret)) - 1 AS total_return, pow(exp(sum(ret)), CAST(12 AS DOUBLE) / count(ret)) - 1 AS annualized_return,
  {_sharpe('ret', 12)} AS sharpe_ratio, stddev_samp(ret) * sqrt(CAST(12 AS DOUBLE)) AS volatility FROM hold_returns)"""
add(
    "buy_and_hold", lambda s, d: portfolio.buy_and_hold(t.month_prices(s, d), "Brand#7"),
    "portfolio_id total_return:f6 annualized_return:f6 sharpe_ratio:f6 volatility:f6",
    [WEIGHTS, HOLD, "q AS (SELECT * FROM hold_metrics)"],
)
_EQUAL_ONLY, _METRICS_ONLY = EQUAL[len(WEIGHTS) + 2:], METRICS[len(WEIGHTS) + 2:]
GAPS = f"""{WEIGHTS}, {_EQUAL_ONLY}, {HOLD}, {_METRICS_ONLY}, gaps AS (
  SELECT m.*, b.portfolio_id AS benchmark, m.annualized_return - b.annualized_return AS excess_return, m.sharpe_ratio - b.sharpe_ratio AS sharpe_improvement
  FROM metrics m CROSS JOIN (SELECT * FROM equal_metrics UNION ALL SELECT * FROM hold_metrics) b)"""


def _gaps(s, d):
    prices = t.month_prices(s, d)
    bench = portfolio.equal_weight_benchmark(prices).unionByName(portfolio.buy_and_hold(prices, "Brand#7"))
    return portfolio.compare_to_benchmarks(portfolio.performance_metrics(curve(s, d)), bench)


add("compare_to_benchmarks", _gaps, "portfolio_id benchmark excess_return:f6 sharpe_improvement:f6", [GAPS, "q AS (SELECT * FROM gaps)"])
add(
    "backtest", lambda s, d: jobs.backtest_job(t.month_weights(s, d), t.month_prices(s, d), "Brand#7"),
    "portfolio_id total_return:f6 sharpe_ratio:f6 max_drawdown:f6 benchmark excess_return:f6 sharpe_improvement:f6",
    [GAPS, "q AS (SELECT * FROM gaps)"],
)
add(
    "rolling_sharpe_12", lambda s, d: portfolio.rolling_sharpe_ratio(returns(s, d)), "portfolio_id date:d rolling_sharpe:f6",
    [WEIGHTS, """q AS (SELECT portfolio_id, date, CASE WHEN count(ret) OVER w = 12 THEN avg(ret) OVER w / nullif(stddev_samp(ret) OVER w, 0) * sqrt(CAST(12 AS DOUBLE)) END AS rolling_sharpe
      FROM port_returns WINDOW w AS (PARTITION BY portfolio_id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""],
)
add("drawdown_series", lambda s, d: portfolio.drawdown_series(curve(s, d)), "portfolio_id date:d drawdown:f6", [WEIGHTS, "q AS (SELECT * FROM under)"])
add(
    "recent_weights", lambda s, d: portfolio.recent_weights(portfolio.normalize_weights(t.month_weights(s, d))), "portfolio_id date:d ticker weight:f6",
    [WEIGHTS, """q AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY portfolio_id ORDER BY date DESC) AS k FROM normalized) WHERE k <= 12)"""],
)
add(
    "benchmark_curve", lambda s, d: portfolio.benchmark_curve(portfolio.equal_weight_returns(t.month_prices(s, d))), "portfolio_id date:d value:f2",
    [EQUAL, """q AS (SELECT 'Equal-Weighted' AS portfolio_id, date, product(1 + ret) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100000 AS value FROM equal_returns)"""],
)


def _episodes(s, d):
    """Orders as episodes: ten per priority."""
    o = t.load(s, d, "orders")
    value = F.col("o_totalprice")
    return o.groupBy(F.col("o_orderpriority").alias("agent"), (F.col("o_custkey") % 10).alias("episode")).agg(
        (F.max(value) / 100000 - 1).alias("total_return"), F.min(value).alias("sharpe_ratio"), (F.min(value) / F.max(value)).alias("max_drawdown"),
        (F.max(value) - F.min(value)).alias("volatility"), F.max(value).alias("final_value"),
    )


add(
    "average_agent_metrics", lambda s, d: portfolio.average_agent_metrics(_episodes(s, d)),
    "agent total_return:f6 sharpe_ratio:f4 max_drawdown:f6 volatility:f4 final_value:f4",
    """episodes AS (SELECT o_orderpriority AS agent, o_custkey % 10 AS episode, max(o_totalprice) / 100000 - 1 AS total_return, min(o_totalprice) AS sharpe_ratio,
        min(o_totalprice) / max(o_totalprice) AS max_drawdown, max(o_totalprice) - min(o_totalprice) AS volatility, max(o_totalprice) AS final_value FROM orders GROUP BY 1, 2),
      q AS (SELECT agent, avg(total_return) AS total_return, avg(sharpe_ratio) AS sharpe_ratio, avg(max_drawdown) AS max_drawdown, avg(volatility) AS volatility, avg(final_value) AS final_value FROM episodes GROUP BY 1)""",
)
add(
    "median_run",
    lambda s, d: portfolio.median_run(
        t.load(s, d, "orders").groupBy(F.col("o_orderpriority").alias("agent"), (F.col("o_orderkey") % 4).alias("seed")).agg(F.max("o_totalprice").alias("reward"))
    ),
    "agent seed:i reward:f2",
    """runs AS (SELECT o_orderpriority AS agent, o_orderkey % 4 AS seed, max(o_totalprice) AS reward FROM orders GROUP BY 1, 2),
      q AS (SELECT agent, seed, reward FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY reward, seed) AS k, count(*) OVER (PARTITION BY agent) AS n FROM runs) WHERE k = n // 2 + 1)""",
)

_AGENT_VALUES = ", ".join(f"('{a}', {k})" for k, a in enumerate(AGENTS))
# An agent gives no weight (NULL) where the raw value is 5, so that some
# vectors are incomplete and fall back.
AGENT_WEIGHTS = f"""{RETURNS}, {ASSETS}, agent_grid AS (
  SELECT agent, agent_order, month_end AS date, r.ticker, asset_order, (year(month_end) * 12 + month(month_end)) AS m
  FROM returns r JOIN assets a ON r.ticker = a.ticker CROSS JOIN (VALUES {_AGENT_VALUES}) AS g(agent, agent_order)),
agent_weights AS (SELECT *, nullif((asset_order * 3 + m * 5 + agent_order) % 79, 5) / CAST(100 AS DOUBLE) AS weight FROM agent_grid)"""


def _agent_grid(s, d):
    listed = F.array(*[F.struct(F.lit(a).alias("agent"), F.lit(k).alias("agent_order")) for k, a in enumerate(AGENTS)])
    month_no = F.year("month_end") * 12 + F.month("month_end")
    return t.ordered_returns(s, d).select(
        F.inline(listed), F.col("month_end").alias("date"), "ticker", "asset_order", month_no.alias("m")
    )


def _agent_weights(s, d):
    raw = (F.col("asset_order") * 3 + F.col("m") * 5 + F.col("agent_order")) % 79
    return _agent_grid(s, d).withColumn("weight", F.when(raw != 5, raw) / 100.0)


add(
    "fallback_allocation", lambda s, d: portfolio.fallback_allocation(_agent_weights(s, d), _agent_grid(s, d)), "agent date:d ticker weight:f6",
    [AGENT_WEIGHTS, """q AS (SELECT g.agent, g.date, g.ticker, CASE WHEN count(w.weight) OVER v = count(*) OVER v THEN w.weight ELSE CAST(1 AS DOUBLE) / count(*) OVER v END AS weight
      FROM agent_grid g LEFT JOIN agent_weights w ON g.agent = w.agent AND g.date = w.date AND g.ticker = w.ticker WINDOW v AS (PARTITION BY g.agent, g.date))"""],
)
add(
    "stack_allocations",
    lambda s, d: portfolio.stack_allocations(_agent_weights(s, d), "nlp").select("date", F.posexplode("allocation").alias("position", "weight")),
    "date:d position:i weight:f6",
    [AGENT_WEIGHTS, """q AS (SELECT date, row_number() OVER (PARTITION BY date ORDER BY agent_order, asset_order) - 1 AS position, coalesce(weight, 0) AS weight FROM agent_weights WHERE contains(agent, 'nlp'))"""],
)


def _observations(s, d):
    table = indicators.indicator_table(t.returns(s, d)).join(t.assets(s, d), "ticker")
    tech = table.select(F.col("month_end").alias("date"), F.col("asset_order").alias("position"), F.col("volatility").alias("value"))
    month = F.last_day(F.to_date(F.concat("month", F.lit("-01"))))
    sent = t.monthly_sentiment(s, d).join(t.assets(s, d), "ticker").select(
        month.alias("date"), F.col("asset_order").alias("position"), F.col("sentiment_weighted").alias("value")
    )
    vectors = portfolio.observation_vectors(tech, sent, width=25, technical_width=25)
    return vectors.select("date", F.posexplode("observation").alias("position", "value"))


from driver_queries.price_queries import RISK  # noqa: E402

add(
    "observation_vectors", _observations, "date:d position:i value:f4",
    [RISK, ASSETS, t.MONTHLY_SENTIMENT, """tech AS (SELECT month_end AS date, asset_order AS position, CAST(coalesce(volatility, 0) AS FLOAT) AS value FROM risk r JOIN assets a ON r.ticker = a.ticker),
      sent AS (SELECT last_day(CAST(month || '-01' AS DATE)) AS date, asset_order + 25 AS position, CAST(coalesce(sentiment_weighted, 0) AS FLOAT) AS value
        FROM monthly_sentiment m JOIN assets a ON m.ticker = a.ticker),
      q AS (SELECT d.date, p.position, coalesce(s.value, 0) AS value FROM (SELECT DISTINCT date FROM tech) d CROSS JOIN (SELECT unnest(range(50)) AS position) p
        LEFT JOIN (SELECT * FROM tech UNION ALL SELECT * FROM sent) s ON s.date = d.date AND s.position = p.position)"""],
)
