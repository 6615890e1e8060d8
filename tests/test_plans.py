"""What the plans look like: exchanges, joins, Python, limits inside map tasks."""

import re

import pytest
from pyspark.sql import functions as F

from driver_queries import registry, tables
from marketloom.operators import articles, features, indicators, reshape, sentiment, validation

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("prices") / "p")
    tables.prices(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


def test_daily_features_shuffle_once_by_ticker(stored):
    text = plan(features.daily_features(stored))
    assert len(re.findall(r"Exchange hashpartitioning\(ticker", text)) == 1
    assert "CartesianProduct" not in text and "Python" not in text and "NestedLoop" not in text


def test_indicators_shuffle_once_by_ticker(spark, stored):
    returns = reshape.monthly_log_return(reshape.month_end_price(stored))
    text = plan(indicators.indicator_table(returns))
    assert len(re.findall(r"Exchange hashpartitioning\(ticker#\d+, \d", text)) == 1


def test_scan_reads_only_what_is_needed(spark):
    text = plan(tables.prices(spark, SF))
    assert "l_tax" not in text and "p_retailprice" not in text


def test_filters_reach_the_scan(spark):
    line = tables.load(spark, SF, "lineitem")
    text = plan(line.where(F.col("l_quantity") > 49).select("l_orderkey"))
    assert "GreaterThan(l_quantity,49" in text


def test_first_and_quota_limit_before_the_shuffle(spark):
    posts = tables.forum_posts(spark, SF)
    for df in (articles.dedup_first(posts, ["ticker", "id"], ["term_rank", "pos"]), articles.cap_per_key(posts, ["ticker"], 100, ["term_rank", "pos"])):
        lines = plan(df).splitlines()
        partial = [i for i, x in enumerate(lines) if "WindowGroupLimit" in x and "Partial" in x]
        exchange = [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x]
        assert partial and max(partial) > max(exchange)


def test_article_aggregates_combine_before_the_shuffle(spark):
    text = plan(sentiment.merge_sources(tables.scored(spark, SF)))
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text and text.count("Exchange") == 1


def test_source_stats_join_aggregated_rows(spark):
    scored = tables.scored(spark, SF)
    text = plan(validation.source_return_stats(scored, spark.createDataFrame([("A", "2024-01", 0.1)], "ticker string, month string, monthly_return double")))
    join = next(i for i, x in enumerate(text.splitlines()) if "Join" in x)
    assert any("HashAggregate" in x and "source" in x for x in text.splitlines()[join:])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_query_has_a_cross_join_or_row_python(spark, name):
    text = plan(registry.QUERIES[name][0](spark, SF))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text and "NestedLoopJoin" not in text


@pytest.mark.parametrize(("name", "most"), [("densify", 2), ("daily_features", 2), ("portfolio_returns", 4), ("equity_curve", 4), ("backtest", 6)])
def test_raw_prices_are_scanned_few_times(spark, name, most):
    """Before any exchange is reused: once for the rows, once for the calendar of each price table."""
    text = plan(registry.QUERIES[name][0](spark, SF))
    assert len(re.findall(r"FileScan[^\n]*lineitem", text)) <= most and "LeftSemi" not in text
