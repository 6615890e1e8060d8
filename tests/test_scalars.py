import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from marketloom.functions import scalars, stats


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_rounding_is_half_to_even(spark):
    rows = [(0.125,), (0.375,), (2.5,), (None,)]
    got = one(spark, rows, "x double", scalars.rounding("x", 2), scalars.rounding("x", 0))
    assert got == [(0.12, 0.0), (0.38, 0.0), (2.5, 2.0), (None, None)]


def test_parse_date_flexible(spark):
    rows = [("1705305600",), ("2024-01-15",), ("2024-01-15T08:00:00Z",), ("Mon, 15 Jan 2024 08:00:00 GMT",), ("soon",), ("",), (None,), ("99999999999999999999",)]
    fallback = F.lit("2000-01-01").cast("timestamp")
    got = [r[0] for r in one(spark, rows, "x string", scalars.parse_date_flexible("x", fallback).cast("string"))]
    assert got == ["2024-01-15 08:00:00", "2024-01-15 00:00:00", "2024-01-15 08:00:00", "2024-01-15 08:00:00"] + ["2000-01-01 00:00:00"] * 4
    assert one(spark, [("soon",)], "x string", scalars.parse_date_flexible("x")) == [(None,)]


def test_extract_domain(spark):
    rows = [("https://User@A.Example.com:80/x?y",), ("//cdn.site.org/a",), ("www.site.org/a",), ("not a url",), (None,)]
    got = [r[0] for r in one(spark, rows, "u string", scalars.extract_domain("u"))]
    assert got == ["user@a.example.com:80", "cdn.site.org", "", "", ""]


def test_quality_rules(spark):
    long = "x" * 45
    rows = [
        ("T" * 5, long, "https://www.reuters.com/a"),
        ("T" * 4, long, "https://www.reuters.com/a"),
        ("SHOCKING news", long, "https://reuters.com/a"),
        ("T" * 5, long, "https://blog.test/a"),
        ("T" * 9, "", "https://reuters.com/a"),
        ("T" * 10, "", "https://reuters.com/a"),
    ]
    schema = "t string, d string, u string"
    got = one(spark, rows, schema, scalars.is_quality_article("t", "d", "u"), scalars.is_quality_article("t", "d", "u", "lenient"))
    assert [g[0] for g in got] == [True, False, False, False, False, False]
    assert [g[1] for g in got] == [True, True, True, True, False, True]
    with pytest.raises(ValueError):
        scalars.is_quality_article("t", "d", "u", "other")


@pytest.mark.parametrize("text,label,confidence", [
    ("Analysts upgrade X stock rating", "positive", 0.6),
    ("X reports strong Q4 earnings", "positive", 0.6),
    ("quarterly results beat expectations, strong growth", "positive", 0.8),
    ("weak quarter, decline, downgrade", "negative", 0.8),
    ("X announces new product launch", "neutral", 0.5),
    ("mission statement", "negative", 0.6),
    ("beat strong growth upgrade bullish positive", "positive", 0.9),
    ("strong but weak", "neutral", 0.5),
])
def test_lexicon(spark, text, label, confidence):
    [(got,)] = one(spark, [(text,)], "t string", scalars.lexicon_sentiment("t"))
    assert got["label"] == label and math.isclose(got["confidence"], confidence)


def test_labels_and_buckets(spark):
    rows = [(0.0009,), (0.001,), (0.01,), (0.05,), (None,)]
    got = [r[0] for r in one(spark, rows, "p double", scalars.significance_label("p"))]
    assert got == ["highly significant", "very significant", "significant", "--------------", "--------------"]
    rows = [(-0.31,), (0.3,), (0.1,), (0.05,), (None,)]
    got = [r[0] for r in one(spark, rows, "r double", scalars.strength_bucket("r"))]
    assert got == ["strong", "moderate", "moderate", "weak", None]


def test_regime_adjust(spark):
    rows = [(0.0, dt.date(2008, 5, 1), "A"), (-0.9, dt.date(2020, 3, 1), "A"), (0.1, dt.date(2021, 1, 1), "CL=F"), (0.3, dt.date(2015, 1, 1), "A"), (None, dt.date(2015, 1, 1), "A")]
    schema = "s double, d date, t string"
    plain = [r[0] for r in one(spark, rows, schema, scalars.regime_adjust("s", "d"))]
    assert plain[:2] == [-0.3, -1.0] and plain[3] == 0.3 and plain[4] is None and math.isclose(plain[2], 0.3)
    scaled = [r[0] for r in one(spark, rows, schema, scalars.regime_adjust("s", "d", ticker="t", scale=scalars.COMMODITY_SCALE))]
    assert math.isclose(scaled[2], 0.45)


def test_text_helpers(spark):
    rows = [(" Title　", " body \n"), (None, None)]
    got = one(spark, rows, "t string, b string", scalars.headline("t", "b"), scalars.forum_text("t", "b", 8))
    assert got[0] == ("Title　  body", " Title　 ") and got[1] == ("", " ")


def test_gain_loss_keeps_null(spark):
    gain, loss = scalars.gain_loss("d")
    assert one(spark, [(2.0,), (-3.0,), (0.0,), (None,)], "d double", gain, loss) == [(2.0, 0.0), (0.0, 3.0), (0.0, 0.0), (None, None)]


def test_sentiment_score(spark):
    rows = [("positive", 0.7), ("negative", 0.7), ("neutral", 0.7), ("mixed", 0.7), (None, 0.7)]
    assert [r[0] for r in one(spark, rows, "l string, c double", scalars.sentiment_score("l", "c"))] == [0.7, -0.7, 0.0, 0.0, 0.0]


# Two-sided p-values from published tables of the correlation coefficient.
@pytest.mark.parametrize("r,n,p", [(0.5, 10, 0.1411), (0.0, 10, 1.0), (1.0, 10, 0.0), (0.632, 10, 0.05), (-0.632, 10, 0.05), (0.878, 5, 0.05), (0.195, 102, 0.05), (0.3, 2, 1.0)])
def test_two_sided_p(r, n, p):
    assert math.isclose(stats.two_sided_p(r, n), p, abs_tol=6e-4)


def test_pvalue_nulls(spark):
    rows = [(None, 10), (0.5, None), (0.5, 10)]
    got = [r[0] for r in one(spark, rows, "r double, n bigint", stats.pearson_pvalue("r", "n"))]
    assert got[:2] == [None, None] and math.isclose(got[2], 0.14111, abs_tol=1e-5)


def test_safe_corr(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, None), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").groupBy("k").agg(stats.safe_corr("x", "y").alias("r"))
    got = {r.k: r.r for r in df.collect()}
    assert math.isclose(got["a"], 1.0) and got["b"] is None and got["c"] is None
