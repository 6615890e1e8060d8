import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from marketloom import schemas
from marketloom.operators import articles
from marketloom.sources import readers, writers


def test_yahoo_articles(spark):
    rows = [
        ("A", "1705305600", ("Earnings beat", "strong", None)),
        ("A", None, ("Downgrade today", "weak", "2024-02-01T10:00:00Z")),
        ("A", "0", ("Zero stamp title", "", "Thu, 01 Feb 2024 10:00:00 GMT")),
        ("A", None, ("No date at all", "text", None)),
        ("A", "1705305600", ("short", "x", None)),
        ("A", "946684800", ("Too old article", "x", None)),
    ]
    df = spark.createDataFrame(rows, schemas.YAHOO_ITEMS)
    got = articles.yahoo_articles(df, 2024, 2024).orderBy("date", "title").collect()
    assert [(r.title, str(r.date), r.month, r.source) for r in got] == [
        ("Earnings beat", "2024-01-15", "2024-01", "yahoo"),
        ("Downgrade today", "2024-02-01", "2024-02", "yahoo"),
        ("Zero stamp title", "2024-02-01", "2024-02", "yahoo"),
    ]


def google_rows(spec):
    long = "d" * 60
    return [("A", "2024-01", i, f"title {i}", long, "https://reuters.com/x" if q else "https://blog.test/x", None) for i, q in enumerate(spec)]


@pytest.mark.parametrize("mode,expected", [("strict", [0, 2, 4]), ("lenient", [0, 1, 2, 3, 4])])
def test_google_quota(spark, mode, expected):
    df = spark.createDataFrame(google_rows([1, 0, 1, 0, 1, 0, 1]), schemas.GOOGLE_ITEMS)
    got = articles.google_articles(df, per_month=3, mode=mode)
    assert sorted(int(r.title.split()[1]) for r in got.collect()) == expected
    assert {str(r.date) for r in got.collect()} == {"2024-01-01"}


def test_quota_of_25_quality_articles(spark):
    df = spark.createDataFrame(google_rows([1, 0] * 25), schemas.GOOGLE_ITEMS)
    assert articles.google_articles(df, 20).count() == 20
    assert articles.google_articles(df, 20, mode="lenient").count() == 39
    assert articles.google_articles(df, 20, mode="lenient", candidates=10).count() == 10


def test_until_quota_matches_a_running_count(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaaaab"), i, rng.random() < 0.3) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, pos int, good boolean")
    got = {(r.k, r.pos) for r in articles.until_quota(df, ["k"], "good", 7, "pos").collect()}
    want, seen = set(), {}
    for k, pos, good in rows:
        if seen.get(k, 0) < 7:
            want.add((k, pos))
            seen[k] = seen.get(k, 0) + good
    assert got == want


def test_cap_per_key_on_a_hot_key(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}", rng.randrange(10_000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o int, id int").repartition(6)
    got = {(r.k, r.id) for r in articles.cap_per_key(df, ["k"], 50, ["o", "id"]).collect()}
    want = set()
    for k in {r[0] for r in rows}:
        want |= {(k, r[2]) for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))[:50]}
    assert got == want


def test_forum_articles(spark):
    base = 1705305600.0
    rows = [
        ("A", 0, 0, "p1", base, 5, "long enough title", "b", "stocks", 1),
        ("A", 1, 0, "p1", base, 5, "long enough title", "again", "stocks", 1),
        ("B", 0, 0, "p1", base, 5, "long enough title", "b", "stocks", 1),
        ("A", 0, 1, "p2", base, 1, "long enough title", "b", "stocks", 1),
        ("A", 0, 2, "p3", base, 2, "nine char", "b", "stocks", 1),
        ("A", 0, 3, "p4", base, 2, "ten chars!", None, "stocks", 1),
    ]
    df = spark.createDataFrame(rows, schemas.FORUM_POSTS)
    got = articles.forum_articles(df, 2024, 2024).orderBy("ticker", "id").collect()
    assert [(r.ticker, r.id, r.headline) for r in got] == [("A", "p1", "long enough title b"), ("A", "p4", "ten chars! "), ("B", "p1", "long enough title b")]
    many = spark.createDataFrame([("A", 0, i, f"p{i}", base, 5, "long enough title", "b", "s", 1) for i in range(101)], schemas.FORUM_POSTS)
    assert articles.forum_articles(many, 2024, 2024, per_ticker=100).count() == 100


def test_skip_full_months(spark):
    rows = [("A", "2024-01", "2024-02")] * 2 + [("A", "2024-02", "2024-03")] * 2 + [("A", "2024-03", "2024-03")] * 3
    df = spark.createDataFrame(rows, "ticker string, query_month string, month string")
    got = articles.skip_full_months(df, 2).groupBy("query_month").count().collect()
    # February is full through January's articles; its own never count for March.
    assert {r.query_month: r["count"] for r in got} == {"2024-01": 2, "2024-03": 3}


def test_snapshot_freshness_edges(spark):
    now = dt.datetime(2024, 1, 2, 0, 0, 0)
    art = [("t", None, None, None)]
    rows = [(k, "yahoo", "s", "e", now - dt.timedelta(seconds=age), a) for k, age, a in (("A", 86_399, art), ("B", 86_400, art), ("C", 86_401, art), ("D", 10, []))]
    rows.append(("A", "yahoo", "s", "e", now - dt.timedelta(seconds=50_000), art))
    df = spark.createDataFrame(rows, schemas.SNAPSHOTS)
    t = F.lit("2024-01-02 00:00:00").cast("timestamp")
    loose = articles.fresh_snapshots(df, t).collect()
    assert sorted(r.ticker for r in loose) == ["A", "B", "D"]
    assert [r.fetched_at for r in loose if r.ticker == "A"] == [now - dt.timedelta(seconds=50_000)]
    assert sorted(r.ticker for r in articles.fresh_snapshots(df, t, inclusive=False).collect()) == ["A", "D"]
    requests = spark.createDataFrame([(k, "yahoo", "s", "e") for k in "ABDE"], "ticker string, source string, start_date string, end_date string")
    assert sorted(r.ticker for r in articles.missing_requests(requests, df).collect()) == ["D", "E"]


def test_search_and_match_terms(spark):
    assets = spark.createDataFrame([("NV", "Nv Corp", 0)], schemas.ASSETS)
    assert [(r.term_rank, r.term) for r in articles.search_terms(assets).orderBy("term_rank").collect()] == [(0, '"NV"'), (1, "$NV"), (2, '"Nv Corp"')]
    docs = spark.createDataFrame([(1, 'buy $NV and "NV" now'), (2, "nothing"), (3, 'the "Nv Corp" and "Nv Corp", again'), (4, None), (5, "$NVX")], "id int, text string")
    hits = articles.match_terms(docs, "text", articles.search_terms(assets), ["id"]).collect()
    assert sorted((r.id, r.ticker, r.term_rank) for r in hits) == [(1, "NV", 0), (1, "NV", 1), (3, "NV", 2), (5, "NV", 1)]


def test_match_terms_is_contains(spark):
    """Keys of every kind against plain substring search."""
    rng = random.Random(4)
    pool = ["a", "b", "ab", "é", "$", "#", '"', " ", "\n", "-", "1", "x9", "語"]
    make = lambda n: "".join(rng.choice(pool) for _ in range(rng.randint(0, n)))
    texts = [(i, make(60)) for i in range(120)] + [(900, None), (901, "")]
    terms = [(f"T{i % 5}", make(5), i) for i in range(150)] + [("T1", None, 900), ("T1", "", 901), ("T1", "ab", 902), ("T1", "ab", 902)]
    df = spark.createDataFrame(texts, "id int, text string").repartition(3)
    got = articles.match_terms(df, "text", spark.createDataFrame(terms, "ticker string, term string, term_rank int"), ["id"]).collect()
    want = {(i, k, t, r) for i, x in texts if x for k, t, r in terms if t and t in x}
    assert sorted((r.id, r.ticker, r.term_rank) for r in got) == sorted((i, k, r) for i, k, t, r in want) and len(want) > 500
    none = articles.match_terms(df, "text", spark.createDataFrame([], "ticker string, term string, term_rank int"), ["id"])
    assert none.columns == ["id", "ticker", "term_rank"] and none.collect() == []


def test_match_terms_of_many_tickers(spark):
    """Few terms: no shuffle but of the terms. Many: the same rows, repeated texts and NULL tickers included."""
    texts = [(1, "alpha beta"), (2, "alpha beta"), (2, "alpha beta"), (3, "gamma"), (4, None), (5, "xalphax")]
    terms = [(f"T{i}", x, i) for i in range(40) for x in ("alph", "beta", "a b")] + [(None, "gam", None), ("T1", "delta", 1)]
    df = spark.createDataFrame(texts, "id int, text string")
    table = spark.createDataFrame(terms, "ticker string, term string, term_rank int")
    want = sorted((i, str(k), str(r)) for i, x in texts if x for k, t, r in terms if t in x)
    for small in (articles.SMALL_TERMS, 0):
        got = articles.match_terms(df, "text", table, ["id"], small=small)
        assert got.columns == ["id", "ticker", "term_rank"]
        assert sorted((r.id, str(r.ticker), str(r.term_rank)) for r in got.collect()) == want
    plan = articles.match_terms(df, "text", table, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "_hash" not in plan


def test_match_terms_reads_a_text_once(spark):
    """All terms in one pass over a text: no candidate is verified by a search of its own, and no text is in the join."""
    terms = [(f"T{i % 7}", f"abcd{i}", i) for i in range(300)] + [("T0", "abcd", 900), ("T1", 'the "Abc Corp"', 901), ("T2", "é語", 902)]
    texts = [(i, f"{i} abcd{i} xabcd{i * 7}é語 " + 'the "Abc Corp"' * (i % 2)) for i in range(60)] + [(900, "abc"), (901, None), (902, "")]
    df = spark.createDataFrame(texts + texts[:3], "id int, text string")
    table = spark.createDataFrame(terms, "ticker string, term string, term_rank int")
    got = articles.match_terms(df, "text", table, ["id"])
    want = sorted((i, k, r) for i, x in texts + texts[:3] if x for k, t, r in terms if t in x)
    assert sorted(tuple(r) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(" not in plan.lower() and plan.count("ArrowEvalPython") == 1


def test_match_terms_of_more_tickers_than_terms(spark):
    """Terms that go to every task, with more bytes of tickers than are broadcast: the same rows."""
    terms = [(f"T{i}", x, i) for i in range(50) for x in ("alph", "beta")]
    df = spark.createDataFrame([(1, "alpha beta"), (1, "alpha beta"), (2, "xalphax"), (3, None)], "id int, text string")
    got = articles.match_terms(df, "text", spark.createDataFrame(terms, "ticker string, term string, term_rank int"), ["id"], small=100)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "broadcast" not in plan
    want = sorted((i, f"T{k}", k) for i, n in ((1, 4), (2, 1)) for k in range(50) for _ in range(n))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_explode_news_and_union(spark):
    news = {"A": {"yahoo": [{"title": "x", "date": "2024-01-01"}], "google": []}, "B": {}}
    df = spark.createDataFrame([(news,)], schemas.COLLECTED_NEWS)
    assert [(r.ticker, r.feed, r.title) for r in articles.explode_news(df).collect()] == [("A", "yahoo", "x")]
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "x int, z int")
    assert sorted(map(tuple, articles.union_sources([a, b]).collect()), key=str) == [(1, 2, None), (3, None, 4)]


def test_read_article_snapshots(spark, tmp_path):
    (tmp_path / "yahoo_NVDA_2024.json").write_text(json.dumps([{"title": "a", "date": "2024-01-01", "source": "yahoo", "url": "u"}, {"title": "b"}]))
    (tmp_path / "google_BRK_B_2024.json").write_text("[]")
    (tmp_path / "reddit_AMD_2024.json").write_text('[{"title": "broken"')
    (tmp_path / "reddit_BRK_B_2023.json").write_text(json.dumps([{"title": "c"}]))
    got = readers.read_article_snapshots(spark, str(tmp_path)).collect()
    assert sorted((r.feed, r.ticker, r.tag, r.title) for r in got) == [
        ("reddit", "BRK_B", "2023", "c"), ("yahoo", "NVDA", "2024", "a"), ("yahoo", "NVDA", "2024", "b"),
    ]
    assert all(r.fetched_at is not None for r in got)


def test_holdings_prices_returns_and_lists(spark, tmp_path):
    (tmp_path / "h.csv").write_text("Ticker,Amount\nB, 5\nA, 7\nB, 1\n")
    assert readers.read_holdings(spark, str(tmp_path / "h.csv"), distinct=False).agg(F.sum("amount")).first()[0] == 13
    assert sorted(r.ticker for r in readers.read_holdings(spark, str(tmp_path / "h.csv")).collect()) == ["A", "B"]
    (tmp_path / "p.csv").write_text("date,ticker,close,adj_close\n2024-01-02,A,1.005,NaN\n2024-01-02,A,3.0,\n")
    [row] = readers.read_prices(spark, str(tmp_path / "p.csv"), "csv", one_per_day=True).collect()
    assert (row.close, row.adj_close) == (3.0, None)
    (tmp_path / "r.csv").write_text("DATE,A,B\n2024-01-31,0.1,\n2024-02-01T00:00:00Z,0.2,0.3\n")
    got = readers.read_daily_returns(spark, str(tmp_path / "r.csv")).orderBy("ticker", "date").collect()
    assert [(r.ticker, str(r.date), r.month, r.log_return) for r in got] == [
        ("A", "2024-01-31", "2024-01", 0.1), ("A", "2024-02-01", "2024-02", 0.2), ("B", "2024-01-31", "2024-01", None), ("B", "2024-02-01", "2024-02", 0.3),
    ]
    (tmp_path / "bad.csv").write_text("day,A\n2024-01-31,0.1\n")
    with pytest.raises(ValueError):
        readers.read_daily_returns(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "bad2.csv").write_text("Date,A\nnever,0.1\n")
    with pytest.raises(Exception, match="unreadable date"):
        readers.read_daily_returns(spark, str(tmp_path / "bad2.csv")).collect()
    assets = spark.createDataFrame([("Z", "z", 0), ("A", "a", 1)], schemas.ASSETS)
    writers.write_ticker_list(assets, str(tmp_path / "list"))
    assert [r.value for r in spark.read.text(str(tmp_path / "list")).collect()] == ["Z", "A"]


def test_writers_round_trip(spark, tmp_path):
    rows = [(dt.date(2024, 1, d), t, float(d), "2024-01", "train") for d in (2, 3) for t in ("A", "B")]
    df = spark.createDataFrame(rows, "date date, ticker string, close double, month string, split string")
    writers.write_features(df, str(tmp_path / "f"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "f")).count() == 4
    writers.write_prices(df.where("not (ticker = 'B' and close = 3)"), str(tmp_path / "p"), ["B", "A"])
    wide = spark.read.csv(str(tmp_path / "p"), header=True)
    assert wide.columns == ["date", "B", "A"] and wide.where("B = '0.0'").count() == 1
    writers.write_sentiment(df, str(tmp_path / "s"))
    assert (tmp_path / "s" / "month=2024-01").exists()
    writers.write_splits({"prices": df}, str(tmp_path / "x"), {"train_end": "2024-01-31"})
    assert spark.read.parquet(str(tmp_path / "x" / "params")).first().train_end == "2024-01-31"
    assert (tmp_path / "x" / "prices" / "split=train").exists()
