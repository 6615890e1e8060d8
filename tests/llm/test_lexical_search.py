"""Ranked search against brute force and DuckDB."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import lexical_search
from marketloom.llm.common import table

SF = "/root/testdata/sf0.001"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, best=50):
    docs = [(d, Counter(terms(t))) for d, t in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for d, c, n in docs:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in words if c[w])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:best], 1)]
    return out


@pytest.fixture(scope="module")
def tables(spark):
    line = "Tie words of equal weight, ünï 42"
    rows = [(900001, None), (900002, ""), (900003, " \n.,"), (None, line), *((900100 - i, line) for i in range(70)), (900200, line), (900200, line), (900300, "TIE tie " * 4000 + line), (900301, "K K ſ 42"), (900302, "equal words TIE of weight ünï 42?")]
    docs = table(spark, SF, "documents").select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    docs = docs.withColumns({c: F.lit("clash") for c in ("key", "m", "vector", "term", "row", "n", "cid", "rank", "score")}).repartition(5).cache()
    asked = [(9001, "tie TIE words"), (9002, None), (9003, "..."), (9004, "nowhereatall"), (None, "tie"), (9001, "42"), (9005, "ünï"), (9006, line), (9006, line)]
    items = table(spark, SF, "benchmark").select("item_id", "text").union(spark.createDataFrame(asked, "item_id long, text string")).withColumn("term", F.lit(1)).withColumn("df", F.lit(1)).cache()
    return docs, items


def test_search(tables):
    docs, items = tables
    rows, asked = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    want = brute(rows, asked)
    assert {w[0] for w in want} >= {9001, 9005, 9006} and sum(w[0] == 9006 for w in want) == 50
    for block in (lexical_search.BLOCK, 40):
        got = lexical_search.lexical_search(docs, items, block=block).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    few = lexical_search.lexical_search(docs, items, best=3).collect()
    assert sorted(map(tuple, few), key=repr) == sorted(brute(rows, asked, 3), key=repr)


def test_equal_bags_are_one_class(spark, tables):
    docs, items = tables
    pairs = lexical_search.query_terms(items)
    vocabulary = pairs.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()).cache()
    bags, classes = lexical_search.bag_classes(lexical_search.restricted(docs.where("doc_id > 900000"), vocabulary), 100, 1000)
    # the 70 copies, the two rows of one id and the reordered text
    assert bags.count() == 75 and classes.count() == 3
    assert bags.groupBy("m", "vector").count().agg(F.max("count")).first()[0] == 73
    assert classes.agg(F.min("least.doc_id")).first()[0] == 900031


def test_block_scores():
    rng = np.random.default_rng(2)
    pairs = [(f"q{q}", int(t), int(t) + 1) for q in range(5) for t in rng.choice(30, 8, replace=False)]
    block = lexical_search.Block(pairs, 1000)
    owner, tid, tf, m = rng.integers(0, 6, 40), rng.integers(0, 40, 40), rng.integers(1, 9, 40), rng.integers(50, 300, 40)
    want = np.zeros((6, 5), np.int64)
    for o, t, f, x in zip(owner.tolist(), tid.tolist(), tf.tolist(), m.tolist(), strict=True):
        for q, item in enumerate(block.items):
            if (item, t, t + 1) in pairs:
                want[o, q] += math.floor(1000 * math.log(2002 / (2 * (t + 1) + 1))) * (10**9 * f // (1000 * f + 20 * x))
    assert (block.scores(owner, tid, tf, m, 6) == want).all() and want.any()


def test_sql_says_the_same(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.execute(lexical_search.SEARCH_SQL).fetchall()
    got = lexical_search.lexical_search(table(spark, SF, "documents"), table(spark, SF, "benchmark")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 500


def test_empty(tables):
    docs, items = tables
    assert lexical_search.lexical_search(docs.limit(0), items).collect() == []
    assert lexical_search.lexical_search(docs, items.limit(0)).collect() == []
