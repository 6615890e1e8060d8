"""The prefix trie against a trie built by hand."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from marketloom.llm import prefix_trie
from marketloom.llm.common import table

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt = turns.get(c - c % 100, [])[:h] + turns[c][h:]
        for d in range(len(rebuilt) + 1):
            members[tuple(rebuilt[:d])].append((c, len(rebuilt) == d))
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c, end in members[p] if end)
        up = members[p[:-1]][0][0] if p else None
        out.append((members[p][0][0], len(p), up, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


AWKWARD = [
    (100, None, "user", "before all"), (100, 1, None, None), (100, 1, "a", "tie"), (100, 1, "a", "tie"), (100, 2, "b", "x" * 5000), (100, 3, "c", "ünï"),
    (101, 1, "user", "own"), (101, 2, "user", "more"), (102, 9, "user", "one turn"), (103, 1, "user", "own"), (150, 1, "", ""),
    (207, 1, "no", "base"), (208, 1, "no", "base"), (209, 1, "no", "base"), (None, 1, "of", "none"), (300, 1, "ab", "c"), (400, 1, "a", "bc"),
    *((500 + i, t, "user", f"same {t}") for i in range(40) for t in range(9)), *((611, t, "hot", f"long {t % 7}") for t in range(700)),
]


@pytest.fixture(scope="module")
def conversations(spark):
    extra = spark.createDataFrame(AWKWARD, SCHEMA)
    df = table(spark, SF, "conversations").where("conv_id >= 20").select("conv_id", "turn", "role", "text").union(extra)
    return df.withColumns({c: F.lit("clash") for c in ("c", "ref", "depth", "hi", "first", "q", "base")}).repartition(5).cache()


def rows_of(df):
    return [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]


def test_trie(conversations):
    want = brute(rows_of(conversations))
    assert sorted(map(tuple, prefix_trie.prefix_trie(conversations).collect()), key=repr) == sorted(want, key=repr)
    assert max(w[1] for w in want) > 600 and any(w[3] > 20 and w[1] > 3 for w in want)


def test_stretches(spark, conversations):
    rows = [(k, i, (i * 7 + k) % 11) for k in (1, 2) for i in range(50 * k)]
    df = spark.createDataFrame(rows, "c long, e long, v long").repartition(3)
    for back in (False, True):
        got = {(r.c, r.e): r.v for r in prefix_trie.running(df, "c", "e", ["v"], back, stretch=8).collect()}
        assert got == {(k, i): sum(v for a, j, v in rows if a == k and (j >= i if back else j <= i)) for k, i, _ in rows}


def test_power(spark):
    exponents = [0, 1, 255, 256, 70_000, (1 << 34) + 5]
    df = spark.createDataFrame([(e,) for e in exponents], "e long")
    for lane in prefix_trie.LANES:
        assert [r[0] for r in df.select(prefix_trie.power(lane, 123_456_789, F.col("e"))).collect()] == [pow(123_456_789, e, prefix_trie.PRIMES[lane]) for e in exponents]


def test_collisions_lead_to_another_seed(spark, conversations, monkeypatch):
    """With hashes that tell almost nothing apart the result must still be right."""
    honest = prefix_trie.turn_hash
    monkeypatch.setattr(prefix_trie, "turn_hash", lambda lane, seed: honest(lane, seed) if seed > 2 else honest(lane, seed) % 3)
    small = conversations.where("conv_id < 60")
    want = brute(rows_of(small))
    assert sorted(map(tuple, prefix_trie.prefix_trie(small).collect()), key=repr) == sorted(want, key=repr)


def test_no_turns_and_no_rows(spark, conversations):
    assert prefix_trie.prefix_trie(conversations.limit(0)).collect() == []
    # a conversation with h > 0 turns to skip and no base is turnless
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    one = spark.createDataFrame([(c, 1, "user", "gone")], SCHEMA)
    assert [tuple(r) for r in prefix_trie.prefix_trie(one).collect()] == brute([(c, 1, "user", "gone")])


def test_sql_says_the_same(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(prefix_trie.TRIE_SQL).fetchall()
    assert len(want) > 300 and sorted(map(repr, want)) == sorted(map(repr, brute(rows_of(table(spark, SF, "conversations")))))
