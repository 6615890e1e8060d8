"""Near-copies against exact Jaccard similarity."""

import math
from collections import defaultdict

import numpy as np
import pytest

from marketloom.llm import near_copies
from marketloom.llm.common import table


def five_words(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x1c", "_").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def classes_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        root[find(a)] = find(b)
    out = defaultdict(set)
    for n in nodes:
        out[find(n)].add(n)
    return {frozenset(v) for v in out.values()}


def test_recall_on_driver_documents(spark):
    """Of all pairs of 0.8 or more, by an exact join on rare shingles, nearly all are
    found, and nothing else is."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    got = {r.doc_id: r.component_id for r in near_copies.near_copy_classes(docs).collect()}
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        s = near_copies.shingle_set(r.text)
        d, _ = sets.setdefault(s.tobytes(), (r.doc_id, s))
        assert got[r.doc_id] == got[d]
    items = [(d, s) for d, s in sets.values() if len(s)]
    often = defaultdict(int)
    for _, s in items:
        for h in s.tolist():
            often[h] += 1
    seen, pairs = defaultdict(list), set()
    for at, (d, s) in enumerate(items):
        rare = sorted(s.tolist(), key=lambda h: (often[h], h))[: len(s) - math.ceil(0.8 * len(s)) + 1]
        for e, t in (items[o] for o in {o for h in rare for o in seen[h]}):
            shared = len(np.intersect1d(s, t, assume_unique=True))
            if shared >= 0.8 * (len(s) + len(t) - shared):
                pairs.add((e, d))
        for h in rare:
            seen[h].append(at)
    assert len(pairs) > 40 and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    firsts = [d for d, _ in items]
    true = classes_of(pairs, firsts)
    mine = defaultdict(set)
    for d in firsts:
        mine[got[d]].add(d)
    assert all(any(m <= t for t in true) for m in mine.values())


def changed(rng, words, share):
    w = list(words)
    for i in rng.choice(len(w), int(share * len(w)), replace=False):
        w[i] = f"new{rng.integers(0, 10**6)}"
    return " ".join(w)


def test_large_groups_of_near_copies(spark):
    """One base with hundreds of changed copies, buckets cut into blocks, and clean texts."""
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in rng.integers(0, 3000, 300)]
    rows = [(i, changed(rng, base, 0.015)) for i in range(400)] + [(1000 + i, " ".join(f"c{x}" for x in rng.integers(0, 3000, 200))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {d: five_words(t) for d, t in rows}
    pairs = [(a, b) for a in range(400) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    true = classes_of(pairs, [d for d, _ in rows])
    # copies that are as far from each other as 0.8 allows: with all chains deep none is lost,
    # with the usual number the operator's recall holds, and nothing else is merged
    for deep, recall in ((1000, 1.0), (near_copies.DEEP, near_copies.RECALL)):
        mine = defaultdict(set)
        for r in near_copies.near_copy_classes(docs, deep=deep).collect():
            mine[r.component_id].add(r.doc_id)
        largest, whole = max(mine.values(), key=len), max(true, key=len)
        assert len(largest) >= recall * len(whole) > 390 * recall and all(any(m <= t for t in true) for m in mine.values())
        assert recall < 1 or {frozenset(v) for v in mine.values()} == true
    nodes = near_copies.sketched(docs).withColumnRenamed("doc_id", "node").cache()
    for block in (2048, 100):
        links = near_copies.candidate_links(nodes, 14, 34, block=block).collect()
        assert max(map(len, classes_of([(r.a, r.b) for r in links], sets))) > 390
        # far from all 80,000 pairs
        assert len(links) < 400 * 60


def test_links_of_a_group_keep_it_whole():
    """What is near in a bucket stays connected, with few links a row."""
    rng = np.random.default_rng(4)
    for own in (None, np.arange(120) % 2):
        w = np.zeros((120, 4), np.uint64)
        for i in range(1, 120):
            w[i] = w[rng.integers(0, i)] if rng.random() < 0.9 else rng.integers(0, 1 << 63, 4, dtype=np.uint64)
            w[i, rng.integers(0, 4)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
        n = np.full(120, 50)
        got = near_copies.pairs_of_group(w, n, own, 0.8, 0.02)
        ok = lambda i, j: (own is None or own[i] != own[j]) and near_copies.near(w[i : i + 1], w[j], n[i : i + 1], n[j], 0.8, 0.02)[0]
        pairs = [(i, j) for i in range(120) for j in range(i) if ok(i, j)]
        assert classes_of(got, range(120)) == classes_of(pairs, range(120)) and all(ok(i, j) for i, j in got)
        assert len(got) == len(set(got)) <= 120 * (near_copies.PARTNERS + 1)


def test_far_partners_in_a_large_bucket_are_compared(spark):
    """A pair of copies, each with more lookalikes near it in every bucket than it gets
    links there: the lookalikes are nearer by their SimHash, but not similar. The pair is found."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, *(f"v{i}" for i in range(90))]))]
    rows += [(10 + i, f"other {i} text") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    class Alike:
        """SimHashes of the lookalikes: one bit off the first copy; the second is 20 off."""

        first = near_copies.sketch(near_copies.shingle_set(rows[0][1]))

        def of(self, doc_id):
            w = self.first.copy()
            for bit in range(100, 120) if doc_id == 2 else [doc_id] if doc_id >= 10 else []:
                w[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            return [int(x) for x in w.view(np.int64)]

    alike = Alike()
    plain = {r.doc_id: r for r in near_copies.sketched(docs).collect()}
    made = [(d, r.text_key, 400, r.hi, r.lo, *alike.of(d), bytes(r.parities)) for d, r in plain.items()]
    columns = "doc_id long, text_key long, n long, hi long, lo long, w0 long, w1 long, w2 long, w3 long, parities binary"
    with pytest.MonkeyPatch.context() as m:
        m.setattr(near_copies, "sketched", lambda docs, shingle: spark.createDataFrame(made, columns))
        m.setattr(near_copies, "PARTNERS", 1)
        got = {r.doc_id: r.component_id for r in near_copies.near_copy_classes(docs, deep=0).collect()}
    assert got == {d: 1 if d == 2 else d for d, _ in rows}


def test_pairs_across_components():
    """All near pairs of two components that their parities leave possible, by brute force."""
    rng = np.random.default_rng(5)
    sets = [np.unique(np.concatenate([np.arange(300), rng.integers(10**6, 10**9, rng.integers(0, 120))])).astype(np.uint64) * np.uint64(near_copies.MIX[0]) for _ in range(70)]
    w, n = np.array([near_copies.sketch(s) for s in sets]), np.array([len(s) for s in sets])
    odd = np.frombuffer(b"".join(map(near_copies.parities, sets)), np.uint64).reshape(70, -1)
    component = rng.integers(0, 6, 70)
    for own in (None, np.arange(70) % 2):
        got = [(min(i, j), max(i, j)) for pairs in near_copies.pairs_across(w, n, odd, own, component, 0.8, 0.5) for i, j in pairs.T.tolist()]
        similar = set()
        for i in range(70):
            for j in range(i + 1, 70):
                shared = len(np.intersect1d(sets[i], sets[j]))
                if component[i] != component[j] and (own is None or own[i] != own[j]) and shared >= 0.8 * (n[i] + n[j] - shared):
                    similar.add((i, j))
        assert len(got) == len(set(got)) and similar <= set(got) and len(similar) > 50 and all(component[i] != component[j] for i, j in got)
        assert len(got) < 70 * 69 / 2 * 0.7


def test_chains_grow_with_the_nodes():
    small, large = near_copies.chains(1000), near_copies.chains(10**9)
    assert small[0] == 14 and large[0] == 30
    for bits, tables in (small, large):
        assert 1 - (1 - near_copies.agreement(0.8) ** bits) ** tables >= near_copies.RECALL


def test_keep_one_copy(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(5, base, "a"), (3, base, "b"), (9, base + " more", "c"), (1, "clean one here", None), (None, "x y z", "d"), (None, base, "d"), (2, None, "e"), (4, "", "f"), (7, "CLEAN  one here", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = near_copies.keep_one_copy(docs).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, [(3, base), (1, "clean one here"), (None, "x y z"), (None, base), (2, None)]))
    assert got[0].asDict().keys() == {"doc_id", "text", "node"}
    # rows of one id with different texts are documents of their own
    other = " ".join(f"other{i}" for i in range(50))
    rows = [(3, base, "x"), (5, other, "x"), (5, base, "x"), (5, other, "x")]
    got = near_copies.keep_one_copy(spark.createDataFrame(rows, "doc_id long, text string, n string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(3, base), (5, other)]
    assert near_copies.keep_one_copy(docs.limit(0)).collect() == []


@pytest.mark.parametrize("text", [None, "", " \n", "one", "one two three four five"])
def test_short_texts_are_one_shingle(text):
    assert len(near_copies.shingle_set(text)) == bool((text or "").split())
