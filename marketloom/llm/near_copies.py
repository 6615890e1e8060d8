"""Near-copies: SimHash candidates, pigeonring filtering, exact Jaccard similarity.

Texts are near-copies if their sets of ``SHINGLE``-word shingles have a Jaccard
similarity of ``SIMILARITY`` or more (a text of fewer words is one shingle). Equal sets
are one node from the start, so copies meet once. A node's SimHash has ``WIDTH`` bits,
four times the usual, since sets that share four fifths differ in some 15 % of them.

The bits are laid out as a ring, in several random orders. Two nodes meet in a bucket if
a chain of ``bits`` consecutive bits is equal; ``bits`` grows with the logarithm of the
number of nodes, so that unrelated nodes seldom meet, and there are as many chains as
bring a pair of the least similarity together with probability ``RECALL``. From
the chain on, differences must stay within budgets in proportion to the bits passed, up
to ``MOST`` of them all around. What passes is compared exactly on the sets themselves.

A bucket of up to ``SMALL`` nodes yields all its pairs. In a larger one a node is linked to
the ``PARTNERS`` nearest of those near it (``SHALLOW`` once it had ``DEEP`` chains to meet them
in), and parts that would stay apart by one link more; a bucket beyond ``BLOCK`` is cut into blocks each pair of which is one group. So links grow
with the nodes, not with the square of a group. The buckets that left out links of theirs are met
again once the classes of the others are known: every pair near in them whose ends lie in two classes
is compared, too, so the classes are those of all pairs that meet in a bucket. Of these, pairs whose
sets surely differ too much are told by ``parities``, a lower bound, before the sets are read.

Rows without doc_id take no part. Texts without words are copies of each other.
Columns other than doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import boxed, by_batch, plain, released, row_key, unboxed, written
from marketloom.llm.components import components

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.97
WIDTH, WORDS = 256, 4
#: Share of the bits that may differ; 3.5 deviations beyond what the least similarity gives.
MOST = 0.23
SMALL, BLOCK = 10, 2048
#: Partners of a node in a large bucket: of the first ``DEEP`` chains, and of the others.
DEEP, PARTNERS, SHALLOW = 16, 8, 1
#: Parities kept of a set.
PARITIES = 2048
NAMES = ("w0", "w1", "w2", "w3")
#: The constants of a common 64-bit mixing step.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(w)] if len(w) < shingle else map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set as ``WORDS`` words of 64 bits."""
    ones = np.zeros((WORDS, 64), np.int64)
    with np.errstate(over="ignore"):
        for lane in range(WORDS):
            for at in range(0, len(hashes), 1 << 13):
                x = hashes[at : at + (1 << 13)] + np.uint64(MIX[0]) * np.uint64(lane + 1)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
                x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
                x ^= x >> np.uint64(31)
                ones[lane] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel()


def parities(hashes: np.ndarray) -> bytes:
    """For each of ``PARITIES`` classes of hashes, whether a set holds an odd number of
    them. Where two sets' parities differ, so do the sets: in that many hashes at least."""
    return np.packbits(np.bincount((hashes & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1 == 1).tobytes()


def _sketched(shingle: int) -> callable:
    def make() -> callable:
        def work(batch: pa.RecordBatch) -> dict:
            sets = [shingle_set(t, shingle) for t in batch["text"].to_pylist()]
            both = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            halves = np.array([(b >> 64, b & (1 << 64) - 1) for b in both], np.uint64).reshape(-1, 2).view(np.int64)
            words = np.array([sketch(s) for s in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
            out = {"doc_id": batch["doc_id"], "text_key": batch["text_key"], "n": [len(s) for s in sets], "hi": halves[:, 0], "lo": halves[:, 1], "parities": [parities(s) for s in sets]}
            return out | {name: words[:, i] for i, name in enumerate(NAMES)}

        return work

    return make


def sketched(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, n (shingles), hi and lo (which set), the words of the SimHash, and the parities."""
    df = plain(docs, "doc_id", "text").where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text_key", row_key())
    names = ["doc_id", "text_key", "n", "hi", "lo", *NAMES]
    schema = pa.schema([*((n, pa.int64()) for n in names), ("parities", pa.binary())])
    return df.mapInArrow(by_batch(_sketched(shingle), schema, 256), ", ".join(f"{n} long" for n in names) + ", parities binary")


def agreement(similarity: float) -> float:
    """The chance that a bit of two SimHashes agrees, for sets of equal size."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def chains(nodes: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a chain, number of chains)."""
    bits = min(48, max(14, math.ceil(math.log2(max(nodes, 2)))))
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-(agreement(similarity) ** bits)))


def _bucketed(bits: int, tables: int, others: tuple[str, ...]) -> callable:
    def make() -> callable:
        per_ring = WIDTH // bits
        orders = []
        for table in range(tables):
            order = np.random.default_rng(table // per_ring).permutation(WIDTH) if table >= per_ring else np.arange(WIDTH)
            orders.append(np.roll(order, -(table % per_ring) * bits))

        def work(batch: pa.RecordBatch) -> dict:
            words = np.stack([batch[n].to_numpy() for n in NAMES], axis=1).copy()
            single = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
            turned = np.concatenate([np.ascontiguousarray(np.packbits(np.take(single, o, axis=1), axis=1, bitorder="little")).view(np.int64) for o in orders])
            n = batch.num_rows
            out = {"part": np.repeat(np.arange(tables), n), "key": turned[:, 0] & ((1 << bits) - 1)}
            return out | {name: np.tile(batch[name].to_numpy(), tables) for name in others} | {name: turned[:, i] for i, name in enumerate(NAMES)}

        return work

    return make


def budgets(most: float) -> np.ndarray:
    """Differences allowed in the first 64, 128, ... bits from the chain on."""
    return np.floor(most * 64 * np.arange(1, WORDS + 1)).astype(np.int64)


def near(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float, most: float) -> np.ndarray:
    """Which pairs of rows keep to the budgets, and to sizes that the similarity allows."""
    ok = np.minimum(n, m) >= similarity * np.maximum(n, m)
    passed = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), np.int64)
    for i, most_so_far in enumerate(budgets(most)):
        passed = passed + np.bitwise_count(a[..., i] ^ b[..., i])
        ok = ok & (passed <= most_so_far)
    return ok


def pairs_of_group(w: np.ndarray, n: np.ndarray, own: np.ndarray | None, similarity: float, most: float, partners: int = PARTNERS) -> list[tuple[int, int]]:
    """The pairs of ``links_of_group``."""
    return links_of_group(w, n, own, similarity, most, partners)[0]


def links_of_group(w: np.ndarray, n: np.ndarray, own: np.ndarray | None, similarity: float, most: float, partners: int = PARTNERS) -> tuple[list[tuple[int, int]], bool]:
    """Links in a large bucket: every row to the ``partners`` nearest of those near it, and
    one wherever two parts would stay apart though some of their rows are near. The
    nearest are much the same in all buckets, so what the buckets of a group say
    together stays linear in its rows. ``own``: two values if only links across the
    two count. And whether these are all pairs of rows that are near."""
    size = len(w)
    ok, far = np.zeros((size, size), bool), np.full((size, size), WIDTH + 1, np.int16)
    for i in range(0, size, 64):
        rows = slice(i, i + 64)
        ok[rows] = near(w[rows, None], w[None], n[rows, None], n[None], similarity, most)
        if own is not None:
            ok[rows] &= own[rows, None] != own[None]
        far[rows][ok[rows]] = np.bitwise_count(w[rows, None] ^ w[None]).sum(axis=-1, dtype=np.int16)[ok[rows]]
    np.fill_diagonal(ok, False)
    np.fill_diagonal(far, WIDTH + 1)
    nearest = np.argsort(far, axis=1, kind="stable")[:, :partners]
    left, place = np.nonzero(np.take_along_axis(ok, nearest, axis=1))
    right = nearest[left, place]
    out = set(zip(np.minimum(left, right).tolist(), np.maximum(left, right).tolist(), strict=True))
    part = np.arange(size)

    def merged(i: int, j: int) -> None:
        if part[i] != part[j]:
            part[part == part[j]] = part[i]

    for i, j in out:
        merged(i, j)
    for i in range(size):
        for j in np.flatnonzero(ok[i] & (part != part[i])).tolist():
            if part[i] != part[j]:
                out.add((min(i, j), max(i, j)))
                merged(i, j)
    return sorted(out), 2 * len(out) == int(ok.sum())


def pairs_across(w: np.ndarray, n: np.ndarray, odd: np.ndarray, own: np.ndarray | None, component: np.ndarray, similarity: float, most: float) -> Iterator[np.ndarray]:
    """All pairs of rows of a group that are near, lie in two components and may be similar
    by their parities, in arrays (left, right). One row of such a pair lies outside the
    largest component, so only these rows are held against the others."""
    names, of = np.unique(component, return_inverse=True)
    rest = np.flatnonzero(of != np.bincount(of).argmax()) if len(names) > 1 else np.zeros(0, np.int64)
    first = np.full(len(w), len(rest))
    first[rest] = np.arange(len(rest))
    for at in range(0, len(rest), 16):
        i = rest[at : at + 16]
        ok = near(w[i, None], w[None], n[i, None], n[None], similarity, most) & (of[i, None] != of[None]) & (first[i, None] < first[None])
        if own is not None:
            ok &= own[i, None] != own[None]
        left, right = np.nonzero(ok)
        left = i[left]
        differ = np.bitwise_count(odd[left] ^ odd[right]).sum(axis=1, dtype=np.int64)
        some = differ <= (1 - similarity) / (1 + similarity) * (n[left] + n[right]) + 1e-6
        yield np.stack([left[some], right[some]])


def bucket_rows(nodes: DataFrame, bits: int, tables: int, *others: str) -> DataFrame:
    """part and key (the bucket), node, n, others and the turned words of every node in every chain."""
    names = ("node", "n", *others)
    schema = pa.schema([(n, pa.int64()) for n in ("part", "key", *names, *NAMES)])
    return nodes.select(*names, *NAMES).mapInArrow(by_batch(_bucketed(bits, tables, names), schema, 512), ", ".join(f"{f.name} long" for f in schema))


def large_buckets(nodes: DataFrame, bits: int, tables: int, block: int = BLOCK) -> DataFrame:
    """part, key and blocks of the buckets beyond ``block``."""
    counts = bucket_rows(nodes, bits, tables).groupBy("part", "key").count().where(F.col("count") > block)
    return written(counts.select("part", "key", F.ceil(F.col("count") / block).alias("blocks")), "large-buckets")


GROUP = ["part", "key", "i", "j"]


def by_group(rows: DataFrame, large: DataFrame, found: Callable[[dict[str, np.ndarray]], Iterator[dict[str, np.ndarray]]], schema: pa.Schema) -> DataFrame:
    """What ``found`` gives for whole groups: buckets, or pairs of blocks of the large ones."""
    columns = [c for c in rows.columns if c not in GROUP]
    rows = rows.join(large, ["part", "key"], "left")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)).cast("int") - 1)))
    rows = rows.select("part", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *columns)

    def given(cols: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for out in found(cols):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {x: batch[x].to_numpy(zero_copy_only=False) for x in (*GROUP, "own", *columns)}
            if held:
                cols = {x: np.concatenate([held[x], c]) for x, c in cols.items()}
            last = np.flatnonzero(np.any([cols[x] != cols[x][-1] for x in GROUP], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from given({x: c[:cut] for x, c in cols.items()})
            held = {x: c[cut:].copy() for x, c in cols.items()}
        if held and len(held["node"]):
            yield from given(held)
        pa.default_memory_pool().release_unused()

    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "node").mapInArrow(run, ", ".join(f"{f.name} long" for f in schema))


def group_bounds(cols: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups of sorted rows start, and their sizes."""
    starts = np.append(0, np.flatnonzero(np.any([cols[x][1:] != cols[x][:-1] for x in GROUP], axis=0)) + 1)
    return starts, np.diff(np.append(starts, len(cols["node"])))


def first_links(nodes: DataFrame, bits: int, tables: int, large: DataFrame, similarity: float = SIMILARITY, most: float = MOST, deep: int = DEEP) -> DataFrame:
    """(a, b, part, key) from nodes (node, n, words): the links of every bucket, and, with
    a and b null, the buckets with pairs that are near and not among their links."""

    def found(cols: dict[str, np.ndarray]) -> Iterator[dict]:
        w, n, node = np.stack([cols[x] for x in NAMES], axis=1).view(np.uint64), cols["n"], cols["node"]
        starts, size = group_bounds(cols)
        end = np.repeat(starts + size, size)
        across = cols["i"] != cols["j"]
        left, right, cut = [], [], []
        at = np.flatnonzero(np.repeat(size, size) <= SMALL)
        for step in range(1, SMALL):
            at = at[at + step < end[at]]
            if not len(at):
                break
            ok = near(w[at], w[at + step], n[at], n[at + step], similarity, most) & (~across[at] | (cols["own"][at] != cols["own"][at + step]))
            left.append(node[at[ok]])
            right.append(node[at[ok] + step])
        for f, k in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            partners = PARTNERS if cols["part"][f] < deep else SHALLOW
            pairs, whole = links_of_group(w[f : f + k], n[f : f + k], cols["own"][f : f + k] if across[f] else None, similarity, most, partners)
            if pairs:
                p = np.array(pairs) + f
                left.append(node[p[:, 0]])
                right.append(node[p[:, 1]])
            if not whole:
                cut.append(f)
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
        none = np.zeros(len(a), np.int64)
        yield {"a": np.minimum(a, b), "b": np.maximum(a, b), "part": none, "key": none}
        yield {"a": pa.nulls(len(cut)), "b": pa.nulls(len(cut)), "part": cols["part"][cut], "key": cols["key"][cut]}

    return by_group(bucket_rows(nodes, bits, tables), large, found, pa.schema([(x, pa.int64()) for x in ("a", "b", "part", "key")]))


def candidate_links(nodes: DataFrame, bits: int, tables: int, similarity: float = SIMILARITY, most: float = MOST, block: int = BLOCK, deep: int = DEEP) -> DataFrame:
    """(a, b) from nodes (node, n, words): the links of ``first_links``, once each."""
    links = first_links(nodes, bits, tables, large_buckets(nodes, bits, tables, block), similarity, most, deep)
    return links.where("a IS NOT NULL").select("a", "b").distinct()


def other_links(nodes: DataFrame, cut: DataFrame, bits: int, tables: int, large: DataFrame, similarity: float = SIMILARITY, most: float = MOST) -> DataFrame:
    """(a, b) from nodes (node, n, words, parities, component): every pair that is near in one
    of the buckets ``cut``, lies in two components and may be similar, once each."""

    def found(cols: dict[str, np.ndarray]) -> Iterator[dict]:
        w, n, node = np.stack([cols[x] for x in NAMES], axis=1).view(np.uint64), cols["n"], cols["node"]
        for f, k in zip(*(x.tolist() for x in group_bounds(cols)), strict=True):
            g = slice(f, f + k)
            own = cols["own"][g] if cols["i"][f] != cols["j"][f] else None
            odd = np.frombuffer(b"".join(cols["parities"][g]), np.uint64).reshape(k, -1)
            for pairs in pairs_across(w[g], n[g], odd, own, cols["component"][g], similarity, most):
                a, b = node[g][pairs]
                yield {"a": np.minimum(a, b), "b": np.maximum(a, b)}

    rows = bucket_rows(nodes, bits, tables, "component").join(cut, ["part", "key"]).join(nodes.select("node", "parities"), "node")
    return by_group(rows, large, found, pa.schema([("a", pa.int64()), ("b", pa.int64())])).distinct()


def _sets(shingle: int) -> callable:
    def make() -> callable:
        def work(batch: pa.RecordBatch) -> dict:
            sets = [shingle_set(t, shingle).view(np.int64) for t in batch["text"].to_pylist()]
            return {"node": batch["node"], "shingles": sets}

        return work

    return make


def verified_links(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The candidates whose sets are similar enough, by the sets themselves."""
    wanted = candidates.select(F.col("a").alias("node")).union(candidates.select("b")).distinct()
    firsts = nodes.join(wanted, "node").select("node", "first.doc_id", "first.text_key")
    texts = plain(docs, "doc_id", "text").where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text_key", row_key())
    texts = texts.join(firsts, ["doc_id", "text_key"]).dropDuplicates(["node"]).select("node", "text")
    sets = written(texts.mapInArrow(by_batch(_sets(shingle), pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))]), 256), "node long, shingles array<long>"), "shingle-sets")
    pairs = candidates.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def near_copy_classes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, most: float = MOST, deep: int = DEEP) -> DataFrame:
    """(doc_id, text_key, component_id, keeps): the class of every row with an id, by its
    smallest doc_id, and whether the row is the one that stands for its class."""
    rows = written(sketched(docs, shingle), "sketches")
    first = F.struct("doc_id", "text_key")
    nodes = rows.groupBy("hi", "lo").agg(F.min(first).alias("first"), F.first("n").alias("n"), *(F.first(x).alias(x) for x in (*NAMES, "parities")))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    filled = nodes.where("n > 0")
    bits, tables = chains(filled.count(), similarity, recall)
    large = large_buckets(filled, bits, tables)
    links = written(first_links(filled, bits, tables, large, similarity, most, deep), "first-links")
    candidates = written(links.where("a IS NOT NULL").select("a", "b").distinct(), "candidates")
    found = written(verified_links(docs, nodes, candidates, shingle, similarity), "links")
    parts = written(nodes.join(components(found, "a", "b"), "node", "left").withColumn("component", F.coalesce("component", "node")), "parts")
    cut = written(links.where("a IS NULL").select("part", "key").distinct(), "cut-buckets")
    others = other_links(parts.where("n > 0"), cut, bits, tables, large, similarity, most)
    others = written(others.join(candidates, ["a", "b"], "left_anti"), "other-candidates")
    more = written(verified_links(docs, nodes, others, shingle, similarity), "other-links")
    ends = more.join(parts.select(F.col("node").alias("a"), F.col("component").alias("u")), "a").join(parts.select(F.col("node").alias("b"), F.col("component").alias("v")), "b")
    tops = components(ends.select("u", "v"), "u", "v").toDF("component", "top")
    named = parts.select("node", "hi", "lo", "first", "component").join(tops, "component", "left").withColumn("component", F.coalesce("top", "component"))
    named = written(named, "named")
    released(large, links, candidates, found, parts, cut, others, more)
    smallest = named.groupBy("component").agg(F.min("first").alias("least"))
    classes = named.join(smallest, "component").select("hi", "lo", "least")
    out = rows.select("doc_id", "text_key", "hi", "lo").join(classes, ["hi", "lo"])
    return out.select("doc_id", "text_key", F.col("least.doc_id").alias("component_id"), ((F.col("doc_id") == F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))).alias("keeps"))


def keep_one_copy(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, the one with the smallest doc_id (of several texts of
    that id the one with the smallest hash), its equal rows once; and all rows without doc_id.
    Rows of one id with different texts are documents of their own."""
    kept = written(near_copy_classes(docs, **options).where("keeps").select("doc_id", "text_key").distinct(), "kept")
    rows = boxed(docs).withColumn("_id", F.col("doc.doc_id").cast("long")).withColumn("_key", row_key())
    chosen = rows.join(kept, (rows["_id"] == kept["doc_id"]) & (rows["_key"] == kept["text_key"]), "left_semi").dropDuplicates(["_id", "_key"])
    return unboxed(chosen.unionByName(rows.where("_id IS NULL")), docs)
