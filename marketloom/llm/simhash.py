"""Near-duplicates by SimHash, with pigeonring filtering.

A fingerprint of 64 bits is cut into 16 segments of 4 bits, laid out as a ring.
If two fingerprints differ in at most 3 bits, then some segment starts a chain in
which every prefix of n consecutive segments differs in at most 3 n / 16 bits, so
no bit in the first 5, one at most in the first 10, two at most in the first 15
(the strong form of the pigeonhole principle). Hence such a pair meets in a bucket
keyed by (start, the first 20 bits, one of the two halves of the next 20 bits
that is equal). In a bucket, pairs whose chain exceeds a budget are dropped, and
only the rest is held against the full Hamming distance.

What goes into the buckets are distinct fingerprints, so copies meet once. A
bucket yields a spanning forest of its links, not its pairs: from each fingerprint
the search goes only to those not reached yet, which is short in a dense bucket. A
bucket of more than ``BLOCK`` fingerprints is cut into blocks, and each pair of
blocks is one group; all links are found whatever the size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import by_batch, plain, written
from marketloom.llm.components import components

SEED = 42
MAX_DISTANCE = 3
SHINGLE = 3
SEGMENT = 4
#: (first segments, bits that may differ in them): the budgets that bind.
BUDGETS = ((5, 0), (10, 1), (15, 2))
STARTS = range(0, 64, SEGMENT)
BLOCK = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash over word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def _fingerprinted() -> callable:
    def work(batch: pa.RecordBatch) -> dict:
        got = np.array([fingerprint(t) for t in batch["text"].to_pylist()], np.uint64)
        return {"doc_id": batch["doc_id"], "fp": got.view(np.int64)}

    return work


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null texts have no words."""
    df = plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return df.mapInArrow(by_batch(_fingerprinted, pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])), "doc_id long, fp long")


def rotated(x: np.ndarray, start: int) -> np.ndarray:
    """The bits from ``start`` on, around the ring."""
    return x if start == 0 else (x >> np.uint64(start)) | (x << np.uint64(64 - start))


def in_budget(difference: np.ndarray, start: int, most: int = MAX_DISTANCE) -> np.ndarray:
    """Which differences keep to the chain's budgets from ``start`` on, and to ``most`` in all."""
    ring = rotated(difference, start)
    ok = (ring & np.uint64((1 << 20) - 1)) == 0
    for segments, bits in BUDGETS[1:]:
        ok &= np.bitwise_count(ring & np.uint64((1 << segments * SEGMENT) - 1)) <= bits
    return ok & (np.bitwise_count(difference) <= most)


def buckets_of(fps: DataFrame) -> DataFrame:
    """(start, key, fp): the 32 buckets of each fingerprint."""

    def keyed() -> callable:
        def work(batch: pa.RecordBatch) -> dict:
            x = batch["fp"].to_numpy().view(np.uint64)
            start, key = [], []
            for s in STARTS:
                ring = rotated(x, s)
                low = ring & np.uint64((1 << 20) - 1)
                for half in (0, 1):
                    mid = (ring >> np.uint64(20 + 10 * half)) & np.uint64(1023)
                    key.append(((low << np.uint64(11)) | (mid << np.uint64(1)) | np.uint64(half)).view(np.int64))
                    start.append(np.full(len(x), s, np.int32))
            return {"start": np.concatenate(start), "key": np.concatenate(key), "fp": np.tile(x.view(np.int64), len(key))}

        return work

    schema = pa.schema([("start", pa.int32()), ("key", pa.int64()), ("fp", pa.int64())])
    return fps.mapInArrow(by_batch(keyed, schema), "start int, key long, fp long")


def forest(x: np.ndarray, start: int, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked in a bucket. ``group``: two values if
    only links across the two count."""
    out, left = [], np.arange(len(x))
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            i = frontier.pop()
            near = in_budget(x[left] ^ x[i], start)
            if group is not None:
                near &= group[left] != group[i]
            if near.any():
                out += [(i, j) for j in left[near].tolist()]
                frontier += left[near].tolist()
                left = left[~near]
    return out


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that connect
    all fingerprints within ``MAX_DISTANCE`` of one another."""
    rows = buckets_of(fps)
    large = rows.groupBy("start", "key").count().where(F.col("count") > block).select("start", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    large = written(large, "large-buckets")
    rows = rows.join(large, ["start", "key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("own", own).withColumn("other", other)
    rows = rows.select("start", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    names = ["start", "key", "i", "j"]

    def run(batches):
        held: list = []

        def found(cols: list[np.ndarray]) -> pa.RecordBatch:
            start, i, j, own, fp = cols[0], cols[2], cols[3], cols[4], cols[5]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            a, b = [], []
            ends = np.append(change, len(start))
            firsts = np.append(0, change)
            size = ends - firsts
            for n in (2,):  # most buckets with a pair have two
                at = firsts[size == n]
                x, y = fp[at].view(np.uint64), fp[at + 1].view(np.uint64)
                ok = np.zeros(len(at), bool)
                for s in STARTS:
                    here = start[at] == s
                    ok[here] = in_budget(x[here] ^ y[here], s)
                ok &= (i[at] == j[at]) | (own[at] != own[at + 1])
                a.append(x[ok])
                b.append(y[ok])
            for f, e in zip(firsts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
                x = fp[f:e].view(np.uint64)
                pairs = forest(x, int(start[f]), own[f:e] if i[f] != j[f] else None)
                if pairs:
                    p = np.array(pairs)
                    a.append(x[p[:, 0]])
                    b.append(x[p[:, 1]])
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch[c].to_numpy() for c in (*names, "own", "fp")]
            if held:
                cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            last = np.flatnonzero(np.any([c != c[-1] for c in cols[:4]], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield found([c[:cut] for c in cols])
            held = [c[cut:].copy() for c in cols]
        if held and len(held[0]):
            yield found(held)

    return rows.repartition(*names).sortWithinPartitions(*names, "fp").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the class of every document.

    Rows of one doc_id are one document each, under the same id. A null doc_id
    takes part but names no class. Empty texts have fingerprint 0 and are linked
    like any other. Columns other than doc_id and text are ignored.
    """
    rows = written(fingerprints(docs), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    found = written(links(nodes.select("fp")), "links")
    classes = components(found, "a", "b")
    named = nodes.join(classes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    named = written(named, "named")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = written(named.join(smallest, "component").select("fp", "component_id"), "classes")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
