"""Ranked lexical search of a query set over all documents, by classes of equal bags.

Documents are restricted to the vocabulary of the queries. Those with the same
term-frequency vector over it and the same length norm m have the same score for every
query: they are one class, found by a hash of both and verified by comparing both.
A class is scored once; its members are expanded by ascending doc_id at the end.

A query needs no more than its 50 best classes by (score, smallest doc_id): each class
before another brings at least one document before all of that one's.

Queries are taken in blocks of about ``BLOCK`` (query, term) pairs, whatever the number
of documents, so what a task and the driver hold of them is bounded (by one query if
that has more terms). The vocabulary meets the documents' terms in an equi-join, so it
may be of any size. Equal documents combine in the map tasks before the shuffle, a hot
term only ever counts, and of a hot class no more than 50 ids a task are shuffled.

A null or empty text has no terms: it isn't counted and matches nothing. Every row of
the documents is one document, rows of the same doc_id too; null doc_ids rank after
others of the same score. Rows of the queries with the same item_id are one query with
the terms of all; rows without item_id are ignored. Other columns are ignored. An
empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marketloom.llm.common import plain, written

BEST = 50
#: (query, term) pairs of a block: some 10 MB in a task.
BLOCK = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: str) -> Column:
    """The terms of a text in their order, repeats included; none of null."""
    words = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)
    return F.coalesce(words, F.array().cast("array<string>"))


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of every query."""
    return plain(items, "item_id", "text").where("item_id IS NOT NULL").select("item_id", F.explode(terms_of("text")).alias("term")).distinct()


def restricted(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, n, vector) of every document with a term: n counts its terms with
    repeats, vector holds (tid, tf) of those in the vocabulary (term, tid), by tid.

    A document's rows carry the number that its scan gave it; the row with the empty
    term, which the vocabulary holds as -1, brings the document itself along.
    """
    df = plain(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), terms_of("text").alias("terms")).where(F.size("terms") > 0)
    df = df.select("row", "doc_id", F.size("terms").alias("n"), F.explode(F.concat(F.array(F.lit("")), "terms")).alias("term"))
    mark = df.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(-1).cast("long").alias("tid"))
    held = df.join(vocabulary.union(mark), "term")
    counts = held.groupBy("row", "tid").agg(F.count("*").cast("int").alias("tf"), F.max(F.when(F.col("tid") < 0, F.col("doc_id"))).alias("doc_id"), F.max(F.when(F.col("tid") < 0, F.col("n"))).alias("n"))
    rows = counts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("tid") >= 0, F.struct("tid", "tf")))).alias("vector"))
    return rows.drop("row")


def bag_classes(vectors: DataFrame, n_docs: int, n_terms: int) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, key, m, vector) and their classes (key, m, vector,
    least, cid): equal m and vector, met under their hash. ``least``: whether a
    doc_id is there and the smallest, nulls last."""
    m = F.expr(f"50L + (50L * n * {n_docs}L) DIV {max(1, n_terms)}L")
    docs = vectors.where(F.size("vector") > 0).select("doc_id", m.alias("m"), "vector").withColumn("key", F.xxhash64("m", "vector"))
    docs = written(docs, "bags")
    last = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"))
    classes = docs.groupBy("key", "m", "vector").agg(F.min(last).alias("least"))
    return docs, written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")


class Block:
    """Some queries as a matrix: for each term its weight and the queries with it."""

    def __init__(self, pairs: list[tuple], n_docs: int):
        self.items = sorted({p[0] for p in pairs})
        place = {item: n for n, item in enumerate(self.items)}
        pairs = sorted((tid, place[item], df) for item, tid, df in pairs)
        tids = np.array([p[0] for p in pairs], np.int64)
        self.tid, first = np.unique(tids, return_index=True)
        self.first, self.count = first, np.diff(np.append(first, len(tids)))
        self.query = np.array([p[1] for p in pairs], np.int64)
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * pairs[at][2] + 1))) for at in first], np.int64)

    def scores(self, owner: np.ndarray, tid: np.ndarray, tf: np.ndarray, m: np.ndarray, n: int) -> np.ndarray:
        """Scores (n classes x queries) from postings: class, term, tf and the class's m."""
        at = np.minimum(np.searchsorted(self.tid, tid), max(len(self.tid) - 1, 0))
        known = self.tid[at] == tid
        at, owner, tf, m = at[known], owner[known], tf[known], m[known]
        value = self.weight[at] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        out = np.zeros(n * len(self.items), np.int64)
        # a stretch of postings at a time, so that very common terms stay small
        ends = np.cumsum(self.count[at])
        for stretch in np.split(np.arange(len(at)), np.flatnonzero(np.diff(ends // 2_000_000)) + 1):
            count = self.count[at[stretch]]
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            query = self.query[np.repeat(self.first[at[stretch]], count) + within]
            np.add.at(out, np.repeat(owner[stretch], count) * len(self.items) + query, np.repeat(value[stretch], count))
        return out.reshape(n, len(self.items))


def best_of(block: Block, best: int, schema: pa.Schema, rows: int = 512):
    """For mapInArrow over classes (cid, m, vector, none, doc_id): the ``best``
    classes of each query in a partition, as (item_id, score, none, doc_id, cid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        width = len(block.items)
        # each query's best so far: score, then least doc_id, as sort keys
        kept = [np.zeros((4, 0), np.int64) for _ in range(width)]
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                vector = part["vector"]
                size = vector.value_lengths().to_numpy()
                flat = vector.flatten()
                owner = np.repeat(np.arange(len(size)), size)
                m = part["m"].to_numpy()[owner]
                got = block.scores(owner, flat.field(0).to_numpy(), flat.field(1).to_numpy().astype(np.int64), m, len(size))
                none = part["none"].to_numpy(zero_copy_only=False).astype(np.int64)
                doc = part["doc_id"].fill_null(0).to_numpy()
                cid = part["cid"].to_numpy()
                for q in range(width):
                    mine = got[:, q]
                    floor = kept[q][0, -1] if kept[q].shape[1] == best else 1
                    hit = np.flatnonzero(mine >= floor)
                    if len(hit):
                        rank = np.concatenate([kept[q], np.stack([mine[hit], none[hit], doc[hit], cid[hit]])], axis=1)
                        kept[q] = rank[:, np.lexsort((rank[2], rank[1], -rank[0]))[:best]]
        item = np.repeat(np.arange(width), [k.shape[1] for k in kept]).tolist()
        columns = [[block.items[i] for i in item], *np.concatenate(kept, axis=1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        pa.default_memory_pool().release_unused()

    return run


def first_of(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group with their rank; Spark cuts the groups in
    the map tasks, too."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def lexical_search(docs: DataFrame, items: DataFrame, best: int = BEST, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of every query.

    The driver holds the number of documents and of terms, and one block at a time.
    """
    spark = docs.sparkSession
    pairs = written(query_terms(items), "query-terms")
    vocabulary = written(pairs.select("term").distinct().select("term", F.monotonically_increasing_id().alias("tid")), "vocabulary")
    vectors = written(restricted(docs, vocabulary), "vectors")
    totals = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    found = vectors.select(F.explode("vector.tid").alias("tid")).groupBy("tid").agg(F.count("*").alias("df"))
    pairs = pairs.join(vocabulary, "term").join(found, "tid")
    blocks = max(1, -(-pairs.count() // block))
    pairs = written(pairs.select("item_id", "tid", "df", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")), "query-blocks")
    documents, classes = bag_classes(vectors, totals["n"], totals["terms"])
    scored = classes.select("cid", "m", "vector", F.col("least.none").cast("int").alias("none"), "least.doc_id")
    names = ("score", "none", "doc_id", "cid")
    schema = pa.schema([to_arrow_schema(pairs.select("item_id").schema).field(0), *((n, pa.int64()) for n in names)])
    ddl = ", ".join([f"item_id {pairs.schema['item_id'].dataType.simpleString()}", *(f"{n} long" for n in names)])
    chosen = []
    for number in range(blocks):
        held = [tuple(r) for r in pairs.where(F.col("block") == number).select("item_id", "tid", "df").collect()]
        if held:
            top = scored.mapInArrow(best_of(Block(held, totals["n"]), best, schema), ddl)
            top = first_of(top, ["item_id"], [F.col("score").desc(), F.col("none"), F.col("doc_id")], best)
            chosen.append(written(top.select("item_id", "cid", "score"), "best-classes"))
    if not chosen:
        return spark.createDataFrame([], ddl.split(",")[0] + ", rank int, doc_id long, score long")
    chosen = reduce(DataFrame.union, chosen)
    # the smallest ids of every chosen class: documents that meet it under its hash and equal it
    picked = written(classes.select("cid", "key", "m", "vector").join(chosen.select("cid").distinct(), "cid"), "picked-classes")
    keys = written(picked.select("key").distinct(), "picked-keys")
    members = documents.join(keys, "key", "left_semi").join(picked, ["key", "m", "vector"]).select("cid", "doc_id")
    members = written(first_of(members, ["cid"], [F.col("doc_id").asc_nulls_last()], best).drop("rank"), "members")
    ranked = first_of(chosen.join(members, "cid"), ["item_id"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], best)
    return ranked.select("item_id", "rank", "doc_id", "score")


#: The same in DuckDB, without classes.
SEARCH_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), counted AS (
    SELECT *, len(terms) AS n FROM texts WHERE len(terms) > 0
), totals AS (
    SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM counted
), postings AS (
    SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM counted) GROUP BY row, term
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE item_id IS NOT NULL
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals
), scored AS (
    SELECT item_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN counted USING (row), totals
    GROUP BY item_id, row
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
    FROM scored JOIN counted USING (row) WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""
