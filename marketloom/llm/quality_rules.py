"""Quality rules, with repetition measured by a suffix array.

The words of a document are a sequence; its suffixes are sorted by prefix doubling,
and neighbours in that order give, by the ranks kept at each doubling, the longest
prefix that a suffix shares with any other. Where that is ``LEAST`` words or more, the
prefix is an occurrence of a maximal repeated substring (an interval of longest
common prefixes). The union of these spans is the covered part. A document fails if
the covered part exceeds ``COVERED`` of its words or a repeat exceeds ``LONGEST``.

Documents are sorted together, in chunks of ``CHUNK`` words, with words numbered by
document, so that no match crosses two documents. Null and empty texts have no words
and fail the base rules. Every row is judged by itself. Columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marketloom.llm.common import plain

#: A repeat has this many words at least; the part of the words it may cover; the longest that may be.
LEAST, COVERED, LONGEST = 8, 0.4, 100
CHUNK = 200_000
SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"


def ranks(values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For 1, 2, 4, ... words: a number for each position, equal where so many words
    are equal, until all differ; and the suffix array. The last value must be unique."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    head = np.append(True, values[order][1:] != values[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, width = [rank], 1
    while True:
        lone = head & np.append(head[1:], True)
        active = order[~lone]
        if not len(active):
            return levels, order
        place = np.flatnonzero(~lone)
        after = rank[np.minimum(active + width, n - 1)]
        by = np.lexsort((after, rank[active]))
        active, after, old = active[by], after[by], rank[active][by]
        order[place] = active
        new = np.append(True, (old[1:] != old[:-1]) | (after[1:] != after[:-1]))
        head[place] = new
        rank = rank.copy()
        rank[active] = np.maximum.accumulate(np.where(new, place, 0))
        levels.append(rank)
        width *= 2


def shared_lengths(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """For each suffix, the longest prefix it shares with another."""
    n = len(order)
    a, b, common = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        equal = (np.maximum(x, y) < n) & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        common += equal << k
    out = np.zeros(n, np.int64)
    out[b] = common
    out[a] = np.maximum(out[a], common)
    return out


def measured(documents: list[list[bytes]], least: int = LEAST) -> dict[str, np.ndarray]:
    """Per document: words in repeated 3-word windows, words covered by repeats of
    ``least`` words or more, the longest repeat."""
    sizes = np.array([len(d) for d in documents], np.int64)
    out = {c: np.zeros(len(documents), np.int64) for c in ("n_repeat_words", "n_covered", "longest_repeat")}
    if not sizes.sum():
        return out
    numbers: list[int] = []
    offset = 0
    for words in documents:
        index: dict[bytes, int] = {}
        numbers += [index.setdefault(w, len(index)) + offset for w in words]
        offset += len(index)
    values = np.array([*numbers, -1], np.int64)
    owner = np.repeat(np.arange(len(documents)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    n = len(numbers)
    levels, order = ranks(values)

    def per_document(first: np.ndarray, length: np.ndarray) -> np.ndarray:
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + length, -1)
        return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=len(documents))

    if len(levels) > 1:
        at = np.flatnonzero(np.arange(n) + 3 <= end)
        pair, third = levels[1][at], levels[0][at + 2]
        by = np.lexsort((third, pair))
        new = np.append(True, (pair[by][1:] != pair[by][:-1]) | (third[by][1:] != third[by][:-1])) if len(at) else np.zeros(0, bool)
        twice = at[by[~(new & np.append(new[1:], True))]] if len(at) else at
        out["n_repeat_words"] = per_document(twice, np.full(len(twice), 3))
        shared = shared_lengths(levels, order)[:n]
        long = np.flatnonzero(shared >= least)
        out["n_covered"] = per_document(long, shared[long])
        np.maximum.at(out["longest_repeat"], owner[long], shared[long])
    return out


def simple_counts(text: str) -> tuple[int, int, int]:
    """word_chars, n_symbols, n_dup_lines."""
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def _judged(schema: pa.Schema, least: int, chunk: int) -> callable:
    def run(batches):
        for batch in batches:
            docs, texts, size, first = [], [], 0, 0

            def done():
                more = measured(docs, least)
                simple = list(zip(*texts, strict=True))
                columns = [[len(d) for d in docs], *simple, *(more[c] for c in COUNTS[4:])]
                ids = batch["doc_id"].slice(first, len(docs))
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) if i else ids for i, (c, f) in enumerate(zip([ids, *columns], schema, strict=True))], schema=schema)

            for value in batch["text"]:
                text = value.as_py() or ""
                docs.append(text.encode("utf-8", "surrogatepass").split())
                texts.append(simple_counts(text))
                size += len(docs[-1])
                if size >= chunk:
                    yield done()
                    first += len(docs)
                    docs, texts, size = [], [], 0
            if docs:
                yield done()

    return run


def measure_quality(docs: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """doc_id and the counts of every document."""
    df = plain(docs, "doc_id", "text")
    kind = to_arrow_schema(df.select("doc_id").schema).field(0)
    schema = pa.schema([kind, *((c, pa.int64()) for c in COUNTS)])
    ddl = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)
    return df.mapInArrow(_judged(schema, least, chunk), ddl)


def quality_report(docs: DataFrame, covered: float = COVERED, longest: int = LONGEST) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    method = (F.col("n_covered") <= covered * F.col("n_words")) & (F.col("longest_repeat") <= longest)
    return measure_quality(docs).withColumn("base_failed", failed).withColumn("kept", ~failed & method)
