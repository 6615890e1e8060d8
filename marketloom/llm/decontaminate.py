"""Benchmark decontamination with a generalised suffix automaton.

The words of the test items go into one automaton. A document streams through it
word by word; the state and the length of the longest match that ends at each word
are tracked. A match of ``WINDOW`` words (or of a whole shorter item) is a hit, and
its words are marked. The items travel in blocks of at most ``BLOCK_WORDS`` words,
each a pass over the documents, so what a task holds is bounded whatever the size of
the benchmark; items longer than a block are cut with an overlap that keeps all
their windows.

Items without id are ignored; null and empty texts, of items or documents, have no
words. Equal items and repeated rows are kept: every document row gets its own
result, and every id of an item that occurs is named once. Columns other than those
named are passed on untouched or ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marketloom.llm.common import boxed, by_batch, plain, runs, unboxed, written

WINDOW = 13
BLOCK_WORDS = 20_000
#: Passes before the rows are written, which keeps plans short.
PASSES = 8
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.next, self.link, self.length = window, [{}], [-1], [0]
        items = [(i, w) for i, w in items if w]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extended(last, w)
        #: Ids of the items by the state of a full window; of short items by state and length.
        self.owners: dict[int, set[str]] = {}
        own: dict[int, dict[int, set[str]]] = {}
        for item, words in items:
            for _, state, length in self.matches(words):
                if len(words) >= window and length >= window:
                    self.owners.setdefault(self._window_state(state), set()).add(item)
            if len(words) < window:
                own.setdefault(state, {}).setdefault(len(words), set()).add(item)
        self.short: dict[int, dict[int, set[str]]] = {}
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__) if own else ():
            if found := self.short.get(self.link[s], {}) | own.get(s, {}):
                self.short[s] = found

    def _state(self, length: int, link: int, following: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _target(self, p: int, w: bytes) -> int:
        """The state that ``w`` leads to from ``p``, split off if it also stands for longer strings."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extended(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            return self._target(last, w)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._target(p, w)
        return new

    def matches(self, words: list[bytes]) -> Iterable[tuple[int, int, int]]:
        """(position, state, length) of the longest match ending at each word that has one."""
        following, link, lengths = self.next, self.link, self.length
        root, state, length = following[0], 0, 0
        for at, w in enumerate(words):
            if state:
                while state and w not in following[state]:
                    state = link[state]
                    length = lengths[state]
                if state:
                    state = following[state][w]
                    length += 1
                    yield at, state, length
                    continue
            if w in root:
                state, length = root[w], 1
                yield at, state, 1

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str], int]:
        """Which words are hit, the items that occur, the longest match."""
        hit, found, longest, short, window = np.zeros(len(words), bool), set(), 0, self.short, self.window
        for at, state, length in self.matches(words):
            if length > longest:
                longest = length
            if length >= window and (owners := self.owners.get(self._window_state(state))):
                hit[at + 1 - window : at + 1] = True
                found |= owners
            if short and state in short:
                for n, owners in short[state].items():
                    if n <= length:
                        hit[at + 1 - n : at + 1] = True
                        found |= owners
        return hit, found, longest


def blocks(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterable[list[tuple[str, list[bytes]]]]:
    """The items with their words, in blocks of bounded size."""
    block, size = [], 0
    rows = plain(items, "item_id", "text").select(F.col("item_id").cast("string"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    for item, text in rows.toLocalIterator():
        words = words_of(text)
        step = max(block_words, window) - window + 1
        pieces = [words[i : i + step + window - 1] for i in range(0, max(1, len(words) - window + 1), step)]
        for piece in pieces if len(words) >= window else [words]:
            if block and size + len(piece) > block_words:
                yield block
                block, size = [], 0
            block.append((item, piece))
            size += len(piece)
    yield block


def _passed(block: list, window: int, names: list[str], first: bool) -> callable:
    def make() -> callable:
        automaton = Automaton(block, window)

        def work(batch: pa.RecordBatch) -> dict:
            out = {c: batch[c] for c in names} | {"n_words": [], "hit_words": [], "item_ids": [], "longest": []}
            before = [None] * batch.num_rows if first else zip(*(batch[c].to_pylist() for c in ("hit_words", "item_ids", "longest")), strict=True)
            for text, old in zip(batch["text"].to_pylist(), before, strict=True):
                words = words_of(text)
                hit, found, longest = automaton.hits(words)
                if old:
                    for x in old[0]:
                        hit[x["start"] : x["end"]] = True
                    found, longest = found | set(old[1]), max(longest, old[2])
                out["n_words"].append(len(words))
                out["hit_words"].append([{"start": a, "end": b} for a, b in runs(hit)] if found else [])
                out["item_ids"].append(sorted(found))
                out["longest"].append(longest)
            return out

        return work

    return make


def find_contamination(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``keep`` columns and text of every document with n_words, hit_words (runs of
    hit words, end exclusive), item_ids (sorted as strings) and the longest match."""
    df = base = plain(docs, *dict.fromkeys((*keep, "text")))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([*to_arrow_schema(base.schema), ("n_words", pa.int64()), ("hit_words", span), ("item_ids", pa.list_(pa.string())), ("longest", pa.int64())])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", n_words long, hit_words array<struct<start:long,end:long>>, item_ids array<string>, longest long"
    for n, block in enumerate(blocks(items, window, block_words)):
        if n and n % PASSES == 0:
            df = written(df, "decontaminated")
        df = df.mapInArrow(by_batch(_passed(block, window, base.columns, n == 0), schema), ddl)
    return df


def contaminated(coverage: int = 20):
    """Whether hits cover a part of 1 / ``coverage`` or more."""
    return (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words"))


def with_hits(found: DataFrame) -> DataFrame:
    return found.withColumn("n_hit", F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]))


def decontamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = with_hits(find_contamination(docs, items))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        "longest",
    )


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words in ``spans`` and what stands between them."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(data.lower())]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def _cut() -> callable:
    def work(batch: pa.RecordBatch) -> dict:
        spans = batch["hit_words"].to_pylist()
        texts = [cut_words(t, [(x["start"], x["end"]) for x in s]) if s else t for t, s in zip(batch["text"].to_pylist(), spans, strict=True)]
        return {"doc": batch["doc"], "text": texts}

    return work


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Drops contaminated documents and cuts the hit words out of the others.
    Documents without hits stay as they are; n_chars, if there, follows the text."""
    rows = boxed(docs)
    found = with_hits(find_contamination(rows, items, ("doc",))).where(~contaminated())
    return unboxed(found.mapInArrow(by_batch(_cut, to_arrow_schema(rows.schema)), rows.schema), docs)
