"""Best-fit packing of documents into training sequences.

Documents become pieces of at most ``CAPACITY`` tokens. Lengths are whole numbers up
to that, so a histogram of at most ``CAPACITY`` counts stands for all pieces and the
plan is made from it: first the reduction of Martello and Toth fixes sequences that
dominate all others with the same longest piece, then best-fit decreasing packs what
is left, many equal sequences at a time. The plan says which ranks of a length go
where; each piece then finds its place by its rank among the pieces of its length.

A rank is the number of such pieces in earlier partitions of the written table, from
their counts, plus the number before it in its own, so no length is gathered in one
task. Null and empty texts are one piece, the end token. Repeated rows are packed
once each. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import os
import string
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marketloom.llm.common import by_batch, plain, written

CAPACITY = 2048
END = 0
#: Words whose ids a task remembers, and as many older ones; longer ones than this are not remembered.
CACHE, CACHED_WORD = 250_000, 40
#: The signs of ASCII, which the tokenizer cuts from the letters before them.
SIGNS = string.punctuation


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> callable:
    """texts -> ids of each as little-endian 32-bit bytes.

    The tokenizer never joins what white space parts, so each part is encoded once
    and remembered. It doesn't join letters with signs after them either, and it
    lower-cases, so a word of letters up to ``ÿ`` is remembered for all its spellings
    and goes straight to the tokenizer's model, as the bytes its byte level names.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, older = Tokenizer.from_file(path), {}
    tokenize, names = tokenizer.model.tokenize, byte_names()

    def whole(word: str) -> bytes:
        return array("I", tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids).tobytes()

    class Cache(dict):
        """The ids of words, encoded where they are first asked for."""

        def __missing__(self, word: str) -> bytes:
            if len(word) > CACHED_WORD:
                return whole(word)
            if (ids := older.get(word)) is None:
                core = word.rstrip(SIGNS)
                if not core.isalpha() or max(core) > "\xff":
                    ids = whole(word)
                else:
                    low = core.lower()
                    if (ids := self.get(low)) is None and (ids := older.get(low)) is None:
                        name = low if low.isascii() else low.encode().decode("latin-1").translate(names)
                        ids = array("I", [t.id for t in tokenize(name)]).tobytes()
                    self[low] = ids
                    if len(core) < len(word):
                        ids += self[word[len(core) :]]
            self[word] = ids
            return ids

    cache = Cache({"": b""})

    def encode(texts: list[str]) -> list[bytes]:
        if len(cache) > CACHE:
            older.clear()
            older.update(cache)
            cache.clear()
            cache[""] = b""
        return [b"".join(map(cache.__getitem__, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) for t in texts]

    return encode


def byte_names() -> dict[int, str]:
    """The character by which a byte-level vocabulary names each byte: itself where
    it is visible, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(hidden)}


def _pieces(path: str, capacity: int) -> callable:
    def make() -> callable:
        encode, end, counts, part = encoder(path), np.array([END], "<u4").tobytes(), Counter(), TaskContext.get().partitionId()

        def work(batch: pa.RecordBatch) -> dict:
            out: dict = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")}
            texts = [t or "" for t in batch["text"].to_pylist()]
            doc = batch["doc_id"].to_pylist()
            for at in range(0, len(texts), 64):
                for d, ids in zip(doc[at : at + 64], encode(texts[at : at + 64]), strict=True):
                    ids += end
                    for n, start in enumerate(range(0, len(ids) // 4, capacity)):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        length = len(piece) // 4
                        for name, value in zip(out, (d, n, start, length, zlib.crc32(piece), part, counts[length]), strict=True):
                            out[name].append(value)
                        counts[length] += 1
            return out

        return work

    return make


def cut_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document; nth counts those of a length in their partition."""
    df = plain(docs, "doc_id", "text")
    kind = to_arrow_schema(df.select("doc_id").schema).field(0)
    schema = pa.schema([kind, ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
    ddl = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, nth long"
    return df.mapInArrow(by_batch(_pieces(path or default_tokenizer(), capacity), schema), ddl)


Run = tuple[list[tuple[int, int]], int]


def reduce_dominated(left: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Fixes sequences that some best packing has, taking them out of ``left``.

    For the longest piece L and room R = capacity - L: without a piece that fits, L
    stays alone. A piece of length R fills the room exactly. Otherwise the longest
    that fits, k, goes with L if no other set that fits can take more: no three
    pieces fit, and no two that fit together are longer than k.
    """
    fixed: list[Run] = []
    changed = True
    while changed:
        changed = False
        for length in sorted(left, reverse=True):
            while n := left.get(length, 0):
                room = capacity - length
                sizes = sorted(s for s, c in left.items() if c and s <= room and (s != length or c > 1))
                if not sizes:
                    partner, count = None, n
                else:
                    partner = sizes[-1]
                    smallest = [s for s in sizes for _ in range(min(3, left[s] - (s == length)))][:3]
                    if partner < room and len(smallest) > 1 and (sum(smallest) <= room and len(smallest) > 2 or best_pair(sizes, left, length, room) > partner):
                        break
                    count = n // 2 if partner == length else min(n, left[partner])
                fixed.append(([(length, 2)] if partner == length else [(length, 1)] + [(partner, 1)] * (partner is not None), count))
                for s in (length, partner):
                    if s:
                        left[s] -= count
                        if not left[s]:
                            del left[s]
                changed = True
    return fixed


def best_pair(sizes: list[int], left: dict[int, int], length: int, room: int) -> int:
    """The largest sum of two pieces that fit together; 0 if none do."""
    best = 0
    for i, s in enumerate(sizes):
        at = bisect.bisect_right(sizes, room - s) - 1
        if at == i and left[s] - (s == length) < 2:
            at -= 1
        if at >= 0:
            best = max(best, s + sizes[at])
    return best


def best_fit(left: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing over counts: pieces of a length go to the fullest
    sequences with room, as many to each as fit, all equal sequences at a time."""
    rooms: list[int] = []  # sorted, with the sequences of each room
    kept: dict[int, list[Run]] = {}

    def put(room: int, run: Run) -> None:
        if room not in kept:
            bisect.insort(rooms, room)
            kept[room] = []
        kept[room].append(run)

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                room, pattern, count = capacity, [], -(-n // (capacity // length))
            else:
                room = rooms[at]
                pattern, count = kept[room].pop()
                if not kept[room]:
                    del kept[room]
                    rooms.pop(at)
            each = room // length
            full = min(count, n // each)
            if full:
                put(room - each * length, (pattern + [(length, each)], full))
                n -= full * each
            rest = count - full
            if rest and n:  # fewer than ``each`` are left
                put(room - n * length, (pattern + [(length, n)], 1))
                rest, n = rest - 1, 0
            if rest and pattern:
                put(room, (pattern, rest))
    return [run for room in rooms for run in kept[room]]


def packing_plan(lengths: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[str, np.ndarray], int]:
    """Where each rank of a length goes, as columns sorted by (length, first rank),
    and the number of sequences."""
    left = {s: c for s, c in lengths.items() if c}
    patterns = reduce_dominated(left, capacity) + best_fit(left, capacity)
    used, sequence, rows = Counter(), 0, []
    for pattern, count in patterns:
        offset = 0
        for length, each in pattern:
            rows.append((length, used[length], each, sequence, offset))
            used[length] += each * count
            offset += each * length
        sequence += count
    if used != Counter(lengths):
        raise AssertionError("the plan misses pieces")
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "each", "sequence", "offset"), columns, strict=True)), sequence


def _placed(plan: dict[str, np.ndarray], names: list[str]) -> callable:
    def make() -> callable:
        width = np.int64(1) << 50
        key = plan["length"] * width + plan["rank"]

        def work(batch: pa.RecordBatch) -> dict:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(key, length * width + rank, side="right") - 1
            nth, each = rank - plan["rank"][at], plan["each"][at]
            return {c: batch[c] for c in names} | {"sequence_id": plan["sequence"][at] + nth // each, "offset": plan["offset"][at] + nth % each * length}

        return work

    return make


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    The driver sees the histogram and the plan, whose sizes the capacity bounds.
    """
    pieces = written(cut_pieces(docs, path, capacity), "pieces")
    counts = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    plan, _ = packing_plan(dict(counts.groupBy("length").agg(F.sum("n")).collect()), capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    df = ranked.select(*names, "rank")
    schema = pa.schema([*to_arrow_schema(df.select(*names).schema), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*names).schema) + ", sequence_id long, offset long"
    return df.mapInArrow(by_batch(_placed(plan, names), schema), ddl)
