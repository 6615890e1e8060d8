"""Harmonic packing of documents into training sequences.

A document of n tokens, n at most the capacity C, belongs to the class k = C div n
(the last class, ``CLASSES``, takes all shorter ones), so its length lies in
(C / (k + 1), C / k] and k such documents always fit together. A sequence of class k
takes exactly k documents, whatever their lengths: no search, no state shared between
workers. Every partition packs by itself in one pass, with one open sequence a class.

What a full class leaves free is filled from documents that are cut: those longer
than the capacity, and only if these run out the emptiest waiting sequence, which is
taken apart. Left over at the end of a partition is less than a sequence; it is cut
into sequences whose lengths are powers of two, which need no padding. So no sequence
is padded, and documents up to the capacity mostly stay whole.

A task holds at most one open sequence a class, ``WAITING`` sequences with room,
``RESERVE`` tokens to fill them, and one document. Nothing is shuffled.

Null and empty texts are one piece, the end token. Repeated rows are packed once each.
Columns other than doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from marketloom.llm.common import plain
from marketloom.llm.packing import SIGNS, byte_names

CAPACITY = 2048
END = 1
CLASSES = 64
#: Sequences that wait for tokens to fill them, and tokens kept for that.
WAITING, RESERVE = 64, 32 * CAPACITY
#: Words whose ids a task remembers, and as many older ones; longer ones than this are not remembered.
CACHE, CACHED_WORD = 250_000, 40
#: White space around a space: there the tokenizer's split depends on what is outside the word.
LOOSE = re.compile(r"\s (?:\s|\Z)")
#: What parts lines and columns; between two words that have no white space there, it is split alone.
BREAKS = re.compile(r"([\t\n\r]+)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """texts -> ids of each as little-endian 32-bit bytes.

    The tokenizer's split puts a space to the word after it and never joins across
    it, so each word with its space is encoded once and remembered. It parts lines
    from the words around them, too, and letters up to U+024F from the signs after
    them, so such letters are remembered for all signs and go straight to the
    tokenizer's model as the bytes its byte level names. Texts with spaces next to
    other white space, or with the string of an added token, are encoded whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, older = Tokenizer.from_file(path), {}
    tokenize, names = tokenizer.model.tokenize, byte_names()
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def whole(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    class Cache(dict):
        """The ids of a space and the word, encoded where they are first asked for; a
        key that begins with a space means its word without one."""

        def __missing__(self, key: str) -> bytes:
            if (ids := older.get(key)) is None:
                bare, word = (" ", key[1:]) if key[:1] == " " else ("", key)
                core = word.rstrip(SIGNS)
                if core.isalpha() and (core.isascii() or max(core) <= "ɏ"):
                    if len(core) < len(word):
                        ids = self[bare + core] + self[f" {word[len(core) :]}"]
                    else:
                        name = word if word.isascii() else word.encode().decode("latin-1").translate(names)
                        ids = array("I", [t.id for t in tokenize(name if bare else names[32] + name)]).tobytes()
                elif len(lines := BREAKS.split(word)) > 1 and all([n and not n[0].isspace() and not n[-1].isspace() for n in lines[::2]]):
                    parts = [self[bare + lines[0]]]
                    for gap, line in zip(lines[1::2], lines[2::2], strict=True):
                        # the last sign of a gap before a word is split from the others
                        parts += self[f" {gap[:-1]}"], self[f" {gap[-1]}"], self[f" {line}"]
                    return b"".join(parts)  # not remembered: the same words seldom meet again
                else:
                    ids = whole([word if bare else f" {word}"])[0]
            if len(key) <= CACHED_WORD:
                self[key] = ids
            return ids

    cache = Cache()

    def encode(texts: list[str]) -> list[bytes]:
        nonlocal cache, older
        if len(cache) > CACHE:
            cache, older = Cache(), cache
        odd = [n for n, t in enumerate(texts) if LOOSE.search(t) or any(a in t for a in added)]
        skip = set(odd)
        parts = [[] if n in skip else t.split(" ") for n, t in enumerate(texts)]
        for words in filter(None, parts):
            words[0] = f" {words[0]}"
        out = [b"".join(map(cache.__getitem__, words)) for words in parts]
        for n, ids in zip(odd, whole([texts[n] for n in odd]) if odd else [], strict=True):
            out[n] = ids
        return out

    return encode


class Packer:
    """Packs a stream of documents; ``rows`` gathers (doc, start, ids, doc_tokens,
    sequence, offset) of the pieces placed so far."""

    def __init__(self, first: int, capacity: int = CAPACITY, classes: int = CLASSES):
        self.capacity, self.classes, self.sequence = capacity, min(classes, capacity), first
        self.open: dict[int, list] = defaultdict(list)
        self.waiting: list[tuple[int, list]] = []  # (room, pieces)
        self.fill: deque = deque()
        self.reserve = 0
        self.rows: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        n = len(ids) // 4
        piece = (doc, 0, ids, n)
        if n > self.capacity:
            self.keep([piece])
        else:
            k = min(self.capacity // n, self.classes)
            self.open[k].append(piece)
            if len(self.open[k]) == k:
                pieces = self.open.pop(k)
                self.wait(self.capacity - sum(len(p[2]) // 4 for p in pieces), pieces)
        self.settle(self.capacity + RESERVE, WAITING)

    def keep(self, pieces: list) -> None:
        self.fill.extend(pieces)
        self.reserve += sum(len(p[2]) // 4 for p in pieces)

    def wait(self, room: int, pieces: list) -> None:
        if room:
            self.waiting.append((room, pieces))
        else:
            self.emit(pieces)

    def take(self, most: int) -> list:
        """Up to ``most`` tokens of the reserve."""
        out = []
        while most and self.fill:
            doc, start, ids, whole = self.fill.popleft()
            n = min(most, len(ids) // 4)
            out.append((doc, start, ids[: 4 * n], whole))
            if 4 * n < len(ids):
                # a view, so that a long document isn't copied piece by piece
                self.fill.appendleft((doc, start + n, memoryview(ids)[4 * n :], whole))
            most -= n
            self.reserve -= n
        return out

    def settle(self, reserve: int, waiting: int) -> None:
        """Fills what waits; then keeps to the bounds."""
        while True:
            while self.waiting and self.reserve:
                room, pieces = self.waiting.pop()
                got = self.take(room)
                self.wait(room - sum(len(p[2]) // 4 for p in got), pieces + got)
            if self.reserve >= max(reserve, self.capacity):
                self.emit(self.take(self.capacity))
            elif len(self.waiting) > waiting:
                emptiest = max(range(len(self.waiting)), key=lambda i: self.waiting[i][0])
                self.keep(self.waiting.pop(emptiest)[1])
            else:
                return

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, whole in pieces:
            self.rows.append((doc, start, bytes(ids), whole, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def finish(self) -> None:
        for pieces in self.open.values():
            self.keep(pieces)
        self.open.clear()
        self.settle(self.capacity, 0)
        while self.reserve:
            self.emit(self.take(1 << self.reserve.bit_length() - 1))


NAMES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_harmonic(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every
    piece. Sequence ids hold the partition in their upper bits."""
    df = plain(docs, "doc_id", "text")
    path = path or default_tokenizer()
    schema = pa.schema([to_arrow_schema(df.select("doc_id").schema).field(0), *((n, pa.int64()) for n in NAMES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        encode, end = encoder(path), array("I", [END]).tobytes()
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, classes)

        def placed() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            columns = [[r[0] for r in rows], [r[1] for r in rows], [len(r[2]) // 4 for r in rows], [zlib.crc32(r[2]) for r in rows], *([r[i] for r in rows] for i in (3, 4, 5))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc, ids in zip(part["doc_id"].to_pylist(), encode([t or "" for t in part["text"].to_pylist()]), strict=True):
                    packer.add(doc, ids + end)
                if len(packer.rows) >= 4096:
                    yield placed()
        packer.finish()
        yield placed()
        # the worker lives on and would keep what it freed
        pa.default_memory_pool().release_unused()

    ddl = ", ".join([f"doc_id {df.schema['doc_id'].dataType.simpleString()}", *(f"{n} long" for n in NAMES)])
    return df.mapInArrow(run, ddl)
