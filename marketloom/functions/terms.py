"""Many search terms at once in Python workers: a trie over the bytes of the terms,
walked from all positions of the texts together with array arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of the trie with a table of all edges, and the entries that one may have; other edges are searched.
TABLES, ENTRIES = 4, 1 << 20
#: Levels of the trie; what a term has beyond is compared byte by byte.
DEPTH = 256
#: Positions walked together, which bounds the memory of a walk whatever the texts.
CHUNK = 1 << 19


class Trie:
    """Distinct terms, none of them empty, as one level of edges per byte. A node is numbered within its
    level, an edge is 256 x node + byte, and its place among the level's sorted edges is the next node."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        size = np.fromiter(map(len, terms), np.int64, len(terms))
        data, start = np.frombuffer(b"".join(terms), np.uint8), np.cumsum(size) - size
        node, alive, parents = np.zeros(len(terms), np.int64), np.arange(len(terms)), 1
        self.levels = []
        while alive.size and len(self.levels) < DEPTH:
            depth = len(self.levels)
            edges, at = np.unique(node[alive] * 256 + data[start[alive] + depth], return_inverse=True)
            node[alive] = at
            ends = size[alive] == depth + 1
            term = np.full(len(edges), -1, np.int32)
            term[at[ends]] = alive[ends]
            table = None
            if depth < TABLES and parents * 256 <= ENTRIES:
                table = np.full(parents * 256, -1, np.int32)
                table[edges] = np.arange(len(edges))
            self.levels.append((edges, table, term))
            alive, parents = alive[~ends], len(edges)
        self.long: dict[int, list[int]] = {}
        for i in alive.tolist():
            self.long.setdefault(int(node[i]), []).append(i)

    def _next(self, depth: int, edge: np.ndarray) -> np.ndarray:
        edges, table, _ = self.levels[depth]
        if table is not None:
            return table[edge]
        at = np.searchsorted(edges, edge)
        at[at == len(edges)] = 0
        at[edges[at] != edge] = -1
        return at

    def _walk(self, data: np.ndarray, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, int | np.ndarray]]:
        """(positions, terms, lengths) of all that starts between ``begin`` and ``end``, across the bounds of texts, too."""
        at = self._next(0, data[begin:end].astype(np.int64))
        for depth, (_, _, term) in enumerate(self.levels):
            if depth == 0:
                pos = np.flatnonzero(at >= 0)
                at, pos = at[pos], pos + begin
            else:
                pos = pos[: np.searchsorted(pos, len(data) - depth)]
                at = self._next(depth, at[: len(pos)].astype(np.int64) * 256 + data[pos + depth])
                held = np.flatnonzero(at >= 0)
                at, pos = at[held], pos[held]
            found = term[at]
            ends = np.flatnonzero(found >= 0)
            yield pos[ends], found[ends], depth + 1
            if not len(pos):
                return
        for p, n in zip(pos.tolist(), at.tolist(), strict=True) if self.long else ():
            for i in self.long.get(n, ()):
                if data[p + DEPTH : p + len(self.terms[i])].tobytes() == self.terms[i][DEPTH:]:
                    yield np.array([p]), np.array([i]), len(self.terms[i])

    def find(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sorted, distinct text x number of terms + term, of the texts that ``offsets`` (one more than texts) cut ``data`` into."""
        met = [np.empty(0, np.int64)]
        for begin in range(int(offsets[0]), int(offsets[-1]), CHUNK):
            end = min(begin + CHUNK, int(offsets[-1]))
            first, last = np.searchsorted(offsets, begin, "right") - 1, np.searchsorted(offsets, end, "left")
            text = np.repeat(np.arange(first, last), np.diff(np.clip(offsets[first : last + 1], begin, end)))
            keys = []
            for pos, term, length in self._walk(data, begin, end):
                of = text[pos - begin]
                keys.append((of * len(self.terms) + term)[pos + length <= offsets[of + 1]])
            met.append(_distinct(np.concatenate(keys)))
        return _distinct(np.concatenate(met))


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys.sort()
    return keys[np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]))]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; a NULL is empty."""
    column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    cuts = np.frombuffer(offsets, kind)[column.offset :][: len(column) + 1] if len(column) else np.zeros(1, kind)
    return np.frombuffer(data or b"", np.uint8)[: cuts[-1]], cuts.astype(np.int64)


def held_terms(text: str, terms: list[bytes]) -> Column:
    """Array of those ``terms`` (distinct, not empty, UTF-8) that a text contains, each once."""

    def held(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie, names = Trie(terms), pa.array(terms, pa.binary())
        for column in columns:
            data, offsets = _texts(column)
            met = trie.find(data, offsets)
            ends = np.searchsorted(met, np.arange(len(column) + 1) * len(terms))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(met % len(terms))))

    return F.arrow_udf(held, "array<binary>")(F.col(text).cast("string"))
