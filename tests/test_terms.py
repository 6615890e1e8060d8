import random

import numpy as np
import pyarrow as pa
import pytest

from marketloom.functions import terms as many


def found(column, terms):
    trie = many.Trie(terms)
    return [(int(k) // len(terms), int(k) % len(terms)) for k in trie.find(*many._texts(column))]


def wanted(column, terms):
    return [(i, j) for i, x in enumerate(column.to_pylist()) for j, t in enumerate(terms) if x and t in x.encode()]


@pytest.mark.parametrize("chunk,depth,tables", [(1 << 19, 256, 4), (3, 256, 4), (7, 2, 1), (1 << 19, 5, 0)])
def test_trie_is_contains(monkeypatch, chunk, depth, tables):
    """Texts cut into chunks, terms beyond the trie, edges with and without a table, against plain search."""
    for name, value in (("CHUNK", chunk), ("DEPTH", depth), ("TABLES", tables)):
        monkeypatch.setattr(many, name, value)
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice(["a", "b", "ab", "é", "語", " "]) for _ in range(rng.randint(0, n)))
    for _ in range(25):
        column = pa.array([rng.choice([None, "", make(20), make(60)]) for _ in range(rng.randint(0, 20))] + [make(5)])
        terms = sorted({make(8).encode() for _ in range(40)} - {b""})
        for x in (column, column.cast(pa.large_string()), column.slice(len(column) // 2)):
            assert found(x, terms) == wanted(x, terms)


def test_trie_edges():
    """Terms longer than the trie is deep, whole texts as terms, a term across two texts, no text at all."""
    x = "ab" * 500
    long = [x[:n].encode() for n in (255, 256, 257, 300, 1000)] + [x[:400].encode() + b"z", x[1:].encode() + x.encode()]
    column = pa.array([x, x[1:], "", None, x[:300]])
    assert found(column, long) == wanted(column, long)
    assert found(pa.array(["xa", "bx"]), [b"ab", b"b"]) == [(1, 1)]
    assert found(pa.array([], pa.string()), [b"a"]) == found(pa.array([None, ""], pa.string()), [b"a"]) == []
    assert many._distinct(np.array([3, 1, 3])).tolist() == [1, 3]
