"""Harmonic packing: exact round trip, no padding, whole short documents."""

import random
import string
import zlib
from array import array
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marketloom.llm import harmonic_packing
from marketloom.llm.common import table

SF = "/root/testdata/sf0.001"


def tokens(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(harmonic_packing.default_tokenizer())
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def packed_right(rows, capacity):
    """Sequences are gapless and fit; returns the padding that they need."""
    sequences = defaultdict(list)
    for sequence, offset, length in rows:
        sequences[sequence].append((offset, length))
    padding = 0
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
        padding += capacity - end if end & (end - 1) else 0
    return padding


def test_encoder_equals_the_tokenizer():
    rng = random.Random(1)
    pool = [" "] * 20 + list("\n\t\r\x0b\x1c\x1f\x85\xa0 ​　.,,..'!?-_09aZéßÀɐжЖ中한ªº²½١́\x00\U0001f600﻿") + ["<|endoftext|>", "ab", "don't", "The", "we'll"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(8000)] + ["word " * 30, "x" * 500 + " " + "y" * 500]
    encode = harmonic_packing.encoder(harmonic_packing.default_tokenizer())
    got = [ids for at in range(0, len(texts), 64) for ids in encode(texts[at : at + 64])]
    assert got == [array("I", ids).tobytes() for ids in tokens(texts)]


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(harmonic_packing, "CACHE", 3)
    encode = harmonic_packing.encoder(harmonic_packing.default_tokenizer())
    texts = [f"one two three{i} four. five, {i}" for i in range(9)] * 2
    assert [encode([t])[0] for t in texts] == [array("I", ids).tobytes() for ids in tokens(texts)]


def test_known_words_are_not_encoded_again(monkeypatch):
    import tokenizers

    inner, asked = tokenizers.Tokenizer.from_file(harmonic_packing.default_tokenizer()), []

    class Counting:
        model = property(lambda self: self)
        get_added_tokens_decoder = inner.get_added_tokens_decoder
        from_file = classmethod(lambda cls, path: cls())

        def tokenize(self, name):
            asked.append(name)
            return inner.model.tokenize(name)

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return inner.encode_batch_fast(texts, **options)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    encode = harmonic_packing.encoder("")
    words, signs, breaks = ["word", "Other", "été"], [*string.punctuation, "!?"], ["\n", "\n\n\n", "\t"]
    encode([f"{w} {w}" for w in words] + [f"x{s}" for s in signs] + [f"x{b}x" for b in breaks])
    asked.clear()
    texts = [f"{v}{s}{b}{w} {v}{s}" for v in words for w in words for s in signs for b in breaks]
    got = encode(texts)
    assert asked == []
    monkeypatch.undo()
    assert got == [array("I", ids).tobytes() for ids in tokens(texts)]


@pytest.mark.parametrize("seed", range(6))
def test_packer(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, rng.randint(1, 12), rng.randint(20, 64), rng.randint(1, 400)][: 4 if seed % 2 else 3]) for _ in range(rng.choice([0, 1, 5, 400]))]
    packer = harmonic_packing.Packer(7, 64, 16)
    for doc, n in enumerate(lengths):
        packer.add(doc, array("I", range(doc * 1000, doc * 1000 + n)).tobytes())
        assert sum(len(p) for p in packer.open.values()) <= 16 * 16 and len(packer.waiting) <= harmonic_packing.WAITING
        assert packer.reserve < 64 + harmonic_packing.RESERVE + n
    packer.finish()
    back = defaultdict(bytes)
    for doc, start, ids, whole, _, _ in sorted(packer.rows, key=lambda r: r[:2]):
        assert start * 4 == len(back[doc]) and whole == lengths[doc]
        back[doc] += ids
    assert [array("I", back[d]).tolist() for d in range(len(lengths))] == [list(range(d * 1000, d * 1000 + n)) for d, n in enumerate(lengths)]
    assert packed_right([(r[4], r[5], len(r[2]) // 4) for r in packer.rows], 64) == 0


def test_a_class_takes_its_number_of_documents():
    packer = harmonic_packing.Packer(0, 64, 16)
    packer.add("long", bytes(4 * 1000))
    for n in range(9):
        packer.add(n, bytes(4 * 20))  # 64 // 20 = 3 a sequence, 4 tokens free
    packer.finish()
    used = defaultdict(list)
    for doc, start, ids, _, sequence, _ in packer.rows:
        used[sequence].append((doc, start, len(ids) // 4))
    threes = [s for s in used.values() if s[0][0] != "long"]
    assert sorted(tuple(d for d, _, n in s if d != "long") for s in threes) == [(0, 1, 2), (3, 4, 5), (6, 7, 8)]
    assert all(s[-1][0] == "long" and s[-1][2] == 4 for s in threes)


def test_query(spark):
    rows = [(900001, None), (900002, ""), (900003, " \n\t "), (900004, "tie"), (900004, "tie"), (None, "no id <|endoftext|> \n  x"), (900005, "Ünï 中文 " * 3000), (900006, "a b\n" * 20_000)]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    docs = table(spark, SF, "documents").select("doc_id", "text").union(extra).withColumns({c: F.lit("clash") for c in ("start", "length", "offset", "piece")}).repartition(3).cache()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = harmonic_packing.pack_harmonic(docs).collect()
    want, whole = defaultdict(list), Counter()
    for (d, _), ids in zip(texts, tokens([t or "" for _, t in texts]), strict=True):
        want[d].append([*ids, 1])
        whole[d, len(ids) + 1] += 1
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    assert by_doc.keys() == want.keys()
    for d, pieces in by_doc.items():
        if len(want[d]) == 1:
            ids, at = want[d][0], 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(array("I", ids[at : at + r.length]).tobytes())
                at += r.length
            assert at == len(ids)
        else:
            assert sum(r.length for r in pieces) == sum(map(len, want[d]))
    assert packed_right([(r.sequence_id, r.offset, r.length) for r in got], 2048) == 0
    short = [r for r in got if r.doc_tokens <= 2048]
    # the open sequences at the end of three small partitions are cut
    assert sum(r.length == r.doc_tokens for r in short) > 0.8 * len(short)
    assert harmonic_packing.pack_harmonic(docs.limit(0)).collect() == []
