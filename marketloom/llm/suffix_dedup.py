"""Removal of byte strings that repeat earlier documents, by a depth-limited sort
of suffixes.

The suffixes of all documents are ordered only through their first ``DEPTH`` bytes,
most significant digit first, and equal groups are exactly the repeated strings.

* The first digit deals suffixes out: the rarest (by a hash) of the 16-byte grams
  in a suffix's first ``DEPTH`` bytes. Neighbouring suffixes mostly share it, so they
  travel as one run of bytes, and equal strings have the same one wherever they are.
  Grams so frequent that they would fill a bucket are passed over for the next rarest
  one; a suffix of none but such grams goes by a hash of all its bytes. So a line
  between differing neighbours that a third of all documents have is no one's bucket.
* In a bucket, groups of a gram that one document has alone are dropped. Runs that
  are equal throughout, byte by byte, are settled as one. What is left goes through passes of
  8-byte digits; each pass drops the groups that one document has alone, and after
  the last the equal suffixes remain. All but those of the smallest doc_id repeat it.
* The same is done first within each unit of ``UNIT`` bytes of text, and what is
  settled there is not sent: a passage shared by a third of all documents reaches
  its bucket at most once a unit.

Texts are UTF-8 bytes; null texts are empty. Rows without doc_id neither remove nor
lose anything. Rows of one doc_id never remove from each other; equal rows get equal
results. Texts shorter than ``DEPTH`` are kept whole. Columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import by_batch, plain, row_key, written

DEPTH = 50
GRAM = 16
#: Bytes of text that a task settles at once, and that feed a bucket.
UNIT, BUCKET = 4 << 20, 12 << 20
#: Bytes whose hashes are in memory at once.
SLICE = 1 << 18
#: Bytes of runs that are hashed or sorted at once.
PIECE = 1 << 20
#: One document in so many is weighed to find the grams that are no use as first digit, and at most so many such grams.
SAMPLED, MOST_HOT = 8, 1_000_000
#: Of compression, for what is shuffled.
LEVEL = 6
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes that start at each position."""
    h = data.astype(np.uint64) + np.uint64(1)
    for width, odd in zip((1, 2, 4, 8), ODD, strict=False):
        h = (h[:-width] ^ (h[:-width] >> np.uint64(29))) * odd + h[width:]
    h ^= h >> np.uint64(32)
    h *= ODD[4]
    return h ^ (h >> np.uint64(29))


def rarest(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return h if step == width else np.minimum(h[: len(h) - (width - step)], h[width - step :])


def first_digit(data: np.ndarray, hot: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each ``depth`` bytes of a stretch, the rarest of its grams that isn't ``hot``
    (sorted hashes); if all are, a hash of the whole."""
    width = depth - GRAM + 1
    h = gram_hashes(data)
    if not len(hot):
        return rarest(h, width)
    at = np.searchsorted(hot, h)
    at[at == len(hot)] = 0
    cool = np.where(hot[at] == h, ~np.uint64(0), h)
    v = rarest(cool, width)
    if len(lost := np.flatnonzero(v == ~np.uint64(0))):
        x = np.zeros(len(lost), np.uint64)
        for place in (*range(0, depth - GRAM, GRAM), depth - GRAM):
            x = (x ^ (x >> np.uint64(29))) * ODD[1] + h[lost + place]
        v[lost] = x >> np.uint64(1)
    return v


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (n of them), for each run, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as a number."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))[at]


def several(group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted groups: which rows are in a group of several documents, and the
    smallest document of each row's group."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    n = np.diff(np.append(first, len(group)))
    low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
    return np.repeat(low != high, n), np.repeat(low, n)


def repeated_suffixes(data: np.ndarray, at: np.ndarray, doc: np.ndarray, group: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Which suffixes have the same first ``depth`` bytes as one of a smaller
    document in their group."""
    out, left = np.zeros(len(at), bool), np.arange(len(at))
    for d in range(0, depth, 8):
        if not len(left):
            return out
        digit = words_at(data, at[left] + min(d, depth - 8))
        order = np.lexsort((digit, group))
        left, group, digit = left[order], group[order], digit[order]
        group = np.cumsum(np.append(0, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])))
        stay, low = several(group, doc[left])
        left, group, low = left[stay], group[stay], low[stay]
    out[left[doc[left] > low]] = True
    return out


def settle(data: np.ndarray, at: np.ndarray, n: np.ndarray, doc: np.ndarray, gram: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Which suffixes repeat a smaller document. Run i has the ``n[i]`` suffixes from
    ``at[i]`` on, of one document, with the first digit ``gram[i]``; the result has
    a value for each suffix, run by run."""
    total = int(n.sum())
    out = np.zeros(total, bool)
    if not total:
        return out
    begin = np.cumsum(n) - n
    order = np.argsort(gram, kind="stable")
    stay, _ = several(gram[order], doc[order])
    runs = order[stay]
    if not len(runs):
        return out
    # equal runs: by the grams in them, as a polynomial of their hashes
    length = n[runs] + depth - GRAM
    power = np.multiply.accumulate(np.full(int(length.max()) + 1, ODD[0]))
    content = np.empty(len(runs), np.uint64)
    for i, j in pieces(length + GRAM - 1):
        own, size = length[i:j], length[i:j] + GRAM - 1
        h = gram_hashes(data[spread(at[runs[i:j]], size)])[spread(np.cumsum(size) - size, own)]
        h *= power[spread(np.zeros(j - i, np.int64), own)]
        content[i:j] = np.add.reduceat(h, np.cumsum(own) - own)
    order = np.lexsort((doc[runs], n[runs], content, gram[runs]))
    runs, content = runs[order], content[order]
    same = (gram[runs][1:] == gram[runs][:-1]) & (content[1:] == content[:-1]) & (n[runs][1:] == n[runs][:-1])
    same[same] = equal_runs(data, at[runs[:-1][same]], at[runs[1:][same]], n[runs[1:][same]] + depth - 1)
    head = np.append(True, ~same)
    cls = np.cumsum(head) - 1
    heads = runs[head]
    later = doc[runs] > doc[heads][cls]
    out[spread(begin[runs[later]], n[runs[later]])] = True
    # the rest: suffix by suffix, some groups at a time
    stay, _ = several(gram[heads], doc[heads])
    rest = heads[stay]
    border = np.append(True, gram[rest][1:] != gram[rest][:-1]) if len(rest) else None
    for i, j in pieces(n[rest] + depth - 1, border):
        own = rest[i:j]
        size = n[own] + depth - 1
        copy = data[spread(at[own], size)]
        found = repeated_suffixes(copy, spread(np.cumsum(size) - size, n[own]), np.repeat(doc[own], n[own]), np.repeat(np.cumsum(border[i:j]), n[own]), depth)
        out[spread(begin[own], n[own])] = found
    twin = runs[~later & ~head & stay[cls]]
    of = heads[cls][~later & ~head & stay[cls]]
    out[spread(begin[twin], n[twin])] = out[spread(begin[of], n[of])]
    return out


def equal_runs(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from ``a`` and from ``b`` on are the same."""
    out = np.ones(len(a), bool)
    for i, j in pieces(size):
        own = size[i:j]
        differs = data[spread(a[i:j], own)] != data[spread(b[i:j], own)]
        out[i:j] = ~np.logical_or.reduceat(differs, np.cumsum(own) - own)
    return out


def pieces(sizes: np.ndarray, border: np.ndarray | None = None, most: int = PIECE) -> list[tuple[int, int]]:
    """Ranges of at most ``most`` in all, or of one; they start at borders."""
    starts = np.arange(len(sizes)) if border is None else np.flatnonzero(border)
    if not len(starts):
        return []
    before = np.append((np.cumsum(sizes) - sizes)[starts], np.sum(sizes))
    cuts, at = [0], 0
    while (at := max(at + 1, int(np.searchsorted(before, before[at] + most, side="right")) - 1)) < len(starts):
        cuts.append(at)
    return list(zip(starts[cuts].tolist(), [*starts[cuts[1:]].tolist(), len(sizes)], strict=True))


def packed(values: np.ndarray) -> bytes:
    """Compressed, with the bytes of each weight side by side."""
    values = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=LEVEL).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpacked(value: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(value), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


#: A block: runs for one bucket, from the documents it lists. Without runs, the
#: suffixes (first, number) of one document that are settled already.
BLOCK = pa.schema([("bucket", pa.int64()), ("docs", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))] + [(c, pa.binary()) for c in ("per_doc", "start", "n", "gram", "data")])
BLOCK_DDL = "bucket long, docs array<long>, keys array<long>, per_doc binary, start binary, n binary, gram binary, data binary"


def _dealt(buckets: int, unit: int, depth: int, hot: np.ndarray) -> callable:
    width = depth - GRAM + 1

    def blocks(parts: list[tuple[int, int, int, bytes]]) -> list[tuple]:
        """parts: (doc_id, key, place in the text, bytes)."""
        data = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
        sizes = np.array([len(p[3]) for p in parts])
        begin = np.cumsum(sizes) - sizes
        ids = np.array([p[0] for p in parts], np.int64)
        value = np.zeros(len(data), np.uint64)
        for b in range(0, len(data), SLICE):
            own = data[b : b + SLICE + depth - 1]
            if len(own) >= depth:
                v = first_digit(own, hot, depth)
                value[b : b + len(v)] = v
        valid, border = np.ones(len(data), bool), np.zeros(len(data), bool)
        border[begin] = True
        for end in (begin + sizes).tolist():
            valid[end - depth + 1 : end] = False

        def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Where runs of one gram start, their suffixes, and their parts."""
            edge = border.copy()
            edge[1:] |= value[1:] != value[:-1]
            edge[1:] |= ~mask[:-1]
            edge &= mask
            last = mask.copy()
            last[:-1] &= edge[1:] | ~mask[1:]
            at = np.flatnonzero(edge)
            return at, np.flatnonzero(last) + 1 - at, np.searchsorted(begin, at, side="right") - 1

        at, n, part = runs_of(valid)
        covered = settle(data, at, n, ids[part], value[at], depth)
        rows = []
        if covered.any():
            done = np.zeros(len(data), bool)
            done[valid] = covered
            edge = np.flatnonzero(np.diff(np.concatenate(([0], done.view(np.int8), [0]))))
            a, b = edge[::2], edge[1::2]
            owner = np.searchsorted(begin, a, side="right") - 1
            cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            for i, j in zip(cut, np.append(cut[1:], len(a)), strict=True):
                p = int(owner[i])
                doc, key, place, _ = parts[p]
                rows.append(((key ^ doc) % buckets, [doc], [key], None, packed(a[i:j] - begin[p] + place), packed(b[i:j] - a[i:j]), None, None))
            valid &= ~done
            at, n, part = runs_of(valid)
        if not len(at):
            return rows
        # where the gram is, in the first suffix of each run
        gram = np.zeros(len(at), np.uint8)
        for b in range(0, len(at), 1 << 14):
            head = data[at[b : b + (1 << 14), None] + np.arange(depth)]
            gram[b : b + (1 << 14)] = _gram_place(head, value[at[b : b + (1 << 14)]], width)
        bucket = (value[at] >> np.uint64(7)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
        for i, j in zip(cut, np.append(cut[1:], len(order)), strict=True):
            own = order[i:j]
            p, per = np.unique(part[own], return_counts=True)
            start = at[own] - begin[part[own]] + np.array([parts[x][2] for x in p]).repeat(per)
            rows.append((int(bucket[own[0]]), ids[p].tolist(), [parts[x][1] for x in p], packed(per.astype("<i4")), packed(np.diff(start, prepend=0)), packed(n[own]), packed(gram[own]), packed(data[spread(at[own], n[own] + depth - 1)])))
        return rows

    def run(batches):
        parts, size = [], 0

        def sent():
            rows = blocks(parts)
            for b in range(0, len(rows), 256):
                columns = list(zip(*rows[b : b + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, BLOCK, strict=True)], schema=BLOCK)

        for batch in batches:
            for doc, key, text in zip(batch["doc_id"].to_pylist(), batch["text_key"].to_pylist(), batch["text"], strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for place in range(0, max(0, len(raw) - depth + 1), unit):
                    piece = raw[place : place + unit + depth - 1]
                    parts.append((doc, key, place, piece))
                    size += len(piece)
                    if size >= unit:
                        yield from sent()
                        parts, size = [], 0
        if parts:
            yield from sent()

    return run


def _gram_place(heads: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    rows, depth = heads.shape
    h = gram_hashes(heads.reshape(-1))
    h = np.append(h, np.zeros(GRAM - 1, np.uint64)).reshape(rows, depth)[:, :width]
    return np.argmax(h == value[:, None], axis=1)


#: What a bucket says to the documents of a group: (first, number) of repeated suffixes.
SPANS = pa.schema([("group", pa.int64()), ("docs", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))] + [(c, pa.binary()) for c in ("per_doc", "start", "n")])
SPANS_DDL = "group long, docs array<long>, keys array<long>, per_doc binary, start binary, n binary"


def _settled(groups: int, depth: int) -> callable:
    def run(table: pa.Table) -> pa.Table:
        docs, keys, start, n, gram, data, of = [], [], [], [], [], [], []
        found: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for row in (r for b in table.to_batches() for r in b.to_pylist()):
            s, m = unpacked(row["start"], "<i8"), unpacked(row["n"], "<i8")
            if row["data"] is None:
                found.append((row["docs"][0], row["keys"][0], s, m))
                continue
            of.append(np.repeat(np.arange(len(docs), len(docs) + len(row["docs"])), unpacked(row["per_doc"], "<i4")))
            docs += row["docs"]
            keys += row["keys"]
            start.append(np.cumsum(s))
            n.append(m)
            gram.append(unpacked(row["gram"], "u1"))
            data.append(unpacked(row["data"], "u1"))
        if data:
            of, start, n, gram, data = (np.concatenate(x) for x in (of, start, n, gram, data))
            at = np.cumsum(n + depth - 1) - (n + depth - 1)
            a, b = words_at(data, at + gram), words_at(data, at + gram + 8)
            order = np.lexsort((b, a))
            number = np.empty(len(at), np.int64)
            number[order] = np.cumsum(np.append(0, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
            covered = settle(data, at, n, np.array(docs, np.int64)[of], number, depth)
            if covered.any():
                run_of, place = np.repeat(of, n)[covered], spread(start, n)[covered]
                order = np.lexsort((place, run_of))
                run_of, place = run_of[order], place[order]
                head = np.flatnonzero(np.append(True, (run_of[1:] != run_of[:-1]) | (place[1:] != place[:-1] + 1)))
                first, count, owner = place[head], np.diff(np.append(head, len(place))), run_of[head]
                cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                for i, j in zip(cut, np.append(cut[1:], len(owner)), strict=True):
                    found.append((docs[owner[i]], keys[owner[i]], first[i:j], count[i:j]))
        by_group: dict[int, list] = {}
        for f in found:
            by_group.setdefault((f[0] ^ f[1]) % groups, []).append(f)
        rows = []
        for group, own in by_group.items():
            per, first, count = np.array([len(f[2]) for f in own], "<i4"), np.concatenate([f[2] for f in own]), np.concatenate([f[3] for f in own])
            rows.append((group, [f[0] for f in own], [f[1] for f in own], packed(per), packed(first), packed(count)))
        columns = list(zip(*rows, strict=True)) or [[] for _ in SPANS]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, SPANS, strict=True)], schema=SPANS)

    return run


def _weighed(depth: int, hot: np.ndarray) -> callable:
    """Bytes by gram, of those that a stretch of text has more than once: of the runs
    that it leads; with ``hot``, of all runs it could lead among those that
    these lead, which are the other grams of the same frequent strings."""
    width = depth - GRAM + 1

    def grams_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = first_digit(data, NONE, depth)
        if not len(hot):
            first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            return v[first], np.diff(np.append(first, len(v))) + depth - 1
        at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
        led = np.flatnonzero(hot[at] == v)
        edge = np.zeros(len(v) + width, np.int32)
        np.add.at(edge, led, 1)
        np.add.at(edge, led + width, -1)
        inside = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        return gram_hashes(data)[inside], np.full(len(inside), width + depth - 1)

    def work(batch: pa.RecordBatch) -> dict:
        grams, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        raws = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch["text"]]
        for raw in (r for r in raws if len(r) >= depth):
            for b in range(0, len(raw) - depth + 1, SLICE):
                found, size = grams_of(np.frombuffer(raw[b : b + SLICE + depth - 1], np.uint8))
                grams.append(found)
                sizes.append(size)
        found, place, often = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        weight = np.bincount(place, np.concatenate(sizes), len(found)).astype(np.int64)
        return {"gram": found[often > 1].view(np.int64), "bytes": weight[often > 1]}

    return work


NONE = np.zeros(0, np.uint64)


def hot_grams(docs: DataFrame, total: int, depth: int = DEPTH, bucket: int = BUCKET, share: int = SAMPLED) -> np.ndarray:
    """Hashes of the grams that would lead a quarter of a bucket's bytes or more to one
    bucket, and of those that could take their place, by a sample of one document in ``share``: it only balances the buckets, the
    result doesn't depend on it. At most ``MOST_HOT``, by the least weight that counts."""
    least = max(bucket // 4, total // MOST_HOT)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(share)) == 0).select("text")
    schema = pa.schema([("gram", pa.int64()), ("bytes", pa.int64())])

    def heavy(hot: np.ndarray) -> np.ndarray:
        weights = sample.mapInArrow(by_batch(lambda: _weighed(depth, hot), schema, 512), "gram long, bytes long").groupBy("gram").agg(F.sum("bytes").alias("bytes"))
        found = weights.where(F.col("bytes") * share >= least).select("gram").toArrow()
        return np.sort(found["gram"].to_numpy().view(np.uint64))

    leading = heavy(NONE)
    return np.union1d(leading, heavy(leading)) if len(leading) else leading


def repeated_spans(docs: DataFrame, parts: int, hot: np.ndarray, depth: int = DEPTH, unit: int = UNIT) -> DataFrame:
    """For each bucket and group of documents, packed: the suffixes whose first
    ``depth`` bytes start in a smaller document, too."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text_key", "text")
    dealt = rows.mapInArrow(_dealt(parts, unit, depth, hot), BLOCK_DDL)
    return dealt.groupBy("bucket").applyInArrow(_settled(parts, depth), SPANS_DDL)


def _compressed() -> callable:
    def work(batch: pa.RecordBatch) -> dict:
        zipped = zstandard.ZstdCompressor(level=LEVEL)
        raw = [zipped.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch["text"]]
        return {"group": batch["group"], "doc_id": batch["doc_id"], "text_key": batch["text_key"], "raw": raw}

    return work


def _kept(schema: pa.Schema, depth: int, digest: bool) -> callable:
    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        gone_of: dict[tuple[int, int], list] = {}
        for row in (r for b in spans.to_batches() for r in b.to_pylist()):
            ends = np.cumsum(unpacked(row["per_doc"], "<i4"))
            first, n = unpacked(row["start"], "<i8"), unpacked(row["n"], "<i8")
            for doc, key, i, j in zip(row["docs"], row["keys"], [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                gone_of.setdefault((doc, key), []).append((first[i:j], n[i:j]))
        out: dict = {f.name: [] for f in schema}
        unzip = zstandard.ZstdDecompressor()
        for doc, key, zipped in zip(texts["doc_id"].to_pylist(), texts["text_key"].to_pylist(), texts["raw"], strict=True):
            raw = unzip.decompress(zipped.as_py())
            edge = np.zeros(len(raw) + 1, np.int32)
            for first, n in gone_of.get((doc, key), ()):
                np.add.at(edge, first, 1)
                np.add.at(edge, first + n + depth - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if gone.any() else raw
            row = (doc, len(raw), int(gone.sum()), int((np.diff(gone.view(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest() if digest else kept, key)
            for c, v in zip(out, row, strict=False):
                out[c].append(v)
        return pa.table([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def remove_repeats(docs: DataFrame, depth: int = DEPTH, digest: bool = False, unit: int = UNIT, bucket: int = BUCKET, sampled: int = SAMPLED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes that are kept (with
    ``digest`` their SHA-256) of every document.

    Documents are dealt to as many groups as there are buckets, by id and text, so
    a bucket answers each group with one row, and copies spread over all groups. Of equal
    rows of one id one is worked on, and all get its result.
    """
    df = plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text_key", row_key())
    rows = written(df.groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"), F.sum(F.octet_length("text")).alias("bytes")), "row-counts")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, math.ceil(total / bucket))
    repeated = rows.where("copies > 1").select("doc_id", "text_key", "copies")
    again = not repeated.isEmpty()
    if again:
        # a null doc_id is equal to another one here
        is_copy = df["doc_id"].eqNullSafe(repeated["doc_id"]) & (df["text_key"] == repeated["text_key"])
        once = df.join(repeated, is_copy, "left_anti")
        df = written(once.unionByName(df.join(repeated, is_copy, "left_semi").dropDuplicates(["doc_id", "text_key"])), "single-rows")
    hot = hot_grams(df, total, depth, bucket, sampled)
    group = F.pmod(F.coalesce("doc_id", F.lit(0)).bitwiseXOR(F.col("text_key")), F.lit(parts).cast("long"))
    raw = pa.schema([("group", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("raw", pa.binary())])
    texts = df.withColumn("group", group).mapInArrow(by_batch(_compressed, raw), "group long, doc_id long, text_key long, raw binary")
    spans = repeated_spans(df, parts, hot, depth, unit)
    names = ("doc_id", "n_bytes", "n_removed", "n_spans")
    schema = pa.schema([*((n, pa.int64()) for n in names), ("kept", pa.string() if digest else pa.binary()), *([("text_key", pa.int64())] if again else [])])
    ddl = ", ".join([*(f"{n} long" for n in names), f"kept {'string' if digest else 'binary'}", *(["text_key long"] if again else [])])
    out = texts.groupBy("group").cogroup(spans.groupBy("group")).applyInArrow(_kept(schema, depth, digest), ddl)
    if not again:
        return out
    of = out["doc_id"].eqNullSafe(repeated["doc_id"]) & (out["text_key"] == repeated["text_key"])
    counted = out.join(repeated, of, "left").select(*(out[c] for c in (*names, "kept")), F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int"))).alias("copy"))
    return counted.drop("copy")


def suffix_dedup_report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")
