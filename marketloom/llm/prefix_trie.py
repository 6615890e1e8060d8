"""The prefix trie of conversations that share heads.

Conversation c is rebuilt from the first h turns of its base (c less c mod 100) and
its own turns after the h-th, h = crc32(c) mod 6. No rebuilt conversation is ever
materialised. A sequence of turns has a fingerprint in a monoid: for each of four
primes p, (n, sum of t_i B^(i-1) mod p) over its n turn hashes t, and the product
(n, a) (m, b) = (n + m, a + B^n b). Products of base heads and running products of own
suffixes are computed once per stored turn, and a rebuilt prefix is the product of
two of them. Its parent's fingerprint follows by taking the last term away.

Prefixes of one depth and fingerprint are a node. That they are equal is verified by
induction: members of a node must share the parent's fingerprint, and the turns that
their prefixes end in, found through references to stored turns, must be equal. If
any are not, the whole is repeated with other hashes.

Subtree measures need no walk over the levels: a conversation counts in every node
it passes, so each leaf is counted by the smallest conversation that ends in it, and
saved tokens are suffix sums along each conversation of the turns for which it isn't
its node's smallest member.

Hot groups: counts and minima combine in the map tasks; turns are numbered by range
partitions and their counts, and running sums go by blocks of positions, so a
conversation of any length is never one task's; joins against a hot node are plain
equi-joins, which Spark splits. The hash of the ids that end in one node is sequential
by nature: its task streams ready pieces of text.

Turns are ordered by turn (null first), equal ones by role and text. Rows without
conv_id belong to no conversation. Repeated rows are turns of their own. Other
columns are ignored. An empty table has no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import plain, written

#: The head's length is below this; conversations of one block share a base.
HEADS, BLOCK_OF = 6, 100
#: The largest primes below 2**31, so that a product of two residues fits a long.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
LANES = range(len(PRIMES))
#: Positions of a conversation that one window sums up.
STRETCH = 4096
KEY = ["depth", "hi", "lo"]
CHUNK = 1 << 16


def bases(seed: int) -> list[int]:
    return [(1 << 20) + xxhash.xxh64_intdigest(f"{seed}:{i}") % ((1 << 30) - 1) for i in LANES]


def longs(values: list[int]) -> Column:
    return F.lit(values).cast("array<bigint>")


def power(lane: int, base: int, exponent: Column) -> Column:
    """base ** exponent mod the lane's prime, by digits of 8 bits; exponents below 2**40."""
    p, out, step = PRIMES[lane], None, base
    for digit in range(5):
        row = [pow(step, n, p) for n in range(256)]
        value = F.get(longs(row), F.shiftright(exponent, 8 * digit).bitwiseAND(F.lit(255)).cast("int"))
        out = value if out is None else out * value % p
        step = pow(step, 256, p)
    return out


def turn_hash(lane: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(lane), "role", "text"), F.lit(PRIMES[lane]))


def packed(lanes: list[Column]) -> tuple[Column, Column]:
    """Four residues as two longs."""
    return lanes[0] * F.lit(1 << 31) + lanes[1], lanes[2] * F.lit(1 << 31) + lanes[3]


def running(df: DataFrame, key: str, at: str, columns: list[str], back: bool = False, stretch: int = STRETCH) -> DataFrame:
    """``columns`` replaced by their sums over the rows of ``key`` up to position
    ``at`` (from it on, if ``back``). ``df`` is read twice."""
    order = F.col(at).desc() if back else F.col(at).asc()
    df = df.withColumn("_stretch", F.floor(F.col(at) / stretch))
    totals = df.groupBy(key, "_stretch").agg(*(F.sum(c).alias(c) for c in columns))
    earlier = Window.partitionBy(key).orderBy(F.col("_stretch").desc() if back else F.col("_stretch").asc()).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "_stretch", *(F.sum(c).over(earlier).alias(f"_{c}") for c in columns)).where(F.col(f"_{columns[0]}").isNotNull())
    within = Window.partitionBy(key, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({c: F.sum(c).over(within) for c in columns})
    df = df.join(before, [key, "_stretch"], "left")
    return df.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in columns}).drop("_stretch", *(f"_{c}" for c in columns))


def stored_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text and ref, which numbers the turns of a partition in their
    order, with the partition in its upper bits. Written, so references hold."""
    df = plain(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    df = df.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    df = df.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return written(df.select("conv_id", "role", "text", F.monotonically_increasing_id().alias("ref")), "turns")


def positions(turns: DataFrame) -> DataFrame:
    """``turns`` with q, the place of a turn in its conversation, from 1."""
    turns = turns.withColumn("_part", F.shiftright("ref", 33))
    parts = turns.groupBy("conv_id", "_part").agg(F.count("*").alias("n"), F.min("ref").alias("first"))
    earlier = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "_part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return turns.join(parts, ["conv_id", "_part"]).withColumn("q", F.col("before") + F.col("ref") - F.col("first") + 1).drop("_part", "before", "first")


def rebuilt_prefixes(turns: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The conversations (c, total turns), and every prefix of one turn or more of
    their rebuilt forms: c, depth, hi, lo, parent_hi, parent_lo, chars and ref of the
    last turn, and last (whether it is the whole)."""
    base = bases(seed)
    t = [f"t{i}" for i in LANES]
    s = [f"s{i}" for i in LANES]
    hashed = turns.select("conv_id", "ref", F.length("text").cast("long").alias("chars"), *(turn_hash(i, seed).alias(t[i]) for i in LANES))
    placed = written(positions(hashed), "placed")

    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(BLOCK_OF))).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % HEADS)
    heads = placed.where((F.pmod("conv_id", F.lit(BLOCK_OF)) == 0) & (F.col("q") < HEADS)).withColumnRenamed("conv_id", "base")
    so_far = Window.partitionBy("base").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    heads = heads.select("base", "q", "ref", "chars", *t, *((F.sum(F.col(t[i]) * power(i, base[i], F.col("q") - 1) % PRIMES[i]).over(so_far) % PRIMES[i]).alias(s[i]) for i in LANES))
    heads = written(heads, "heads")

    reach = heads.groupBy("base").agg(F.max("q").alias("reach"))
    convs = sizes.join(reach, "base", "left").withColumn("k", F.least("h", F.coalesce("reach", F.lit(0))))
    tops = heads.select("base", F.col("q").alias("k"), *(F.col(x).alias(f"head_{x}") for x in s))
    convs = convs.join(tops, ["base", "k"], "left").select(F.col("conv_id").alias("c"), "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"), *(F.coalesce(f"head_{x}", F.lit(0)).alias(f"head_{x}") for x in s))
    convs = written(convs, "rebuilt")

    shared = convs.select("c", "base", "k", "total").join(heads, "base").where("q <= k").select("c", "q", "total", "ref", "chars", *t, *s)
    own = placed.join(convs, placed["conv_id"] == convs["c"]).where("q > h").withColumn("e", F.col("q") - F.col("h") - 1)
    own = own.select("c", "e", "k", "total", "ref", "chars", *t, *(f"head_{x}" for x in s), *((F.col(t[i]) * power(i, base[i], F.col("e")) % PRIMES[i]).alias(s[i]) for i in LANES))
    own = running(own, "c", "e", s)
    shift = {i: F.get(longs([pow(base[i], n, PRIMES[i]) for n in range(HEADS)]), F.col("k").cast("int")) for i in LANES}
    own = own.select("c", (F.col("k") + F.col("e") + 1).alias("q"), "total", "ref", "chars", *t, *(((F.col(f"head_{s[i]}") + F.col(s[i]) % PRIMES[i] * shift[i]) % PRIMES[i]).alias(s[i]) for i in LANES))

    every = shared.unionByName(own)
    hi, lo = packed([F.col(x) for x in s])
    up_hi, up_lo = packed([F.pmod(F.col(s[i]) - F.col(t[i]) * power(i, base[i], F.col("q") - 1) % PRIMES[i], F.lit(PRIMES[i])) for i in LANES])
    every = every.select("c", F.col("q").alias("depth"), hi.alias("hi"), lo.alias("lo"), up_hi.alias("parent_hi"), up_lo.alias("parent_lo"), "chars", "ref", (F.col("q") == F.col("total")).alias("last"))
    return convs.select("c", "total"), written(every, "prefixes")


def grouped(prefixes: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """The nodes; the prefixes with their node's data; whether some node holds
    prefixes of more than one parent."""
    up = F.struct("parent_hi", "parent_lo")
    nodes = prefixes.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min(F.struct("c", "ref")).alias("first"), F.min(up).alias("up"), F.max(up).alias("up_max"))
    nodes = written(nodes.select(*KEY, "n_convs", "first", "up", (F.col("up") != F.col("up_max")).alias("mixed")), "grouped")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("up.parent_hi").alias("hi"), F.col("up.parent_lo").alias("lo")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    own = F.col("c") == F.col("first.c")
    marked = prefixes.join(nodes, KEY).select(
        *KEY, "c", "ref", F.col("first.ref").alias("first_ref"), "last", (F.col("last") & own & (F.col("n_children") == 0)).cast("long").alias("leaf"), F.when(own, 0).otherwise(F.col("chars")).alias("saved")
    )
    return nodes, written(marked, "marked"), not nodes.where("mixed").isEmpty()


def has_collision(marked: DataFrame, turns: DataFrame) -> bool:
    """Whether a node's members end in different turns, by their stored contents."""
    pairs = marked.where("ref != first_ref").select("ref", "first_ref").distinct()
    one = turns.select("ref", F.struct("role", "text").alias("one"))
    other = turns.select(F.col("ref").alias("first_ref"), F.struct("role", "text").alias("other"))
    return not pairs.join(one, "ref").join(other, "first_ref").where("one != other").isEmpty()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Sorted (key, c) -> the ids of a stretch of a node as one text."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK // 16):
            part = batch.slice(at, CHUNK // 16)
            cols = [part[k].to_numpy() for k in KEY]
            c = part["c"].to_numpy()
            starts = np.append(0, np.flatnonzero(np.any([x[1:] != x[:-1] for x in cols], axis=0)) + 1) if len(c) else np.array([], int)
            names = list(map(str, c.tolist()))
            ends = np.append(starts[1:], len(c))
            text = [",".join(names[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[starts]) for x in cols), pa.array(c[starts]), pa.array(text, pa.string())], names=[*KEY, "c", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Sorted (key, c, ids) -> SHA-256 of each key's ids, comma-joined."""
    held, state = None, None

    def made(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([r[0][i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64()))), pa.array([r[1] for r in rows], pa.string())], names=[*KEY, "ends_sha256"])

    for batch in batches:
        rows = []
        for key, ids in zip(zip(*(batch[k].to_pylist() for k in KEY), strict=True), batch["ids"].to_pylist(), strict=True):
            if key == held:
                state.update(b"," + ids.encode())
                continue
            if state:
                rows.append((held, state.hexdigest()))
            held, state = key, hashlib.sha256(ids.encode())
        yield made(rows)
    if state:
        yield made([(held, state.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, hi, lo, ends_sha256) from (depth, hi, lo, c)."""
    kinds = ", ".join(f"{k} long" for k in KEY)
    chunks = ends.select(*(F.col(k).cast("long").alias(k) for k in KEY), "c").repartitionByRange(*KEY, "c").sortWithinPartitions(*KEY, "c").mapInArrow(_chunks, f"{kinds}, c long, ids string")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "c").mapInArrow(_digests, f"{kinds}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, seed: int = 1) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    turns = stored_turns(conversations)
    while True:
        convs, prefixes = rebuilt_prefixes(turns, seed)
        nodes, marked, mixed = grouped(prefixes)
        if not mixed and not has_collision(marked, turns):
            break
        seed += 1  # different prefixes met in one fingerprint
    sums = running(marked, "c", "depth", ["leaf", "saved"], back=True).groupBy(*KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    rootless = convs.where("total = 0").select(*(F.lit(0).cast("long").alias(k) for k in KEY), "c")
    digests = written(end_digests(marked.where("last").select(*KEY, "c").unionByName(rootless)), "ends")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    nodes = nodes.select(*KEY, "n_convs", "n_children", F.col("first.c").alias("conv_id"), F.col("up.parent_hi").alias("up_hi"), F.col("up.parent_lo").alias("up_lo"))
    below = written(nodes.join(sums, KEY), "measured")

    # the root has no turn; its measures are sums of the nodes of depth 1
    missing = F.lit(None).cast("long")
    members = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"))
    ones = below.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    both = members.select("conv_id", "n_convs", *(missing.alias(c) for c in ones.columns)).union(ones.select(missing, missing, *ones.columns))
    root = both.agg(*(F.max(c).alias(c) for c in both.columns)).where("n_convs > 0")
    root = root.select(
        *(F.lit(0).cast("long").alias(k) for k in KEY), "n_convs", "n_children", "conv_id", missing.alias("up_hi"), missing.alias("up_lo"),
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
    )
    root = written(root, "root")
    first = root.first()
    parents = below.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id"))
    deep = below.where("depth > 1").join(parents, ["depth", "up_hi", "up_lo"])
    flat = below.where("depth = 1").withColumn("parent_conv_id", F.lit(first["conv_id"] if first else None).cast("long"))
    every = deep.unionByName(flat).unionByName(root.withColumn("parent_conv_id", F.lit(None).cast("long")))
    every = every.join(digests, KEY, "left")
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


#: The same in DuckDB, on lists of turns. crc32 is folded over the digits of the id.
TRIE_SQL = r"""
WITH RECURSIVE turns AS (
    SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS q
    FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
    SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT c FROM turns)
), rebuilt AS (
    SELECT c, list(struct_pack(role := role, text := text) ORDER BY own, q) AS seq FROM (
        SELECT k.c, t.role, t.text, t.q, 0 AS own FROM crc k JOIN turns t ON t.c = k.c - ((k.c % 100) + 100) % 100 AND t.q <= k.h
        UNION ALL SELECT k.c, t.role, t.text, t.q, 1 FROM crc k JOIN turns t ON t.c = k.c AND t.q > k.h) GROUP BY c
), convs AS (
    SELECT c, coalesce(seq, []) AS seq, coalesce(len(seq), 0) AS total FROM crc LEFT JOIN rebuilt USING (c)
), prefixes AS (
    SELECT c, d, seq[1:d] AS p, total = d AS ends FROM convs, (SELECT unnest(range(0, (SELECT max(total) + 1 FROM convs))) AS d) WHERE d <= total
), nodes AS (
    SELECT p, CAST(d AS BIGINT) AS depth, min(c) AS conv_id, count(*) AS n_convs, coalesce(sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends)), sha256('')) AS ends_sha256,
           CASE WHEN d > 0 THEN length(p[d].text) ELSE 0 END AS chars
    FROM prefixes GROUP BY p, d
), shaped AS (
    SELECT n.*, u.conv_id AS parent_conv_id  FROM nodes n LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.p = n.p[1:n.depth - 1]
), kids AS (
    SELECT depth - 1 AS depth, p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
    SELECT s.depth, s.p, s.conv_id, s.parent_conv_id, s.n_convs, coalesce(k.n, 0) AS n_children, s.ends_sha256, s.chars FROM shaped s LEFT JOIN kids k ON k.depth = s.depth AND k.p = s.p
), below AS (
    SELECT a.depth, a.p, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved
    FROM (SELECT n.depth, n.p, unnest(range(0, n.depth + 1)) AS up, n.n_children, n.n_convs, n.chars FROM full_nodes n) b JOIN full_nodes a ON a.depth = b.up AND a.p = b.p[1:b.up] GROUP BY a.depth, a.p
)
SELECT conv_id, depth, parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM full_nodes JOIN below USING (depth, p)
"""
