"""Toxicity by multiple-instance learning.

A document is a bag of sentences. The document's score is a noisy-or: the bias, once
a document, and what each sentence adds to it,
1 - (1 - p0) * prod(min(1, (1 - p) / (1 - p0))), with p the sentence's logistic score
and p0 that of the bias alone. For one sentence that is p; a sentence without evidence,
or with evidence against, adds nothing however many there are. Nor does, in a finished
model's scores, one below ``EVIDENCE``: else the faint suspicions of a very long clean
text would add up. Only documents have labels:
the gradient of the document's log-loss reaches the sentences through the
noisy-or, so the sentences that explain a toxic label get high scores and can be
pointed out afterwards.

Features are words and word beginnings of 3 to 8 letters. Their counts are taken
over the training rows in Spark; the strongest ``vocabulary`` of them by
likelihood ratio are kept, so the model has a fixed size.

Null and empty texts are one empty sentence: their score is that of the bias.
Rows of one doc_id are scored one by one. Without training rows of both classes
every score is ``PRIOR``. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import boxed, by_batch, plain, written

#: Training documents of each class, at most. Chosen by a hash.
TRAINING_PER_CLASS = 8000
#: Code points of them, at most: what the driver gets of a text is some bytes a word.
TRAINING_CHARS = 32_000_000
VOCABULARY = 4096
#: Likelihood ratio below which a feature is no evidence (chi-square, p = 0.001).
LEAST_EVIDENCE = 10.8
#: Sentence score below which a sentence adds nothing to its document's score.
EVIDENCE = 0.2
PRIOR = 0.05
SENTENCE = re.compile(r"[.!?\n]+")
EDGE = "\"'()[]{}<>,;:*#$%&|/\\-_=+~`^…«»¿¡"
CACHE = 200_000


def word_features(word: str) -> tuple[str, ...]:
    """The word and its beginnings; ``^`` marks a beginning."""
    word = word.strip(EDGE)
    return (word, *(f"^{word[:n]}" for n in range(3, 9) if len(word) > n)) if word else ()


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = TRAINING_PER_CLASS, chars: int = TRAINING_CHARS) -> DataFrame:
    """(text, y, weight) of labelled documents: ``per_class`` of each class and
    ``chars`` code points a class at most, taken in the order of a hash, whole
    documents only. ``weight`` is how many labels of its class a sampled one stands
    for, so the classes keep their ratio whatever the caps. A doc_id with several
    labels counts as toxic if any of them says so; of several rows of a doc_id the
    least text counts, once."""
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("training"))
    chosen = y.where("y = 1").orderBy(order).limit(per_class).union(y.where("y = 0").orderBy(order).limit(per_class))
    # 2 * per_class rows of two numbers at most, whatever the size of the input
    rows = plain(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = written(rows.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "labelled")
    taken = F.sum(F.length("text")).over(Window.partitionBy("y").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    within = written(rows.select("doc_id", "y", taken.alias("taken")).where(F.col("taken") <= chars).select("doc_id", "y"), "sampled")
    full = y.groupBy("y").agg(F.count("*").alias("all"))
    weight = within.groupBy("y").agg(F.count("*").alias("n")).join(full, "y").select("y", (F.col("all") / F.col("n")).alias("weight"))
    return rows.join(F.broadcast(within.join(F.broadcast(weight), "y").select("doc_id", "weight")), "doc_id").select("text", "y", "weight")


def _counted() -> callable:
    def work(batch: pa.RecordBatch) -> dict:
        counts: dict[str, list[int]] = {}
        for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), strict=True):
            for f in {f for w in set(text.lower().replace(".", " ").split()) for f in word_features(w.strip("!?"))}:
                counts.setdefault(f, [0, 0])[y] += 1
        return {"feature": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]}

    return work


def vocabulary(training: DataFrame, toxic: int, clean: int, size: int = VOCABULARY) -> list[str]:
    """The features whose document counts differ most between the classes."""
    schema = pa.schema([("feature", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())])
    counts = training.mapInArrow(by_batch(_counted, schema, 256), "feature string, clean long, toxic long")
    n, t = float(toxic + clean), toxic / float(toxic + clean)
    a, b = F.col("toxic"), F.col("clean")

    def part(seen, expected):
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    both = a + b
    ratio = part(a, both * t) + part(b, both * (1 - t)) + part(toxic - a, (n - both) * t) + part(clean - b, (n - both) * (1 - t))
    strong = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where((both < n) & (both > 2)).select("feature", ratio.alias("g"))
    return [r[0] for r in strong.where(F.col("g") > LEAST_EVIDENCE).orderBy(F.desc("g"), "feature").limit(size).collect()]


def _encoded(index: dict[str, int]) -> callable:
    def make() -> callable:
        def work(batch: pa.RecordBatch) -> dict:
            out = {"y": batch["y"], "weight": batch["weight"], "features": []}
            for text in batch["text"].to_pylist():
                sentences = [[index[f] for w in s.split() for f in word_features(w) if f in index] for s in SENTENCE.split(text.lower())]
                out["features"].append([s for s in sentences if s])
            return out

        return work

    return make


def fit(training: DataFrame, size: int = VOCABULARY, steps: int = 300, l2: float = 5e-6) -> dict:
    """Weights by feature, and the bias under ``""``; empty without both classes.

    What reaches the driver is bounded: the vocabulary, and of each training
    document the vocabulary ids in its sentences.
    """
    n = dict(training.groupBy("y").count().collect())
    if not n.get(0) or not n.get(1):
        return {}
    names = vocabulary(training, n[1], n[0], size)
    index = {f: i for i, f in enumerate(names)}
    schema = pa.schema([("y", pa.int32()), ("weight", pa.float64()), ("features", pa.list_(pa.list_(pa.int32())))])
    rows = training.mapInArrow(by_batch(_encoded(index), schema), "y int, weight double, features array<array<int>>").toArrow()
    y = rows["y"].to_numpy()
    bags = rows["features"].combine_chunks()
    sentences = bags.flatten()
    bag = np.repeat(np.arange(len(bags)), pc.list_value_length(bags))
    of = np.repeat(np.arange(len(sentences)), pc.list_value_length(sentences))
    feature = sentences.flatten().to_numpy()
    weight, bias = np.zeros(len(names)), -4.0
    each = rows["weight"].to_numpy() / rows["weight"].to_numpy().sum()
    grown = [np.zeros(len(names) + 1), np.zeros(len(names) + 1)]
    for step in range(1, steps + 1):
        z = np.bincount(of, weight[feature], len(bag))
        p, p0 = 1 / (1 + np.exp(-np.clip(bias + np.maximum(z, 0), -30, 30))), 1 / (1 + math.exp(-bias))
        log_p0 = math.log1p(-p0)
        log_clean = log_p0 + np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-12)) - log_p0, len(y))
        score = np.clip(-np.expm1(log_clean), 1e-12, 1)
        push = each * np.where(y == 1, (1 - score) / score, -1.0)
        d = push[bag] * p * (z >= 0)
        gradient = np.append(np.bincount(feature, d[of], len(names)) - l2 * weight, push.sum() * p0 + (push[bag] * (p - p0)).sum())
        for k, (keep, now) in enumerate(((0.9, gradient), (0.99, gradient**2))):
            grown[k] = keep * grown[k] + (1 - keep) * now
        move = 0.1 * (grown[0] / (1 - 0.9**step)) / (np.sqrt(grown[1] / (1 - 0.99**step)) + 1e-9)
        weight += move[:-1]
        bias = min(bias + float(move[-1]), -2.0)
    return {"": float(bias)} | {f: float(w) for f, w in zip(names, weight, strict=True)}


def scorer(model: dict) -> callable:
    """text -> (score, [(start, end, sentence score)])."""
    bias, cache = model.get("", 0.0), {}
    base = math.log1p(-1 / (1 + math.exp(-bias)))

    def known(word: str) -> float:
        if len(cache) >= CACHE:
            cache.clear()
        cache[word] = w = sum(model.get(f, 0.0) for f in word_features(word))
        return w

    def score(text: str) -> tuple[float, list]:
        if not model:
            return PRIOR, []
        low = text.lower()
        clean, bad = base, []
        for n, s in enumerate(SENTENCE.split(low)):
            words = s.split()
            try:
                z = sum(map(cache.__getitem__, words))
            except KeyError:
                z = sum(cache[w] if w in cache else known(w) for w in words)
            if z <= 0:
                continue
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + z))))
            if p < EVIDENCE:
                continue
            clean += math.log1p(-min(p, 1 - 1e-12)) - base
            if p >= 0.5:
                bad.append((n, p))
        if bad and len(low) == len(text):
            ends = [m.span() for m in SENTENCE.finditer(low)]
            starts, stops = [0, *(e for _, e in ends)], [*(b for b, _ in ends), len(low)]
            return -math.expm1(clean), [(starts[n], stops[n], p) for n, p in bad]
        return -math.expm1(clean), [(None, None, p) for _, p in bad]

    return score


def _scored(model: dict) -> callable:
    def make() -> callable:
        one = scorer(model)

        def work(batch: pa.RecordBatch) -> dict:
            got = [one(t or "") for t in batch["text"].to_pylist()]
            offending = [[{"start": a, "end": b, "score": p} for a, b, p in found] for _, found in got]
            return {c: batch[c] for c in batch.schema.names} | {"score": [s for s, _ in got], "offending": offending}

        return work

    return make


def score_toxicity(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every document, its score and the sentences that
    score 0.5 or more (code points; null where lower-casing moves positions)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    df = plain(docs, *dict.fromkeys((*keep, "text")))
    out = "score double, offending array<struct<start:long,end:long,score:double>>"
    schema = to_arrow_schema(df.schema)
    fields = [*schema, pa.field("score", pa.float64()), pa.field("offending", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + out
    return df.mapInArrow(by_batch(_scored(model), pa.schema(fields)), ddl)


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def contract_model(docs: DataFrame, labels: DataFrame) -> dict:
    """Fitted to the rows that are not held out."""
    return fit(written(training_rows(docs, labels.where(~held_out())), "training"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(docs, contract_model(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below 0.5, with the columns they came with."""
    clean = score_toxicity(boxed(docs), contract_model(docs, labels), ("doc",)).where("score < 0.5")
    return clean.select(*(F.col("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
