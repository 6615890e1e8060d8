"""A quality classifier by co-training of two views.

The content view sees words and their shapes; the metadata view sees source, language
and page measures (length, lines, share of symbols, capitals, digits). Both are
logistic regressions, first fitted to labelled documents. In each round both views
score all other documents, and quantiles of those scores give the ``PER_ROUND`` share,
growing by as much every round, of which a view is most sure, split between the
classes at their rate among the labels. These become training rows of the other view. At
the end each view is calibrated (Platt) on labelled rows it was not fitted to, and the
mean of the calibrated log-odds scores all documents.

Features of all documents are computed once and written; rounds and scoring read them.
Only what a view is fitted to is a bounded sample, by a hash: ``LABELLED`` labelled rows,
and of the rows that a round is sure of ``PSEUDO`` a view and class; what reaches the
driver are their hashed features, at most ``WIDTH`` of each kind a row. A labelled row
counts in the calibration and in the rate of pseudo-labels as the labels of its
class that it stands for, so both keep the ratio of the classes. Of several rows of a
labelled doc_id the one with the smallest text hash is fitted to.
Null and empty texts, null source and language have their own features. Rows of one
doc_id are scored one by one; a doc_id with several labels takes the lowest. Without
labels of both classes every score is 0.5. Missing columns count as null, further ones
are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marketloom.llm.common import by_batch, plain, row_key, written

LABELLED, PSEUDO, ROUNDS, PER_ROUND = 6000, 1500, 4, 0.05
WIDTH = 1 << 12
SHAPE = re.compile(r"[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+|[0-9]+")
COLUMNS = ("doc_id", "text", "lang", "source")


def hashed(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % WIDTH


def shape(word: str) -> str:
    """Runs of small letters, capitals and digits as one sign each."""
    return SHAPE.sub(lambda m: "a" if m[0][0].islower() else "9" if m[0][0].isdigit() else "A", word)[:8]


def content(text: str, known: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, value) of words and shapes: square roots of their shares."""
    words = text.split()
    counts: Counter = Counter()
    for w, n in Counter(words).items():
        if (ids := known.get(w)) is None:
            if len(known) > 100_000:
                known.clear()
            known[w] = ids = (hashed("w" + w.lower().strip(".,!?")), hashed("s" + shape(w)))
        for i in ids:
            counts[i] += n
    ids = np.fromiter(counts, np.int64, len(counts))
    values = np.sqrt(np.fromiter(counts.values(), float, len(counts)) / max(1, len(words)))
    repeat = 1 - len(set(words)) / len(words) if words else 1.0
    return np.append(ids, hashed(f"repeat{int(10 * repeat)}")), np.append(values, 1.0)


def metadata(text: str | None, lang: str | None, source: str | None) -> tuple[np.ndarray, np.ndarray]:
    body = text or ""
    n = max(1, len(body))
    lines = body.count("\n") + 1
    visible = body.translate(CLASSES)
    measures = {
        "length": int(2 * math.log2(n)),
        "line": int(2 * math.log2(n / lines)),
        "symbols": int(20 * visible.count("#") / n),
        "capitals": int(20 * visible.count("A") / n),
        "digits": int(20 * visible.count("9") / n),
        "null": text is None,
    }
    names = [f"lang={lang}", f"source={source}", *(f"{k}={v}" for k, v in measures.items())]
    return np.array([hashed(x) for x in names]), np.ones(len(names))


CLASSES = {i: "A" if chr(i).isupper() else "9" if chr(i).isdigit() else "#" if not chr(i).isalnum() and chr(i) not in " \n.,'\"" else "a" for i in range(33, 256)}


class View:
    """A logistic regression over hashed features."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
        self.ids = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
        self.values = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
        self.n, self.weight, self.bias, self.scale, self.shift = len(rows), np.zeros(WIDTH), 0.0, 1.0, 0.0

    def logits(self) -> np.ndarray:
        return np.bincount(self.row, self.values * self.weight[self.ids], self.n) + self.bias

    def fit(self, y: np.ndarray, chosen: np.ndarray, steps: int = 120, l2: float = 1e-4) -> None:
        """``y`` counts where ``chosen``; both classes weigh the same."""
        share = np.where(y == 1, 0.5 / max(1, (chosen & (y == 1)).sum()), 0.5 / max(1, (chosen & (y == 0)).sum())) * chosen
        weight, first, second = np.append(self.weight, self.bias), np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
        for step in range(1, steps + 1):
            self.weight, self.bias = weight[:-1], weight[-1]
            error = share * (1 / (1 + np.exp(-np.clip(self.logits(), -30, 30))) - y)
            gradient = np.append(np.bincount(self.ids, self.values * error[self.row], WIDTH) + l2 * self.weight, error.sum())
            first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
            weight = weight - 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        self.weight, self.bias = weight[:-1], float(weight[-1])

    def calibrate(self, y: np.ndarray, chosen: np.ndarray, weight: np.ndarray) -> None:
        """Platt scaling: log-odds = scale * logit + shift, by Newton steps."""
        z, y, each = self.logits()[chosen], y[chosen].astype(float), weight[chosen]
        each = each * (len(each) / max(1e-9, each.sum()))
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w, miss = each * (p * (1 - p) + 1e-6), each * (p - y)
            g = np.array([(miss * z).sum() + 1e-3 * (a - 1), miss.sum()])
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            move = np.linalg.solve(h, g)
            a, b = a - move[0], b - move[1]
        self.scale, self.shift = max(0.0, float(a)), float(b)


FEATURES = (("c_ids", pa.list_(pa.int32())), ("c_values", pa.list_(pa.float32())), ("m_ids", pa.list_(pa.int32())))
FEATURES_DDL = "c_ids array<int>, c_values array<float>, m_ids array<int>"


def _features(names: list[str]) -> callable:
    def make() -> callable:
        known: dict = {}

        def work(batch: pa.RecordBatch) -> dict:
            c = [content(t or "", known) for t in batch["text"].to_pylist()]
            m = [metadata(*x) for x in zip(*(batch[n].to_pylist() for n in ("text", "lang", "source")), strict=True)]
            return {n: batch[n] for n in names} | {"c_ids": [i for i, _ in c], "c_values": [v for _, v in c], "m_ids": [i for i, _ in m]}

        return work

    return make


def features_of(docs: DataFrame) -> DataFrame:
    """doc_id, at (a hash that orders samples) and both views' features of every row. Written."""
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("co-training"))
    df = columns_of(docs).withColumn("text_key", row_key()).withColumn("at", order)
    kept = df.select("doc_id", "text_key", "at")
    schema = pa.schema([*to_arrow_schema(kept.schema), *(pa.field(n, t) for n, t in FEATURES)])
    ddl = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, text_key long, at long, {FEATURES_DDL}"
    return written(df.mapInArrow(by_batch(_features(kept.columns), schema, 256), ddl), "quality-features")


def _logits(models: list[tuple], names: list[str]) -> callable:
    """Adds the calibrated log-odds of both views."""

    def make() -> callable:
        def work(batch: pa.RecordBatch) -> dict:
            out = {n: batch[n] for n in names}
            for (weight, bias, scale, shift), view in zip(models, ("c", "m"), strict=True):
                ids = batch[f"{view}_ids"]
                at = weight[ids.flatten().to_numpy()]
                if view == "c":
                    at = at * batch["c_values"].flatten().to_numpy()
                row = np.repeat(np.arange(batch.num_rows), ids.value_lengths().to_numpy())
                out[f"{view}_odds"] = scale * (np.bincount(row, at, batch.num_rows) + bias) + shift
            return out

        return work

    return make


def with_odds(features: DataFrame, views: tuple[View, View], *names: str) -> DataFrame:
    """``names`` of every row with c_odds and m_odds, by the views as they are now."""
    kept = features.select(*names)
    schema = pa.schema([*to_arrow_schema(kept.schema), ("c_odds", pa.float64()), ("m_odds", pa.float64())])
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema), "c_odds double, m_odds double"])
    models = [(v.weight, v.bias, v.scale, v.shift) for v in views]
    columns = dict.fromkeys([*names, *(n for n, _ in FEATURES)])
    return features.select(*columns).mapInArrow(by_batch(_logits(models, list(names)), schema, 4096), ddl)


def collected(rows: DataFrame, *names: str) -> tuple[pa.Table, list, list]:
    """A bounded sample on the driver: its columns, and the rows of either view."""
    got = rows.select(*names, *(n for n, _ in FEATURES)).toArrow()
    c = [(np.asarray(i.values, np.int64), np.asarray(v.values, float)) for i, v in zip(got["c_ids"], got["c_values"], strict=True)]
    m = [(np.asarray(i.values, np.int64), np.ones(len(i.values))) for i in got["m_ids"]]
    return got, c, m


def confident(pool: DataFrame, views: tuple[View, View], share: float, rate: float, most: int = PSEUDO) -> DataFrame:
    """For each pupil (0: content, 1: metadata) and class, ``most`` of the rows that the
    other view is surest of: pupil, y and the features. All rows of the pool
    are scored, and thresholds are quantiles over all of them."""
    scored = written(with_odds(pool, views, "doc_id", "text_key", "at"), "pool-odds")
    quantiles = F.array(F.lit(share * (1 - rate)), F.lit(1 - share * rate))
    cut = scored.agg(*(F.percentile_approx(f"{v}_odds", quantiles, 10_000).alias(v) for v in ("c", "m"))).first()
    labelled = []
    for pupil, teacher in ((0, "m"), (1, "c")):
        low, high = cut[teacher] or (0.0, 0.0)
        y = F.when((F.col(f"{teacher}_odds") <= low) & (F.col(f"{teacher}_odds") < 0), 0).when((F.col(f"{teacher}_odds") >= high) & (F.col(f"{teacher}_odds") > 0), 1)
        labelled.append(F.struct(F.lit(pupil).alias("pupil"), y.alias("y")))
    rows = scored.select("doc_id", "text_key", "at", F.inline(F.array(*labelled))).where("y IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("pupil", "y").orderBy("at", "text_key"))
    # 4 * most rows of five numbers at most, whatever the size of the pool
    sample = rows.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "text_key", "pupil", "y")
    return pool.join(F.broadcast(written(sample, "pseudo-labels")), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key", "pupil"])


def columns_of(docs: DataFrame) -> DataFrame:
    return plain(docs.withColumns({c: F.lit(None).cast("string") for c in COLUMNS if c not in docs.columns}), *COLUMNS)


def fit_quality(features: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS, per_round: float = PER_ROUND) -> tuple[View, View] | None:
    """The two views, fitted in rounds and calibrated; None without labels of both classes."""
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("co-training"))
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    half = labelled // 2
    some = y.where("y = 0").orderBy(order).limit(half).union(y.where("y = 1").orderBy(order).limit(half))
    full = y.groupBy("y").agg((F.count("*") / F.least(F.count("*"), F.lit(half))).alias("weight"))
    # ``labelled`` rows of three numbers at most
    some = written(some.join(F.broadcast(full), "y").select("doc_id", "y", "weight"), "sampled-labels")
    one = features.join(F.broadcast(some), "doc_id").groupBy("doc_id", "y", "weight", "at").agg(F.min_by(F.struct(*(n for n, _ in FEATURES)), "text_key").alias("f"))
    got, *own = collected(one.select("y", "weight", "at", "f.*").orderBy("at"), "y", "weight")
    truth = got["y"].to_numpy() if got.num_rows else np.zeros(0, np.int32)
    if not {0, 1} <= set(truth.tolist()):
        return None
    weight = got["weight"].to_numpy()
    rate = weight[truth == 1].sum() / weight.sum()
    held = np.arange(len(truth)) % 5 == 4
    pool = features.where("doc_id IS NOT NULL").join(F.broadcast(some.select("doc_id")), "doc_id", "left_anti")

    def fitted(extra: list[tuple[list, np.ndarray]], before: tuple[View, View] | None) -> tuple[View, View]:
        views = tuple(View(rows + more) for rows, (more, _) in zip(own, extra, strict=True))
        for k, (view, (_, labels_of)) in enumerate(zip(views, extra, strict=True)):
            if before:
                view.weight, view.bias = before[k].weight, before[k].bias
            everything = np.append(truth, labels_of)
            view.fit(everything, np.append(~held, np.ones(len(labels_of), bool)))
            view.calibrate(everything, np.append(held, np.zeros(len(labels_of), bool)), np.append(weight, np.ones(len(labels_of))))
        return views

    none = ([], np.zeros(0, np.int32))
    views = fitted([none, none], None)
    for k in range(rounds):
        found, c, m = collected(confident(pool, views, per_round * (k + 1), rate).orderBy("at", "text_key"), "pupil", "y")
        pupil, new = (np.asarray(found[n].to_numpy(), np.int32) if found.num_rows else np.zeros(0, np.int32) for n in ("pupil", "y"))
        extra = [([rows[i] for i in np.flatnonzero(pupil == v)], new[pupil == v]) for v, rows in enumerate((c, m))]
        views = fitted(extra, views)
    return views


def score_quality(features: DataFrame, views: tuple[View, View] | None) -> DataFrame:
    """doc_id, the calibrated score of each view and of both, for every document."""
    names = ("content_score", "metadata_score", "score")
    if views is None:
        return features.select("doc_id", *(F.lit(0.5).alias(n) for n in names))
    scored = with_odds(features, views, "doc_id")
    odds = (F.col("c_odds"), F.col("m_odds"), (F.col("c_odds") + F.col("m_odds")) / 2)
    return scored.select("doc_id", *((1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias(n) for n, z in zip(names, odds, strict=True)))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """As the contract of classifiers in this list asks: labels of held-out rows,
    crc32(doc_id) mod 5 = 0, are not used."""
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    features = features_of(docs)
    scored = score_quality(features, fit_quality(features, labels.where(~held)))
    return scored.withColumn("held_out", F.coalesce(held, F.lit(False))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
