"""The pipeline stage by stage against brute force, and as a whole."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from marketloom.llm import packing, secrets, toxicity
from marketloom.llm.common import table
from tests.llm.test_contracts import contamination
from tests.llm.test_near_copies import five_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """The driver's smallest tables with awkward rows added."""
    path = str(tmp_path_factory.mktemp("sf"))
    docs = table(spark, SF, "documents")
    item = table(spark, SF, "benchmark").first().text
    filler = " ".join(f"filler{i}" for i in range(900))
    rows = [
        (900001, None), (900002, ""), (900003, "tie"), (900003, "tie"), (900004, item), (900005, f"{filler} {item} {filler}"),
        (900006, "my password = hunter22hunter22 here"), (900007, "word " * 5000), (None, "no id, but kept"),
    ]
    extra = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'xx' AS lang", "NULL AS source", "CAST(length(text) AS long) AS n_chars")
    # names that the stages use inside
    clash = {c: F.lit("clash") for c in ("doc", "score", "offending", "hit_words", "n_words", "item_ids", "node", "text_key", "_id", "_key", "keeps", "found", "spans", "row", "fp")}
    docs.unionByName(extra).withColumns(clash).repartition(3).write.parquet(os.path.join(path, "documents.parquet"))
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(os.path.join(path, f"{name}.parquet"))
    return path


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, sf):
    docs = table(spark, sf, "documents").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]

    clean = stages["toxicity"](spark, docs, sf).cache()
    model = toxicity.contract_model(docs, table(spark, sf, "labels"))
    score = toxicity.scorer(model)
    assert clean.columns == docs.columns
    assert Counter(rows_of(clean)) == Counter((d, t) for d, t in rows_of(docs) if score(t or "")[0] < 0.5)

    single = stages["near_duplicates"](spark, clean, sf).cache()
    rows = [(d, t) for d, t in rows_of(clean) if d is not None]
    sets, label = [five_words(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    groups = {x: [d for (d, _), y in zip(rows, label) if y == x] for x in set(label)}
    want = Counter(min(g) for g in groups.values()) + Counter([None])
    assert Counter(d for d, _ in rows_of(single)) == want and single.columns == docs.columns
    assert len(want) < len(rows) - 10

    fresh = stages["decontamination"](spark, single, sf).cache()
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    judged = {d: (hit, bad) for d, _, hit, _, _, bad in contamination(rows_of(single), items)}
    before, after = dict(rows_of(single)), dict(rows_of(fresh))
    assert set(after) == {d for d, (_, bad) in judged.items() if not bad} and fresh.columns == docs.columns
    assert all(after[d] == before[d] for d in after if not judged[d][0])
    assert not judged[900005][1] and "filler899 " in after[900005] and len(after[900005]) < len(before[900005])
    assert all(n == 0 for _, _, n, _, _, _ in contamination(after.items(), items))

    masked = stages["secrets"](spark, fresh, sf).cache()
    assert masked.columns == docs.columns and {d for d, _ in rows_of(masked)} == set(after)
    for d, t in rows_of(masked):
        strong, weak = secrets.scan(after[d] or "")
        assert t == after[d] if not strong and not weak else not [s for s in secrets.scan(t)[0]]
    assert "[assign]" in dict(rows_of(masked))[900006]

    tokenizer = packing.encoder(packing.default_tokenizer())
    want = Counter()
    for d, t in rows_of(masked):
        ids = np.append(np.frombuffer(tokenizer([t or ""])[0], "<u4"), np.uint32(0)).astype("<u4")
        for n, s in enumerate(range(0, len(ids), 2048)):
            want[d, n, zlib.crc32(ids[s : s + 2048].tobytes())] += 1
    got = stages["packing"](spark, masked, sf).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in got) == want
    whole = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole) == want


def test_empty_documents(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, sf, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_nothing_else_needs_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(root):
        if folder.endswith("llm") or ".git" in folder:
            continue
        for name in names:
            if name.endswith(".py") and name not in ("corpus_pipeline.py", "__spark_entry__.py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert not re.search(r"marketloom\.llm|corpus_pipeline", f.read()), name
