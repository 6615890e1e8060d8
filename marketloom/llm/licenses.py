"""License scans: MinHash bands over overlapping windows, then exact containment.

Texts and templates are lower-case words ``[a-z0-9]+`` and shingles of ``SHINGLE``
words. A template of T shingles belongs to the smallest window size W, a power of two, with
T + W / 4 <= W, and windows start every W / 4 shingles (1 at least), so some window holds any
occurrence whole. A window that contains ``CONTAINMENT`` of the template has a
Jaccard similarity of at least 0.8 T / (W + 0.2 T) with it (0.8 T rounded up), and each of ``BANDS``
bands of one MinHash collides with that probability; ``miss_probability`` gives what is
left, below 1e-3 for all templates here. Retrieved pairs are verified by the exact
share of the template's shingles that the window holds. Windows without a shingle of
any template have a share of 0 and are not hashed.

The conditions of the two BSD licences begin alike; the three-clause one is told by its
endorsement clause, a template of its own.

Verified windows of a template that overlap are one finding: from the first to the
last word of the template's shingles in them, with the best share. Positions count
words. Null and empty texts, and texts of fewer words than a shingle, have no
findings. Rows with equal doc_id and text are reported once; rows without doc_id are
reported with null. Columns other than doc_id and text are ignored.

Everything is DataFrame functions. Only the templates, a fixed list, are broadcast.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import plain, row_key

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 24

#: Wordings of public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSD-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
    IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
    INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
    OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
    OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE""",
    "CC-BY-4.0": "Licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-3.0": "licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT-conditions": """to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
    copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
    notice shall be included in all copies or substantial portions of the Software""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def once(value: Column, use: callable) -> Column:
    """``use(value)`` with the value computed once a row: bound to a lambda's name, it
    isn't copied into each place that uses it."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def shingles(w: Column) -> Column:
    """A hash for each place where a shingle starts."""
    return F.when(F.size(w) < SHINGLE, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(w[i + k] for k in range(SHINGLE)))))


def band_keys(values: Column) -> Column:
    """(band, least hash) of a set of shingles."""
    return F.array(*(F.struct(F.lit(k).alias("band"), F.array_min(F.transform(values, _hashed(k))).alias("least")) for k in range(BANDS)))


def _hashed(k: int) -> callable:
    return lambda x: F.xxhash64(x, F.lit(k))


def miss_probability(t: int, window: int) -> float:
    """That no band of a window with the least containment meets a template of t shingles."""
    held = math.ceil(CONTAINMENT * t)
    return (1 - held / (window + t - held)) ** BANDS


def step_of(window: int) -> int:
    return max(1, window // 4)


def window_of(shingles: int) -> int:
    """The smallest window that holds a template wherever it lies on the grid."""
    size = 2
    while shingles + step_of(size) > size:
        size *= 2
    return size


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """(license, own, size): the distinct shingles of each template, its window size.
    Templates may be of any length from a shingle on; a shorter one is an error."""
    templates = TEMPLATES if templates is None else templates
    lengths = {name: len(set(_plain_shingles(text))) for name, text in templates.items()}
    if short := sorted(name for name, n in lengths.items() if not n):
        raise ValueError(f"templates of fewer than {SHINGLE} words: {', '.join(short)}")
    listed = F.explode(F.array(*(F.struct(F.lit(n).alias("license"), F.lit(t).alias("text"), F.lit(window_of(lengths[n])).alias("size")) for n, t in templates.items())))
    rows = spark.range(1).select(listed.alias("t"))
    return rows.select("t.license", F.array_distinct(once(words(F.col("t.text")), shingles)).alias("own"), "t.size")


def _plain_shingles(text: str) -> list[tuple[str, ...]]:
    w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    return [tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, start, end (words, end exclusive) and share of every finding."""
    spark = docs.sparkSession
    known = template_table(spark, templates)
    # the shingles of the templates: a fixed list
    any_of = [r[0] for r in known.select(F.explode("own")).distinct().collect()]
    window_sizes = sorted({r[0] for r in known.select("size").collect()})

    def with_hits(sh: Column) -> Column:
        hits = F.filter(F.transform(sh, lambda x, i: F.when(x.isin(any_of), i)), lambda i: i.isNotNull())
        return F.struct(sh.alias("sh"), hits.alias("hits"))

    found = once(words(F.col("text")), lambda w: once(shingles(w), with_hits))
    found = F.explode(F.array(found))  # a generator, so that filters below don't compute it again
    rows = plain(docs, "doc_id", "text").select("doc_id", row_key().alias("key"), found.alias("f")).where(F.size("f.hits") > 0)
    sizes = F.explode(F.array(*(F.lit(s) for s in window_sizes))).alias("size")
    rows = rows.select("doc_id", "key", "f.sh", "f.hits", sizes).withColumn("step", F.greatest(F.lit(1), F.expr("size div 4")))
    # the windows on the grid that hold a hit
    grid = F.expr("array_distinct(flatten(transform(hits, h -> sequence(greatest(0, ceil((h - size + 1) / step)), h div step))))")
    at = rows.withColumn("at", F.explode(grid)).withColumn("start", (F.col("at") * F.col("step")).cast("int"))
    windows = at.select("doc_id", "key", "size", "start", F.expr("slice(sh, start + 1, int(size))").alias("inside")).distinct()
    keyed = windows.select("*", F.explode(band_keys(F.col("inside"))).alias("k")).select("doc_id", "key", "size", "start", "inside", "k.*")
    bands = known.select("license", "own", "size", F.explode(band_keys(F.col("own"))).alias("k")).select("license", "own", "size", "k.*")
    met = keyed.join(F.broadcast(bands), ["size", "band", "least"])
    share = F.size(F.array_intersect("inside", "own")) / F.size("own")
    good = met.withColumn("share", share).where(F.col("share") >= CONTAINMENT)
    places = F.filter(F.transform("inside", lambda x, i: F.when(F.array_contains("own", x), i)), lambda i: i.isNotNull())
    good = good.withColumn("places", places).select(
        "doc_id", "key", "license", "share", (F.col("start") + F.array_min("places")).alias("start"), (F.col("start") + F.array_max("places") + SHINGLE).alias("end")
    ).distinct()
    # overlapping windows are one finding; a document's own windows are what a group holds
    by = Window.partitionBy("doc_id", "key", "license").orderBy("start", "end", "share")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = good.withColumn("new", F.when(F.col("start") < before, 0).otherwise(1)).withColumn("n", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "key", "license", "n").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.max("share").alias("share")).drop("key", "n")


def license_report(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs).select("doc_id", "license", "start", "end", "share")
