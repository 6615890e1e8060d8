"""Secret scans with linking of multipart credentials.

Strong findings (assigned passwords and tokens, access ids, hex keys) are reported
as they are. Weak candidates are too common to report alone: user names and short
access ids (``identifier``), short or bare key material (``fragment``) and
``endpoint`` addresses. An interval join by document and position finds the parts
within ``SCOPE`` code points of each other; an identifier counts if key material is
near, a fragment if an identifier or endpoint is near, and an endpoint if both an
identifier and key material are near. Strong findings are parts, too: an access id
is an identifier, the others are key material.

Positions are code points, ends exclusive. Null and empty texts have no findings.
Repeated rows and rows of one doc_id are scanned one by one. Columns other than
doc_id and text are passed on untouched or ignored.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marketloom.llm.common import boxed, by_batch, unboxed, written

#: Kinds in the order in which they are listed; the first three are strong.
KINDS = ("assign", "access", "hex", "identifier", "fragment", "endpoint")
ROLES = {"access": "identifier", "identifier": "identifier", "assign": "key", "hex": "key", "fragment": "key", "endpoint": "endpoint"}
SCOPE = 200
_GIVEN = r"[\"']?\x20*[:=]\x20*[\"']?"
ASSIGN = re.compile(rf"(password|passwd|secret|token|api_?key){_GIVEN}([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
WEAK_ACCESS = re.compile(r"(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{8,}")
NAMED = re.compile(rf"\b(?:(user(?:name)?|login|client_?id|access_?key_?id)|(pwd|pass_?phrase|private_?key|credential|signature)|(host|endpoint|server)){_GIVEN}([A-Za-z0-9@+/_.:=-]{{4,}})", re.I | re.A)
BARE = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
ADDRESS = re.compile(r"https?://[^\s\"'<>]+")


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Strong findings and weak candidates as (kind, start, end)."""
    strong, weak, low = [], [], text.lower()
    if any(n in low for n in ASSIGN_NAMES):
        for m in ASSIGN.finditer(text):
            (strong if len(m[2]) >= 6 else weak).append(("assign" if len(m[2]) >= 6 else "fragment", *m.span()))
    if "AKIA" in text:
        strong += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if max(map(len, text.split()), default=0) >= 16:
        for m in HEX.finditer(text):
            (strong if len(m[0]) >= 24 else weak).append(("hex" if len(m[0]) >= 24 else "fragment", *m.span()))
        weak += [("fragment", *m.span()) for m in BARE.finditer(text)]
    if any(n in text for n in ("AKIA", "ASIA", "AROA", "AIDA")):
        weak += [("identifier", *m.span()) for m in WEAK_ACCESS.finditer(text)]
    if ":" in text or "=" in text:
        weak += [("identifier" if m[1] else "fragment" if m[2] else "endpoint", *m.span()) for m in NAMED.finditer(text)]
    if "://" in text:
        weak += [("endpoint", *m.span()) for m in ADDRESS.finditer(text)]
    return strong, apart(sorted(set(weak), key=lambda x: (x[1], KINDS.index(x[0]), x[2])), strong)


def apart(weak: list[tuple[str, int, int]], strong: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Those of ``weak`` that overlap none of ``strong``. The union of the strong spans is
    a sorted list of disjoint ones, in which each weak span is looked up."""
    starts, ends = [], []
    for _, start, end in sorted(strong, key=lambda x: x[1]):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)

    def free(start: int, end: int) -> bool:
        at = bisect.bisect_right(ends, start)
        return at == len(ends) or starts[at] >= end

    return [w for w in weak if free(w[1], w[2])] if strong else weak


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS_DDL = "array<struct<kind:string,start:long,end:long>>"


def _scanned(names: list[str]) -> callable:
    def make() -> callable:
        def work(batch: pa.RecordBatch) -> dict:
            got = [scan(t or "") for t in batch["text"].to_pylist()]
            as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
            return {n: batch[n] for n in names} | {"strong": [as_rows(s) for s, _ in got], "weak": [as_rows(w) for _, w in got]}

        return work

    return make


def scanned(docs: DataFrame, names: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``names``, the findings of each row's text, and ``row``, its number."""
    df = docs.select(*(F.col(f"`{n}`") for n in dict.fromkeys((*names, "text")))).withColumn("text", F.col("text").cast("string"))
    kept = df.select(*names)
    schema = pa.schema([*to_arrow_schema(kept.schema), ("strong", SPANS), ("weak", SPANS)])
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"strong {SPANS_DDL}", f"weak {SPANS_DDL}"])
    return df.mapInArrow(by_batch(_scanned(list(names)), schema), ddl).withColumn("row", F.monotonically_increasing_id())


def linked(scans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, added): the weak candidates that complementary parts confirm.

    Parts go to the bins of ``scope`` code points they touch, weak candidates to
    all bins within ``scope``, so a join by (row, bin) meets every pair that can be
    near, in one bin or more. What stands in a bin is bounded by its length.
    """
    role = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    some = scans.where(F.size("weak") > 0)

    def bins(column, before=0):
        return F.explode(F.sequence(F.floor((F.col(f"{column}.start") - before) / scope), F.floor((F.col(f"{column}.end") + before) / scope)))

    weak = some.select("row", F.explode("weak").alias("w")).withColumn("bin", bins("w", scope))
    part = some.select("row", F.explode(F.concat("weak", "strong")).alias("p")).withColumn("bin", bins("p"))
    near = weak.join(part, ["row", "bin"]).where((F.col("p.start") - F.col("w.end") <= scope) & (F.col("w.start") - F.col("p.end") <= scope) & (F.col("w") != F.col("p")))
    has = [F.bool_or(role[F.col("p.kind")] == r).alias(r) for r in ("identifier", "key", "endpoint")]
    kind = F.col("w.kind")
    confirmed = F.when(kind == "identifier", F.col("key")).when(kind == "fragment", F.col("identifier") | F.col("endpoint")).otherwise(F.col("identifier") & F.col("key"))
    return near.groupBy("row", "w").agg(*has).where(confirmed).groupBy("row").agg(F.collect_list("w").alias("added"))


def find_secrets(docs: DataFrame, scope: int = SCOPE, names: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``names`` of every row, strong, and spans (strong and added, by
    start and kind)."""
    scans = written(scanned(docs, names), "scans")
    added = linked(scans, scope)
    kinds = F.array(*map(F.lit, KINDS))

    def by_start(spans):
        ranked = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(kinds, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
        return F.transform(F.array_sort(ranked), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    out = scans.join(added, "row", "left")
    return out.select(*names, by_start("strong").alias("strong"), by_start(F.concat("strong", F.coalesce("added", F.array().cast(SPANS_DDL)))).alias("spans"))


def _listed(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _of_kind(kind: str) -> callable:
    return lambda x: x["kind"] == kind


def secrets_report(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs)
    counts = [F.size(F.filter("strong", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(_listed("strong"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def masked(text: str, spans: list[dict]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that
    overlap, the first names the whole."""
    out, at = [], 0
    for x in spans:
        if x["start"] >= at:
            out += [text[at : x["start"]], f"[{x['kind']}]"]
        at = max(at, x["end"])
    return "".join([*out, text[at:]])


def _masked() -> callable:
    def work(batch: pa.RecordBatch) -> dict:
        spans = batch["found"].to_pylist()
        return {"doc": batch["doc"], "text": [masked(t, s) if s else t for t, s in zip(batch["text"].to_pylist(), spans, strict=True)]}

    return work


def redact(docs: DataFrame) -> DataFrame:
    """All documents, every found secret replaced by its kind in brackets. Text and
    findings travel in one row."""
    found = find_secrets(boxed(docs), names=("doc", "text")).select("doc", "text", F.col("spans").alias("found"))
    out = found.select("doc", "text")
    return unboxed(found.mapInArrow(by_batch(_masked, to_arrow_schema(out.schema)), out.schema), docs)
