"""URL filters with trust and distrust spread over the host graph.

A rule (host, path) fits its host and all subdomains if the path of the url starts
with the rule's; the longest that fits decides. For other pages the host graph
does. Its edges are the links between hosts in the pages, and a link both ways
between a host and its parent domain (two labels at least), by which related hosts
vouch for each other. Trust is a personalised PageRank along the edges from hosts with
allowed pages; distrust one against the edges from hosts with blocked pages, since who
links to bad hosts is bad. A host is blocked if its distrust is ``THRESHOLD`` or more
of the sum of both, and allowed if nothing reaches it.

Null urls, and those without ``://``, have an empty host and path: no rule fits, no
edge leaves them, and they are allowed. Null html has no links. Of rules of the same
length that fit, the first in the order of host and path decides. Every row of a page_id
is judged by itself. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from marketloom.llm.common import plain, released, written

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, THRESHOLD = 0.85, 0.5
#: Share of the seeds' weight that may still be under way at the end.
TOLERANCE = 1e-3
LINK = r"(?i)(?:href|src)\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s<>]+)"


def lower_host(host: Column) -> Column:
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def with_host(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumn("host", lower_host(F.regexp_extract(rest, r"^([^/?#]*)", 1))).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def by_rule(rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) by host and path; null where none fits."""

    def first(value) -> Column:
        fits = [F.when(((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p), F.lit(value(h, p, v))) for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))]
        return F.coalesce(*fits, F.lit(None).cast("string"))

    return first(lambda h, p, v: h + p), first(lambda h, p, v: v)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts."""
    found = F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    links = pages.where("host != '' AND html IS NOT NULL").select(F.col("host").alias("src"), found.alias("dst")).withColumn("dst", lower_host(F.col("dst")))
    links = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.where("host != ''").select("host").union(links.select("dst")).distinct()
    labels = F.split("host", r"\.")
    at = F.explode(F.sequence(F.lit(1), F.size(labels) - 2))
    chain = hosts.where(F.size(labels) > 2).select(labels.alias("labels"), at.alias("at"))
    part = lambda i: F.array_join(F.expr(f"slice(labels, {i}, size(labels))"), ".")
    parents = chain.select(part("at").alias("src"), part("at + 1").alias("dst")).distinct().withColumn("weight", F.lit(1.0))
    both = parents.union(parents.select("dst", "src", "weight"))
    return links.union(both).where("src != dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def spread_scores(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score): personalised PageRank by kind, summing to 1. ``edges``
    (kind, src, dst, weight); ``seeds`` (kind, host, weight).

    Each round moves on what the last one moved, and adds it to what hosts hold,
    until every host that can be reached is and less than ``tolerance`` of each kind's
    seeds is under way. What reaches a host without edges out stays
    there; returning it to the seeds would only scale all scores of the kind alike.
    """
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("all"))
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("all"))
    shares = written(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("all")).alias("share")), "shares")
    held = seeds.join(total, "kind").select("kind", "host", (F.col("weight") / F.col("all")).alias("score"), (F.col("weight") / F.col("all")).alias("moving"))
    held, left, reached = _written_with_sums(held)
    before = 0
    while left >= tolerance or reached > before:
        before = reached
        moved = held.where("moving > 0").select("kind", F.col("host").alias("src"), "moving").join(shares, ["kind", "src"])
        moved = moved.select("kind", F.col("dst").alias("host"), (damping * F.col("moving") * F.col("share")).alias("score")).withColumn("moving", F.col("score"))
        both = held.select("kind", "host", "score", F.lit(0.0).alias("moving")).union(moved)
        done = held
        held, left, reached = _written_with_sums(both.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("moving").alias("moving")))
        released(done)
    whole = held.groupBy("kind").agg(F.sum("score").alias("all"))
    return held.join(whole, "kind").select("kind", "host", (F.col("score") / F.col("all")).alias("score"))


def _written_with_sums(held: DataFrame) -> tuple[DataFrame, float, int]:
    """The written rows; the larger sum of ``moving`` of the kinds, and the number of
    hosts reached, both taken while writing."""
    seen = Observation()
    sums = [F.sum(F.when(F.col("kind") == k, F.col("moving"))).alias(k) for k in ("trust", "distrust")]
    out = written(held.observe(seen, *sums, F.count("*").alias("n")), "host-scores")
    got = seen.get
    return out, max(got["trust"] or 0.0, got["distrust"] or 0.0), got["n"]


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    rule, verdict = by_rule(rules)
    rows = with_host(plain(pages, "page_id", "url", "html")).withColumn("rule", rule).withColumn("said", verdict)
    seeds = rows.where("said IS NOT NULL AND host != ''").groupBy(F.when(F.col("said") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").cast("double").alias("weight"))
    links = written(host_edges(rows), "host-edges")
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(links.select(F.lit("distrust"), F.col("dst"), F.col("src"), "weight"))
    scores = spread_scores(edges, seeds)

    def of(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)

    hosts = written(scores.groupBy("host").agg(of("trust"), of("distrust")), "hosts")
    joined = rows.join(hosts, "host", "left").fillna(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust")))
    return joined.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
