"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import released, written


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): every node of an edge with the smallest node that it
    can reach. Self-links and repeated edges do no harm; null ends are ignored.

    Alternates two steps until nothing changes. In the first, each node points
    its larger neighbours to its smallest neighbour; in the second, it does so
    with its smaller neighbours. Both keep components whole and end in stars.
    A step is an aggregate with map-side combine and a join of two written
    tables, which Spark splits where a node has very many edges. The tables of a step are deleted
    when the next edges are written.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    now = written(pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        lowest = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        done, now = now, written(small.select("e.u", "e.v").where("u != v").distinct(), "edges")
        released(done, least, large, lowest)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == before:
            break
        before = state
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops.select("node", F.col("node").alias("component"))) if before[0] else spark.createDataFrame([], f"node {edges.schema[left].dataType.simpleString()}, component {edges.schema[left].dataType.simpleString()}")
