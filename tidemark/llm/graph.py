"""Connected components of an edge table, by alternating large and small stars; tables only, nothing goes to the driver.

Each round is a map-side combined minimum per node and a join that adaptive execution can split where a node is hot. The
rounds end when a round changes nothing; their number grows with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import core


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (u, v): the least node reachable. Self-loops and repeats don't matter."""
    e = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = core.stash(e, "edges")
    seen, old = _digest(e), []
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        new = core.stash(small.select("x.*").where("u != v").distinct(), "edges")
        now = _digest(new)
        old.append(e)
        e = new
        if now == seen:
            break
        seen = now
    for x in old:
        core.drop_stash(x.sparkSession, x)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
