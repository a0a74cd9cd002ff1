"""Graph operators on tables of nodes (id) and edges (src, dst, directed, cost) (N-*). Frontiers and distances are tables;
the driver only counts rounds. Lineage is cut by tables in the shared checkpoint folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local master gets a temporary one; on a
    cluster executors would write to their own disks, so that is an error."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        said = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", said)
    return said


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arcs(edges: DataFrame) -> DataFrame:
    """(src, dst, cost) in every direction an edge can be walked."""
    back = edges.where("not directed").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")
    return edges.select("src", "dst", "cost").unionByName(back)


def inverted(edges: DataFrame) -> DataFrame:
    """N-02: directed edges turned around."""
    turn = F.col("directed")
    return edges.select(F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"), "directed", "cost")


def bfs(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """N-03: (id, level, path) of all nodes reachable from the starts (id), by frontiers; the least path of equal length."""
    a = arcs(edges)
    seen = cut(starts.distinct().select("id", F.lit(0).cast("long").alias("level"), F.array("id").alias("path")))
    front, level = seen, 0
    while True:
        level += 1
        step = front.join(a, front["id"] == a["src"]).select(F.col("dst").alias("id"), F.col("path"))
        new = step.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti")
        front = cut(new.select("id", F.lit(level).cast("long").alias("level"), F.concat("path", F.array("id")).alias("path")))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """N-06: nodes that no directed edge enters and no undirected edge touches."""
    a = arcs(edges)
    return nodes.join(a.select(F.col("dst").alias("id")), "id", "left_anti")


def updown(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """N-07: descendants and ancestors of the chosen nodes, and these."""
    return bfs(edges, chosen).select("id").union(bfs(inverted(edges), chosen).select("id")).distinct()


def depth_first(edges: DataFrame, start: str) -> DataFrame:
    """N-04 on a tree or forest below start: preorder number of each node, children by id. A node's place is that of its
    path among all paths."""
    b = bfs(edges, edges.sparkSession.createDataFrame([(start,)], "id string"))
    return b.select("id", F.array_join("path", "\x00").alias("p")).select("id", (F.row_number().over(Window.orderBy("p")) - 1).cast("long").alias("place"))


def walked(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """N-08: the graph that a walk from the starts (id) creates, its nodes and its edges, each once; merged() adds it to another one."""
    seen = bfs(edges, starts).select("id")
    return nodes.join(seen, "id", "left_semi"), edges.join(seen.withColumnRenamed("id", "src"), "src", "left_semi")


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """N-05: (src, dst, cost, hop) from each source (id), hop the node after it, by rounds of min-plus joins over improved
    distances. A negative cost is an error."""
    a = cut(arcs(edges))
    if not a.where("cost < 0").isEmpty():
        raise ValueError("an edge has a negative cost")
    start = sources.distinct().select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("hop"))
    best = front = cut(start)
    while True:
        step = front.alias("f").join(a.alias("a"), F.col("f.dst") == F.col("a.src")).select("f.src", F.col("a.dst").alias("dst"), (F.col("f.cost") + F.col("a.cost")).alias("cost"), F.coalesce("f.hop", "a.dst").alias("hop"))
        new = step.groupBy("src", "dst").agg(F.min(F.struct("cost", "hop")).alias("n"))
        old = best.select("src", "dst", F.col("cost").alias("c"))
        front = cut(new.join(old, ["src", "dst"], "left").where("c is null or n.cost < c").select("src", "dst", "n.cost", "n.hop"))
        if front.isEmpty():
            return best
        both = best.unionByName(front).groupBy("src", "dst").agg(F.min(F.struct("cost", "hop")).alias("n"))
        best = cut(both.select("src", "dst", "n.cost", "n.hop"))


def merged(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """N-01, U-02, U-03: keyed union; rows of a win."""
    return a.unionByName(b.join(a.select(key), key, "left_anti"))


def flows(graph_edges: DataFrame, supply: DataFrame) -> DataFrame:
    """N-11: (id, supply, inflow, outflow, kind) of capacities: edges carry theirs in `cost`, supply is (id, supply), above 0 for
    a source, below 0 for a sink, else what flows through is directed."""
    ends = graph_edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.col("cost").alias("inflow"), F.lit(0.0).alias("outflow")), F.struct(F.col("src").alias("id"), F.lit(0.0).alias("inflow"), F.col("cost").alias("outflow")))).alias("e")).select("e.*")
    sums = ends.groupBy("id").agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))
    both = sums.join(supply, "id", "full").select("id", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in ("supply", "inflow", "outflow")])
    s = F.col("supply")
    return both.withColumn("kind", F.when(s > 0, "FloodSource").when(s < 0, "FloodSink").otherwise("Directed"))


def force_layout(nodes: list[str], edges: list[tuple[str, str]], rounds: int = 50, length: float = 1.0) -> dict[str, tuple[float, float]]:
    """N-09: force-directed places of one small graph: springs along edges, repulsion of all nodes, pull to the centre, with
    falling step size. Starts on a circle, so that results repeat."""
    import numpy as np

    n, at = len(nodes), {x: i for i, x in enumerate(nodes)}
    p = np.stack([np.cos(2 * np.pi * np.arange(n) / max(n, 1)), np.sin(2 * np.pi * np.arange(n) / max(n, 1))], axis=1)
    s, t = (np.array([at[e[k]] for e in edges], int) for k in (0, 1))
    for r in range(rounds):
        d = p[:, None] - p[None]
        q = (d**2).sum(-1) + 1e-3
        f = (d / q[..., None]).sum(axis=1) * length**2 - 0.05 * p
        if len(s):
            e = p[t] - p[s]
            x = np.sqrt((e**2).sum(-1, keepdims=True)) + 1e-9
            pull = (x - length) / x * e
            np.add.at(f, s, pull)
            np.add.at(f, t, -pull)
        p = p + 0.1 * (1 - r / rounds) * f
    return {x: (float(a), float(b)) for x, (a, b) in zip(nodes, p - p.mean(axis=0), strict=True)}


def layered_layout(levels: DataFrame) -> DataFrame:
    """N-10: a place for each node of bfs(): its level below, its number within the level across."""
    return levels.select("id", F.col("level").alias("y"), (F.row_number().over(Window.partitionBy("level").orderBy("id")) - 1).cast("long").alias("x"))
