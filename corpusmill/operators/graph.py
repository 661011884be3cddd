"""Dependency graphs as tables of edges (src, dst): degrees, reachability, layers, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import written


def import_edges(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """src (path), dst (module) of import lines."""
    py = F.regexp_extract_all(content, F.lit(r"(?m)^\s*(?:from|import)\s+([\w.]+)"), 1)
    js = F.regexp_extract_all(content, F.lit(r"""(?m)(?:from|require\()\s*["']([^"']+)["']"""), 1)
    return files.select(F.col(path).alias("src"), F.explode(F.array_distinct(F.concat(py, js))).alias("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, depth: what the start nodes reach in at most so many steps. Each step is a join with the new nodes only."""
    seen = written(start.select("node", F.lit(0).alias("depth")))
    front = seen
    for d in range(1, depth + 1):
        step = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = written(step.join(seen, "node", "left_anti").select("node", F.lit(d).alias("depth")))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def cyclic(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """node: those left when nodes without incoming or without outgoing edges are peeled off, again and again."""
    left = written(edges.select("src", "dst").distinct())
    n = left.count()
    for _ in range(rounds):
        both = left.select(F.col("src").alias("k")).intersect(left.select(F.col("dst").alias("k")))
        left = written(left.join(both.withColumnRenamed("k", "src"), "src", "left_semi").join(both.withColumnRenamed("k", "dst"), "dst", "left_semi").select("src", "dst"))
        before, n = n, left.count()
        if n == before:
            break
    return left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def layers(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """node, layer: a topological order; a node's dependencies (dst) are in lower layers. Nodes on cycles are left out."""
    left = written(edges.select("src", "dst").distinct())
    nodes = written(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    placed = None
    for k in range(rounds):
        ready = written(nodes.join(left.select(F.col("src").alias("node")), "node", "left_anti").select("node", F.lit(k).alias("layer")))
        if ready.isEmpty():
            break
        placed = ready if placed is None else placed.union(ready)
        nodes = written(nodes.join(ready, "node", "left_anti"))
        left = written(left.join(ready.select(F.col("node").alias("dst")), "dst", "left_anti"))
    return placed if placed is not None else nodes.select("node", F.lit(0).alias("layer"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node reachable.

    edges: (a, b). Large-star and small-star steps by turns until nothing changes.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star over edges that point from the larger to the smaller node
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v"))).distinct()
        before = state
