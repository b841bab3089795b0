"""Minimum spanning trees on random weights as rounds of joins.

The order (weight, u, v) is total, so the tree is unique: the edge that each part of an
iteration's forest likes best is in it, and taking all of these at once, round by round,
gives the same tree as taking edges in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signweave.functions.mixhash import draw
from signweave.functions.scratch import Scratch
from signweave.operators.components import connected_components
from signweave.operators.graph import Graph


def weighted(graph: Graph, iterations: int, seed: int) -> DataFrame:
    """iter, u, v, sign, w for every edge and iteration."""
    each = graph.edges.select("u", "v", "sign", F.explode(F.slice(F.sequence(F.lit(0), F.lit(iterations)), 1, iterations)).alias("iter"))
    return each.withColumn("w", weight_of(graph, seed, "u", "v")).select("iter", "u", "v", "sign", "w")


def weight_of(graph: Graph, seed: int, u: str, v: str) -> Column:
    """The lower of two draws from 1 to 2 |E|, one for each direction."""
    one = lambda a, b: draw(seed, F.col("iter"), F.col(a), F.col(b)) % F.lit(max(1, 2 * graph.m)) + 1
    return F.least(one(u, v), one(v, u))


def tree_edges(graph: Graph, iterations: int, seed: int) -> DataFrame:
    """iter, u, v, sign, w of the minimum spanning tree of each iteration, by rounds."""
    scratch = Scratch(graph.edges.sparkSession, "kruskal")
    n = max(1, graph.n)
    part = lambda c: F.col("iter").cast("long") * n + F.col(c)
    left = scratch.table(weighted(graph, iterations, seed).withColumns({"a": part("u"), "b": part("v")}), "edges0")
    taken, k = [], 0
    while left.limit(1).count():
        best = F.min(F.struct("w", "u", "v", "sign", "iter", "a", "b")).alias("e")
        sides = left.withColumn("p", F.explode(F.array("a", "b")))
        chosen = scratch.table(sides.groupBy("p").agg(best).select("e.*").distinct(), f"taken{k}")
        taken.append(chosen.select("iter", "u", "v", "sign", "w"))
        merged = scratch.table(connected_components(chosen, "a", "b"), f"merged{k}")
        moved = left.join(renamed(merged, "a"), "a", "left").join(renamed(merged, "b"), "b", "left")
        moved = moved.withColumns({"a": F.coalesce("a_to", "a"), "b": F.coalesce("b_to", "b")}).drop("a_to", "b_to").where("a != b")
        left, k = scratch.table(moved, f"edges{k + 1}"), k + 1
    found = graph.edges.select(F.lit(0).alias("iter"), "u", "v", "sign", F.lit(0).cast("long").alias("w")).limit(0)
    for part_of in taken:
        found = found.unionByName(part_of)
    return scratch.table(found, "tree")


def renamed(merged: DataFrame, c: str) -> DataFrame:
    return merged.select(F.col("id").alias(c), F.col("component").alias(f"{c}_to"))


def spanning_trees(graph: Graph, iterations: int, seed: int) -> DataFrame:
    """Trees hung up at node iter % n: each round takes the neighbours of the last one's
    nodes but their parents, as nothing else of a tree has been reached before."""
    scratch = Scratch(graph.edges.sparkSession, "hung")
    tree = tree_edges(graph, iterations, seed)
    ways = tree.select("iter", F.col("u").alias("src"), F.col("v").alias("dst"), "sign").unionByName(tree.select("iter", F.col("v").alias("src"), F.col("u").alias("dst"), "sign"))
    ways = scratch.table(ways, "ways")
    root = (F.col("iter") % max(1, graph.n)).cast("long")
    start = graph.edges.sparkSession.range(iterations if graph.n else 0).select(F.col("id").cast("int").alias("iter"))
    reached = [scratch.table(start.select("iter", root.alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("level"), F.lit(1).alias("s")), "level0")]
    while not reached[-1].isEmpty():
        level = len(reached)
        last = reached[-1].select("iter", F.col("node").alias("src"), F.col("parent").alias("above"), "s")
        ahead = last.join(ways, ["iter", "src"]).where("above is null or dst != above")
        found = ahead.select("iter", F.col("dst").alias("node"), F.col("src").alias("parent"), F.lit(level).alias("level"), (F.col("s") * F.col("sign")).cast("int").alias("s"))
        reached.append(scratch.table(found, f"level{level}"))
    paths = [f"{scratch.root}/level{k}" for k in range(len(reached))]
    return graph.edges.sparkSession.read.schema(reached[0].schema).parquet(*paths)
