"""From clean edges to the dense graph of the largest component."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signweave.functions.order import ranked
from signweave.functions.scratch import Scratch

from .components import connected_components


@dataclass
class Graph:
    """nodes: nid, orig_id; edges: u, v, sign (dense ids, u < v, sign 1 or -1)."""

    nodes: DataFrame
    edges: DataFrame
    n: int
    m: int


def component_labels(edges: DataFrame) -> DataFrame:
    """node, component: the smallest original id of the component."""
    return connected_components(edges, "u", "v").withColumnRenamed("id", "node")


def component_sizes(edges: DataFrame) -> DataFrame:
    return component_labels(edges).groupBy("component").agg(F.count("*").alias("nodes"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the component of most nodes; of equals, of the one whose first row is first."""
    scratch = Scratch(edges.sparkSession, "largest")
    edges = scratch.table(edges, "edges")
    labels = scratch.table(component_labels(edges), "labels")
    first = edges.join(labels, edges.u == labels.node).groupBy("component").agg(F.min("seq").alias("first"))
    sizes = labels.groupBy("component").agg(F.count("*").alias("nodes"))
    best = sizes.join(first, "component").orderBy(F.desc("nodes"), "first").limit(1).select("component")
    kept = labels.join(F.broadcast(best), "component").select("node")  # one row
    return edges.join(kept, edges.u == kept.node, "left_semi")


def dense_graph(edges: DataFrame) -> Graph:
    """Ids by first appearance in the edges sorted by (u, v), u before v; sign 0 is positive."""
    scratch = Scratch(edges.sparkSession, "graph")
    edges = scratch.table(edges.select("u", "v", "sign"), "edges")
    seen = edges.select(F.col("u").alias("orig_id"), "u", "v", F.lit(0).alias("end")).unionByName(edges.select(F.col("v").alias("orig_id"), "u", "v", F.lit(1).alias("end")))
    first = seen.groupBy("orig_id").agg(F.min(F.struct("u", "v", "end")).alias("first"))
    nodes = scratch.table(ranked(first, ["first"], "nid", scratch).select("nid", "orig_id"), "nodes")
    by = lambda c, new: nodes.select(F.col("orig_id").alias(c), F.col("nid").alias(new))
    dense = edges.join(by("u", "a"), "u").join(by("v", "b"), "v")
    table = dense.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.when(F.col("sign") == -1, -1).otherwise(1).alias("sign"))
    table = scratch.table(table, "dense")
    return Graph(nodes, table, nodes.count(), table.count())


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "sign").unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst"), "sign"))


def degrees(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy(F.col("src").alias("nid")).agg(F.count("*").alias("degree"))


def adjacency_lists(edges: DataFrame) -> DataFrame:
    """nid, neighbours (ascending) and the signs in the same order."""
    lists = adjacency(edges).groupBy(F.col("src").alias("nid")).agg(F.sort_array(F.collect_list(F.struct("dst", "sign"))).alias("ends"))
    return lists.select("nid", F.col("ends.dst").alias("neighbours"), F.col("ends.sign").alias("signs"))


def roots(graph: Graph, iterations: int) -> DataFrame:
    """k, nid: the min(iterations, n) nodes of highest degree; of equals the lowest id."""
    top = degrees(graph.edges).orderBy(F.desc("degree"), "nid").limit(min(iterations, graph.n))
    return top.select((F.row_number().over(Window.orderBy(F.desc("degree"), "nid")) - 1).cast("long").alias("k"), "nid")


def iteration_roots(graph: Graph, iterations: int, by_degree: bool) -> DataFrame:
    """iter, nid: the roots list over and over, or dense ids over and over."""
    iters = graph.edges.sparkSession.range(iterations).select(F.col("id").cast("int").alias("iter"))
    if not by_degree:
        return iters.select("iter", (F.col("iter") % graph.n).cast("long").alias("nid"))
    return iters.withColumn("k", F.col("iter") % graph.n).join(F.broadcast(roots(graph, iterations)), "k").select("iter", "nid")  # iterations rows at most
