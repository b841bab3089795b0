"""Sides of states and consensus features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .graph import Graph, degrees


def positive_components(graph: Graph, edge_states: DataFrame, trees: DataFrame) -> DataFrame:
    """iter, node, component: what hangs together by edges that are positive in the state,
    by its smallest node; a node without any is a component of its own."""
    n = max(1, graph.n)
    code = lambda c: F.col("iter").cast("long") * n + F.col(c)
    linked = connected_components(edge_states.where("not minus").select(code("u").alias("a"), code("v").alias("b")), "a", "b")
    named = linked.select(F.floor(F.col("id") / n).cast("int").alias("iter"), (F.col("id") % n).alias("node"), (F.col("component") % n).alias("component"))
    return trees.select("iter", "node").join(named, ["iter", "node"], "left").select("iter", "node", F.coalesce("component", "node").alias("component"))


def quotient(edge_states: DataFrame, components: DataFrame) -> DataFrame:
    """iter, a, b: pairs of components that a negative edge joins, a < b."""
    of = lambda c, name: components.select("iter", F.col("node").alias(c), F.col("component").alias(name))
    crossing = edge_states.where("minus").join(of("u", "cu"), ["iter", "u"]).join(of("v", "cv"), ["iter", "v"])
    return crossing.select("iter", F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).distinct()


def source_components(components: DataFrame) -> DataFrame:
    """iter, component, nodes: the largest component; of equals the one of the lowest node."""
    sizes = components.groupBy("iter", "component").agg(F.count("*").alias("nodes"))
    best = sizes.groupBy("iter").agg(F.max(F.struct("nodes", (-F.col("component")).alias("low"))).alias("best"))
    return best.select("iter", (-F.col("best.low")).alias("component"), "best.nodes")


def hops(pairs: DataFrame, components: DataFrame, source: DataFrame) -> DataFrame:
    """iter, component, hops: steps over the quotient from the source component."""
    from signweave.functions.scratch import Scratch

    scratch = Scratch(pairs.sparkSession, "hops")
    both = scratch.table(pairs.select("iter", "a", "b").unionByName(pairs.select("iter", F.col("b").alias("a"), F.col("a").alias("b"))), "pairs")
    seen = [scratch.table(source.select("iter", "component", F.lit(0).alias("hops")), "hop0")]
    while seen[-1].limit(1).count():
        ahead = seen[-1].join(both.withColumnRenamed("a", "component"), ["iter", "component"]).select("iter", F.col("b").alias("component")).distinct()
        near = seen[-1] if len(seen) == 1 else seen[-1].unionByName(seen[-2])
        new = ahead.join(near, ["iter", "component"], "left_anti")
        seen.append(scratch.table(new.select("iter", "component", F.lit(len(seen)).alias("hops")), f"hop{len(seen)}"))
    whole = seen[0]
    for part in seen[1:]:
        whole = whole.unionByName(part)
    return whole


def sides(trees: DataFrame, source: DataFrame) -> DataFrame:
    """iter, node, side: whether a node is on the source component's side.

    Every step over the quotient changes the side, so an even number of steps from the
    source is the source's own sign.
    """
    at = source.select("iter", F.col("component").alias("node")).join(trees.select("iter", "node", F.col("s").alias("s0")), ["iter", "node"]).select("iter", "s0")
    return trees.join(at, "iter").select("iter", "node", (F.col("s") == F.col("s0")).alias("side"))


def edge_features(graph: Graph, edge_states: DataFrame, side: DataFrame, iterations: int) -> DataFrame:
    """u, v (original ids), agreement, authority, resolution."""
    counts = _edge_counts(edge_states, side)
    status = side.groupBy("node").agg(F.sum(F.col("side").cast("long")).alias("on"))
    of = lambda c: status.select(F.col("node").alias(c), F.col("on").alias(f"on_{c}"))
    whole = counts.join(of("u"), "u").join(of("v"), "v")
    name = lambda c: graph.nodes.select(F.col("nid").alias(c), F.col("orig_id").alias(f"orig_{c}"))
    whole = whole.join(name("u"), "u").join(name("v"), "v")
    ratio = lambda x, y: (F.col(x) if isinstance(x, str) else x).cast("double") / y
    return whole.select(
        F.least("orig_u", "orig_v").alias("u"),
        F.greatest("orig_u", "orig_v").alias("v"),
        ratio("agreement", iterations).alias("agreement"),
        ratio(F.col("on_u") + F.col("on_v"), 2 * iterations).alias("authority"),
        ratio("resolution", iterations).alias("resolution"),
    )


def _edge_counts(edge_states: DataFrame, side: DataFrame) -> DataFrame:
    of = lambda c: side.select("iter", F.col("node").alias(c), F.col("side").alias(f"side_{c}"))
    placed = edge_states.join(of("u"), ["iter", "u"]).join(of("v"), ["iter", "v"])
    return placed.groupBy("u", "v").agg(F.sum((F.col("side_u") & F.col("side_v")).cast("long")).alias("agreement"), F.sum((F.col("minus") == (F.col("sign") == -1)).cast("long")).alias("resolution"))


def node_features(graph: Graph, edge_states: DataFrame, side: DataFrame, iterations: int) -> DataFrame:
    """orig_id, status, influence, strength; whole sums, divided once."""
    counts = _edge_counts(edge_states, side)
    ends = counts.select(F.explode(F.array("u", "v")).alias("nid"), "agreement", "resolution")
    sums = ends.groupBy("nid").agg(F.sum("agreement").alias("a"), F.sum("resolution").alias("r"))
    status = side.groupBy(F.col("node").alias("nid")).agg(F.sum(F.col("side").cast("long")).alias("on"))
    whole = graph.nodes.join(status, "nid").join(sums, "nid").join(degrees(graph.edges), "nid")
    of = lambda c, d: F.col(c).cast("double") / d
    return whole.select("orig_id", of("on", iterations).alias("status"), of("a", F.col("degree") * iterations).alias("influence"), of("r", F.col("degree") * iterations).alias("strength"))
