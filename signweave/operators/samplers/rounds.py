"""Breadth-first trees as rounds of joins, all iterations at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signweave.functions.mixhash import as_signed, draw, mix
from signweave.functions.order import ranked
from signweave.functions.scratch import Scratch
from signweave.operators.graph import Graph, adjacency, iteration_roots


def breadth_first(graph: Graph, iterations: int, seed: int = 17) -> DataFrame:
    """A node's parent is, of its neighbours one level up, the one of the highest (signed
    hash, tag), where the tag holds the neighbour's id and the parity of its level and the
    hash mixes the tag, the node and the iteration's seed; a maximum, so in any order.
    """
    scratch = Scratch(graph.edges.sparkSession, "rounds")
    adj = scratch.table(adjacency(graph.edges), "adjacency")
    start = iteration_roots(graph, iterations, by_degree=True).select("iter", F.col("nid").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("level"), F.lit(1).alias("s"))
    reached = [scratch.table(start, "level0")]
    level = 0
    while reached[-1].limit(1).count():
        tag = F.shiftleft(F.col("node"), 2).bitwiseOR((level & 1) | 2)
        plus = F.col("iter").cast("long") + seed
        mixed = as_signed(mix(tag.bitwiseXOR(F.col("dst")).bitwiseXOR((plus * plus + plus).bitwiseAND(0xFFFFFFFF))))
        ahead = reached[-1].join(adj, reached[-1].node == adj.src).select("iter", "dst", F.struct(mixed.alias("hash"), tag.alias("tag"), F.col("node").alias("parent"), (F.col("s") * F.col("sign")).alias("s")).alias("offer"))
        best = ahead.groupBy("iter", F.col("dst").alias("node")).agg(F.max("offer").alias("offer"))
        # only the last two levels can be met again
        near = reached[-1] if level == 0 else reached[-1].unionByName(reached[-2])
        new = best.join(near.select("iter", "node"), ["iter", "node"], "left_anti")
        level += 1
        reached.append(scratch.table(new.select("iter", "node", "offer.parent", F.lit(level).alias("level"), "offer.s"), f"level{level}"))
    whole = reached[0]
    for part in reached[1:]:
        whole = whole.unionByName(part)
    return whole


def first_in_first_out(graph: Graph, iterations: int, seed: int = 17) -> DataFrame:
    """Trees of a queue that takes each node's neighbours in the order of a draw, from node
    iter % n: a node's parent is the neighbour one level up that stands first in the queue.

    The place in the queue is the rank of (parent's place, draw, node) among the level's
    nodes; ranks run over all iterations at once, as only their order within one counts.
    """
    scratch = Scratch(graph.edges.sparkSession, "queue")
    adj = scratch.table(adjacency(graph.edges), "adjacency")
    start = iteration_roots(graph, iterations, by_degree=False).select("iter", F.col("nid").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("level"), F.lit(1).alias("s"), F.lit(0).cast("long").alias("place"))
    reached = [scratch.table(start, "level0")]
    while not reached[-1].isEmpty():
        level = len(reached)
        offer = F.struct("place", draw(seed, F.col("iter"), F.col("src"), F.col("dst")).alias("draw"), F.col("src").alias("parent"), (F.col("s") * F.col("sign")).cast("int").alias("s"))
        ahead = reached[-1].withColumnRenamed("node", "src").join(adj, "src").select("iter", F.col("dst").alias("node"), offer.alias("offer"))
        # only the last two levels can be met again
        near = reached[-1] if level == 1 else reached[-1].unionByName(reached[-2])
        new = ahead.groupBy("iter", "node").agg(F.min("offer").alias("offer")).join(near.select("iter", "node"), ["iter", "node"], "left_anti")
        queued = ranked(new.select("iter", "node", "offer.*"), ["iter", "place", "draw", "node"], f"place{level}", scratch)
        reached.append(scratch.table(queued.select("iter", "node", "parent", F.lit(level).alias("level"), "s", F.col(f"place{level}").alias("place")), f"level{level}"))
    paths = [f"{scratch.root}/level{k}" for k in range(len(reached))]
    return graph.edges.sparkSession.read.schema(reached[0].schema).parquet(*paths).drop("place")
