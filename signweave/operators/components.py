"""Connected components of an undirected graph given as pairs of ids (G1, A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signweave.functions.scratch import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): the smallest id reachable from each id that an edge names.

    Every id holds a parent, at first its smallest neighbour.  Each round takes
    grandparents and offers them along the edges to the ids and to their parents;
    parents only fall, and the number of rounds grows with the logarithm of the longest
    path.  All minima are partial sums before any shuffle, joins read written tables, so
    that Spark can split the rows of a hub.  Edges with a null end are dropped; no edges,
    no rows.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    there = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null")
    both = there.unionByName(there.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    pairs = scratch.table(both, "pairs")
    parents = scratch.table(pairs.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("p")).select("id", F.least("id", "p").alias("p")), "0")
    before, k = None, 0
    while (now := parents.agg(F.sum(F.col("p").cast("decimal(38,0)")).alias("s")).first().s) != before:
        before, k = now, k + 1
        up = parents.select(F.col("id").alias("p"), F.col("p").alias("g"))
        grand = parents.join(up, "p")  # id, p, g
        offers = pairs.join(grand.select(F.col("id").alias("v"), F.col("g").alias("offer")), "v").select("u", "offer")
        low = offers.groupBy("u").agg(F.min("offer").alias("offer"))
        hooked = grand.join(low, grand.id == low.u).select("id", "p", F.least("g", "offer").alias("g"))
        fallen = hooked.select("id", "g").unionByName(hooked.select(F.col("p").alias("id"), "g"))
        parents = scratch.table(fallen.groupBy("id").agg(F.min("g").alias("p")), str(k))
        scratch.drop(str(k - 1))
    return parents.withColumnRenamed("p", "component")
