"""Frustration from relaxed signs by gradient steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signweave.functions.mixhash import mix, mix_np
from signweave.functions.scratch import Scratch

from .graph import Graph, adjacency
from .samplers import IN_WORKER
from .samplers.kernels import Csr


def gradient_history(graph: Graph, iterations: int, rate: float = 0.001, in_worker: int = IN_WORKER) -> DataFrame:
    """iter, frustration before each step, for whole signs 1 where the relaxed sign is not
    negative and -1 elsewhere.  A step adds rate / 2 times the signed sum of the
    neighbours.  Starts come from a hash of the node, between -1 and 1.
    """
    if graph.m > in_worker:
        return _by_joins(graph, iterations, rate)
    spark = graph.edges.sparkSession
    table = graph.edges.select("u", "v", "sign").toArrow()
    held = spark.sparkContext.broadcast(([table.column(c).to_numpy() for c in ("u", "v", "sign")], graph.n))

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (u, v, sign), n = held.value
        for _ in (1 for batch in batches for _ in range(len(batch) * bool(n))):
            csr = Csr(u, v, sign, n)
            x, found = 2.0 * mix_np(np.arange(1, n + 1)) / (1 << 32) - 1, []
            for _ in range(iterations):
                whole = np.where(x >= 0, 1, -1)
                found.append(int((whole[u] * whole[v] * sign == -1).sum()))
                x = x + 0.5 * rate * np.bincount(csr.src, x[csr.ends] * csr.signs, n)
            yield pd.DataFrame({"iter": range(iterations), "frustration": found})

    return spark.range(0, 1, 1, 1).mapInPandas(steps, "iter int, frustration long")


def _by_joins(graph: Graph, iterations: int, rate: float) -> DataFrame:
    """The same steps as joins, the signs written after each."""
    spark = graph.edges.sparkSession
    scratch = Scratch(spark, "relax")
    adj = scratch.table(adjacency(graph.edges), "adjacency")
    x = scratch.table(graph.nodes.select(F.col("nid").alias("node"), (mix(F.col("nid") + 1) * 2.0 / (1 << 32) - 1).alias("x")), "x0")
    found = []
    for i in range(iterations):
        whole = x.select("node", F.when(F.col("x") >= 0, 1).otherwise(-1).alias("w"))
        of = lambda c: whole.select(F.col("node").alias(c), F.col("w").alias(f"w{c}"))  # noqa: B023, E731
        conflict = graph.edges.join(of("u"), "u").join(of("v"), "v").where("wu * wv * sign = -1").count()
        found.append((i, conflict))
        pull = adj.join(x.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("x") * F.col("sign")).alias("pull"))
        x = scratch.table(x.join(pull, "node").select("node", (F.col("x") + 0.5 * rate * F.col("pull")).alias("x")), f"x{i + 1}")
        scratch.drop(f"x{i}")
    return spark.createDataFrame(found, "iter int, frustration long")
