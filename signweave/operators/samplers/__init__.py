"""Spanning-tree samplers.

``sample(graph, sampler, iterations, seed)`` gives one row per iteration and node: iter,
node, parent (null at the root), level (null where the sampler has none) and s, the side
that the tree gives the node.  All that follows depends on s and the tree alone.

Iterations are independent.  While a graph's edges fit one worker, each iteration is a
task with the graph at hand; beyond that, breadth-first samplers and Kruskal run as
rounds of joins over all iterations at once.  Depth-first search, random walks and Prim
are sequential by definition and need the graph in one worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from signweave.operators.graph import Graph

from . import kernels, kruskal, rounds

#: Edges that a worker holds: about 16 bytes each way, and the kernels' arrays.
IN_WORKER = 20_000_000
SAMPLERS = ("bfs", "dfs", "rdfs", "aldous", "kruskal", "prim", "hybrid", "enhanced")


def sample(graph: Graph, sampler: str, iterations: int, seed: int = 17, in_worker: int = IN_WORKER) -> DataFrame:
    """Trees and sides of each iteration; an empty graph or no iterations give no rows."""
    if sampler not in SAMPLERS:
        raise ValueError(f"unknown sampler {sampler!r}; one of {', '.join(SAMPLERS)}")
    if graph.m <= in_worker:
        return kernels.run(graph, sampler, iterations, seed)
    if sampler == "bfs":
        return rounds.breadth_first(graph, iterations, seed)
    if sampler == "enhanced":
        return rounds.first_in_first_out(graph, iterations, seed)
    if sampler == "kruskal":
        return kruskal.spanning_trees(graph, iterations, seed)
    raise ValueError(f"{sampler} walks the graph in one worker, which holds {in_worker} edges; this graph has {graph.m}")
