"""The steps that queries share: clean edges, the dense graph, trees, states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signweave.functions.scratch import Scratch
from signweave.operators import clean, samplers, states
from signweave.operators.graph import Graph, dense_graph, largest_component
from signweave.sources.edges import GRAPHS

#: Cleaned graphs of this session: application, tables, name.
_graphs: dict[tuple[str, str, str], Graph] = {}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return GRAPHS[name](spark, sf_dir)


def graph(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    """The graph of a derived edge list, made once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _graphs:
        _graphs[key] = from_raw(raw(spark, sf_dir, name))
    return _graphs[key]


def from_raw(rows: DataFrame) -> Graph:
    return dense_graph(largest_component(clean.clean_edges(rows)))


class Run:
    """Trees of one sampler and what follows from them, written once."""

    def __init__(self, g: Graph, sampler: str, iterations: int, seed: int = 17):
        self.graph, self.iterations = g, iterations
        scratch = Scratch(g.edges.sparkSession, f"run-{sampler}")
        self.trees = scratch.table(samplers.sample(g, sampler, iterations, seed), "trees")
        self.edge_states = states.on_edges(g, self.trees)
        self.switches = states.switches(self.edge_states)
        self.scratch = scratch

    def cloud(self, max_states: int | None = None) -> DataFrame:
        return states.cloud(states.state_keys(self.trees), self.switches, max_states)
