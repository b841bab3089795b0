"""One query for each operator of the survey, over graphs derived from the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signweave.operators import clean, consensus, graph, relax, states
from signweave.operators.samplers import kruskal as mst
from signweave.sources import sinks

from .prepare import Run
from .prepare import graph as made
from .prepare import raw

ITERATIONS, CONSENSUS_ITERATIONS, STEPS = 16, 8, 10

Query = Callable[[SparkSession, str], DataFrame]


def _events(sampler: str = "bfs", iterations: int = ITERATIONS, name: str = "events"):
    return lambda spark, d: Run(made(spark, d, name), sampler, iterations)


def _int(*columns: str):
    return [F.col(c).cast("int").alias(c) for c in columns]


def _switches(sampler: str, name: str = "events") -> Query:
    return lambda spark, d: _events(sampler, name=name)(spark, d).switches.select(*_int("iter"), "switches")


def _degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(made(spark, d, "events").edges)


def _negative_share(spark: SparkSession, d: str) -> DataFrame:
    e = made(spark, d, "events").edges.agg(F.sum((F.col("sign") == -1).cast("long")).alias("negative"), F.count("*").alias("edges"))
    return e.select("negative", "edges", (F.col("negative").cast("double") / F.col("edges")).alias("share"))


def _adjacency_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = graph.adjacency_lists(made(spark, d, "events").edges)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return lists.select("nid", text("neighbours"), text("signs"))


def _bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    return _events()(spark, d).trees.select(*_int("iter"), "node", *_int("level"))


def _bfs_parents(spark: SparkSession, d: str) -> DataFrame:
    return _events()(spark, d).trees.where("parent is not null").select(*_int("iter"), "node", "parent")


def _bfs_signs(spark: SparkSession, d: str) -> DataFrame:
    return _events()(spark, d).trees.select(*_int("iter"), "node", *_int("s"))


def _frustration_index(spark: SparkSession, d: str) -> DataFrame:
    return states.frustration_index(_events()(spark, d).switches)


def _min_states(spark: SparkSession, d: str) -> DataFrame:
    best = states.best_states(_events()(spark, d).cloud())
    return best.agg(F.count("*").alias("states"), F.min("switches").alias("switches"))


def _cloud(spark: SparkSession, d: str) -> DataFrame:
    return _events()(spark, d).cloud()


def _best_cloud(spark: SparkSession, d: str) -> DataFrame:
    return _events()(spark, d).cloud(max_states=5)


def _states_csv(spark: SparkSession, d: str) -> DataFrame:
    return states.numbered(_events()(spark, d).cloud())


def _report(spark: SparkSession, d: str) -> DataFrame:
    return sinks.report_lines(_events()(spark, d).cloud(), ITERATIONS).select(F.col("line_no").cast("long").alias("line_no"), "line")


def _edge_counts(column: str) -> Query:
    return lambda spark, d: states.edge_counts(_events()(spark, d).edge_states).select("u", "v", column)


def _subtree_sizes(spark: SparkSession, d: str) -> DataFrame:
    return states.subtree_sizes(_events()(spark, d).trees).select(*_int("iter"), "node", "size")


def _preorder(spark: SparkSession, d: str) -> DataFrame:
    return states.preorder_ranges(_events()(spark, d).trees).select(*_int("iter"), "node", "begin", "finish")


def _edge_string_states(spark: SparkSession, d: str) -> DataFrame:
    run = _events()(spark, d)
    words = run.scratch.table(states.edge_words(run.graph, run.trees, run.iterations), "words")
    switches = words.groupBy("iter").agg(F.sum("switches").alias("switches"))
    return states.numbered(states.cloud(states.edge_string_keys(words, run.graph.m), switches))


class _Sides:
    def __init__(self, spark: SparkSession, d: str):
        self.run = _events(iterations=CONSENSUS_ITERATIONS)(spark, d)
        table = self.run.scratch.table
        self.edges = table(self.run.edge_states, "edges")
        self.components = table(consensus.positive_components(self.run.graph, self.edges, self.run.trees), "components")
        self.source = consensus.source_components(self.components)
        self.sides = consensus.sides(self.run.trees, self.source)


def _pos_components(spark: SparkSession, d: str) -> DataFrame:
    return _Sides(spark, d).components.select(*_int("iter"), "node", "component")


def _cc_quotient(spark: SparkSession, d: str) -> DataFrame:
    x = _Sides(spark, d)
    return consensus.quotient(x.edges, x.components).select(*_int("iter"), "a", "b")


def _cc_hops(spark: SparkSession, d: str) -> DataFrame:
    x = _Sides(spark, d)
    return consensus.hops(consensus.quotient(x.edges, x.components), x.components, x.source).select(*_int("iter"), "component", *_int("hops"))


def _sides(spark: SparkSession, d: str) -> DataFrame:
    return _Sides(spark, d).sides.select(*_int("iter"), "node", "side")


def _consensus_edges(spark: SparkSession, d: str) -> DataFrame:
    x = _Sides(spark, d)
    return consensus.edge_features(x.run.graph, x.edges, x.sides, CONSENSUS_ITERATIONS)


def _consensus_nodes(spark: SparkSession, d: str) -> DataFrame:
    x = _Sides(spark, d)
    return consensus.node_features(x.run.graph, x.edges, x.sides, CONSENSUS_ITERATIONS)


def _kruskal_tree(spark: SparkSession, d: str) -> DataFrame:
    g = made(spark, d, "nation")
    ends = Run(g, "kruskal", 2).trees.where("parent is not null").select("iter", F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"))
    return ends.select(*_int("iter"), "u", "v", mst.weight_of(g, 17, "u", "v").alias("w"))


def _mst_weight(spark: SparkSession, d: str) -> DataFrame:
    return _kruskal_tree(spark, d).groupBy("iter").agg(F.sum("w").alias("weight"))


def _history(spark: SparkSession, d: str) -> DataFrame:
    return _events("enhanced")(spark, d).switches.select(*_int("iter"), F.col("switches").alias("frustration"))


def _gradient(name: str) -> Query:
    return lambda spark, d: relax.gradient_history(made(spark, d, name), STEPS)


QUERIES: dict[str, Query] = {
    "frustration_index": _frustration_index,
    "edge_classes": lambda spark, d: clean.edge_classes(raw(spark, d, "events")),
    "clean_edges": lambda spark, d: clean.clean_edges(raw(spark, d, "events")),
    "load_stats": lambda spark, d: clean.load_stats(raw(spark, d, "events")),
    "load_stats_custsupp": lambda spark, d: clean.load_stats(raw(spark, d, "custsupp")),
    "undirected_degree": _degrees,
    "negative_share": _negative_share,
    "adjacency_lists": _adjacency_lists,
    "root_order": lambda spark, d: graph.roots(made(spark, d, "events"), ITERATIONS),
    "component_labels": lambda spark, d: graph.component_labels(clean.clean_edges(raw(spark, d, "custpart"))),
    "component_sizes": lambda spark, d: graph.component_sizes(clean.clean_edges(raw(spark, d, "custpart"))),
    "largest_component": lambda spark, d: graph.largest_component(clean.clean_edges(raw(spark, d, "custpart"))).select("u", "v", "sign"),
    "dense_ids": lambda spark, d: made(spark, d, "events").nodes,
    "edges_dense": lambda spark, d: made(spark, d, "events").edges,
    "bfs_levels": _bfs_levels,
    "bfs_parents": _bfs_parents,
    "bfs_signs": _bfs_signs,
    "bfs_switches": _switches("bfs"),
    "nation_bfs_switches": _switches("bfs", "nation"),
    "custpart_bfs_switches": _switches("bfs", "custpart"),
    "min_states": _min_states,
    "cloud": _cloud,
    "cloud_best": _best_cloud,
    "states_csv": _states_csv,
    "report_lines": _report,
    "tree_edge_counts": _edge_counts("in_tree"),
    "neg_edge_counts": _edge_counts("negative"),
    "subtree_sizes": _subtree_sizes,
    "preorder_ranges": _preorder,
    "states_by_edge_string": _edge_string_states,
    "pos_components": _pos_components,
    "cc_quotient": _cc_quotient,
    "cc_hops": _cc_hops,
    "sides": _sides,
    "consensus_edges": _consensus_edges,
    "consensus_nodes": _consensus_nodes,
    "kruskal_tree": _kruskal_tree,
    "mst_weight": _mst_weight,
    "kruskal_switches": _switches("kruskal"),
    "dfs_switches": _switches("dfs"),
    "rdfs_switches": _switches("rdfs"),
    "aldous_switches": _switches("aldous"),
    "prim_switches": _switches("prim"),
    "hybrid_switches": _switches("hybrid"),
    "enhanced_history": _history,
    "gradient_history": _gradient("events"),
    "gradient_history_nation": _gradient("nation"),
}
