"""One call from an edge list to its reports: python -m signweave EDGES ITERATIONS OUT.

OUT gets the folders report, iterations, states, history and, if asked for, features.
Each step is printed with its seconds.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from signweave.operators import clean, consensus, relax, states
from signweave.operators.samplers import SAMPLERS
from signweave.plans.prepare import Run, from_raw
from signweave.sources import sinks
from signweave.sources.edges import read_edge_list


def analyse(spark: SparkSession, edges: str, iterations: int, out: str, sampler: str = "bfs", seed: int = 17, max_states: int | None = None, features: bool = False, say=print) -> DataFrame:
    """Write the reports of an edge list below out; returns frustration_index.

    sampler is one of SAMPLERS, or "gradient", which gives the history alone.  An edge list
    without usable edges gives empty files and no row.
    """
    began = time.perf_counter()

    def done(step: str) -> None:
        say(f"{step}: {time.perf_counter() - began:.1f} s")

    rows = read_edge_list(spark, edges)
    for r in clean.load_stats(rows).orderBy("class").collect():
        say(f"{r['class']}: {r.n}")
    graph = from_raw(rows)
    done(f"graph of {graph.n} nodes and {graph.m} edges")
    if sampler == "gradient":
        history = relax.gradient_history(graph, iterations)
        sinks.write_history(history, f"{out}/history")
        done("history")
        return states.frustration_index(history.withColumnRenamed("frustration", "switches"))
    run = Run(graph, sampler, iterations, seed)
    found = run.scratch.table(run.switches, "switches")
    done(f"{iterations} trees")
    cloud = run.scratch.table(run.cloud(max_states), "cloud")
    sinks.write_report(cloud, iterations, f"{out}/report")
    sinks.write_iterations(found, f"{out}/iterations")
    sinks.write_states(cloud, f"{out}/states")
    sinks.write_history(found.withColumnRenamed("switches", "frustration"), f"{out}/history")
    done("reports")
    if features:
        marked = run.scratch.table(run.edge_states, "edges")
        parts = run.scratch.table(consensus.positive_components(graph, marked, run.trees), "components")
        sides = run.scratch.table(consensus.sides(run.trees, consensus.source_components(parts)), "sides")
        sinks.write_features(consensus.edge_features(graph, marked, sides, iterations), consensus.node_features(graph, marked, sides, iterations), f"{out}/features")
        done("features")
    return states.frustration_index(found)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="signweave", description=__doc__.split("\n")[0])
    parser.add_argument("edges", help="text file of src,dst,sign below a header line")
    parser.add_argument("iterations", type=int)
    parser.add_argument("out", help="folder of the reports")
    parser.add_argument("--sampler", default="bfs", choices=[*SAMPLERS, "gradient"])
    parser.add_argument("--seed", type=int, default=17)
    parser.add_argument("--max-states", type=int)
    parser.add_argument("--features", action="store_true")
    found = analyse(SparkSession.builder.getOrCreate(), **vars(parser.parse_args(argv)))
    for r in found.collect():
        print(f"frustration index: at most {r.frustration_index}")


if __name__ == "__main__":
    main()
