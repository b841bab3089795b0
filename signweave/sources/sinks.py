"""Reports (S5-S9): bounded summaries, written to a folder that the caller names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signweave.operators.states import best_states, numbered


# The phrases of the report.
INDEX = "Frustration Index (%d iterations): "
AT_LEAST = "# of Unique Balanced States With Minimum Number of Switches: "
DETAIL = "Detailed Analysis:"
OF_STATE, OF_ITERATION = "# of Switches of Balanced State #", "# of Switches of iteration "
CLOSING = "Minimum # of Switches after %d iteration(s): "


def report_lines(states: DataFrame, iterations: int) -> DataFrame:
    """line_no, line: the bound, the number of states at it, every state's switches and the
    bound again; states are those of so many iterations.  No states give no lines."""
    least = states.agg(F.min("switches").alias("least"), F.count("*").alias("n")).where("n > 0")
    best = best_states(states).agg(F.count("*").alias("at"))
    number = F.col("Balanced State ID")
    each = numbered(states).select((number + 4).alias("line_no"), F.concat(F.lit(OF_STATE), number, F.lit(": "), F.col("Frustration Index")).alias("line"))
    index, closing = F.concat(F.lit(INDEX % iterations), "least"), F.concat(F.lit(CLOSING % iterations), "least")
    fixed = [(F.lit(1), index), (F.lit(2), F.concat(F.lit(AT_LEAST), "at")), (F.lit(3), F.lit("")), (F.lit(4), F.lit(DETAIL)), ((F.col("n") + 5).cast("int"), closing)]
    frame = least.crossJoin(best).select(F.inline(F.array(*(F.struct(no.alias("line_no"), line.alias("line")) for no, line in fixed))))  # one row each
    return frame.unionByName(each)


def write_report(states: DataFrame, iterations: int, path: str) -> None:
    report_lines(states, iterations).orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)


def write_iterations(per_iteration: DataFrame, path: str) -> None:
    lines = per_iteration.orderBy("iter").select(F.concat(F.lit(OF_ITERATION), F.col("iter"), F.lit(": "), F.col("switches")).alias("line"))
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_states(states: DataFrame, path: str) -> None:
    numbered(states).orderBy("Balanced State ID").coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_history(history: DataFrame, path: str) -> None:
    history.orderBy("iter").select(F.col("frustration").cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_features(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").csv(f"{path}/edges", header=True)
    nodes.write.mode("overwrite").csv(f"{path}/nodes", header=True)
