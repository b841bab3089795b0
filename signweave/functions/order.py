"""Global order without a single task: range partitions and a count of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

_BITS = 33  # Spark's own split of an increasing id into partition and row


def ranked(df: DataFrame, order: list, name: str, scratch: Scratch | None = None) -> DataFrame:
    """df with the column `name`: 0, 1, 2, ... in the given order, over all rows.

    The rows are range-partitioned and sorted and written once, so that ids are settled;
    what reaches the driver is one count per partition.
    """
    scratch = scratch or Scratch(df.sparkSession, "order")
    placed = scratch.table(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), f"by-{name}")
    part = F.shiftright("_at", _BITS)
    counts = sorted(placed.groupBy(part.alias("part")).count().collect())
    before, total = {}, 0
    for p, n in counts:
        before[p], total = total, total + n
    if not before:
        return placed.withColumn(name, F.col("_at")).drop("_at")
    first = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    return placed.withColumn(name, first[part] + F.col("_at").bitwiseAND((1 << _BITS) - 1)).drop("_at")


def with_next(df: DataFrame, order: list, value: str, name: str, seq: str = "seq") -> DataFrame:
    """df with seq, its place in the order, and the next row's value (null at the end).

    Rows look ahead inside blocks of neighbouring places; the first of the next block is
    one row of a table of blocks.
    """
    block = 1 << 16
    placed = Scratch(df.sparkSession, "next").table(ranked(df, order, seq), "placed").withColumn("_block", F.floor(F.col(seq) / block))
    heads = placed.where(F.col(seq) % block == 0).select((F.col("_block") - 1).alias("_block"), F.col(value).alias("_head"))
    ahead = F.lead(value).over(Window.partitionBy("_block").orderBy(seq))
    last = F.col(seq) % block == block - 1
    return placed.withColumn("_ahead", ahead).join(heads, "_block", "left").withColumn(name, F.when(last, F.col("_head")).otherwise(F.col("_ahead"))).drop("_ahead", "_head", "_block")
