"""Cleaning of edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _judged(raw: DataFrame) -> DataFrame:
    """raw with the undirected pair and what a row is by itself."""
    alone = F.when(F.col("src").isNull() | F.col("dst").isNull() | F.col("sign").isNull(), "malformed").when(F.col("src") == F.col("dst"), "self").when(~F.col("sign").between(-1, 1), "range")
    return raw.select("seq", "src", "dst", "sign", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), alone.alias("alone"))


def clean_edges(raw: DataFrame) -> DataFrame:
    """seq, u, v, sign: the first valid row of each unordered pair, with its own sign.

    The first row is a minimum, summed in part before the shuffle, so a pair that holds a
    third of all rows is one row per task.
    """
    first = _judged(raw).where("alone is null").groupBy("u", "v").agg(F.min(F.struct("seq", "sign")).alias("first"))
    return first.select("first.seq", "u", "v", "first.sign")


def edge_classes(raw: DataFrame) -> DataFrame:
    """Every row and its class: malformed, self, range, kept, dup (same sign as the pair's
    first row) or inconsistent (another sign)."""
    rows = _judged(raw)
    first = clean_edges(raw).select("u", "v", F.col("seq").alias("first_seq"), F.col("sign").alias("first_sign"))
    found = rows.join(first, ["u", "v"], "left")
    paired = F.when(F.col("seq") == F.col("first_seq"), "kept").when(F.col("sign") == F.col("first_sign"), "dup").otherwise("inconsistent")
    return found.select("seq", "src", "dst", "sign", F.coalesce("alone", paired).alias("class"))


def load_stats(raw: DataFrame) -> DataFrame:
    """Rows of each class, from counts per pair and sign alone."""
    rows = _judged(raw)
    dropped = rows.where("alone is not null").groupBy(F.col("alone").alias("class")).agg(F.count("*").alias("n"))
    signs = rows.where("alone is null").groupBy("u", "v", "sign").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    pairs = signs.groupBy("u", "v").agg(F.sum("n").alias("n"), F.min(F.struct("seq", F.col("n").alias("same"))).alias("first"))
    sums = pairs.agg(F.count("*").alias("kept"), F.sum(F.col("first.same") - 1).alias("dup"), F.sum(F.col("n") - F.col("first.same")).alias("inconsistent"))
    tall = sums.selectExpr("stack(3, 'kept', kept, 'dup', dup, 'inconsistent', inconsistent) as (class, n)")
    return dropped.unionByName(tall).where("n > 0")
