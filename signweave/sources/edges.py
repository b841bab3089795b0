"""Edge lists: text files (S1) and the graphs derived from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signweave.functions.order import ranked, with_next


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """seq, src, dst, sign of a text file of `src,dst,sign` lines after one header line.

    seq is the place in the file (of several files: by name), whatever the splits.  A row
    that is not three whole numbers keeps its seq and has nulls, so cleaning can report it.
    A path that does not exist is Spark's own error.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    placed = ranked(rows, ["file", "at", "row"], "seq").where("seq > 0")
    pattern = r"^\s*([+-]?\d+)\s*,\s*([+-]?\d+)\s*,\s*([+-]?\d+)\s*$"
    part = lambda i, kind: F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, i).try_cast(kind))
    return placed.select("seq", part(1, "long").alias("src"), part(2, "long").alias("dst"), part(3, "int").alias("sign"))


def edge_table(df: DataFrame, order: list) -> DataFrame:
    """Any table with src, dst and sign, put in order."""
    return ranked(df.select(*order, "src", "dst", "sign"), order, "seq").select("seq", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("sign").cast("int").alias("sign"))


def _tables(spark: SparkSession, sf_dir: str):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of consecutive events: errors are negative, views neutral, sign-ups out of range."""
    events = _tables(spark, sf_dir)("events").select("ts", "event_id", "user_id", "event_type")
    sign = F.expr("case event_type when 'error' then -1 when 'signup' then 2 when 'view' then 0 else 1 end")
    found = with_next(events, ["ts", "event_id"], "user_id", "dst").where("dst is not null")
    return found.select("seq", F.col("user_id").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), sign.cast("int").alias("sign"))


_FLAG = "case l_returnflag when 'R' then -1 when 'A' then 1 else 0 end as sign"


def custpart_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the parts of their large discounted lines: sparse, in many components."""
    t = _tables(spark, sf_dir)
    lines = t("lineitem").where("l_quantity >= 45 and l_discount >= 0.07").join(t("orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return edge_table(lines.selectExpr(*order, "o_custkey * 2 as src", "l_partkey * 2 + 1 as dst", _FLAG), order)


def nation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers and of suppliers of all lines: small and dense."""
    t = _tables(spark, sf_dir)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    lines = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
    lines = lines.join(t("customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.expr("l_suppkey = s_suppkey"))
    return edge_table(lines.selectExpr(*order, "c_nationkey as src", "s_nationkey as dst", _FLAG), order)


def custsupp_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of all lines, signed by quantity: large and bipartite."""
    t = _tables(spark, sf_dir)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    lines = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
    return edge_table(lines.selectExpr(*order, "o_custkey * 2 as src", "l_suppkey * 2 + 1 as dst", "cast(floor((l_quantity - 1) / 10) as int) - 2 as sign"), order)


GRAPHS = {"events": events_graph, "custpart": custpart_graph, "nation": nation_graph, "custsupp": custsupp_graph}
