"""Balanced states, switches, the frustration bound and the collection of states
(G11, P12, J5, J7, A6, A8-A13, C1-C5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signweave.functions.mixhash import draw
from signweave.functions.order import ranked
from signweave.functions.scratch import Scratch

from .graph import Graph

#: Seeds of the four 32-bit draws of a node that make up a state's key.
KEYS = (1, 2, 3, 4)
#: Bits of a word (a long that stays positive), words of a run.
WORD, RUN = 62, 512


def on_edges(graph: Graph, trees: DataFrame) -> DataFrame:
    """iter, u, v, sign, su, sv, minus, in_tree for each iteration and edge.

    An edge is negative in the balanced state exactly if its ends are on two sides.
    """
    u = trees.select("iter", F.col("node").alias("u"), F.col("s").alias("su"), F.col("parent").alias("pu"))
    v = trees.select("iter", F.col("node").alias("v"), F.col("s").alias("sv"), F.col("parent").alias("pv"))
    both = graph.edges.join(u, "u").join(v, ["iter", "v"])
    in_tree = F.coalesce(F.col("pu") == F.col("v"), F.lit(False)) | F.coalesce(F.col("pv") == F.col("u"), F.lit(False))
    return both.select("iter", "u", "v", "sign", "su", "sv", (F.col("su") != F.col("sv")).alias("minus"), in_tree.alias("in_tree"))


def switches(edge_states: DataFrame) -> DataFrame:
    """iter, switches: edges whose sign the state changes."""
    return edge_states.groupBy("iter").agg(F.sum((F.col("minus") != (F.col("sign") == -1)).cast("long")).alias("switches"))


def frustration_index(per_iteration: DataFrame) -> DataFrame:
    """frustration_index: the least number of switches, an upper bound of the true index."""
    return per_iteration.agg(F.min("switches").alias("frustration_index")).where("frustration_index is not null")


def edge_counts(edge_states: DataFrame) -> DataFrame:
    """u, v, in_tree, negative: iterations in which the edge is in the tree, is negative."""
    return edge_states.groupBy("u", "v").agg(F.sum(F.col("in_tree").cast("long")).alias("in_tree"), F.sum(F.col("minus").cast("long")).alias("negative"))


def state_keys(trees: DataFrame) -> DataFrame:
    """iter, state_key: sums of draws over the nodes that are not on node 0's side.

    The graph hangs together, so two states are equal exactly if their sides are up to a
    swap.  A node has four draws of 32 bits, and sums of them are added in any order, so
    that no row holds the sides of an iteration.
    """
    zero = trees.where("node = 0").select("iter", F.col("s").alias("s0"))
    node = F.col("node")
    sums = [F.sum(F.when(F.col("s") != F.col("s0"), draw(k, F.shiftright(node, 32), node)).otherwise(0)).cast("string") for k in KEYS]
    return trees.join(zero, "iter").groupBy("iter").agg(F.concat_ws("-", *sums).alias("state_key"))


def edge_words(graph: Graph, trees: DataFrame, iterations: int) -> DataFrame:
    """iter, at, bits, switches: every state as words of WORD edges in order of original
    ids, negative edges as ones from the highest bit, and the switches among those edges.

    Until the words are made, a row holds an edge in WORD iterations, not in one.
    """
    shift = lambda way, x, by: F.call_function(way, x, by.cast("int"))
    bit = F.when(F.col("s") == -1, shift("shiftleft", F.lit(1).cast("long"), F.col("iter") % WORD)).otherwise(0)
    packed = trees.groupBy("node", F.floor(F.col("iter") / WORD).alias("group")).agg(F.sum(bit).alias("s"))
    side = lambda c: packed.select(F.col("node").alias(c), "group", F.col("s").alias(f"s{c}"))
    name = lambda c: graph.nodes.select(F.col("nid").alias(c), F.col("orig_id").alias(f"orig_{c}"))
    both = graph.edges.join(name("u"), "u").join(name("v"), "v").join(side("u"), "u").join(side("v"), ["v", "group"])
    minus = both.select("group", "orig_u", "orig_v", "sign", F.col("su").bitwiseXOR(F.col("sv")).alias("minus"))
    # each group has all edges
    placed = ranked(minus, ["group", "orig_u", "orig_v"], "place").withColumn("place", F.col("place") % graph.m)
    first = F.col("group") * WORD
    each = placed.select("place", "sign", "minus", F.explode(F.sequence(first, F.least(first + WORD, F.lit(iterations)) - 1)).alias("iter"))
    one = shift("shiftright", F.col("minus"), F.col("iter") % WORD).bitwiseAND(1)
    rows = each.select(F.col("iter").cast("int").alias("iter"), "place", one.alias("minus"), (F.col("sign") == -1).cast("long").alias("was"))
    bits = F.sum(shift("shiftleft", F.col("minus"), WORD - 1 - F.col("place") % WORD))
    return rows.groupBy("iter", F.floor(F.col("place") / WORD).alias("at")).agg(bits.alias("bits"), F.sum(F.col("minus").bitwiseXOR(F.col("was"))).alias("switches"))


def edge_string_keys(words: DataFrame, m: int) -> DataFrame:
    """iter, state_key: the state's place in the order of whole states as text, edges in
    order of original ids, as a map of such texts lists them; equal states share a place.

    Texts of one graph differ in the digits of its edges alone, so words of edges are
    compared, then runs of RUN words by the places of their words, then runs of runs: no
    row holds a state, and a task compares the iterations of a run.
    """
    places, left = words.select("iter", "at", F.col("bits").alias("place")), -(-m // WORD)
    while True:
        run = F.sort_array(F.collect_list(F.struct("at", "place")))
        runs = places.groupBy("iter", F.floor(F.col("at") / RUN).alias("at")).agg(run["place"].alias("run"))
        place = F.dense_rank().over(Window.partitionBy("at").orderBy("run"))
        places, left = runs.select("iter", "at", place.cast("long").alias("place")), -(-left // RUN)
        if left <= 1:
            return places.select("iter", F.col("place").alias("state_key"))


def cloud(keys: DataFrame, per_iteration: DataFrame, max_states: int | None = None) -> DataFrame:
    """state_key, frequency, switches of each distinct state; with max_states the best of
    them by (switches, key), in place of dropping states when memory runs short."""
    found = keys.join(per_iteration, "iter").groupBy("state_key").agg(F.count("*").alias("frequency"), F.min("switches").alias("switches"))
    return found if max_states is None else found.orderBy("switches", "state_key").limit(max_states)


def merged(*clouds: DataFrame) -> DataFrame:
    """States of several runs over one graph, frequencies added."""
    whole = clouds[0]
    for c in clouds[1:]:
        whole = whole.unionByName(c)
    return whole.groupBy("state_key").agg(F.sum("frequency").alias("frequency"), F.min("switches").alias("switches"))


def best_states(states: DataFrame) -> DataFrame:
    least = states.agg(F.min("switches").alias("least"))
    return states.join(F.broadcast(least), F.col("switches") == F.col("least"), "left_semi")  # one row


def numbered(states: DataFrame) -> DataFrame:
    """The rows of the states file: number by key, frequency, switches."""
    number = (F.col("number") + 1).cast("int")
    return ranked(states, ["state_key"], "number").select(number.alias("Balanced State ID"), F.col("frequency").alias("Frequency"), F.col("switches").alias("Frustration Index"))


def ancestors(trees: DataFrame) -> DataFrame:
    """iter, node, over: every node with itself and each node above it.

    Steps double, so the number of joins grows with the logarithm of the depth; the rows
    are the sum of the depths, which suits breadth-first trees.
    """
    scratch = Scratch(trees.sparkSession, "ancestors")
    # reach: ancestors at distance 0 .. 2^k - 1; jump: the ancestor at distance 2^k
    reach = scratch.table(trees.select("iter", "node", F.col("node").alias("over")), "reach0")
    jump = scratch.table(trees.where("parent is not null").select("iter", "node", F.col("parent").alias("to")), "jump0")
    k = 0
    while jump.limit(1).count():
        k += 1
        further = reach.join(jump.select("iter", F.col("node").alias("over"), "to"), ["iter", "over"]).select("iter", "node", F.col("to").alias("over"))
        reach = scratch.table(reach.unionByName(further), f"reach{k}")
        jump = scratch.table(jump.join(jump.select("iter", F.col("node").alias("to"), F.col("to").alias("far")), ["iter", "to"]).select("iter", "node", F.col("far").alias("to")), f"jump{k}")
    return reach


def subtree_sizes(trees: DataFrame) -> DataFrame:
    """iter, node, size: nodes below and including each node."""
    return ancestors(trees).groupBy("iter", F.col("over").alias("node")).agg(F.count("*").alias("size"))


def preorder_ranges(trees: DataFrame) -> DataFrame:
    """iter, node, begin, finish: preorder numbers of each node's subtree, children by id.

    A node's number is, over itself and its ancestors but the root, the sum of one and the
    sizes of earlier siblings.
    """
    scratch = Scratch(trees.sparkSession, "preorder")
    over = scratch.table(ancestors(trees), "over")
    sizes = over.groupBy("iter", F.col("over").alias("node")).agg(F.count("*").alias("size"))
    placed = scratch.table(trees.select("iter", "node", "parent").join(sizes, ["iter", "node"]), "placed")
    before = F.sum("size").over(Window.partitionBy("iter", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
    steps = placed.withColumn("step", F.when(F.col("parent").isNull(), 0).otherwise(1 + F.coalesce(before, F.lit(0))))
    begins = over.join(steps.select("iter", F.col("node").alias("over"), "step"), ["iter", "over"]).groupBy("iter", "node").agg(F.sum("step").alias("begin"))
    return placed.join(begins, ["iter", "node"]).select("iter", "node", "begin", (F.col("begin") + F.col("size") - 1).alias("finish"))
