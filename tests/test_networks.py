"""Operators on the hand-checkable graph of FIXTURES.md."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from signweave.__main__ import analyse
from signweave.functions.mixhash import draw_np
from signweave.operators import clean, consensus, graph, relax, samplers, states
from signweave.operators.components import connected_components
from signweave.operators.samplers import kruskal, rounds
from signweave.plans.prepare import Run, from_raw
from signweave.plans.prepare import graph as made
from signweave.plans.queries import QUERIES
from signweave.sources import sinks
from signweave.sources.edges import read_edge_list

ROWS = "10,20,1 20,10,1 20,30,-1 30,20,1 30,10,1 30,40,0 40,50,-1 50,30,-1 50,60,1 60,10,-1 7,7,1 20,40,2 70,80,1 80,90,-1".split()

#: Switches of 16 iterations, from FIXTURES.md.
GOLDEN = {
    ("events", "bfs"): [38, 36, 42, 46, 36, 44, 48, 38, 42, 44, 36, 42, 52, 36, 50, 38],
    ("events", "dfs"): [36, 36, 36, 42, 38, 42, 36, 36, 36, 40, 36, 36, 36, 42, 38, 36],
    ("custpart", "bfs"): [5, 2, 3, 3, 3, 4, 4, 4, 5, 3, 4, 5, 5, 5, 4, 3],
    ("custpart", "dfs"): [3, 3, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 3, 2, 3],
    ("nation", "bfs"): [90, 74, 94, 88, 82, 92, 84, 78, 78, 82, 88, 84, 72, 78, 96, 86],
    ("nation", "dfs"): [86, 84, 86, 84, 86, 76, 78, 78, 88, 86, 82, 86, 84, 84, 80, 84],
}


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(i + 1, *map(int, r.split(","))) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "seq long, src long, dst long, sign int").cache()


@pytest.fixture(scope="module")
def tiny(raw):
    return from_raw(raw)


@pytest.fixture(scope="module")
def run(tiny):
    return Run(tiny, "bfs", 8)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_classes_and_statistics(raw):
    counts = {r["class"]: r.n for r in clean.load_stats(raw).collect()}
    assert counts == {"self": 1, "range": 1, "dup": 1, "inconsistent": 1, "kept": 10}
    by_row = {r["class"]: r["count"] for r in clean.edge_classes(raw).groupBy("class").count().collect()}
    assert by_row == counts


def test_text_source_keeps_order_and_reports_malformed_rows(spark, tmp_path):
    path = tmp_path / "edges.csv"
    path.write_text("src,dst,sign\n" + "\n".join([*ROWS, "a,b,c", "1,2", " 11 , 12 , 1"]) + "\n")
    got = read_edge_list(spark, str(path))
    assert [r.src for r in got.orderBy("seq").collect()][:4] == [10, 20, 20, 30]
    counts = {r["class"]: r.n for r in clean.load_stats(got).collect()}
    assert counts["malformed"] == 2 and counts["kept"] == 11


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_edge_list(spark, str(tmp_path / "none.csv")).count()


def test_dense_graph(tiny):
    assert (tiny.n, tiny.m) == (6, 8)
    assert rows(tiny.nodes.select("nid", "orig_id"), "nid") == [(0, 10), (1, 20), (2, 30), (3, 60), (4, 40), (5, 50)]
    assert rows(tiny.edges, "u", "v") == [(0, 1, 1), (0, 2, 1), (0, 3, -1), (1, 2, -1), (2, 4, 1), (2, 5, -1), (3, 5, 1), (4, 5, -1)]
    assert [r.nid for r in graph.roots(tiny, 6).orderBy("k").collect()] == [2, 0, 5, 1, 3, 4]
    assert graph.adjacency(tiny.edges).count() == 2 * tiny.m


def test_components(raw, spark):
    labels = graph.component_labels(clean.clean_edges(raw))
    assert {r.component for r in labels.collect()} == {10, 70}
    chain = spark.range(300).selectExpr("id as src", "id + 1 as dst")
    assert connected_components(chain).where("component = 0").count() == 301
    assert connected_components(chain.limit(0)).count() == 0


def test_breadth_first_switches_states_and_parents(run):
    assert [r.switches for r in run.switches.orderBy("iter").collect()] == [1, 1, 1, 2, 1, 1, 1, 1]
    first = {r.node: (r.parent, r.s) for r in run.trees.where("iter = 0").collect()}
    assert first == {0: (2, 1), 1: (2, -1), 2: (None, 1), 4: (2, 1), 5: (2, -1), 3: (5, -1)}
    cloud = run.cloud()
    assert cloud.count() == 3 and states.best_states(cloud).count() == 2
    assert cloud.agg(F.sum("frequency")).first()[0] == 8
    assert run.cloud(max_states=1).count() == 1
    assert states.merged(cloud, cloud).agg(F.sum("frequency")).first()[0] == 16


def test_exact_frustration_bounds_every_sampler(tiny):
    edges = rows(tiny.edges, "u", "v")
    exact = min(sum(s[u] * s[v] != w for u, v, w in edges) for s in product((1, -1), repeat=tiny.n))
    assert exact == 1
    for name in samplers.SAMPLERS:
        x = Run(tiny, name, 7)
        assert x.trees.count() == 7 * tiny.n
        assert x.trees.where("parent is null").groupBy("iter").count().where("count = 1").count() == 7
        assert min(r.switches for r in x.switches.collect()) >= exact
        in_tree = x.edge_states.where("in_tree")
        assert in_tree.count() == 7 * (tiny.n - 1)
        assert in_tree.where("minus != (sign = -1)").count() == 0
    assert [r.switches for r in Run(tiny, "dfs", 8).switches.orderBy("iter").collect()] == [2, 1, 1, 2, 1, 1, 2, 1]


def test_rounds_give_what_kernels_give(tiny):
    kernel = samplers.sample(tiny, "bfs", 5)
    joined = rounds.breadth_first(tiny, 5)
    assert sorted(map(tuple, kernel.collect()), key=str) == sorted(map(tuple, joined.collect()), key=str)
    by_kernel = {(r.iter, r.node): (r.parent, r.s) for r in samplers.sample(tiny, "kruskal", 2).collect()}
    assert {(r.iter, r.node): (r.parent, r.s) for r in kruskal.spanning_trees(tiny, 2, 17).collect()} == by_kernel


def test_large_graphs_are_refused_by_sequential_samplers(tiny):
    with pytest.raises(ValueError, match="in one worker"):
        samplers.sample(tiny, "dfs", 2, in_worker=3)
    with pytest.raises(ValueError, match="unknown sampler"):
        samplers.sample(tiny, "none", 2)


def test_consensus(tiny, run):
    components = consensus.positive_components(tiny, run.edge_states, run.trees)
    side = consensus.sides(run.trees, consensus.source_components(components))
    nodes = {r.orig_id: (r.status, round(r.influence, 6), round(r.strength, 6)) for r in consensus.node_features(tiny, run.edge_states, side, 8).collect()}
    assert nodes == {10: (1.0, 0.458333, 0.791667), 20: (0.5, 0.4375, 0.5625), 30: (0.875, 0.53125, 0.875), 40: (0.875, 0.4375, 1.0), 50: (0.125, 0.0, 0.958333), 60: (0.0, 0.0, 0.9375)}
    edges = {(r.u, r.v): (r.agreement, r.authority, r.resolution) for r in consensus.edge_features(tiny, run.edge_states, side, 8).collect()}
    assert edges[10, 20] == (0.5, 0.75, 0.5) and edges[50, 60] == (0.0, 0.0625, 0.875) and edges[30, 40] == (0.875, 0.875, 1.0)


def test_gradient_kernel_and_joins_agree(tiny):
    assert rows(relax.gradient_history(tiny, 3), "iter") == rows(relax.gradient_history(tiny, 3, in_worker=0), "iter")


def test_subtree_sizes(run, tiny):
    sizes = states.subtree_sizes(run.trees)
    roots = run.trees.where("parent is null").select("iter", "node")
    assert {r["size"] for r in sizes.join(roots, ["iter", "node"]).collect()} == {tiny.n}


def test_sinks(run, tmp_path):
    cloud = run.cloud()
    sinks.write_report(cloud, 8, str(tmp_path / "report"))
    sinks.write_states(cloud, str(tmp_path / "states"))
    sinks.write_iterations(run.switches, str(tmp_path / "iterations"))
    found = {r.state_key: (r.frequency, r.switches) for r in cloud.collect()}
    ordered = [found[k] for k in sorted(found)]
    assert lines(tmp_path / "report") == [
        "Frustration Index (8 iterations): 1",
        "# of Unique Balanced States With Minimum Number of Switches: 2",
        "",
        "Detailed Analysis:",
        *(f"# of Switches of Balanced State #{i + 1}: {n}" for i, (_, n) in enumerate(ordered)),
        "Minimum # of Switches after 8 iteration(s): 1",
    ]
    assert lines(tmp_path / "states") == ["Balanced State ID,Frequency,Frustration Index", *(f"{i + 1},{f},{n}" for i, (f, n) in enumerate(ordered))]
    assert lines(tmp_path / "iterations") == [f"# of Switches of iteration {i}: {n}" for i, n in enumerate((1, 1, 1, 2, 1, 1, 1, 1))]


def lines(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*"))).splitlines()


def test_one_call_writes_every_report(spark, tmp_path):
    path, said = tmp_path / "edges.csv", []
    path.write_text("src,dst,sign\n" + "\n".join(ROWS) + "\n")
    got = analyse(spark, str(path), 8, str(tmp_path / "out"), features=True, say=said.append)
    assert got.first().frustration_index == 1 and "kept: 10" in said
    assert lines(tmp_path / "out" / "history") == ["1", "1", "1", "2", "1", "1", "1", "1"]
    assert len(lines(tmp_path / "out" / "report")) == 5 + 3
    nodes = [x for x in lines(tmp_path / "out" / "features" / "nodes") if not x.startswith("orig_id")]
    assert sorted(x.split(",")[:2] for x in nodes)[:2] == [["10", "1.0"], ["20", "0.5"]] and len(nodes) == 6
    analyse(spark, str(path), 3, str(tmp_path / "relaxed"), sampler="gradient", say=said.append)
    assert len(lines(tmp_path / "relaxed" / "history")) == 3


def test_states_are_equal_up_to_a_swap_of_sides(spark):
    sides = [[1, 1, -1, -1], [-1, -1, 1, 1], [1, -1, -1, 1], [1, 1, 1, 1], [-1, -1, -1, -1]]
    trees = spark.createDataFrame([(i, v, s) for i, x in enumerate(sides) for v, s in enumerate(x)], "iter int, node long, s int")
    keys = {r.iter: r.state_key for r in states.state_keys(trees).collect()}
    assert keys[0] == keys[1] and keys[3] == keys[4] and len(set(keys.values())) == 3


@pytest.mark.parametrize("name", ["events", "custpart", "nation"])
def test_golden_switches_of_every_graph(spark, name):
    g = made(spark, "/root/testdata/sf0.001", name)
    for sampler in ("bfs", "dfs"):
        assert [r.switches for r in Run(g, sampler, 16).switches.orderBy("iter").collect()] == GOLDEN[name, sampler]


def test_queue_of_shuffled_neighbours(spark):
    """Against a plain queue, in a worker and by joins."""
    g = made(spark, "/root/testdata/sf0.001", "nation")
    around = {}
    for u, v, sign in rows(g.edges, "u", "v"):
        around.setdefault(u, []).append((v, sign))
        around.setdefault(v, []).append((u, sign))
    want = []
    for i in range(3):
        found, queue = {i % g.n: (None, 0, 1)}, [i % g.n]
        for v in queue:
            for w, sign in sorted(around[v], key=lambda x: (int(draw_np(17, i, v, x[0])), x[0])):
                if w not in found:
                    found[w] = (v, found[v][1] + 1, found[v][2] * sign)
                    queue.append(w)
        want += [(i, v, *x) for v, x in found.items()]
    for in_worker in (samplers.IN_WORKER, 0):
        got = [tuple(r) for r in samplers.sample(g, "enhanced", 3, 17, in_worker).select("iter", "node", "parent", "level", "s").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_no_edges_give_no_rows(spark):
    empty = spark.createDataFrame([], "seq long, src long, dst long, sign int")
    g = from_raw(empty)
    assert (g.n, g.m) == (0, 0)
    assert Run(g, "bfs", 3).switches.count() == 0
    assert states.frustration_index(Run(g, "bfs", 3).switches).count() == 0


def test_kruskal_trees_alike_in_a_worker_and_by_joins(spark):
    g = made(spark, "/root/testdata/sf0.001", "nation")
    found = []
    for in_worker in (samplers.IN_WORKER, 0):
        trees = samplers.sample(g, "kruskal", 2, 17, in_worker)
        edges = states.on_edges(g, trees)
        found.append((sorted((r.iter, r.node, r.parent or -1, r.s) for r in trees.collect()), sorted((r.iter, r.u, r.v, r.minus) for r in edges.where("in_tree").collect())))
    assert found[0] == found[1] and len(found[0][1]) == 2 * (g.n - 1)


def test_states_in_the_order_of_their_texts(spark, monkeypatch):
    """Several words, runs and groups of iterations, against the texts."""
    g = made(spark, "/root/testdata/sf0.001", "custpart")
    monkeypatch.setattr(states, "RUN", 2)
    run = Run(g, "bfs", 70)
    names = {r.nid: r.orig_id for r in g.nodes.collect()}
    edges, texts = {}, {}
    for r in run.edge_states.collect():
        edges.setdefault(r.iter, []).append((names[r.u], names[r.v], int(r.minus)))
    for i, found in edges.items():
        texts[i] = "".join(f"{u}-->{v}:{x} | " for u, v, x in sorted(found))
    order = {text: k + 1 for k, text in enumerate(sorted(set(texts.values())))}
    words = run.scratch.table(states.edge_words(g, run.trees, 70), "words")
    assert g.m > 2 * 62 and 1 < len(order)
    assert {r.iter: r.state_key for r in states.edge_string_keys(words, g.m).collect()} == {i: order[text] for i, text in texts.items()}
    assert rows(words.groupBy("iter").agg(F.sum("switches")), "iter") == rows(run.switches, "iter")


def test_states_that_differ_late_or_not_at_all(spark, monkeypatch):
    """Through three rounds of runs, the last of them not full."""
    monkeypatch.setattr(states, "RUN", 2)
    whole = [[7] * 7, [7] * 6 + [8], [7] * 7, [7, 7, 7, 9, 0, 0, 0], [7] * 5 + [2**62 - 1, 0], [6] + [9] * 6]
    words = spark.createDataFrame([(i, at, x) for i, state in enumerate(whole) for at, x in enumerate(state)], "iter int, at long, bits long")
    keys = {r.iter: r.state_key for r in states.edge_string_keys(words, 6 * states.WORD + 1).collect()}
    assert keys == {5: 1, 0: 2, 2: 2, 1: 3, 4: 4, 3: 5}


def test_no_row_to_be_ordered_holds_a_state(spark, monkeypatch):
    """Bounds of a range partition are rows that the driver holds."""
    widest, plain = [], states.ranked

    def watched(df, order, *rest):
        widest.append(df.agg(F.max(F.length(F.concat_ws(",", *(F.col(c).cast("string") for c in order))))).first()[0])
        return plain(df, order, *rest)

    monkeypatch.setattr(states, "ranked", watched)
    QUERIES["states_by_edge_string"](spark, "/root/testdata/sf0.01").collect()
    assert widest and max(widest) < 64
