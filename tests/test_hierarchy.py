from __future__ import annotations

from collections import defaultdict

from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import functions as F

from thistle.operators.hierarchy import double_pointers

EDGE, NODE = "hier string, child string, parent string, node string", "hier string, node string"


def brute(edges):
    up = defaultdict(set)
    nodes = set()
    for c, p in edges:
        nodes |= {x for x in (c, p) if x is not None}
        if c is not None and p is not None:
            up[c].add(p)
    reached, cyclic = set(), set()
    for n in nodes:
        dist, front, d = {n: 0}, [n], 0
        while front:
            d, nxt = d + 1, []
            for x in front:
                for y in up.get(x, ()):
                    if y == n:
                        cyclic.add(n)
                    if y not in dist:
                        dist[y] = d
                        nxt.append(y)
            front = nxt
        reached |= {(n, x, k) for x, k in dist.items() if not up.get(x)}
    return reached, cyclic


def run(spark, edges, **options):
    e = spark.createDataFrame([("h", c, p, "clash") for c, p in edges], EDGE)
    n = spark.createDataFrame([("h", x) for c, p in edges for x in (c, p)], NODE)
    h = double_pointers(e, n, **options)
    return h.reached.collect(), {r["node"] for r in h.cyclic.collect()}


def check(spark, edges):
    reached, cyclic = run(spark, edges)
    want = brute(edges)
    assert {(r["node"], r["target"], r["node_depth"]) for r in reached} == want[0]
    assert cyclic == want[1]
    assert len(reached) == len(want[0])


def test_chain_trees_and_several_parents(spark):
    check(spark, [(f"n{i}", f"n{i + 1}") for i in range(37)] + [("n3", "n30"), ("n3", "x"), ("x", None), (None, "y"), ("n3", "n30")])


def test_loops(spark):
    check(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("self", "self"), ("in", "a"), ("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("l3", "b"), ("between", "l1"), ("d", "root")])


def test_long_way_out_of_a_loop(spark):
    check(spark, [("a", "b"), ("b", "a"), ("b", "c0")] + [(f"c{i}", f"c{i + 1}") for i in range(21)])


def test_long_loops(spark):
    ring = lambda n, k: [(f"{n}{i}", f"{n}{(i + 1) % k}") for i in range(k)]
    check(spark, ring("a", 90) + ring("b", 2) + ring("c", 31) + [("c7", "d0"), ("d0", "d1"), ("d1", "d2"), ("d2", "c9")] + [("x0", "c3"), ("c4", "y0"), ("y0", "y1"), ("y1", "a5"), ("b1", "b1"), ("a9", "root")])


def test_a_ring_of_many(spark):
    n = 20_000
    ids = spark.range(n)
    e = ids.select(F.lit("h").alias("hier"), F.col("id").cast("string").alias("child"), ((F.col("id") + 1) % n).cast("string").alias("parent"))
    h = double_pointers(e, e.select("hier", F.col("child").alias("node")))
    assert h.cyclic.count() == n and h.reached.count() == 0


def test_empty(spark):
    reached, cyclic = run(spark, [("only", None)])
    assert [(r["node"], r["target"], r["node_depth"]) for r in reached] == [("only", "only", 0)] and cyclic == set()
    e, n = spark.createDataFrame([], EDGE), spark.createDataFrame([], NODE)
    assert double_pointers(e, n).reached.count() == 0


def test_paths_are_shortest_and_first(spark):
    reached, _ = run(spark, [("a", "c"), ("a", "b"), ("b", "r"), ("c", "r"), ("a", "x"), ("x", "y"), ("y", "r")], paths=True)
    assert {r["node"]: r["path"] for r in reached}["a"] == ["a", "b", "r"]


def test_all_ancestors(spark):
    reached, _ = run(spark, [("a", "b"), ("b", "c")], targets="all")
    assert {(r["node"], r["target"], r["node_depth"]) for r in reached} == {("a", "a", 0), ("b", "b", 0), ("c", "c", 0), ("a", "b", 1), ("b", "c", 1), ("a", "c", 2)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=20))
def test_random_graphs(spark, edges):
    check(spark, [(str(a), str(b)) for a, b in edges])
