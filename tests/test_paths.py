from __future__ import annotations

import random

import numpy as np
import pytest

from thistle.more_queries import path_beam
from thistle.operators import paths, vector
from thistle.plans.mapping import map_table
from thistle.graph import Graph

from .graphs import EX, ask, graph

TREE = [("x1", "broader", "x2"), ("x1", "broader", "x3"), ("x2", "broader", "x4"), ("x3", "broader", "x5"), ("x5", "broader", "x6"), ("x4", "broader", "x7"), ("x4", "a", "Top"), ("x6", "a", "Top"), ("x7", "a", "Top")]
LOOP = [("n1", "p", "n2"), ("n2", "p", "n2"), ("n3", "q", "n4"), ("n1", "name", "'A")]


def test_until(spark):
    g = graph(spark, TREE)
    assert ask(g, "SELECT ?t WHERE { ex:x1 ex:broader+ ?t UNTIL(EXISTS { ?t a ex:Top }) }") == [("x4",), ("x6",)]
    assert ask(g, "SELECT ?t WHERE { ex:x1 ex:broader+ ?t . ?t a ex:Top }") == [("x4",), ("x6",), ("x7",)]
    assert ask(g, "SELECT ?t WHERE { ex:x4 ex:broader* ?t UNTIL(EXISTS { ?t a ex:Top }) }") == [("x4",)]
    assert ask(g, "SELECT ?s ?t WHERE { ?s a ex:Top . ?s ex:broader+ ?t UNTIL(?t = ex:x7) }") == [("x4", "x7")]


def test_zero_length(spark):
    g = graph(spark, LOOP)
    nodes = ["n1", "n2", "n3", "n4", '"A"']
    assert ask(g, "SELECT ?a ?b WHERE { ?a ex:p* ?b }") == sorted([(n, n) for n in nodes] + [("n1", "n2")], key=repr)
    assert ask(g, "SELECT ?b WHERE { ex:n2 ex:p? ?b }") == [("n2",)]
    assert ask(g, "SELECT ?b WHERE { ex:n1 ex:p? ?b }") == [("n1",), ("n2",)]
    assert ask(g, "SELECT ?b WHERE { ex:nowhere ex:p* ?b }") == [("nowhere",)]
    assert ask(g, "SELECT ?a WHERE { ?a ex:unknown+ ?b }") == []
    assert ask(g, "SELECT ?a WHERE { ?a ex:p+ ?a }") == [("n2",)]
    assert ask(g, "SELECT ?a WHERE { ?a ex:p+ ex:n2 }") == [("n1",), ("n2",)]


def test_sequences_are_bags(spark):
    g = graph(spark, [("s", "p", "m1"), ("s", "p", "m2"), ("m1", "q", "o"), ("m2", "q", "o")])
    assert ask(g, "SELECT ?o WHERE { ex:s ex:p/ex:q ?o }") == [("o",), ("o",)]
    assert ask(g, "SELECT ?o WHERE { ex:s (ex:p/ex:q)+ ?o }") == [("o",)]
    assert ask(g, "SELECT ?m WHERE { ex:o ^ex:q ?m }") == [("m1",), ("m2",)]
    assert ask(g, "SELECT ?m WHERE { ex:s (ex:p|ex:q) ?m }") == [("m1",), ("m2",)]


def test_closure_on_grids_and_depth(spark):
    n = 7
    edges = [(f"{i},{j}", f"{i + a},{j + b}") for i in range(n) for j in range(n) for a, b in ((0, 1), (1, 0)) if i + a < n and j + b < n]
    df = spark.createDataFrame([*edges, *edges[:5], (None, "x"), ("x", None)], "src string, dst string")
    assert paths.closure(df).count() == (n * (n + 1) // 2) ** 2 - n * n
    with pytest.warns(UserWarning, match="longer than 3"):
        assert paths.closure(df, spark.createDataFrame([("0,0",)], "src string"), depth=3).count() == 9
    assert paths.closure(df.limit(0)).count() == 0


def test_paths_in_time(spark):
    facts = [("alice", "knows", "bob"), ("bob", "knows", "charlie"), ("charlie", "knows", "dave")]
    spans = [(100, 200), (150, 300), (250, 400)]
    tv = "http://thistle.example/vocab#"
    notes = [(f, tv + k, v) for f, s in zip(facts, spans, strict=True) for k, v in zip(("validFrom", "validTo"), s, strict=True)]
    g = graph(spark, facts + notes)
    assert ask(g, "SELECT ?x WHERE { AT_TIME(175) { ex:alice ex:knows+ ?x } }") == [("bob",), ("charlie",)]
    assert ask(g, "SELECT ?x WHERE { AT_TIME(400) { ex:alice ex:knows+ ?x } }") == []


def walk(edges, sims, start, query=None):
    at = start
    while True:
        better = [(sims[n], n) for n in edges.get(at, ()) if sims[n] > sims[at]]
        if not better:
            return at
        top = max(s for s, _ in better)
        at = min(n for s, n in better if s == top)


def best_first(edges, sims, start, k):
    seen, todo, best = {start}, [start], [start]
    key = lambda n: (-sims[n], n)
    while todo:
        todo.sort(key=key)
        at = todo.pop(0)
        if len(best) >= k and key(at) > key(max(best, key=key)):
            break
        for n in edges.get(at, ()):
            if n in seen:
                continue
            seen.add(n)
            if len(best) < k or key(n) < key(max(best, key=key)):
                todo.append(n)
                best.append(n)
                best = sorted(best, key=key)[:k]
    return set(best)


def test_greedy_and_beam_against_brute_force(spark):
    r = random.Random(11)
    names = [f"n{i:02d}" for i in range(30)]
    edges = {n: r.sample([m for m in names if m != n], 3) for n in names}
    sims = {n: round(r.random(), 2) for n in names}
    e = spark.createDataFrame([(a, b) for a, bs in edges.items() for b in bs], "src string, dst string")
    s = spark.createDataFrame(list(sims.items()), "node string, score double")
    seeds = spark.createDataFrame([(n,) for n in names[:8]] + [("unknown",)], "src string")
    assert {x["src"]: x["dst"] for x in paths.greedy(e, s, seeds).collect()} == {n: walk(edges, sims, n) for n in names[:8]}
    got = {}
    for x in paths.beam(e, s, seeds, 4).collect():
        got.setdefault(x["src"], set()).add(x["dst"])
    assert got == {n: best_first(edges, sims, n, 4) for n in names[:8]}


def test_vector_searches(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 2.0]), (4, [-1.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [1.0, 1.0, 1.0])], "id int, vec array<float>")
    g = Graph(spark, [map_table("doc", v, "id", base=EX)], prefixes={"ex": EX})
    q = '"1 0"^^tv:f32vec'
    name = lambda *ids: [(f"doc/{i}",) for i in ids]
    assert ask(g, f"SELECT ?d WHERE {{ VECTOR_SIMILAR(?d ex:vec {q}, 0.5) }}") == name(1, 2)
    assert ask(g, f"SELECT ?d WHERE {{ VECTOR_SIMILAR(?d ex:vec {q}, -2, k:=3, ef:=50) }}") == name(1, 2, 3)
    assert ask(g, f"SELECT ?d WHERE {{ EUCLID_SEARCH(?d ex:vec {q}, -1.0) }}") == name(1, 2, 5)
    assert ask(g, f"SELECT ?d WHERE {{ DOTPRODUCT_SEARCH(?d ex:vec {q}, 0.0) }}") == name(1, 2, 3, 5)
    assert ask(g, f"SELECT ?d WHERE {{ ?d ex:id 2 . VECTOR_SIMILAR(?d ex:vec {q}, 0.5, k:=1) }}") == []
    got = [r[0].removeprefix(EX) for r in g.sparql(f"SELECT ?d WHERE {{ ?d ex:id ?i }} ORDER BY DESC(VECTOR_SCORE(?d ex:vec {q})) LIMIT 2").collect()]
    assert got == ["doc/1", "doc/2"]


def test_knn_edges_are_exact_while_small(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 8))
    df = spark.createDataFrame([(i, [float(y) for y in row]) for i, row in enumerate(x)], "id long, vec array<double>")
    e = vector.knn_edges(df, m=3).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    got = {}
    for r in e:
        if r["layer"] == 0:
            got.setdefault(r["src"], set()).add(r["dst"])
    assert got == {i: set(np.argsort(-s[i])[:6].tolist()) for i in range(80)}
    above = {r["src"] for r in e if r["layer"] == 1}
    assert above and all(r["dst"] in above for r in e if r["layer"] == 1)
    assert vector.knn_edges(df.limit(0)).count() == 0


def test_knn_edges_are_exact_with_many_cells(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 32))
    x[700:720], x[720:740] = x[0], 0
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    sims = np.round(u @ u.T, 9)
    df = spark.createDataFrame([(i, [float(y) for y in row]) for i, row in enumerate(x)], "id long, vec array<double>")
    for options in ({}, {"block": 70}):
        got = {}
        for e in vector.knn_edges(df, m=4, per_cell=20, **options).collect():
            got.setdefault((e["layer"], e["src"]), []).append((-round(e["similarity"], 9), e["dst"]))
        assert len([i for layer, i in got if layer == 0]) == 900 and max(layer for layer, _ in got) > 1
        for layer in {k for k, _ in got}:
            nodes = [i for k, i in got if k == layer]
            for i in nodes:
                # no other similarity among its own than brute force has; ties may be taken either way where rounding parts them
                want = sorted(-sims[i, j] for j in nodes if j != i)[: 8 if layer == 0 else 4]
                assert [s for s, _ in sorted(got[layer, i])] == want and all(-s == sims[i, j] for s, j in got[layer, i])


def test_path_beam_starts_from_every_vector_of_the_label(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(160, 16)).astype(np.float32)
    rows = [(i, i % 10, [float(y) for y in v]) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    name = lambda i: f"http://ex.example/embeddings/{i}"
    edges = {name(i): [name(j) for j in sorted(range(160), key=lambda j: -s[i, j]) if j != i][:16] for i in range(160)}
    sims = {name(i): s[0, i] for i in range(160)}
    want = {(name(i), b) for i in range(3, 160, 10) for b in best_first(edges, sims, name(i), 4)}
    assert {tuple(r) for r in path_beam(spark, str(tmp_path)).collect()} == want


def test_paths_from_a_start_have_no_limit(spark):
    g = graph(spark, [(f"c{i}", "p", f"c{i + 1}") for i in range(53)])
    assert g.sparql("SELECT ?b WHERE { ex:c0 ex:p+ ?b }").count() == 53
    assert g.sparql("SELECT ?b WHERE { ex:c0 ex:p+ ?b UNTIL(?b = ex:c53) }").count() == 1
