from __future__ import annotations

import time

import pytest

from thistle.operators import health, proptable
from thistle.plans.ast import QueryError

from .graphs import EX, ask, graph

PEOPLE = [(f"s{i}", p, f"v{i % 7}" if p != "age" else i) for i in range(40) for p in ("type", "name", "age", "city", "knows", "email")]
COUNTRIES = [f for i in range(60) for f in ((f"c{i}", "capital", f"t{i}"), (f"t{i}", "mayor", f"m{i % 9}"), (f"t{i}", "mayor", f"k{i}"))]
QUERIES = [
    "SELECT ?s ?n ?a WHERE { ?s ex:name ?n ; ex:age ?a ; ex:city ?n }",
    "SELECT ?s WHERE { ?s ex:name ex:v3 ; ex:age ?a FILTER(?a > 20) }",
    "SELECT ?n WHERE { ex:s5 ex:name ?n ; ex:email ?e }",
    "SELECT ?s ?o WHERE { ?s ex:name ?n ; ex:knows ?o OPTIONAL { ?s ex:fax ?f ; ex:name ?n } }",
]


def test_found_tables_give_the_same_rows(spark):
    g = graph(spark, PEOPLE + [("s1", "fax", "f")])
    before = [ask(g, q) for q in QUERIES]
    assert g.find_tables() and len(g.stars[0][1]) == 6
    assert [ask(g, q) for q in QUERIES] == before
    plan = g.sparql(QUERIES[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    g.update("INSERT DATA { ex:s1 ex:name ex:other }")
    assert g.stars == [] and ("s1",) in ask(g, "SELECT ?s WHERE { ?s ex:name ex:other ; ex:age ?a }")


def test_only_tables_that_can_serve_are_built(spark, monkeypatch):
    built = []
    build = proptable.build
    monkeypatch.setattr(proptable, "build", lambda *a: built.append(a[2]) or build(*a))
    # of a's predicates all have subjects elsewhere, too
    g = graph(spark, [(f"{k}{i}", p, "v") for k in "ab" for i in range(12) for p in ("name", "age", f"{k}1", f"{k}2", f"{k}3")] + [("z", p, "v") for p in ("a1", "a2", "a3")])
    assert len(g.find_tables()) == 2
    assert [[p.removeprefix(">" + EX) for p in t.core] for t in built] == [["age", "b1", "b2", "b3", "name"]]
    assert [sorted(c.values()) for _, c in g.stars] == [["b1", "b2", "b3"]]
    assert len(ask(g, "SELECT ?s WHERE { ?s ex:b1 ?x ; ex:b2 ?y }")) == 12 and len(ask(g, "SELECT ?s WHERE { ?s ex:a1 ?x ; ex:a2 ?y }")) == 13


def test_columns_with_several_values_serve_nothing(spark):
    g = graph(spark, PEOPLE + [("s1", "name", "second")])
    q = "SELECT ?s ?n WHERE { ?s ex:name ?n ; ex:age ?a }"
    before = ask(g, q)
    g.find_tables()
    assert EX + "name" not in g.stars[0][1] and ask(g, q) == before and len(before) == 41


def test_kept_chains(spark):
    g = graph(spark, COUNTRIES)
    qs = ["SELECT ?c ?m WHERE { ?c ex:capital/ex:mayor ?m }", "SELECT ?c WHERE { ?c ex:capital/ex:mayor ex:m3 }", "SELECT ?m WHERE { ex:c4 ex:capital/ex:mayor ?m }"]
    before = [ask(g, q) for q in qs]
    g.keep_chain(EX + "capital", EX + "mayor")
    assert [ask(g, q) for q in qs] == before
    assert "Join" not in g.sparql(qs[0])._jdf.queryExecution().optimizedPlan().toString()


def test_statistics_change_no_rows(spark):
    hubs = [(f"x{i}", "p", f"h{i % 4}") for i in range(60)] + [(f"h{i}", "q", f"y{k}") for i in range(4) for k in range(5)] + [("x7", "s", "z")]
    g = graph(spark, hubs)
    q = "SELECT ?x ?y WHERE { ?x ex:p ?h . ?h ex:q ?y . ?x ex:s ?z }"
    before = ask(g, q)
    g.analyze()
    assert ask(g, q) == before and len(before) == 5 and g.rows_of[EX + "p"] == 60


def test_vectors(spark):
    g = graph(spark, [("d1", "about", "x")])
    g.declare_vectors(EX + "v", 2)
    rows = lambda *vs: spark.createDataFrame([(EX + s, v) for s, v in vs], "s string, vec array<float>")
    assert g.insert_vectors(EX + "v", rows(("d1", [1.0, 0.0]), ("d2", [0.6, 0.8]), ("d3", [0.0, 1.0]))) == 3
    for bad in ([1.0], None):
        with pytest.raises(QueryError):
            g.insert_vectors(EX + "v", rows(("d4", bad)))
    with pytest.raises(QueryError):
        g.insert_vectors(EX + "w", rows(("d4", [1.0, 0.0])))
    with pytest.raises(QueryError):
        g.declare_vectors(EX + "v", 2, "manhattan")
    q = '"1 0"^^tv:f32vec'
    assert ask(g, f"SELECT ?d WHERE {{ VECTOR_SIMILAR(?d ex:v {q}, 0.5) }}") == [("d1",), ("d2",)]
    assert ask(g, f"SELECT ?d ?x WHERE {{ ?d ex:about ?x . COSINE_SEARCH(?d ex:v {q}, 0.5) }}") == [("d1", "x")]
    g.index_vectors(EX + "v", m=2)
    assert ask(g, "SELECT ?b WHERE { ex:d1 tv:hnswHorizontalNeighbor ?b }") == [("d2",), ("d3",)]
    assert ask(g, f"SELECT ?b WHERE {{ ex:d3 tv:hnswNeighbor+ ?b GREEDY({q}) }}") == [("d1",)]
    assert ask(g, f"SELECT ?b WHERE {{ ex:d3 tv:hnswNeighbor+ ?b BEAM({q}, 2) }}") == [("d1",), ("d2",)]
    assert ask(g, "SELECT ?b WHERE { ex:d3 tv:hnswLayerDescend*/tv:hnswHorizontalNeighbor+ ?b }") == [("d1",), ("d2",), ("d3",)]
    assert health.report(g)["index"]["active"] == 3
    g.insert_vectors(EX + "v", rows(("d9", [0.1, 1.0])))
    edges = g.index_vectors(EX + "v", m=1)
    # nothing of the earlier index is left
    assert ask(g, "SELECT ?a ?b WHERE { ?a tv:hnswHorizontalNeighbor ?b }") == sorted({(r["src"].removeprefix(EX), r["dst"].removeprefix(EX)) for r in edges.collect()}, key=repr)
    assert {r["dst"].removeprefix(EX) for r in edges.where("layer = 0").collect() if r["src"] == EX + "d3"} == {"d2", "d9"}


def test_vectors_of_quoted_statements(spark):
    edge = ("ada", "knows", "bob")
    g = graph(spark, [edge, (edge, "v", '"1 0"^^<http://thistle.example/vocab#f32vec>'), (("bob", "knows", "cy"), "v", '"0 1"^^<http://thistle.example/vocab#f32vec>')], vectors={EX + "v": "cosine"})
    assert ask(g, 'SELECT ?s ?o WHERE { << ?s ?p ?o >> ex:v ?x . VECTOR_SIMILAR(<< ?s ?p ?o >> ex:v "1 0.1"^^tv:f32vec, 0.9) }') == [("ada", "bob")]
    assert ask(g, 'SELECT ?o WHERE { VECTOR_SIMILAR(<< ex:bob ?p ?o >> ex:v "0 1"^^tv:f32vec, 0.9) }') == [("cy",)]


def test_timeout(spark):
    g = graph(spark, [(f"n{i}", "p", f"n{i + 1}") for i in range(300)])
    start = time.monotonic()
    with pytest.raises(TimeoutError):
        g.rows("SELECT (COUNT(*) AS ?n) WHERE { ?a ex:p+ ?b }", timeout=1)
    assert time.monotonic() - start < 30
    assert len(g.rows("SELECT ?b WHERE { ex:n0 ex:p ?b }", timeout=60)) == 1


def test_report(spark):
    assert health.report(graph(spark, [("n", "p", "m")]))["status"] == "healthy"
