from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from thistle.operators import corpus, health, owl, proptable, ranks, retract

from .graphs import EX, ask, graph, short

TV = "http://thistle.example/vocab#"
RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", owl.RDFS, owl.OWL


def test_retraction_by_depth(spark):
    real = [("n", "p", "o1"), ("m", "p", "n"), ("m", "p", "z")]
    g1, g2 = ("g", "says", "1x"), ("g", "says", "2x")
    facts = [*real, g1, g2, (g1, TV + "selectedFrom", real[0]), (g2, TV + "selectedFrom", g1), (g1, TV + "generatedBy", "'run"), (g2, TV + "generatedBy", "'run"), (g1, "note", "'kept"), (real[2], TV + "selectedFrom", real[2])]
    g = graph(spark, facts)
    got = {tuple(short(x) for x in r[:3]): r["depth"] for r in retract.retract(g, EX + "n").collect()}
    key = lambda f: "<< " + " ".join(EX + x for x in f) + " >>"
    assert got == {("n", "p", "o1"): 0, ("m", "p", "n"): 0, g1: 1, (key(g1), "selectedFrom", key(real[0])): 1, (key(g1), "generatedBy", '"run"'): 1, g2: 2, (key(g2), "selectedFrom", key(g1)): 2, (key(g2), "generatedBy", '"run"'): 2}
    n = g.triples.count()
    retract.retract(g, EX + "n", commit=True)
    assert g.triples.count() == n - len(got) and ask(g, "SELECT ?o WHERE { ex:m ex:p ?o }") == [("z",)]


def test_cascade_against_fixpoint(spark):
    r = random.Random(4)
    for _ in range(3):
        edges = [(r.randrange(60), r.randrange(60)) for _ in range(70)] + [(None, 3), (3, None), (5, 5)]
        seeds = [1, 2, 3, None]
        depth = {s: 0 for s in seeds if s is not None}
        front = set(depth)
        d = 0
        while front:
            d += 1
            front = {c for c, p in edges if p in front and c is not None and c not in depth}
            depth |= dict.fromkeys(front, d)
        got = retract.cascade(spark.createDataFrame([(s, "x") for s in seeds], "id int, depth string"), spark.createDataFrame(edges, "child int, parent int"))
        assert {x["id"]: x["depth"] for x in got.collect()} == depth


def people(n=40):
    return [(f"s{i}", p, f"v{i % 7}" if p != "age" else i) for i in range(n) for p in ("type", "name", "age", "city", "knows", "email")] + [(f"s{i}", "fax", f"f{i}") for i in range(3)]


def test_discovery(spark):
    g = graph(spark, people())
    found, members = proptable.discover(g.triples)
    table = max(found, key=lambda t: t.nodes)
    assert table.nodes == 40 and [p[1:].removeprefix(EX) for p in table.core] == ["age", "city", "email", "knows", "name", "type"]
    assert [(p[1:].removeprefix(EX), round(c, 3)) for p, c in table.tail] == [("fax", 0.075)] and round(table.cliff, 2) == round(1 / 0.075, 2)
    rows = proptable.build(g.triples, members, table)
    assert rows.count() == 40 and all(proptable.exact(g.triples, rows, table).values())
    assert proptable.discover(g.triples.limit(0))[0] == []


def test_merging_is_largest_first_and_in_order():
    a, b, c = tuple("abcde"), tuple("abcdef"), tuple("vwxyz")
    got = proptable.merge([(c, 5), (b, 3), (a, 9)])
    assert [(sorted(p), m) for p, m in got] == [(sorted(b), [2, 1]), (sorted(c), [0])]


def test_merging_equals_a_scan_of_all_pairs():
    r = random.Random(6)
    groups = list({tuple(sorted(r.sample("abcdefghijkl", r.randint(1, 10)))): r.randint(1, 9) for _ in range(600)}.items())
    order = sorted(range(len(groups)), key=lambda i: (-groups[i][1], groups[i][0]))
    taken, want = set(), []
    for at, i in enumerate(order):
        if i not in taken:
            props, members = set(groups[i][0]), [i]
            for j in order[at + 1 :]:
                other = set(groups[j][0])
                if j not in taken and len(props & other) / len(props | other) >= proptable.SIMILAR:
                    props |= other
                    members.append(j)
                    taken.add(j)
            want.append((props, members))
    assert len(want) < len(groups) and proptable.merge(groups) == want


def test_merging_with_keys_of_any_length(monkeypatch):
    r = random.Random(3)
    base = [r.sample(range(60), r.randint(1, 24)) for _ in range(80)]
    # near a few sets, so that tables grow
    groups = list({tuple(sorted(f"{p:02}" for p in {*r.sample(x, max(1, len(x) - r.randint(0, 3))), *r.sample(range(60), r.randint(0, 3))})): r.randint(1, 9) for x in base * 12}.items())
    want: list[tuple[set[str], list[int]]] = []
    for i in sorted(range(len(groups)), key=lambda i: (-groups[i][1], groups[i][0])):
        own = set(groups[i][0])
        for props, members in want:
            if len(props & own) / len(props | own) >= proptable.SIMILAR:
                props |= own
                members.append(i)
                break
        else:
            want.append((own, [i]))
    assert max(len(m) for _, m in want) > 5
    for most in (1, 30, 100, 1000):
        monkeypatch.setattr(proptable, "MOST_KEYS", most)
        assert proptable.merge(groups) == want


def test_merging_of_many_signatures_of_few_properties():
    r = random.Random(1)
    groups = [(sig, 1) for sig in {tuple(p for p in (f"p{k:02}" for k in range(36)) if r.random() < 0.33) for _ in range(12_000)}]
    start = time.process_time()
    assert sum(len(m) for _, m in proptable.merge(groups)) == len(groups)
    assert time.process_time() - start < 20


def test_discovery_of_any_number_of_signatures(spark):
    pairs = [(i, j) for i in range(206) for j in range(i)]
    many = spark.createDataFrame([(f"n{i}-{j}", f"p{k}", "o") for i, j in pairs for k in (i, j)], "s string, p string, o string")
    facts = [(f"t{i}", f"q{k}", f"v{i}") for i in range(12) for k in range(5)]
    found, members = proptable.discover(many.unionByName(spark.createDataFrame(facts, "s string, p string, o string")))
    assert len(pairs) > 20_000
    assert {t.nodes: [p for p, _ in t.columns] for t in found}[12] == [f">q{k}" for k in range(5)] and members.where("node like 't%'").count() == 12


def test_deep(spark):
    facts = [f for i in range(60) for f in ((f"c{i}", "capital", f"t{i}"), (f"t{i}", "mayor", f"m{i}"), (f"t{i}", "size", i), (f"c{i}", "name", f"'n{i}"))]
    got = {r["path"].replace(EX, ""): (r["roots"], r["coverage"], r["fan_in"]) for r in proptable.deep(graph(spark, facts).triples).collect()}
    assert got == {"capital mayor": (60, 1.0, 1.0), "capital size": (60, 1.0, 1.0)}


def test_ontology(spark):
    data = graph(spark, [("x", "a", "Dog"), ("y", "a", "Rock"), ("x", "eats", "y"), ("y", "eats", "x"), ("z", "eats", "x"), ("x", "a", "Cat"), ("x", "born", 1), ("x", "born", 2), ("y", "born", 3), ("x", "eats", "'text")]).triples
    schema = graph(spark, [("eats", RDFS + "domain", "Animal"), ("eats", RDFS + "range", "Thing"), ("Dog", RDFS + "subClassOf", "Mammal"), ("Mammal", RDFS + "subClassOf", "Animal"), ("Rock", RDFS + "subClassOf", "Thing"), ("Dog", OWL + "disjointWith", "Cat"), ("born", RDF + "type", OWL + "FunctionalProperty")]).triples
    got = sorted((r["kind"], short(r["s"]), short(r["o"])) for r in owl.violations(data, schema).collect())
    assert got == [("disjoint", "x", "Cat"), ("disjoint", "x", "Dog"), ("domain", "y", "x"), ("functional", "x", 1), ("functional", "x", 2), ("range", "y", "x"), ("range", "z", "x")]


def test_pagerank(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("c", "e"), ("a", "b"), (None, "a")], "src string, dst string")
    out = {"a": ["b"], "b": ["c"], "c": ["a", "e"], "d": ["c"], "e": []}
    rank = dict.fromkeys(out, 0.2)
    for _ in range(15):
        loose = rank["e"]
        rank = {n: 0.15 / 5 + 0.85 * loose / 5 + 0.85 * sum(rank[s] / len(ds) for s, ds in out.items() if n in ds) for n in out}
    got = {r["node"]: r["rank"] for r in ranks.pagerank(e, rounds=15).collect()}
    assert got.keys() == rank.keys() and all(abs(got[n] - rank[n]) < 1e-12 for n in rank) and abs(sum(got.values()) - 1) < 1e-9
    assert ranks.pagerank(e.limit(0)).count() == 0


def test_neighbourhood(spark):
    t = graph(spark, [("n", "p", "m1"), ("m1", "p", "m2"), ("m2", "p", "m3"), ("w", "q", "n"), ("far", "p", "away")]).triples
    near = spark.createDataFrame([(EX + "far",)], "node string")
    got = [(short(r["s"]), short(r["o"]), r["score"]) for r in ranks.neighbourhood(t, EX + "n", hops=1, similar=near).collect()]
    assert got == [("n", "m1", 1.0), ("w", "n", 1.0), ("m1", "m2", 0.75), ("far", "away", 0.6)]
    assert len(ranks.neighbourhood(t, EX + "n", hops=3, budget=2).collect()) == 2


def test_clean_corpus(spark):
    labels = spark.createDataFrame([("kge:a", "A", "en", 2.0, None), ("kge:a", "old", "en", 1.0, None), ("kge:a", "gone", "en", 9.0, 10.0), ("kgp:p", "has", "en", 1.0, None), ("kge:b", "B", "de", 1.0, None), (None, "x", None, None, None), ("kge:c", None, "en", 1.0, None)], "iri string, label string, lang string, fetched_at double, removed_at double")
    facts = [("kge:a", "kgp:p", "<kge:b>"), ("kge:a", "kgp:p", '"+12.5"^^xsd:decimal'), ("kge:a", "kgp:p", '"1999-01-02T00:00:00Z"'), ("kge:a", "kgp:p", "kge:c"), ("kge:a", "kgp:p", '"  "'), ("kge:a", "kgp:x", '"v"'), ("kge:a", None, '"v"'), ("kge:a", "kgp:p", "_:b"), ("kge:a", "kgp:p", "kge:b")]
    t = spark.createDataFrame(facts, "s string, p string, o string")
    got = sorted(tuple(r) for r in corpus.clean_rows(t, labels, ["http://kg.example/prop/x"]).collect())
    assert got == [("A", "has", "12.5"), ("A", "has", "1999-01-02"), ("A", "has", "B")]


def test_health(spark):
    nodes = spark.createDataFrame([(i, 1 if i < 5 else 0, i >= 60) for i in range(100)] + [(100, 0, None)], "id int, layer int, deleted boolean")
    edges = spark.createDataFrame([(i, (i + k) % 60, 0) for i in range(60) for k in range(1, 9)], "src int, dst int, layer int")
    r = health.index_health(nodes, edges).first()
    assert (r["total"], r["active"], r["layer_distribution"], r["status"], r["min_neighbours"], r["vertical_edges"]) == (101, 61, [61, 5], "warning", 0, 5)
    assert health.index_health(nodes.limit(0), edges.limit(0)).first()["status"] == "healthy"


def test_metrics():
    m = health.QueryMetrics(keep=100)
    for i in range(200):
        m.record(i, 10, "star" if i % 2 else "chain", 20.0)
    s = m.summary()
    assert s["queries"] == 100 and s["p50"] == 149 and s["p99"] == 198 and s["q_error_p50"] == 2.0
    assert m.summary("star")["queries"] == 50 and m.summary("none")["p50"] is None


def test_statistics(spark):
    t = graph(spark, [("a1", "p", "b"), ("a1", "p", "c"), ("a2", "q", "b")]).triples
    assert {(short(r["p"]), r["n"], r["subjects"], r["objects"]) for r in health.predicate_statistics(t).collect()} == {("p", 2, 1, 2), ("q", 1, 1, 1)}
    assert proptable.coverage(t, EX + "q").select(F.col("coverage")).first()[0] == 1.0
