from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from thistle.graph import Graph
from thistle.plans.ast import QueryError
from thistle.plans.sparql import parse

from .graphs import EX, ask, graph, term

SOCIAL = [("ada", "a", "Person"), ("bob", "a", "Person"), ("cy", "a", "Person"), ("rome", "a", "City"), ("ada", "name", "'Ada"), ("bob", "name", "'Bob"), ("cy", "name", '"Cy"@en-GB'), ("ada", "age", 36), ("bob", "age", 25), ("cy", "age", 50), ("ada", "knows", "bob"), ("bob", "knows", "cy"), ("ada", "knows", "ada"), ("ada", "lives", "rome"), ("rome", "height", 21.5)]
NUMBERS = [(f"s{i}", "temp", v) for i, v in enumerate((-20, -5, 0, 5, 20))]


@pytest.fixture(scope="module")
def social(spark):
    return graph(spark, SOCIAL)


@pytest.mark.parametrize(
    "query, want",
    [
        ("SELECT ?x WHERE { ?x a ex:Person }", [("ada",), ("bob",), ("cy",)]),
        ("SELECT ?x WHERE { ?x ex:knows ?x }", [("ada",)]),
        ("SELECT ?a ?c WHERE { ?a ex:knows ?b . ?b ex:knows ?c }", [("ada", "ada"), ("ada", "bob"), ("ada", "cy")]),
        ("SELECT ?x WHERE { ?x ex:age 36 }", [("ada",)]),
        ('SELECT ?x WHERE { ?x ex:age "36"^^xsd:integer ; ex:name "Ada" }', [("ada",)]),
        ("SELECT ?x ?l WHERE { ?x a ex:Person OPTIONAL { ?x ex:lives ?l } }", [("ada", "rome"), ("bob", None), ("cy", None)]),
        ("SELECT ?x WHERE { ?x a ex:Person FILTER NOT EXISTS { ?x ex:knows ?y } }", [("cy",)]),
        ("SELECT ?x WHERE { ?x ex:age ?n FILTER(?n > 30 && ?n < 50) }", [("ada",)]),
        ("SELECT ?x WHERE { ?x ex:height ?h FILTER(?h > 5) }", [("rome",)]),
        ("SELECT ?x WHERE { ?x ex:name ?n FILTER(LANG(?n) = \"en-GB\") }", [("cy",)]),
        ("SELECT ?x WHERE { ?x ex:name ?n FILTER(LANGMATCHES(LANG(?n), \"EN\")) }", [("cy",)]),
        ("SELECT ?x WHERE { ?x ex:name ?n FILTER(LANGMATCHES(LANG(?n), \"*\")) }", [("cy",)]),
        ("SELECT ?p ?o WHERE { ex:bob ?p ?o FILTER(isIRI(?o)) }", [("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "Person"), ("knows", "cy")]),
        ("SELECT (COUNT(*) AS ?n) (SUM(?a) AS ?s) (AVG(?a) AS ?m) (MIN(?a) AS ?lo) (MAX(?a) AS ?hi) WHERE { ?x ex:age ?a }", [(3, 111.0, 37.0, 25, 50)]),
        ("SELECT (COUNT(*) AS ?n) WHERE { ?x ex:nothing ?a }", [(0,)]),
        ("SELECT ?x WHERE { { ?x ex:age 25 } UNION { ?x ex:lives ex:rome } }", [("ada",), ("bob",)]),
        ("SELECT ?x WHERE { ?x a ex:Person MINUS { ?x ex:lives ?l } }", [("bob",), ("cy",)]),
        ("SELECT ?x ?y WHERE { VALUES ?x { ex:ada ex:zed } ?x ex:knows ?y }", [("ada", "ada"), ("ada", "bob")]),
        ("SELECT ?x ?k WHERE { ?x ex:age ?a BIND(?a / (?a - 25) AS ?k) }", [("ada", 36 / 11), ("bob", None), ("cy", 2.0)]),
        ("SELECT ?n WHERE { [ ex:knows ex:cy ; ex:name ?n ] }", [('"Bob"',)]),
        ("SELECT ?x WHERE { ?x a ex:Person . ?x a ex:City }", []),
        ("SELECT ?x WHERE { ?x ex:unknown ?y }", []),
        ("SELECT ?x WHERE { ?x ex:age ?a FILTER(?a != \"nothing\") }", [("ada",), ("bob",), ("cy",)]),
        ("SELECT ?x WHERE { ?x ex:age ?a FILTER(!(?a > \"text\")) }", []),
        ("SELECT ?x WHERE { ?x ex:age ?a FILTER(EXISTS { ?x ex:lives ?l } || ?a = 50) }", [("ada",), ("cy",)]),
        ("SELECT ?x WHERE { ?x ex:age ?a FILTER(NOT EXISTS { ?x ex:knows ?y . ?y ex:age ?b FILTER(?b > ?a) } && ?a < 40) }", [("ada",)]),
        ("SELECT ?x ?l WHERE { ?x a ex:Person OPTIONAL { ?x ex:lives ?l } OPTIONAL { ?l ex:height ?h } FILTER(!BOUND(?h)) }", []),
        ("SELECT ?k (COUNT(?x) AS ?n) WHERE { ?x ex:name ?m } GROUP BY (STRLEN(?m) AS ?k) HAVING(COUNT(?x) > 1)", [(3, 2)]),
    ],
)
def test_select(social, query, want):
    assert ask(social, query) == sorted(want, key=repr)


def test_order(spark):
    g = graph(spark, NUMBERS + [("b", "temp", "_:x"), ("i", "temp", "iri"), ("t", "temp", "'text")])
    get = lambda q: [r[0].removeprefix(EX) for r in g.sparql(q).collect()]
    up = ["b", "i", "s0", "s1", "s2", "s3", "s4", "t"]
    assert get("SELECT ?x WHERE { ?x ex:temp ?t } ORDER BY ?t") == up
    assert get("SELECT ?x WHERE { ?x ex:temp ?t } ORDER BY DESC(?t)") == up[::-1]
    assert get("SELECT ?x WHERE { ?x ex:temp ?t } ORDER BY ?t LIMIT 2 OFFSET 3") == ["s1", "s2"]
    assert get("SELECT ?x WHERE { ?x ex:temp ?t FILTER(?t > -5) } ORDER BY ?t") == ["s2", "s3", "s4"]
    # a limit never cuts what is counted
    assert g.sparql("SELECT (COUNT(*) AS ?n) WHERE { ?x ex:temp ?t } LIMIT 1").first()["n"] == 8


def test_strings(spark):
    g = graph(spark, [("x", "label", "'Alpha beta"), ("y", "label", '"gamma"@de')])
    q = 'SELECT ?u ?r ?c WHERE { ?e ex:label ?l BIND(UCASE(STR(?l)) AS ?u) BIND(REPLACE(?l, "(a)(.)", "${2}-$1") AS ?r) BIND(CONCAT(?l, "!", ?nothing) AS ?c) }'
    assert ask(g, q) == [("ALPHA BETA", "Alph -abeta", None), ("GAMMA", "gm-ama", None)]
    assert ask(g, 'SELECT ?e WHERE { ?e ex:label ?l FILTER(CONTAINS(?l, "eta") || STRSTARTS(?l, "gam") && STRENDS(?l, "x") || REGEX(?l, "^ALPHA", "i")) }') == [("x",)]
    with pytest.raises(QueryError):
        g.sparql('SELECT ?e WHERE { ?e ex:label ?l FILTER(REGEX(?l, "(")) }')


def test_forms(social):
    assert social.ask("ASK { ex:ada ex:knows ex:bob }") and not social.ask("ASK { ex:cy ex:knows ?x }")
    assert ask(social, "CONSTRUCT { ?b ex:knownBy ?a . ?a ex:home ?h } WHERE { ?a ex:knows ?b OPTIONAL { ?a ex:lives ?h } } ORDER BY ?a LIMIT 2") == [("ada", "home", "rome"), ("ada", "knownBy", "ada"), ("bob", "knownBy", "ada")]
    assert len(ask(social, "DESCRIBE ex:rome")) == 3
    assert len(ask(social, "DESCRIBE ?x WHERE { ?x a ex:City }")) == 3


def test_quoted(spark):
    g = graph(spark, [("ada", "knows", "bob"), (("ada", "knows", "bob"), "source", "book"), (("cy", "knows", "bob"), "source", "film"), ("film", "about", ("ada", "knows", "bob")), ((("ada", "knows", "bob"), "source", "book"), "note", "'sure")])
    assert ask(g, "SELECT ?x WHERE { << ex:ada ex:knows ex:bob >> ex:source ?x }") == [("book",)]
    assert ask(g, "SELECT ?s ?x WHERE { << ?s ex:knows ex:bob >> ex:source ?x }") == [("ada", "book"), ("cy", "film")]
    assert ask(g, "SELECT ?f ?o WHERE { ?f ex:about << ex:ada ?p ?o >> }") == [("film", "bob")]
    assert ask(g, "SELECT ?a ?src ?n WHERE { << << ?a ex:knows ?b >> ex:source ?src >> ex:note ?n }") == [("ada", "book", '"sure"')]


def test_updates(spark):
    g = graph(spark, [("n", "p", "b")])
    assert g.update("INSERT DATA { ex:n ex:p ex:b . ex:n ex:p 7 . << ex:x ex:y ex:z >> ex:src ex:s }") == 3
    assert ask(g, "SELECT ?z WHERE { ex:x ex:y ?z }") == [("z",)]
    assert ask(g, "SELECT ?s WHERE { << ?a ex:y ?b >> ex:src ?s }") == [("s",)]
    assert g.update("DELETE DATA { ex:n ex:p 07 . ex:no ex:no ex:no }") == 1
    assert ask(g, "SELECT ?o WHERE { ex:n ex:p ?o }") == [("b",)]


def test_functions_of_ones_own(social):
    social.register_function(EX + "twice", lambda c: c * F.lit(2), "int")
    assert ask(social, "SELECT ?x (ex:twice(STRLEN(STR(?n))) AS ?k) WHERE { ?x ex:name ?n }") == [("ada", 6), ("bob", 6), ("cy", 4)]


@pytest.mark.parametrize("bad", ["SELECT", "SELECT ?x { ?x ex:p }", "SELECT ?x WHERE { ?x nope:p ?y }", "SELECT ?x WHERE { ?x ex:p ?y", "SELECT ?x WHERE { ?x ex:p+ ?y BEAM(\"1 2\"^^tv:f32vec, 0) }", "SELECT ?x WHERE { ?x ex:p ?y UNTIL(?y = 1) }", "SELECT ?x WHERE { ?x 'p' ?y }", "SELECT (?x) WHERE { ?x ex:p ?y }", "FOO", "SELECT ?x WHERE { ?x ex:p ?y } LIMIT x"])
def test_syntax_errors(bad):
    with pytest.raises(QueryError):
        parse(bad, {"ex": EX})


@pytest.mark.parametrize("bad", ["SELECT ?x WHERE { ?x ex:age ?a BIND(1 AS ?a) }", "SELECT ?x (COUNT(*) AS ?n) WHERE { ?x ex:age ?a }", "SELECT ?x WHERE { ?x ex:age ?a FILTER(NOPE(?a)) }", "SELECT ?x WHERE { VECTOR_SIMILAR(?x ex:nope \"1 2\"^^tv:f32vec, 0.5) }"])
def test_semantic_errors(social, bad):
    with pytest.raises(QueryError):
        social.sparql(bad)


def test_grammar():
    q = parse("PREFIX p: <http://p/> SELECT DISTINCT $x (COUNT(DISTINCT ?y) AS ?n) WHERE { ?x p:a|p:b/^p:c ?y . ?x p:d \"a\\\"b\\u0041\"@en, 1.5e3, -4, true ; p:e '''long 'text''' . # comment\n } GROUP BY ?x ORDER BY DESC(COUNT(?y)) ?x LIMIT 3")
    lits = [t.o for t in q.where.parts[1:]]
    assert lits[0].lex == 'a"bA' and lits[0].lang == "en" and [x.lex for x in lits[1:]] == ["1.5e3", "-4", "true", "long 'text"]
    assert q.limit == 3 and q.order_by[0][1] is False


# a naive evaluator as the standard

TERMS = [EX + c for c in "abcd"]
FACTS = st.lists(st.tuples(st.sampled_from(TERMS), st.sampled_from([EX + "p", EX + "q"]), st.sampled_from([*TERMS, term(1), term(2)])), min_size=1, max_size=12, unique=True)
SLOT = st.sampled_from(["?x", "?y", "?z", f"<{EX}a>"])
PATTERN = st.tuples(SLOT, st.sampled_from([f"<{EX}p>", f"<{EX}q>", "?w"]), SLOT)


def match(facts, patterns, start):
    out = [start]
    for pat in patterns:
        step = []
        for b in out:
            for f in facts:
                new = dict(b)
                for slot, value in zip(pat, f, strict=True):
                    if slot.startswith("?"):
                        if new.setdefault(slot, value) != value:
                            break
                    elif slot[1:-1] != value:
                        break
                else:
                    step.append(new)
        out = step
    return out


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(FACTS, st.lists(PATTERN, min_size=1, max_size=2), st.lists(PATTERN, min_size=1, max_size=2), st.lists(PATTERN, min_size=1, max_size=1), st.sampled_from(["OPTIONAL", "UNION", "MINUS", "EXISTS", "NOT EXISTS"]))
def test_against_a_naive_evaluator(spark, facts, first, second, third, form):
    g = Graph(spark, triples=spark.createDataFrame(facts, "s string, p string, o string"))
    text = lambda ps: " . ".join(" ".join(p) for p in ps)
    base = match(facts, first, {})
    if form == "OPTIONAL":
        body = f"{text(first)} OPTIONAL {{ {text(second)} }} OPTIONAL {{ {text(third)} }}"
        for group in (second, third):
            base = [m for b in base for m in (match(facts, group, b) or [b])]
    elif form == "UNION":
        body = f"{{ {text(first)} }} UNION {{ {text(second)} }} {text(third)}"
        base = [m for b in base + match(facts, second, {}) for m in match(facts, third, b)]
    elif form == "MINUS":
        body = f"{text(first)} MINUS {{ {text(second)} }}"
        gone = match(facts, second, {})
        base = [b for b in base if not any(set(b) & set(m) and all(b[k] == m[k] for k in set(b) & set(m)) for m in gone)]
    else:
        body = f"{text(first)} FILTER {form} {{ {text(second)} }}"
        base = [b for b in base if bool(match(facts, second, b)) == (form == "EXISTS")]
    names = ["?x", "?y", "?z", "?w"]
    want = sorted((tuple(b.get(n) for n in names) for b in base), key=repr)
    got = sorted((tuple(r) for r in g.sparql(f"SELECT {' '.join(names)} WHERE {{ {body} }}").collect()), key=repr)
    assert got == want
