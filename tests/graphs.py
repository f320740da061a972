"""Small graphs for the engine's tests."""

from __future__ import annotations

from thistle.graph import Graph
from thistle.plans.ast import RDF_TYPE, VOCABULARY, XSD

EX = "http://ex/"


def term(x):
    if isinstance(x, bool):
        return f'"{str(x).lower()}"^^<{XSD}boolean>'
    if isinstance(x, int):
        return f'"{x}"^^<{XSD}integer>'
    if isinstance(x, float):
        return f'"{x}"^^<{XSD}decimal>'
    if isinstance(x, tuple):
        return "<< " + " ".join(term(y) for y in x) + " >>"
    if x == "a":
        return RDF_TYPE
    return x if x.startswith(("_:", '"', "http")) else f'"{x[1:]}"' if x.startswith("'") else EX + x


def graph(spark, facts, **options):
    """facts: (s, p, o); names are IRIs under EX, 'text is a plain literal, a tuple a quoted statement."""
    rows, quoted = set(), set()

    def add(f):
        rows.add(tuple(term(x) for x in f))
        for x in (f[0], f[2]):
            if isinstance(x, tuple):
                quoted.add((term(x), *(term(y) for y in x)))
                for y in (x[0], x[2]):
                    if isinstance(y, tuple):
                        quoted.add((term(y), *(term(z) for z in y)))

    for f in facts:
        add(f)
    q = spark.createDataFrame(sorted(quoted), "key string, qs string, qp string, qo string") if quoted else None
    return Graph(spark, triples=spark.createDataFrame(sorted(rows), "s string, p string, o string"), quoted=q, prefixes={"": EX, "ex": EX}, **options)


def short(x):
    if not isinstance(x, str):
        return x
    if x.startswith('"') and x.endswith("integer>"):
        return int(x[1:].split('"')[0])
    return x.removeprefix(EX).removeprefix(VOCABULARY)


def ask(g, text, language="sparql"):
    return sorted((tuple(short(v) for v in r) for r in getattr(g, language)(text).collect()), key=repr)
