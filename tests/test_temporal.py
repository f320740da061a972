from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from thistle.graph import epoch
from thistle.operators import temporal
from thistle.plans.ast import QueryError

from .graphs import ask, graph

TV = "http://thistle.example/vocab#"


def annotated(spark, spans, plain=()):
    """spans: statement -> (froms, tos, asserted)"""
    notes = [(f, TV + k, v) for f, s in spans.items() for k, vs in zip(("validFrom", "validTo", "assertedAt"), s, strict=True) for v in vs]
    return graph(spark, [*spans, *plain, *notes])


def test_scopes(spark):
    g = annotated(spark, {("alice", "in", "office"): ([100], [200], []), ("bob", "in", "office"): ([150], [300], []), ("alice", "at", "acme"): ([50], [], [])}, [("water", "formula", "h2o")])
    at = lambda t: ask(g, f"SELECT ?x WHERE {{ AT_TIME({t}) {{ ?x ex:in ex:office }} }}")
    assert at(120) == [("alice",)] and at(175) == [("alice",), ("bob",)] and at(400) == [] and at(200) == [("alice",), ("bob",)]
    assert ask(g, "SELECT ?x WHERE { WORLD_STATE(9999) { ?x ex:formula ex:h2o } }") == [("water",)]
    assert ask(g, "SELECT ?x WHERE { AT_TIME(9999) { ?x ex:at ex:acme } }") == [("alice",)] and ask(g, "SELECT ?x WHERE { AT_TIME(10) { ?x ex:at ex:acme } }") == []
    assert ask(g, "SELECT ?x WHERE { DURING(210, 290) { ?x ex:in ex:office } }") == [("bob",)]
    assert ask(g, "SELECT ?x WHERE { VALUES ?t { 120 } AT_TIME(?t) { ?x ex:in ex:office } }") == [("alice",)]


def test_diff(spark):
    g = annotated(spark, {("alice", "in", "office"): ([100], [200], []), ("bob", "in", "office"): ([150], [300], []), ("alice", "in", "park"): ([250], [400], [])})
    assert ask(g, "SELECT ?x ?y ?change_type WHERE { TEMPORAL_DIFF(150, 275) { ?x ex:in ?y } }") == [("alice", "office", "removed"), ("alice", "park", "added"), ("bob", "office", "unchanged")]


def visible(s, e, a, t):
    s, e, n = sorted(s), sorted(e), min(len(s), len(e))
    return any(x <= t <= y for x, y in zip(s, e, strict=False)) or any(x <= t for x in s[n:]) or any(y >= t for y in e[n:]) or t in a or not s and not e


def overlap(s, e, a, lo, hi):
    s, e, n = sorted(s), sorted(e), min(len(s), len(e))
    return not (s or e or a) or any(lo <= x <= hi for x in a) or any(x <= hi and y >= lo for x, y in zip(s, e, strict=False)) or any(x <= hi for x in s[n:]) or any(y >= lo for y in e[n:])


def test_containment_against_brute_force(spark):
    r = random.Random(2)
    some = lambda: [r.randrange(20) for _ in range(r.choice([0, 0, 1, 2, 3]))]
    cases = [(i, some(), some(), some()) for i in range(300)]
    df = spark.createDataFrame(cases, "i int, s array<bigint>, e array<bigint>, a array<bigint>")
    for t in (0, 7, 13, 25):
        got = {x["i"]: x["v"] for x in df.select("i", temporal.visible_at(F.col("s"), F.col("e"), F.col("a"), t).alias("v")).collect()}
        assert got == {i: visible(s, e, a, t) for i, s, e, a in cases}
        got = {x["i"]: x["v"] for x in df.select("i", temporal.overlaps(F.col("s"), F.col("e"), F.col("a"), t, t + 4).alias("v")).collect()}
        assert got == {i: overlap(s, e, a, t, t + 4) for i, s, e, a in cases}


def test_null_annotations(spark):
    df = spark.sql("select cast(null as array<bigint>) s, cast(null as array<bigint>) e, array(cast(null as bigint)) a")
    assert df.select(temporal.visible_at(F.col("s"), F.col("e"), F.col("a"), 5)).first()[0] is True


@pytest.mark.parametrize("text, at, precision", [("1970", 0, "year"), ("1847-03", -3876422400, "month"), ("1970-01-02", 86400, "day"), ("1970-01-01T09", 32400, "hour"), ("1970-01-01T09:32", 34320, "minute"), ("1970-01-01T00:00:01Z", 1, "second"), ("1970-01-01T01:00:00+01:00", 0, "second"), ("2000-02-29", 951782400, "day")])
def test_parse(text, at, precision):
    assert temporal.parse(text) == (at, precision)


def test_far_years_and_precision():
    assert temporal.parse("-0500")[0] == temporal.days(-500, 1, 1) * 86400
    assert temporal.days(2000, 3, 1) - temporal.days(-400, 3, 1) == 6 * 146_097
    for y in (-401, -400, -1, 0, 1, 400, 1999, 12_000):
        assert temporal.civil(temporal.days(y, 7, 4) * 86_400) == (y, 7)
    a, _ = temporal.parse("1999-12")
    assert temporal.interval(a, "month")[1] == temporal.parse("2000")[0]
    assert temporal.interval(*temporal.parse("2000"))[1] - temporal.parse("2000")[0] == 366 * 86_400
    for bad in ("", "x", "1999-13", "1999-02-30", "1999-1"):
        with pytest.raises(QueryError):
            temporal.parse(bad)


def test_epoch_of_terms_agrees(spark):
    texts = ["1970", "1847-03", "-0500", "2000-02-29T10:20:30", "1999-12-31T23", "0000-03-01"]
    df = spark.createDataFrame([(i, f'"{t}"^^<http://x#temporal>') for i, t in enumerate(texts)] + [(90, '"77"^^<http://www.w3.org/2001/XMLSchema#integer>'), (91, '"soon"'), (92, None)], "i int, o string")
    got = {r["i"]: r["t"] for r in df.select("i", epoch("o").alias("t")).collect()}
    assert got == {**{i: temporal.parse(t)[0] for i, t in enumerate(texts)}, 90: 77, 91: None, 92: None}
