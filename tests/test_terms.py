from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from thistle.functions import terms
from thistle.sources.statements import statements

E, C, P = (terms.PREFIXES[k] for k in ("kge", "kgc", "kgp"))


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f("v")).collect()]


def test_clean_iri(spark):
    dirty = [f"{E}E1", f" <{E}E1> ", "kge:E1", f"\t{E}E1", f"HTTP://KG.Example/entity/E1", "https://kg.example/entity/E1", f"<{E}E1>", " kge:E1　"]
    assert column(spark, dirty, terms.clean_iri) == [f"{E}E1"] * len(dirty)
    assert column(spark, [f"{E}e1", f"{E}E1X", None, "", "  ", "kgc:C2", "kgp:p", "HTTPS://Other.Example/A?b=C"], terms.clean_iri) == [f"{E}e1", f"{E}E1X", None, "", "", f"{C}C2", f"{P}p", "http://other.example/A?b=C"]


def test_iri_of_only_iris(spark):
    assert column(spark, ["kge:E1", f"<{E}E1> ", '"kge:E1"', "_:b1", "5", "true", "", None, "http://x.example/y "], terms.iri_of) == [f"{E}E1", f"{E}E1", None, None, None, None, None, None, "http://x.example/y"]


def test_lexical(spark):
    terms_ = ['"a"', '"a"@en', '"1"^^xsd:integer', '"1"^^<xsd:integer>', r'"say \"x\" \\ \n"@en', " 12 ", "true", f"{E}E1", "_:b", None, "", '""', '"open']
    assert column(spark, terms_, terms.lexical) == ["a", "a", "1", "1", 'say "x" \\ \n', "12", "true", None, None, None, "", "", "open"]


@pytest.mark.parametrize(
    "kind, good, bad",
    [
        ("integer", {'"+07"': "7", "12": "12", '"884.0"^^xsd:decimal': "884", '" -5 "': "-5", '"1E2"': "100", '"-0"': "0", '"12345678901234567890123456789"': "12345678901234567890123456789", '"-0012345678901234567890123456789.000"': "-12345678901234567890123456789", '"1e30"': "1" + "0" * 30, '"120e-1"': "12"}, ['"1.5"', '"12abc"', '"1-2"', '""', '"about 40"', '"-"', None, f"{E}E1", '"3.00000000001"', '"1e-11"', '"INF"', '"1e9999"']),
        ("decimal", {'"282,25"': "282.25", '"3.599E1"^^xsd:double': "35.99", '"+4.00"': "4.00", "9": "9.00", '".5"': "0.50", '"2.345"': "2.35", '"5."': "5.00", '"1234567890123456789012345678901234567890,125"': "1234567890123456789012345678901234567890.13", '"-1e-11"': "0.00", '"0.00499999999999999"': "0.00", '"-99.999999999999"': "-100.00", '".0050000000000001"': "0.01", '"2,5e40"': "25" + "0" * 39 + ".00"}, ['"1.2.3"', '"NaN"', '"12 m"', '"1 2"', '"?"', '","']),
        ("boolean", {'"TRUE"': "true", "f": "false", '"0"^^xsd:boolean': "false", '"Yes"@en': "true", "1": "true"}, ['"maybe"', '""', '"2"']),
        ("date", {'"1936-07-12"^^xsd:date': "1936-07-12", '"1924-07-01T00:00:00Z"^^xsd:dateTime': "1924-07-01", '"19000528"': "1900-05-28", '"1.12.1785"@de': "1785-12-01", '"1735-8-20"': "1735-08-20"}, ['"1999-02-30"', '"spring 1912"', '"20011301"', '"31.4.1999"', '"1999"']),
        ("string", {'"  n/a "': "n/a", '"x y"@en': "x y"}, ['"   "', '""', '" "']),
    ],
)
def test_values(spark, kind, good, bad):
    both = [*good, *bad]
    df = spark.createDataFrame([(i, kind, v) for i, v in enumerate(both)], "i int, kind string, o string")
    got = [r["x"] for r in terms.with_value(df, "kind", "o", "x").orderBy("i").collect()]
    assert got == [*good.values(), *[None] * len(bad)]


def test_value_of_other_kinds_is_null(spark):
    df = spark.createDataFrame([("text", '"5"'), (None, '"5"'), ("entity", "kge:E1")], "kind string, o string")
    assert [r["x"] for r in terms.with_value(df, "kind", "o", "x").collect()] == [None] * 3


def test_where_any_keeps_rows_once(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", None), (3, "a", "b")], "i int, x string, y string")
    assert sorted(r["i"] for r in terms.where_any(df, "x", "y").collect()) == [2, 3]


def test_micros(spark):
    got = spark.sql("select timestamp_ntz'1970-01-02 00:00:01.5' as a, timestamp_ntz'1969-12-31 23:59:59' as b").select(terms.micros("a"), terms.micros("b")).first()
    assert tuple(got) == (86_401_500_000, -1_000_000)


def test_words(spark):
    assert column(spark, ["Ab'c 12 déjà-Vu", "", None], lambda c: F.array_join(terms.words(c), "|")) == ["ab|c|déjà|vu", "", None]


def test_statements(spark, rows):
    xsd = "http://www.w3.org/2001/XMLSchema#"
    df = spark.createDataFrame([("kge:E1", "kgp:n", '"+07"^^xsd:int', 1), (f"<{E}E1>", f"{P}n", "7", 2), ("kge:E1", "kgp:n", "1.50", 3), ("kge:E1", "kgp:n", "true", 4), ("kge:E1", "", "x", 5), (None, "kgp:n", "x", 6), ("kge:E1", "kgp:n", " ", 7), ('"l"', "kgp:n", "x", 8), ("_:b", "kgp:n", '"x"@en', 9)], "s string, p string, o string, _t int")
    assert rows(statements(df)) == sorted([("_:b", f"{P}n", '"x"@en'), (f"{E}E1", f"{P}n", f'"7"^^<{xsd}integer>'), (f"{E}E1", f"{P}n", f'"1.50"^^<{xsd}decimal>'), (f"{E}E1", f"{P}n", f'"true"^^<{xsd}boolean>')], key=repr)
