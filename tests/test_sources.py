from __future__ import annotations

import pytest

from thistle.graph import Graph
from thistle.plans.ast import XSD, QueryError
from thistle.sources import readers, writers
from thistle.sources.store import Store

from .graphs import EX, graph

LINES = [
    "<http://ex/a> <http://ex/p> <http://ex/b> .", "", "# comment", '  <http://ex/a>\t<http://ex/n> "x \\"y\\" \\\\ \\n z"@en . # end', '<http://ex/a> <http://ex/i> "+07"^^<http://www.w3.org/2001/XMLSchema#int> .',
    "_:b1 <http://ex/p> _:b2 .", '<< <http://ex/s> <http://ex/p> "q"@de >> <http://ex/src> << <http://ex/a> <http://ex/p> <http://ex/b> >> .', "not a line", '<http://ex/a> <http://ex/p> "open .', '"lit" <http://ex/p> <http://ex/b> .',
]


def test_ntriples(spark, rows):
    triples, quoted, errors = readers.load_lines(spark.createDataFrame([(x, 1) for x in LINES], "value string, ok int"))
    k1, k2 = '<< http://ex/s http://ex/p "q"@de >>', "<< http://ex/a http://ex/p http://ex/b >>"
    assert rows(triples) == sorted([("http://ex/a", "http://ex/p", "http://ex/b"), ("http://ex/a", "http://ex/n", '"x "y" \\ \n z"@en'), ("http://ex/a", "http://ex/i", f'"7"^^<{XSD}integer>'), ("_:b1", "http://ex/p", "_:b2"), (k1, "http://ex/src", k2), ("http://ex/s", "http://ex/p", '"q"@de')], key=repr)
    assert {r["key"] for r in quoted.collect()} == {k1, k2}
    assert rows(errors) == sorted([(LINES[7],), (LINES[8],), (LINES[9],)], key=repr)
    again, q2, e2 = readers.load_lines(writers.ntriples(triples, quoted))
    assert rows(again) == rows(triples) and rows(q2) == rows(quoted) and e2.count() == 0


def test_nquads(spark, tmp_path, rows):
    (tmp_path / "x.nq").write_text("<http://a> <http://p> <http://b> <http://g> .\n<http://a> <http://p> <http://c> .\nbad\n")
    assert rows(readers.read_nquads(spark, str(tmp_path))) == [("http://a", "http://p", "http://b", "http://g"), ("http://a", "http://p", "http://c", None)]


def test_documents(spark, tmp_path):
    (tmp_path / "1.ttl").write_text('@prefix e: <http://e/> .\n@base <http://b/> .\ne:a a e:T ; e:p 1, 2.5, true, "x"@en ; e:q [ e:r <c> ] .\n')
    (tmp_path / "2.ttl").write_text("this is not turtle")
    got = readers.read_documents(spark, str(tmp_path / "*.ttl"), "turtle").collect()
    assert sum(r["error"] is not None for r in got) == 1
    o = {(r["p"][9:], r["o"]) for r in got if r["error"] is None and r["s"] == "http://e/a"}
    assert ("p", f'"1"^^<{XSD}integer>') in o and ("p", '"x"@en') in o and ("p", f'"2.5"^^<{XSD}decimal>') in o
    inner = [r for r in got if r["error"] is None and r["p"] == "http://e/r"]
    assert inner[0]["o"] == "http://b/c" and inner[0]["s"].startswith("_:f")


def test_turtle_writer_can_be_read_again(spark, tmp_path, rows):
    g = graph(spark, [("x", "a", "T"), ("x", "n", "'say"), ("y", "k", 5), ("y", "k", "_:z")])
    writers.write_turtle(g.triples, str(tmp_path / "out"))
    got = readers.read_documents(spark, str(tmp_path / "out/*.txt"), "turtle").where("error is null").select("s", "p", "o")
    assert rows(got.where("o not like '\\_:%'")) == rows(g.triples.where("o not like '\\_:%'")) and got.count() == 4
    assert any(r["value"].startswith("ex:x") for r in writers.turtle(g.triples, {"ex": EX}).collect())


def test_rdfxml_and_jsonld():
    xml = '<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><r:Description r:about="http://a" e:k="v"><e:n r:datatype="http://t">5</e:n><e:m r:parseType="Resource"><e:x>y</e:x></e:m></r:Description></r:RDF>'
    got = set(readers.rdfxml(xml))
    assert ("http://a", "http://e/k", '"v"') in got and ("http://a", "http://e/n", '"5"^^<http://t>') in got and any(o == '"y"' and s.startswith("_:") for s, _, o in got)
    doc = '{"@context": {"e": "http://e/", "when": {"@id": "e:when", "@type": "http://t"}}, "@graph": [{"@id": "e:a", "@type": ["e:T"], "when": "2000", "e:l": [1, {"@value": "x", "@language": "en"}], "skip": 1}]}'
    assert set(readers.jsonld(doc)) == {("http://e/a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://e/T"), ("http://e/a", "http://e/when", '"2000"^^<http://t>'), ("http://e/a", "http://e/l", f'"1"^^<{XSD}integer>'), ("http://e/a", "http://e/l", '"x"@en')}


def test_results(spark):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "n int, t string")
    lines = lambda k: [r["value"] for r in writers.results(df, k).collect()]
    assert lines("csv") == ['1,"a ""b"", c"', "2,"]
    assert lines("tsv") == ['1\ta "b", c', "2\t"]
    assert lines("json") == ['{"n":1,"t":"a \\"b\\", c"}', '{"n":2}']
    assert lines("xml")[1] == '<result><binding name="n"><literal>2</literal></binding></result>'
    with pytest.raises(ValueError):
        writers.results(df, "pdf")


def test_store(spark, tmp_path, rows):
    s = Store(spark, f"file://{tmp_path}/store", spread=4)
    with pytest.raises(QueryError):
        s.triples()
    t = graph(spark, [("x", "p", "y"), ("x", "q", "y")]).triples
    assert s.insert(t) == (2, 0) and s.insert(t) == (0, 2) and s.versions() == [0]
    assert s.insert(graph(spark, [("x", "p", "z"), ("x", "p", "y")]).triples) == (1, 1)
    assert rows(s.triples(predicate=EX + "p"), "o") == [(EX + "y",), (EX + "z",)]
    assert s.delete(graph(spark, [("x", "q", "y"), ("no", "q", "y")]).triples) == 1 and s.triples(0).count() == 2
    assert Graph(spark, triples=s.triples()).ask("ASK { <http://ex/x> ?p <http://ex/z> }")
    (tmp_path / "store/v9/triples").mkdir(parents=True)
    assert s.versions() == [0, 1, 2] and rows(s.triples(1)) != rows(s.triples(2))
    # a change is written as itself alone
    assert rows(spark.read.parquet(f"{tmp_path}/store/v2/removed").select("s", "o")) == [(EX + "x", EX + "y")]
    assert rows(s.verify(), "version", "ok") == [(0, True), (1, True), (2, True), (9, False)] and s.repair() == [9]
    whole = rows(s.triples())
    assert s.compact() == [0, 1, 2] and rows(s.triples()) == whole
    assert sorted(r["value"] for r in s.export().collect())[0].startswith(f"<{EX}x> <{EX}p>")
    assert s.replace(graph(spark, [("new", "p", "y")]).triples) == 1 and s.triples().count() == 1
    s.clear()
    assert s.triples().count() == 0


def test_a_lost_file_is_found_and_repaired(spark, tmp_path, rows):
    s = Store(spark, f"file://{tmp_path}/store", spread=2)
    s.insert(graph(spark, [("x", "p", "y")]).triples)
    s.insert(graph(spark, [("x", "p", "z")]).triples)
    s.insert(graph(spark, [("x", "p", "w")]).triples)
    for f in (tmp_path / "store/v1").rglob("*.parquet"):
        f.unlink()
    assert rows(s.verify(), "version", "ok") == [(0, True), (1, False), (2, True)]
    assert s.repair() == [1, 2] and rows(s.triples(), "o") == [(EX + "y",)]


def test_service_description(spark):
    assert "void:triples 2" in writers.service_description(graph(spark, [("x", "p", "y"), ("x", "q", "y")]).triples)
