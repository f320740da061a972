from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from thistle.operators.widen import narrow, widen

T = "s string, p string, o string, asserted_at timestamp_ntz, stmt_id long, slot int, c0 string, val string"
PRED = [("http://kg.example/prop/n", "integer"), ("http://kg.example/prop/d", "date"), ("http://kg.example/prop/s", "string"), ("http://other.example/x/n", "decimal"), ("http://kg.example/prop/t", "text"), ("http://kg.example/prop/empty", "boolean")]


def make(spark, facts):
    rows = [(s, p, o, datetime(2024, 1, d) if d else None, i, 0, "", "") for i, (s, p, o, d) in enumerate(facts)]
    return spark.createDataFrame(rows, T), spark.createDataFrame(PRED, "pred_iri string, value_type string")


def test_newest_valid_value_wins(spark):
    t, p = make(spark, [("kge:a", "kgp:n", '"1"', 1), ("http://kg.example/entity/a", "kgp:n", '"+2"', 3), ("kge:a", "kgp:n", '"bad"', 9), ("kge:a", "kgp:n", '"3"', 3), ("kge:a", "kgp:n", '"9"', None), ("kge:a", "kgp:d", '"1.2.1999"', 1), ("kge:a", "http://other.example/x/n", "1,5", 1), ("kge:b", "kgp:t", '"x"', 1), (None, "kgp:n", "1", 1), ("kge:c", None, "1", 1), ("kge:d", "kgp:n", None, 1), ("kge:e", "kgp:zzz", "1", 1)])
    w = widen(t, p)
    r = w.collect()
    assert len(r) == 1 and r[0]["n"] == Decimal(3) and str(r[0]["d"]) == "1999-02-01" and r[0]["n_2"] == Decimal("1.50") and r[0]["empty"] is None
    assert set(w.columns) == {"ordinal", "s", "n", "n_2", "d", "s_2", "empty", "overflow"}
    assert {(x["p"].rsplit("/", 1)[1], x["val_text"]) for x in narrow(w).collect()} == {("n", "3"), ("n", "1.50"), ("d", "1999-02-01")}


def test_many_entities_keep_their_cells(spark):
    facts = [(f"kge:e{i}", "kgp:n", str(i), 1) for i in range(3000)] + [(f"kge:e{i}", "kgp:s", f'"v{i}"', 1) for i in range(0, 3000, 3)]
    t, p = make(spark, facts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = widen(t, p).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 3000 and len({r["ordinal"] for r in rows}) == 3000
    assert all(r["s"].endswith(f"/e{r['n']}") and r["s_2"] == (f"v{r['n']}" if int(r["n"]) % 3 == 0 else None) for r in rows)


def test_empty_tables(spark):
    t, p = make(spark, [])
    assert narrow(widen(t, p)).count() == 0
    t, _ = make(spark, [("kge:a", "kgp:n", "1", 1)])
    assert narrow(widen(t, p.limit(0))).count() == 0


def test_long_texts(spark):
    t, p = make(spark, [("kge:a", "kgp:s", '"' + "x" * 300_000 + '"', 1), ("kge:a", "kgp:n", '"' + "9" * 5000 + '"', 1)])
    assert sorted((r["p"][-1], len(r["val_text"])) for r in narrow(widen(t, p)).collect()) == [("n", 5000), ("s", 300_000)]


def test_numbers_too_long_for_their_columns(spark):
    t, p = make(spark, [("kge:a", "kgp:n", '"' + "7" * 38 + '"', 1), ("kge:b", "kgp:n", '"-' + "7" * 39 + '"', 1), ("kge:b", "http://other.example/x/n", '"' + "8" * 37 + '.125"', 1)])
    w = widen(t, p)
    rows = {r["s"][-1]: r for r in w.collect()}
    assert rows["a"]["n"] == Decimal("7" * 38) and not rows["a"]["overflow"]
    assert rows["b"]["n"] is None and rows["b"]["overflow"] == {"n": "-" + "7" * 39, "n_2": "8" * 37 + ".13"}
    assert {(r["s"][-1], r["val_text"]) for r in narrow(w).collect()} == {("a", "7" * 38), ("b", "-" + "7" * 39), ("b", "8" * 37 + ".13")}
