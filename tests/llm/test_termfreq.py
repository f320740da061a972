from __future__ import annotations

from collections import Counter

from thistle.llm.termfreq import marked, term_counts


def test_counts_against_brute_force(spark):
    docs = [["a", "b", "a"], ["b"], [], None, ["", None, "c"], ["a"] * 1000, ["hot"], ["hot", "x"]] * 5
    df = spark.createDataFrame([(d, d, 1) for d in docs], "w array<string>, term array<string>, occurrences int").repartition(3)
    occ, rec = Counter(), Counter()
    for d in docs:
        words = [x for x in d or [] if x]
        occ.update(words)
        rec.update(set(words))
    for field in ("w", "term"):
        got = {r["term"]: (r["occurrences"], r["records"]) for r in term_counts(df, ["w", "term"]).where(f"field = '{field}'").collect()}
        assert got == {t: (occ[t], rec[t]) for t in occ}


def test_small_batches(spark):
    df = spark.createDataFrame([([str(i % 3), "x", "x"],) for i in range(50)], "w array<string>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r["term"]: (r["occurrences"], r["records"]) for r in term_counts(df, ["w"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got["x"] == (100, 50) and got["0"] == (17, 17)


def test_marks_and_empty(spark):
    df = spark.createDataFrame([("w", "a", 9, 2), ("w", "b", 9, 3), ("w", "c", 9, 10), ("w", "d", 1, 1)], "field string, term string, occurrences long, records long")
    assert {r["term"]: r["mark"] for r in marked(df, 1000).collect()} == {"a": "rare", "b": None, "c": "common", "d": "rare"}
    assert {r["mark"] for r in marked(df, 50).collect()} == {"common"}
    assert term_counts(spark.createDataFrame([], "w array<string>"), ["w"]).count() == 0


def test_last_seen_over_batches_and_parts():
    """The reducer alone: a counter that begins with the record its term ended with doesn't count that record again."""
    import pyarrow as pa

    from thistle.llm.termfreq import _last_seen

    rows = [("f", "a", 3, 2, 1, 5), ("f", "a", 2, 2, 5, 9), ("f", "a", 1, 1, 9, 9), ("f", "b", 1, 1, 9, 9), ("g", "b", 4, 3, 9, 12), ("g", "b", 1, 1, 13, 13)]
    names = ["field", "term", "occurrences", "records", "first", "last"]
    for size in (1, 2, 3, 6):
        batches = [pa.RecordBatch.from_pydict({n: [r[i] for r in rows[k : k + size]] for i, n in enumerate(names)}) for k in range(0, 6, size)]
        got = [tuple(c[i].as_py() for c in b.columns) for b in _last_seen(iter(batches)) for i in range(b.num_rows)]
        assert got == [("f", "a", 6, 3), ("f", "b", 1, 1), ("g", "b", 5, 4)]
