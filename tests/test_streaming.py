from __future__ import annotations

from datetime import datetime, timedelta

from thistle.operators.orphans import OrphanTracker
from thistle.streaming.statements import sessions, statement_stream, track_orphans, windowed_counts


def events(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=7 * i), i % 2) for i in range(30)]
    spark.createDataFrame(rows, "id int, ts timestamp_ntz, user int").write.mode("overwrite").parquet(str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in df.sparkSession.table(name).collect())


def test_windows_equal_the_batch(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    want = sorted(tuple(r) for r in windowed_counts(batch, "ts", "user", "1 hour").collect())
    assert drain(windowed_counts(stream, "ts", "user", "1 hour"), "w", "complete") == want
    slide = windowed_counts(batch, "ts", "user", "1 hour", "30 minutes").collect()
    assert sum(r["n"] for r in slide) == 60


def test_sessions(spark, tmp_path):
    batch, _ = events(spark, tmp_path)
    assert sorted((r["key"], r["n"]) for r in sessions(batch, "ts", "user", "15 minutes").collect()) == [(0, 15), (1, 15)]
    assert len(sessions(batch, "ts", "user", "10 minutes").collect()) == 30


def test_statements_once(spark, tmp_path):
    (tmp_path / "a.nt").write_text("<http://a> <http://p> <http://b> .\n<http://a> <http://p> <http://b> .\nbad\n<http://a> <http://p> <http://c> .\n")
    got = drain(statement_stream(spark, str(tmp_path / "*.nt")).select("s", "p", "o"), "st")
    assert got == [("http://a", "http://p", "http://b"), ("http://a", "http://p", "http://c")]


def test_orphans_in_batches(spark, tmp_path):
    refs = [(1, "t", "a", 5), (2, "t", "b", 5)]
    schema = "id int, tbl string, key string, at long"
    for k, r in enumerate(refs):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(str(tmp_path / f"r/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r/*"))
    tracker = OrphanTracker(spark)
    parents = lambda k: spark.createDataFrame([("a", 1, None)] if k == 1 else [], "key string, from_us long, to_us long")
    q = track_orphans(tracker, stream, parents).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["id"] for r in tracker.pending.collect()] == [2]
