"""Streams of statements and events. An extension: batches are the main road."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.orphans import OrphanTracker
from ..sources.readers import parse_lines


def statement_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed statements of N-Triples files as they arrive in a folder, each once within ten minutes of its arrival."""
    lines = spark.readStream.text(folder).withColumn("seen_at", F.current_timestamp())
    rows = parse_lines(lines).where("ok").select("s", "p", "o").withColumn("seen_at", F.current_timestamp())
    return rows.withWatermark("seen_at", "10 minutes").dropDuplicatesWithinWatermark(["s", "p", "o"])


def _zoned(events: DataFrame, at: str) -> tuple[DataFrame, str]:
    """Watermarks need times with a zone; results go back to the type that came in."""
    kind = events.schema[at].dataType.simpleString()
    return (events.withColumn(at, F.col(at).cast("timestamp")) if kind != "timestamp" else events), kind


def windowed_counts(events: DataFrame, at: str, kind: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, kind, n): events per tumbling or sliding window; in a stream, what comes later than `late` is dropped."""
    df, back = _zoned(events, at)
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return df.withWatermark(at, late).groupBy(w.alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast(back).alias("start"), "kind", "n")


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): runs of events of one key without a pause of `gap`."""
    df, back = _zoned(events, at)
    w = F.session_window(at, gap)
    per = df.withWatermark(at, late).groupBy(F.col(key).alias("key"), w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return per.select("key", F.col("w.start").cast(back).alias("start"), F.col("w.end").cast(back).alias("end"), "n")


def track_orphans(tracker: OrphanTracker, references: DataFrame, parents_of: callable):
    """A stream writer that feeds each batch of references, with the parents that parents_of(batch number) gives, to a tracker."""

    def each(batch: DataFrame, number: int) -> None:
        tracker.advance(batch, parents_of(number))

    return references.writeStream.foreachBatch(each)
