"""Queries of the core operators on training data problems, and their SQL."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions.terms import ENTITY, clean_iri, iri_of, micros
from .operators import hierarchy, orphans, widen
from .oracles import ORACLES as ORACLES
from .runtime import cut, table


#: Ends of the batches that the tracker of problem 1 is fed with: what was ingested, fetched or removed before, and after all, the rest.
BATCHES = ("2025-01-01", "2026-01-01", None)


def _moment(day: str) -> int:
    return int(datetime.fromisoformat(day).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000


def _batch(spark: SparkSession, d: str, after: str | None, until: str | None) -> tuple[DataFrame, DataFrame]:
    """References and parent changes of problem 1 between two days: statements refer to labels as of their assertion, labels to subjects of any time.

    Keys of labels begin with l, those of subjects with s. A label whose end lies in a later batch comes without it, and again then. Rows
    without a time of arrival come last.
    """
    t, lab = table(spark, d, "triples"), table(spark, d, "labels")
    lo, hi = (_moment(x) if x else None for x in (after, until))

    def arrives(c: Column) -> Column:
        late, early = F.lit(True) if lo is None else c >= lo, F.lit(True) if hi is None else c < hi
        return F.coalesce(late & early, F.lit(hi is None))

    def key(side: str, c: Column) -> Column:
        return F.when(c.startswith(ENTITY), F.concat(F.lit(side), F.substr(c, F.lit(len(ENTITY) + 1))))

    us = lambda c: F.round(F.col(c) * 1e6).cast("long")
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    if after or until:
        inside = (F.col("ingested_at") >= day(after) if after else F.lit(True)) & (F.col("ingested_at") < day(until) if until else F.lit(True))
        t = t.where(F.coalesce(inside, F.lit(until is None)))
    fetched, removed = us("fetched_at"), us("removed_at")
    from_statements = t.where("o is not null").select(F.col("stmt_id").alias("id"), F.lit("triples").alias("tbl"), key("l", iri_of("o")).alias("key"), micros("asserted_at").alias("at"), micros("asserted_at").alias("on_us"))
    own = lab.where(arrives(fetched) & F.col("iri").isNotNull())
    from_labels = own.select(F.col("label_id").alias("id"), F.lit("labels").alias("tbl"), key("s", clean_iri("iri")).alias("key"), F.coalesce(fetched, F.lit(0)).alias("at"), fetched.alias("on_us"))
    known_end = removed if hi is None else F.when(removed < hi, removed)
    ends_now = F.lit(False) if lo is None else arrives(removed) & (fetched < lo) & removed.isNotNull()
    labels = lab.where(F.col("iri").isNotNull() & (arrives(fetched) | F.coalesce(ends_now, F.lit(False)))).select(key("l", clean_iri("iri")).alias("key"), fetched.alias("from_us"), known_end.alias("to_us"), F.col("label_id").cast("string").alias("parent_id"))
    subjects = t.where("s is not null").select(key("s", clean_iri("s")).alias("key")).distinct().select("key", F.lit(orphans.FIRST).alias("from_us"), F.lit(None).cast("long").alias("to_us"), F.lit(None).cast("string").alias("parent_id"))
    return from_statements.unionByName(from_labels), labels.unionByName(subjects)


def _tracked(spark: SparkSession, d: str) -> Iterator[orphans.OrphanTracker]:
    """The tracker after each batch."""
    tracker = orphans.OrphanTracker(spark)
    for after, until in zip((None, *BATCHES), BATCHES):
        tracker.advance(*_batch(spark, d, after, until))
        yield tracker


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    *_, tracker = _tracked(spark, d)
    return tracker.pending.select("tbl", F.col("id").alias("row_id"))


def p1_per_month(spark: SparkSession, d: str) -> DataFrame:
    *_, tracker = _tracked(spark, d)
    return tracker.snapshot().select("tbl", "month", "orphans")


def p1_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The orphans pending after each batch, per table and month: what arrived late resolves some, what was removed reopens others."""
    out = None
    for i, tracker in enumerate(_tracked(spark, d)):
        now = cut(tracker.snapshot().withColumn("batch", F.lit(i + 1)))
        out = now if out is None else out.unionByName(now)
    return out


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sub, prov = table(spark, d, "subclass_of"), table(spark, d, "provenance")
    a = sub.select(F.lit("subclass_of").alias("hier"), clean_iri("class_iri").alias("child"), clean_iri("parent_iri").alias("parent"))
    p = clean_iri("p")
    b = prov.where(p.endswith("/selectedFrom") | p.endswith("/inferredFrom")).select(F.lit("provenance").alias("hier"), F.col("generated_id").cast("string").alias("child"), F.col("source_id").cast("string").alias("parent"))
    edges = a.unionByName(b.where("child is not null and parent is not null"))
    nodes = edges.select("hier", F.explode(F.array("child", "parent")).alias("node"))
    return edges, nodes


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.double_pointers(*_links(spark, d))
    return h.reached.select("hier", "node", F.col("target").alias("root"), "node_depth").unionByName(h.cyclic.select("hier", "node", F.lit("cycle").alias("root"), F.lit(-1).alias("node_depth")))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """The full path from every node to each of its roots."""
    h = hierarchy.double_pointers(*_links(spark, d), paths=True)
    return h.reached.select("hier", "node", F.col("target").alias("root"), "node_depth", F.array_join("path", " ").alias("path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every node with every descendant below it."""
    h = hierarchy.double_pointers(*_links(spark, d), targets="all")
    return h.reached.where("node_depth > 0").select("hier", F.col("target").alias("node"), F.col("node").alias("descendant"), F.col("node_depth").alias("levels"))


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    """One typed row per entity, exact numbers as bigint and double; the ordinal is left out, as it depends on the partitions."""
    wide = widen.widen(table(spark, d, "triples"), table(spark, d, "predicates"))
    plain = {"integer": "bigint", "decimal": "double"}
    return wide.select("s", *(F.col(name).try_cast(plain[kind]).alias(name) if kind in plain else F.col(name) for _, name, kind in wide._thistle_columns))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return widen.narrow(widen.widen(table(spark, d, "triples"), table(spark, d, "predicates")))


QUERIES = {f.__name__: f for f in (p1_found, p1_per_month, p1_snapshots, p2_found, p2_paths, p2_descendants, p3_found, p3_wide)}
