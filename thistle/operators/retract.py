"""Cascade retraction: what falls with a node, because it was made from what falls."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.ast import VOCABULARY
from ..runtime import cut, cut_counted


#: Citations that one round goes on.
HOPS = 4


def cascade(seeds: DataFrame, citations: DataFrame) -> DataFrame:
    """(id, depth): the seeds at 0, and everything that cites one of them, directly or through others, at its least distance.

    citations: child, parent (a child cites its parent). Loops end as soon as nothing new falls; nulls cite nothing. The state of a round is
    only its newly fallen ids, matched with the citations HOPS times over before they are written.
    """
    edges = cut(citations.where("child is not null and parent is not null").select("child", "parent").distinct())
    front = cut(seeds.select("id").where("id is not null").distinct().withColumn("depth", F.lit(0)))
    fallen, depth = front, 0
    while True:
        step, ahead = front.select("id"), None
        for k in range(1, HOPS + 1):
            step = step.withColumnRenamed("id", "parent").join(edges, "parent").select(F.col("child").alias("id")).distinct()
            now = step.withColumn("depth", F.lit(depth + k))
            ahead = now if ahead is None else ahead.unionByName(now)
        new, seen = cut_counted(ahead.groupBy("id").agg(F.min("depth").alias("depth")).join(fallen.select("id"), "id", "left_anti"), n=F.count(F.lit(1)))
        if not seen["n"]:
            return fallen
        fallen, depth = fallen.unionByName(new), depth + HOPS
        front = new.where(F.col("depth") == depth)


def retraction_set(triples: DataFrame, quoted: DataFrame, root: str, selected_from: list[str] | None = None, reserved: str = VOCABULARY) -> DataFrame:
    """(s, p, o, depth): the statements that go with a node.

    Depth 0: statements with the node as subject or object, and the reserved-namespace annotations on these. Depth k: statements whose
    provenance annotation names one of depth k - 1 as a source, with all their reserved annotations. Other edges are never followed. A
    statement that several ways lead to has its least depth.
    """
    follow = selected_from or [reserved + "selectedFrom", reserved + "inferredFrom"]
    key = F.concat(F.lit("<< "), F.col("s"), F.lit(" "), F.col("p"), F.lit(" "), F.col("o"), F.lit(" >>"))
    own = triples.where((F.col("s") == root) | (F.col("o") == root)).select("s", "p", "o").distinct()
    cited = triples.where(F.col("p").isin(*follow)).select(F.col("s").alias("child"), F.col("o").alias("parent"))
    cited = cited.join(quoted.select(F.col("key").alias("child")).distinct(), "child", "left_semi")
    fallen = cut(cascade(own.select(key.alias("id")), cited))
    made = fallen.where("depth > 0").join(quoted.withColumnRenamed("key", "id"), "id").select(F.col("qs").alias("s"), F.col("qp").alias("p"), F.col("qo").alias("o"), "depth")
    notes = triples.where(F.col("p").startswith(reserved)).select("s", "p", "o").join(fallen.withColumnRenamed("id", "s"), "s").select("s", "p", "o", "depth")
    every = own.withColumn("depth", F.lit(0)).unionByName(made).unionByName(notes)
    return every.groupBy("s", "p", "o").agg(F.min("depth").alias("depth"))


def retract(graph, root: str, commit: bool = False, **options) -> DataFrame:
    """The retraction set of a Graph; with commit its statements are deleted."""
    found = cut(retraction_set(graph.triples, graph.quoted, root, reserved=graph.vocabulary, **options))
    if commit:
        graph.delete(found)
    return found
