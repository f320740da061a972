"""PageRank, and neighbourhoods by edges and by similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import cut, cut_counted, forget


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(node, rank) after that many rounds, summing to 1; edges: src, dst, each pair once; what dead ends hold is spread over all nodes.

    Edges are read from a table sorted by source; a round is one join and one sum with map-side combining, so a hub's incoming ranks are
    added up before they are sent. What dead ends hold is summed up while a round's ranks are written.
    """
    e = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    e = cut(e.join(out, "src"), "src")
    nodes = cut(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(out.select(F.col("src").alias("node"), "n"), "node", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    dead = F.coalesce(F.sum(F.when(F.col("n").isNull(), F.col("rank"))), F.lit(0.0))
    ranks, seen = cut_counted(nodes.select("node", "n", F.lit(1.0 / n).alias("rank")), dead=dead)
    for _ in range(rounds):
        loose = seen["dead"]
        got = ranks.select(F.col("node").alias("src"), "rank").join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("n")).alias("in"))
        new, seen = cut_counted(nodes.join(got, "node", "left").select("node", "n", (F.lit((1 - damping) / n + damping * loose / n) + damping * F.coalesce("in", F.lit(0.0))).alias("rank")), dead=dead)
        forget(ranks)
        ranks = new
    return ranks.select("node", "rank")


def neighbourhood(triples: DataFrame, node: str, hops: int = 2, similar: DataFrame | None = None, budget: int = 60) -> DataFrame:
    """(s, p, o, score): the `budget` statements most related to a node: those within `hops` steps in either direction, nearer ones higher,
    and those of similar nodes (node), at 0.6. A statement has its best score; ties are decided by its text."""
    spark = triples.sparkSession
    front = spark.createDataFrame([(node,)], "node string")
    seen, found = front, None
    for depth in range(hops + 1):
        touched = triples.join(front.select(F.col("node").alias("s")), "s", "left_semi").select("s", "p", "o").unionByName(triples.join(front.select(F.col("node").alias("o")), "o", "left_semi").select("s", "p", "o")).distinct()
        touched = cut(touched.withColumn("score", F.lit(0.5 + 0.5 / (1 + depth))))
        found = touched if found is None else found.unionByName(touched)
        ends = touched.select(F.explode(F.array("s", "o")).alias("node")).where(~F.col("node").startswith('"')).distinct()
        front = cut(ends.join(seen, "node", "left_anti"))
        seen = seen.unionByName(front)
    if similar is not None:
        near = triples.join(similar.select(F.col("node").alias("s")).distinct(), "s", "left_semi").select("s", "p", "o").withColumn("score", F.lit(0.6))
        found = found.unionByName(near)
    return found.groupBy("s", "p", "o").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "s", "p", "o").limit(budget)
