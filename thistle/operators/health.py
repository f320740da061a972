"""What state a graph and its indexes are in."""

from __future__ import annotations

import math
import time
from collections import deque

from pyspark.sql import DataFrame, functions as F


def predicate_statistics(triples: DataFrame) -> DataFrame:
    """(p, n, subjects, objects): numbers of statements, different subjects and different objects (the latter two within 5 %)."""
    return triples.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("s").alias("subjects"), F.approx_count_distinct("o").alias("objects"))


def index_health(nodes: DataFrame, edges: DataFrame, m: int = 16) -> DataFrame:
    """One row: nodes in all and active, tombstone share, nodes by layer, neighbours on layer 0, edges across and down, status and reason.

    nodes: id, layer, deleted (null: not). edges: src, dst, layer. Over 0.30 tombstones or under 6 neighbours on average is a warning, over
    0.50 or under 2 is critical.
    """
    n = nodes.select("id", "layer", F.coalesce("deleted", F.lit(False)).alias("gone"))
    alive = n.where("not gone")
    a = n.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(~F.col("gone"), 1)).alias("active"), F.max(F.when(~F.col("gone"), F.col("layer"))).alias("top"), F.sum(F.when(~F.col("gone"), F.col("layer"))).alias("down")).first()
    by_top = {r["layer"]: r["k"] for r in alive.groupBy("layer").agg(F.count(F.lit(1)).alias("k")).collect()}
    layers = [sum(k for t, k in by_top.items() if t is not None and t >= at) for at in range((a["top"] if a["top"] is not None else -1) + 1)]
    per = alive.select(F.col("id").alias("src")).join(edges.where("layer = 0").groupBy("src").agg(F.count(F.lit(1)).alias("k")), "src", "left")
    k = F.coalesce("k", F.lit(0))
    p = per.agg(F.avg(k).alias("avg"), F.min(k).alias("min"), F.max(k).alias("max")).first()
    dead = 1 - a["active"] / a["total"] if a["total"] else 0.0
    few = lambda least: a["active"] > m and (p["avg"] or 0) < least
    status = "critical" if dead > 0.5 or few(2) else "warning" if dead > 0.3 or few(6) else "healthy"
    detail = "many tombstones: rebuild" if dead > 0.3 else "few neighbours: rebuild" if few(6) else ""
    row = (a["total"], a["active"], dead, a["top"], layers, p["avg"], p["min"], p["max"], edges.count(), a["down"] or 0, status, detail)
    schema = "total long, active long, tombstone_ratio double, max_layer int, layer_distribution array<long>, avg_neighbours double, min_neighbours long, max_neighbours long, horizontal_edges long, vertical_edges long, status string, detail string"
    return nodes.sparkSession.createDataFrame([row], schema)


def report(graph) -> dict:
    """Numbers of statements, predicates and found tables, the neighbour index if there is one, and the worst status of the parts."""
    t = graph.triples
    r = t.agg(F.count(F.lit(1)).alias("statements"), F.countDistinct("s").alias("subjects"), F.countDistinct("p").alias("predicates")).first().asDict()
    literal_predicates = t.where(F.col("p").startswith('"') | F.col("p").startswith("_:")).limit(1).count()
    out = {**r, "tables": len(graph.stars), "status": "critical" if literal_predicates else "healthy"}
    near = t.where(F.col("p") == graph.vocabulary + "hnswHorizontalNeighbor")
    if graph.vector_predicates() and not near.isEmpty():
        edges = near.select(F.col("s").alias("src"), F.col("o").alias("dst"), F.lit(0).alias("layer"))
        nodes = edges.select(F.col("src").alias("id")).distinct().withColumns({"layer": F.lit(0), "deleted": F.lit(False)})
        out["index"] = index_health(nodes, edges).first().asDict()
        if out["status"] == "healthy":
            out["status"] = out["index"]["status"]
    return out


def maintain(graph, tables: bool = True, most_dead: float = 0.3) -> dict:
    """One maintenance run over a Graph, as a batch job: its updates are written as one table, statistics are counted, tables are found anew, and the
    neighbour index of a vector predicate is rebuilt where vectors came or went since. Queries meanwhile see the old tables. What was done.
    """
    done: dict = {"updates": graph.updates}
    if graph.updates:
        graph.compact()
    graph.analyze()
    done["predicates"] = len(graph.rows_of)
    if tables:
        done["tables"] = len(graph.find_tables())
    near = graph.triples.where(F.col("p") == graph.vocabulary + "hnswHorizontalNeighbor").select(F.col("s").alias("node")).distinct()
    done["indexed"] = 0
    for predicate in graph.vector_predicates():
        held = graph.triples.where(F.col("p") == predicate).select(F.col("s").alias("node")).distinct()
        both = held.withColumn("a", F.lit(1)).join(near.withColumn("b", F.lit(1)), "node", "full")
        n = both.agg(F.count("a").alias("held"), F.count("b").alias("indexed"), F.count(F.when(F.col("a").isNull() | F.col("b").isNull(), 1)).alias("off")).first()
        if n["indexed"] and n["off"] > most_dead * n["indexed"] or n["held"] and n["indexed"] and n["off"]:
            graph.index_vectors(predicate)
            done["indexed"] += 1
    return done


class QueryMetrics:
    """The last queries' times and rows: nearest-rank percentiles, by shape if wanted, and how far estimates were off."""

    def __init__(self, keep: int = 1024):
        self.ring: deque = deque(maxlen=keep)

    def record(self, seconds: float, rows: int, shape: str = "", estimate: float | None = None) -> None:
        self.ring.append((seconds, rows, shape, estimate))

    def timed(self, df: DataFrame, shape: str = "", estimate: float | None = None) -> list:
        start = time.monotonic()
        rows = df.collect()
        self.record(time.monotonic() - start, len(rows), shape, estimate)
        return rows

    @staticmethod
    def rank(values: list[float], share: float) -> float | None:
        return sorted(values)[max(0, math.ceil(share * len(values)) - 1)] if values else None

    def summary(self, shape: str | None = None) -> dict:
        own = [x for x in self.ring if shape is None or x[2] == shape]
        off = [max(e / max(r, 1), max(r, 1) / max(e, 1e-9)) for _, r, _, e in own if e]
        times = [x[0] for x in own]
        return {"queries": len(own), **{f"p{int(100 * s)}": self.rank(times, s) for s in (0.5, 0.9, 0.99)}, "rows": sum(x[1] for x in own), "q_error_p50": self.rank(off, 0.5), "q_error_max": max(off, default=None)}
