"""Scores of vectors, exact searches, and neighbour graphs."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..runtime import cut, map_arrow, ship

METRICS = ("cosine", "euclidean", "dot")


def score(vec: Column, query: tuple[float, ...], metric: str = "cosine") -> Column:
    """cosine; the dot product; or minus the squared distance. Null for vectors of another length; a zero vector has cosine 0."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = vec.cast("array<double>")
    add = lambda a, x: a + x
    if metric == "euclidean":
        s = -F.aggregate(F.zip_with(v, q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), add)
    else:
        s = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), add)
        if metric == "cosine":
            norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
            mine = sqrt(sum(x * x for x in query))
            s = F.when((norm == 0) | F.lit(mine == 0), F.lit(0.0)).otherwise(s / (norm * F.lit(mine or 1.0)))
    return F.when(F.size(v) == len(query), s)


def _matrix(c: pa.Array, n: int) -> np.ndarray:
    return c.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, 1)
        for i in range(len(c)):
            if (own := x[near == i]).size:
                c[i] = own.mean(0)
        c = _unit(c)
    return c


def _bound(compare, keep: int):
    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        return compare(a, b, keep)

    return both


def knn_edges(
    vectors: DataFrame, m: int = 16, layer_of: Column | None = None, probes: int | None = None, per_cell: int = 200, sample: int = 20_000, block: int = 20_000
) -> DataFrame:
    """(src, dst, layer, similarity): for each node of each layer its m most similar (2 m on layer 0), by cosine.

    vectors: id, vec (one length, not null). Layers are drawn from a hash of the id, each holding a m-th of the one below; layer_of gives the
    highest layer of a node instead. A node is compared with all nodes of its layer, in blocks of `block` against `block`, so neighbours are
    exact and the work is quadratic. With `probes`, nodes are kept in cells of about `per_cell` around centroids fitted on at most `sample`
    vectors, and a node is compared with the nodes of the `probes` nearest cells only, unless that is all: fast, but without clusters most
    neighbours are lost where cells are many.
    """
    spark = vectors.sparkSession
    ship(spark)
    top = layer_of if layer_of is not None else F.floor(-F.log(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double") / 1_000_003 + 1e-9) / F.log(F.lit(float(max(m, 2))))).cast("int")
    v = cut(vectors.select("id", "vec", F.least(top, F.lit(12)).alias("top")))
    counts = {r["top"]: r["n"] for r in v.groupBy("top").agg(F.count(F.lit(1)).alias("n")).collect()}
    kind, vec = (v.schema[c].dataType.simpleString() for c in ("id", "vec"))
    out = None
    for layer in range(max(counts, default=-1) + 1):
        n = sum(k for t, k in counts.items() if t >= layer)
        part = v.where(F.col("top") >= layer).select("id", "vec")
        keep = 2 * m if layer == 0 else m
        cells = min(max(1, n // per_cell), 4096)
        if probes is None or probes >= cells or n <= per_cell * probes:
            blocks, pieces = -(-n // block), max(-(-n // block), min(4, -(-n // 1000)))
            own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
            mine = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(pieces)).cast("int")
            each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
            entries = part.select("id", "vec", own.alias("cell"), each(pieces).alias("piece"))
            asking = part.select("id", "vec", each(blocks).alias("cell"), mine.alias("piece"))
        else:
            fit = part.orderBy(F.xxhash64("id")).limit(sample).select("vec").toPandas()
            books = spark.sparkContext.broadcast(_centroids(_unit(np.array(fit["vec"].tolist(), np.float64)), cells))

            def place(batches: Iterator[pa.RecordBatch], count: int, books=books) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        s = _unit(_matrix(b.column(1), b.num_rows)) @ books.value.T
                        k = min(count, s.shape[1])
                        near = np.argsort(-s, axis=1, kind="stable")[:, :k]
                        at = np.repeat(np.arange(b.num_rows), k)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(near.ravel().astype(np.int32))], names=["id", "vec", "cell"])

            schema = f"id {kind}, vec {vec}, cell int"
            entries = map_arrow(part, lambda b, p=place: p(b, 1), schema).withColumn("piece", F.lit(0))
            asking = map_arrow(part, lambda b, p=place: p(b, probes), schema).withColumn("piece", F.lit(0))

        def compare(a: pa.Table, b: pa.Table, keep: int) -> pa.Table:
            a_ids, b_ids = (t.column("id").combine_chunks() for t in (a, b))
            src, dst, sim = [], [], []
            if len(a_ids) and len(b_ids):
                order = np.argsort(np.array(b_ids.to_pylist()), kind="stable")
                e, b_ids = _unit(_matrix(b.column("vec").combine_chunks(), len(b_ids)))[order], b_ids.take(pa.array(order))
                step = max(1, 4_000_000 // len(e))
                for lo in range(0, len(a_ids), step):
                    part = a.slice(lo, step)
                    s = _unit(_matrix(part.column("vec").combine_chunks(), part.num_rows)) @ e.T
                    # the node itself may be among them; of equally similar ones the smaller ids
                    least = np.partition(s, -(keep + 1), axis=1)[:, -(keep + 1), None] if s.shape[1] > keep + 1 else -np.inf
                    i, j = np.nonzero(s >= least)
                    order = np.lexsort((j, -s[i, j], i))
                    i, j = i[order], j[order]
                    fine = np.arange(len(i)) - np.searchsorted(i, i) <= keep
                    i, j = i[fine], j[fine]
                    src.append(a_ids.take(pa.array(lo + i))), dst.append(b_ids.take(pa.array(j))), sim.append(s[i, j])
            t = a.schema.field("id").type
            out = pa.table({"src": pa.chunked_array(src, t), "dst": pa.chunked_array(dst, t), "similarity": pa.chunked_array([pa.array(x) for x in sim], pa.float64())})
            return out.filter(pc.not_equal(out["src"], out["dst"]))

        near = asking.groupBy("cell", "piece").cogroup(entries.groupBy("cell", "piece")).applyInArrow(_bound(compare, keep), f"src {kind}, dst {kind}, similarity double")
        w = W.partitionBy("src").orderBy(F.desc("similarity"), "dst")
        near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep).select("src", "dst", F.lit(layer).alias("layer"), "similarity")
        out = near if out is None else out.unionByName(near)
    return out if out is not None else spark.createDataFrame([], f"src {vectors.schema['id'].dataType.simpleString()}, dst {vectors.schema['id'].dataType.simpleString()}, layer int, similarity double")
