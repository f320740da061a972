"""Filling containers of fixed capacity with items, by bulk-synchronous best fit."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..runtime import cut, cut_counted, forget, ship

#: Parts in which the items of one size are ranked, so that a size shared by a third of all items isn't ranked in one task.
BUCKETS = 256
SLICES = 4096
ITEM, GAP, MOVE = 0, 1, 2
STATE = "kind int, value int, first long, n long, container long, per int"


def match(items: Iterable[tuple[int, int, int]], gaps: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int | None, int | None]]:
    """A slice's sweep: its items (size, first rank, number) and gaps (gap, first container, number), as rows of STATE after it.

    From the largest size down, every run of equal items goes to its successor among the gaps, the smallest that holds one, as many into a
    container as it holds; of equal items those of lower rank go first. A gap that was taken from is a smaller one from then on.
    """
    out: list[tuple[int, int, int, int, int | None, int | None]] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []

    def add(gap: int, container: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                insort(order, gap)
            runs[gap].append((container, n))

    for gap, container, n in sorted(gaps):
        add(gap, container, n)
    for size, first, n in sorted(items, key=lambda x: (-x[0], x[1])):
        while n and (at := bisect_left(order, size)) < len(order):
            gap = order[at]
            container, free = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], order[at]
            per = min(gap // size, n)
            used = min(free, n // per)
            out.append((MOVE, size, first, used * per, container, per))
            first, n = first + used * per, n - used * per
            add(gap, container + used, free - used)
            add(gap - per * size, container, used)
        if n:
            out.append((ITEM, size, first, n, None, None))
    return out + [(GAP, gap, container, n, None, None) for gap, of in runs.items() for container, n in of]


def _sweep(key: tuple, t: pa.Table) -> pa.Table:
    rows = list(zip(*(t.column(c).to_pylist() for c in ("kind", "value", "first", "n")), strict=True))
    found = match([r[1:] for r in rows if r[0] == ITEM], [r[1:] for r in rows if r[0] == GAP])
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    names = ("kind", "value", "first", "n", "container", "per")
    return pa.table({name: pa.array([r[i] for r in found], kind) for i, (name, kind) in enumerate(zip(names, kinds, strict=True))})


def _sliced(state: DataFrame, slices: int, turn: int) -> DataFrame:
    """Every run cut into nearly equal parts, one a slice (fewer if it is shorter). What a part goes to turns with the value and the superstep, so
    that leftovers meet other gaps the next time."""
    if slices == 1:
        return state.withColumn("slice", F.lit(0))
    i = F.col("_i")
    lo, hi = F.floor(F.col("n") * i / slices).cast("long"), F.floor(F.col("n") * (i + 1) / slices).cast("long")
    parts = state.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))).withColumns({"_lo": lo, "_hi": hi}).where("_hi > _lo")
    return parts.select("kind", "value", (F.col("first") + F.col("_lo")).alias("first"), (F.col("_hi") - F.col("_lo")).alias("n"), "container", "per", F.pmod(i + F.col("value") + turn, F.lit(slices)).cast("int").alias("slice"))


def recipe(counts: DataFrame, capacity: int, per_slice: int = 1000, least_share: float = 0.02) -> DataFrame:
    """(size, first, n, container, per): items of that size and of rank first to first + n - 1 go into containers from `container` on, `per` into each.

    counts: size (1 to capacity), n. Items and gaps are held as runs of equal ones, however many these stand for. A superstep deals the runs
    to slices, of `per_slice` containers' room each but at most 4,096, and every slice's task sweeps its sorted items over its sorted gaps;
    what is left of both goes into the next superstep, dealt differently. Where one places less than `least_share` of the room still
    asked for, as many containers are opened as that would fill. The driver sees the room asked for, and nothing else.
    """
    spark = counts.sparkSession
    ship(spark)
    room = {"asked": F.coalesce(F.sum(F.when(F.col("kind") == ITEM, F.col("value") * F.col("n"))), F.lit(0))}
    none = [F.lit(None).cast(t).alias(c) for c, t in (("container", "long"), ("per", "int"))]
    state, seen = cut_counted(counts.select(F.lit(ITEM).alias("kind"), F.col("size").alias("value"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"), *none), **room)
    opened, open_more, turn = 0, True, 0
    tables = [state]
    while seen["asked"]:
        asked = seen["asked"]
        live = state.where(F.col("kind") != MOVE)
        if open_more:
            n = max(1, ceil(asked / capacity))
            live = live.unionByName(_one(spark, (GAP, capacity, opened, n, None, None)))
            opened += n
        slices = min(SLICES, max(1, ceil(asked / (capacity * per_slice))))
        state, seen = cut_counted(_sliced(live, slices, turn).groupBy("slice").applyInArrow(_sweep, STATE), **room)
        tables.append(state)
        open_more, turn = asked - seen["asked"] <= least_share * asked, turn + 1
    moves = tables[0].where(F.col("kind") == MOVE)
    for t in tables[1:]:
        moves = moves.unionByName(t.where(F.col("kind") == MOVE))
    done = cut(moves.select(F.col("value").alias("size"), "first", "n", "container", "per"))
    for t in tables:
        forget(t)
    return done


def _one(spark: SparkSession, row: tuple) -> DataFrame:
    kinds = [f.split() for f in STATE.split(", ")]
    return spark.range(1).select(*(F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, kinds, strict=True)))


def pack(items: DataFrame, id_column: str, size: str, capacity: int) -> DataFrame:
    """(id, part, container, size): where each item goes. Containers never hold more than `capacity`, which must be from 1 to 65,536.

    An item larger than the capacity is cut into full parts and a rest, numbered from 0; all others have part 0. Items of size 0, less or
    null take no room: one row with container null and size 0. An id occurring twice is two items. Which of several equal items goes where is decided by id.

    Ranks within a size are taken in 256 buckets by a hash of the id, and the rows of the recipe are cut at the buckets' ends, so an item meets
    only those of its bucket.
    """
    if not 1 <= capacity <= 65_536:
        raise ValueError(f"capacity must be from 1 to 65,536, not {capacity}")
    n = F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))
    rows = items.select(F.col(id_column).alias("id"), F.greatest(n, F.lit(0).cast("long")).alias("n"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))))
    rows = cut(rows.select("id", "n", parts.alias("part")).select("id", F.col("part").cast("int").alias("part"), F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).cast("int").alias("size"), F.pmod(F.xxhash64("id", "part"), F.lit(BUCKETS)).cast("int").alias("bucket")))
    per = cut(rows.where("size > 0").groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("k")))
    plan = recipe(per.groupBy("size").agg(F.sum("k").alias("n")), capacity)
    before = per.select("size", "bucket", "k", F.coalesce(F.sum("k").over(W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    meets = (F.col("first") < F.col("before") + F.col("k")) & (F.col("before") < F.col("first") + F.col("n"))
    plan = before.join(plan, "size").where(meets).select("size", "bucket", "before", "first", "n", "container", "per")
    ranked = rows.where("size > 0").withColumn("r", F.row_number().over(W.partitionBy("size", "bucket").orderBy("id", "part")) - 1)
    r = F.col("before") + F.col("r")
    placed = ranked.join(plan, ["size", "bucket"]).where((r >= F.col("first")) & (r < F.col("first") + F.col("n")))
    placed = placed.select("id", "part", (F.col("container") + F.floor((r - F.col("first")) / F.col("per"))).alias("container"), "size")
    none = rows.where("size = 0").select("id", "part", F.lit(None).cast("long").alias("container"), "size")
    return placed.unionByName(none).withColumnRenamed("id", id_column)
