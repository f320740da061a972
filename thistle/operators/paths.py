"""Reachability along edges: closures, searches with an exit, and walks led by similarity."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from itertools import count

from pyspark.sql import DataFrame, Window as W, functions as F

from ..runtime import cut, cut_counted, forget
from .hierarchy import double_pointers


#: Edges that one round of a search from given starts goes on.
HOPS = 4


def _rounds(depth: int | None) -> Iterable[int]:
    return count(1) if depth is None else range(1, depth + 1)


def closure(edges: DataFrame, seeds: DataFrame | None = None, depth: int | None = None, stop: DataFrame | None = None) -> DataFrame:
    """(src, dst): each node reachable from each start over one or more edges, once; the start itself only if it lies on a loop.

    edges: src, dst. seeds: src, the starts (all sources where None). stop: node, where a walk ends: then only nodes of stop are given, and
    nothing behind them is searched. Nulls are no nodes.

    From all sources pointers are doubled, in a number of rounds logarithmic in the longest way. From given starts, or with an exit, rounds
    go outward, all starts at once and HOPS edges a round, until nothing new is reached, or after `depth` edges where given, of which a
    warning tells.
    """
    e = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    if seeds is None and stop is None:
        one = F.lit("").alias("hier")
        every = double_pointers(e.select(one, F.col("src").alias("child"), F.col("dst").alias("parent")), e.select(one, F.explode(F.array("src", "dst")).alias("node")), targets="all", loops=False)
        pairs = cut(every.reached.select(F.col("node").alias("src"), F.col("target").alias("dst"), "node_depth"))
        # a start reaches itself over an edge to a node that leads back to it
        loops = e.join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi").select("src", F.col("src").alias("dst")).distinct()
        return pairs.where("node_depth > 0").select("src", "dst").unionByName(loops)
    ends = None if stop is None else stop.select(F.col("node").alias("dst"))
    front = e if seeds is None else e.join(seeds.where("src is not null").select("src").distinct(), "src", "left_semi")
    front = cut(front)
    reached, made, gone = [front], [front], 1
    every = front
    while depth is None or gone < depth:
        hops = HOPS if depth is None else min(HOPS, depth - gone)
        step, ahead = front, None
        for _ in range(hops):
            onward = step if ends is None else step.join(ends, "dst", "left_anti")
            step = onward.select(F.col("src").alias("start"), F.col("dst").alias("src")).join(e, "src").select(F.col("start").alias("src"), "dst").distinct()
            ahead = step if ahead is None else ahead.unionByName(step)
        new, seen = cut_counted(ahead.distinct().join(every, ["src", "dst"], "left_anti"), n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        gone += hops
        reached.append(new)
        made.append(new)
        front = new
        every = every.unionByName(new)
        if len(reached) == 10:
            every = cut(every)
            for t in made:
                if t is not front:
                    forget(t)
            reached, made = [every], [every, front]
    else:
        warnings.warn(f"paths longer than {depth} edges were not followed", stacklevel=2)
    return every if ends is None else every.join(ends, "dst", "left_semi").select("src", "dst")


def greedy(edges: DataFrame, similarity: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(src, dst): where each start ends that goes on to its most similar neighbour while that is more similar than where it is.

    similarity: node, score. Starts without a score give nothing. Of equally similar neighbours the first by text is taken.
    """
    scored = edges.select("src", "dst").distinct().join(similarity.select(F.col("node").alias("dst"), "score"), "dst")
    best = cut(scored.groupBy("src").agg(F.max_by("dst", F.struct("score")).alias("d0"), F.max("score").alias("to")).join(scored, "src").where("score = to").groupBy("src").agg(F.min("dst").alias("next"), F.first("to").alias("to")))
    at = cut(seeds.select("src").distinct().join(similarity.select(F.col("node").alias("src"), "score"), "src").select("src", F.col("src").alias("dst"), "score"))
    for _ in _rounds(depth):
        moved = at.join(best.select(F.col("src").alias("dst"), "next", "to"), "dst", "left")
        go = F.coalesce(F.col("to") > F.col("score"), F.lit(False))
        new = cut(moved.select("src", F.when(go, F.col("next")).otherwise(F.col("dst")).alias("dst"), F.when(go, F.col("to")).otherwise(F.col("score")).alias("score"), go.alias("moved")))
        done = new.where("moved").isEmpty()
        forget(at)
        at = new.drop("moved")
        if done:
            break
    return at.select("src", "dst")


def beam(edges: DataFrame, similarity: DataFrame, seeds: DataFrame, width: int, depth: int | None = None) -> DataFrame:
    """(src, dst): of each start up to `width` nodes, the most similar that a best-first search of that width meets.

    In a round every start still searching expands its most similar node not yet expanded, unless the width is filled with better ones.
    Ties go to the smaller node by text. A node is met once; nodes without a score aren't met.
    """
    scores = cut(similarity.select("node", "score"))
    e = cut(edges.where("src <> dst").select(F.col("src").alias("node"), "dst").distinct().join(scores.select(F.col("node").alias("dst"), F.col("score").alias("to")), "dst"))
    state = cut(seeds.select("src").distinct().join(scores.select(F.col("node").alias("src"), "score"), "src").select("src", F.col("src").alias("node"), "score", F.lit(False).alias("spent"), F.lit(True).alias("kept")))
    order = W.partitionBy("src").orderBy(F.desc("score"), "node")
    for _ in _rounds(depth):
        turn = state.where("kept and not spent").withColumn("r", F.row_number().over(order)).where("r = 1").select("src", "node")
        turn = cut(turn)
        if turn.isEmpty():
            break
        met = turn.join(e, "node").select("src", F.col("dst").alias("node"), F.col("to").alias("score")).join(state.select("src", "node"), ["src", "node"], "left_anti")
        spent = state.join(turn.withColumn("now", F.lit(True)), ["src", "node"], "left").withColumn("spent", F.col("spent") | F.coalesce("now", F.lit(False))).drop("now")
        every = spent.unionByName(met.select("src", "node", "score", F.lit(False).alias("spent"), F.lit(True).alias("kept")))
        ranked = every.withColumn("r", F.row_number().over(W.partitionBy("src", "kept").orderBy(F.desc("score"), "node")))
        new = cut(ranked.withColumn("kept", F.col("kept") & (F.col("r") <= width)).drop("r"))
        forget(state)
        state = new
    return state.where("kept").select("src", F.col("node").alias("dst"))
