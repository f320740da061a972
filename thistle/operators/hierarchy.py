"""Parent-child links to full hierarchies, by pointer doubling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..runtime import cut, cut_counted, forget


@dataclass
class Hierarchy:
    """reached: (hier, node, target, node_depth[, path]). cyclic: (hier, node), the nodes from which edges lead back to themselves."""

    reached: DataFrame
    cyclic: DataFrame


def double_pointers(edges: DataFrame, nodes: DataFrame, targets: str = "roots", paths: bool = False, loops: bool = True) -> Hierarchy:
    """As _double(), on numbers in place of names, which are long and would be shuffled in every round: the nodes are numbered in a written table, and
    names put back at the end. With paths, whose order is that of the names, these are kept. Nulls are no nodes."""
    if paths:
        return _double(edges, nodes, targets, paths, loops)
    edges = edges.where("child is not null and parent is not null").select("hier", "child", "parent")
    every = edges.select("hier", F.explode(F.array("child", "parent")).alias("node")).unionByName(nodes.where("node is not null").select("hier", "node")).distinct()
    names = cut(every.withColumn("id", F.monotonically_increasing_id()))
    side = lambda c, k: names.select("hier", F.col("node").alias(c), F.col("id").alias(k))
    one = F.lit(0).cast("tinyint").alias("hier")
    numbered = edges.distinct().join(side("child", "a"), ["hier", "child"]).join(side("parent", "b"), ["hier", "parent"]).select(one, F.col("a").alias("child"), F.col("b").alias("parent"))
    asked = names.join(nodes.select("hier", "node").distinct(), ["hier", "node"], "left_semi").select(one, F.col("id").alias("node"))
    h = _double(numbered, asked, targets, False, loops)
    by = names.select("hier", F.col("node").alias("name"), F.col("id").alias("node"))
    reached = h.reached.drop("hier").join(by, "node").select("hier", F.col("name").alias("node"), "target", "node_depth")
    reached = reached.join(names.select(F.col("id").alias("target"), F.col("node").alias("name")), "target").select("hier", "node", F.col("name").alias("target"), "node_depth")
    return Hierarchy(reached, h.cyclic.select("node").join(by, "node").select("hier", F.col("name").alias("node")))


def _double(edges: DataFrame, nodes: DataFrame, targets: str, paths: bool, loops: bool) -> Hierarchy:
    """All targets each node reaches upwards, with the fewest edges, and all nodes that lie on loops.

    edges: hier, child, parent (repeats and nulls allowed, they count once or not at all). nodes: hier, node. targets: "roots" (nodes
    without an edge to a parent; each reaches itself at 0) or "all" (every ancestor). paths: also the shortest path from node to target as
    an array, the smallest of several in order of its names. loops: whether to look for the nodes on loops.

    After round k a jump joins a node with each ancestor exactly 2^k edges up, and `reached` holds every target less than 2^k edges up.
    One join of the jumps with jumps and reached targets doubles both. A round that reaches nothing new shows that nothing is farther: on a
    shortest way of 2^(k+1) edges or more lies a node whose shortest way to the same target has from 2^k to less. So the number of rounds is
    logarithmic in the depth. Nodes on loops begin and end jumps of any length, so they are looked for among those that still do. Empty
    edges give each node as its own root.
    """
    spark = edges.sparkSession
    e = edges.where("child is not null and parent is not null").select("hier", "child", "parent").distinct()
    n = nodes.where("node is not null").select("hier", "node").distinct()
    e = cut(e)
    start = n if targets == "all" else n.join(e.select("hier", F.col("child").alias("node")).distinct(), ["hier", "node"], "left_anti")
    way = lambda *c: [F.array(*c).alias("path")] if paths else []
    sizes = {"reached": F.count_if(~F.col("jump")), "jumps": F.count_if(F.col("jump"))}
    state, seen = cut_counted(
        start.select("hier", "node", F.col("node").alias("target"), F.lit(0).alias("d"), F.lit(False).alias("jump"), *way("node")).unionByName(
            e.select("hier", F.col("child").alias("node"), F.col("parent").alias("target"), F.lit(1).alias("d"), F.lit(True).alias("jump"), *way("child", "parent"))
        ),
        **sizes,
    )
    step = 1
    while seen["jumps"]:
        left = state.where("jump").select("hier", F.col("node").alias("from"), F.col("target").alias("node"), *([F.col("path").alias("head")] if paths else []))
        joined = left.join(state, ["hier", "node"]).select(
            "hier", F.col("from").alias("node"), "target", (F.col("d") + step).alias("d"), "jump",
            *([F.concat("head", F.slice("path", F.lit(2), F.size("path"))).alias("path")] if paths else []),
        )
        every = joined.unionByName(state.where("not jump"))
        if paths:
            best = every.groupBy("hier", "node", "target", "jump").agg(F.min(F.struct("d", "path")).alias("b")).select("hier", "node", "target", F.col("b.d").alias("d"), "jump", F.col("b.path").alias("path"))
        else:
            best = every.groupBy("hier", "node", "target", "jump").agg(F.min("d").alias("d")).select("hier", "node", "target", "d", "jump")
        old, before = state, seen
        state, seen = cut_counted(best, **sizes)
        forget(old)
        step *= 2
        if seen["reached"] == before["reached"]:
            break
    result = state.where("not jump").select("hier", "node", "target", F.col("d").alias("node_depth"), *(["path"] if paths else []))
    if not seen["jumps"] or not loops:
        return Hierarchy(result, spark.createDataFrame([], n.schema))
    return Hierarchy(result, _on_loops(e, state.where("jump")))


def _settled(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of nodes with one link each: (hier, node, end), the first node without a link that theirs lead to, and (hier, node) of those that never
    come to one. links: hier, node, to. Pointers are doubled until the open ones no longer get fewer."""
    still = {"n": F.count_if(F.col("open"))}
    state, seen = cut_counted(links.join(links.select("hier", F.col("node").alias("to"), F.lit(True).alias("open")), ["hier", "to"], "left").select("hier", "node", "to", F.coalesce("open", F.lit(False)).alias("open")), **still)
    left = -1
    while seen["n"] not in (0, left):
        left = seen["n"]
        ahead = state.select("hier", F.col("node").alias("to"), F.col("to").alias("further"), F.col("open").alias("still"))
        moved = state.join(ahead, ["hier", "to"], "left")
        old = state
        state, seen = cut_counted(moved.select("hier", "node", F.when(F.col("open"), F.col("further")).otherwise(F.col("to")).alias("to"), (F.col("open") & F.coalesce("still", F.lit(False))).alias("open")), **still)
        forget(old)
    return state.where("not open").select("hier", "node", F.col("to").alias("end")), state.where("open").select("hier", "node")


def _on_loops(e: DataFrame, jumps: DataFrame) -> DataFrame:
    """Nodes on loops, among those that both begin and end a jump of the last round.

    Nodes with one edge in and one out only pass a way on. Runs of them are found by doubling: those without an end are loops, all others
    become one edge. Only the rest, the nodes where ways meet or part, is closed.
    """
    core = cut(jumps.select("hier", "node").distinct().join(jumps.select("hier", F.col("target").alias("node")).distinct(), ["hier", "node"], "left_semi"))
    inner = e.join(core.select("hier", F.col("node").alias("child")), ["hier", "child"], "left_semi").join(core.select("hier", F.col("node").alias("parent")), ["hier", "parent"], "left_semi")
    inner = cut(inner.select("hier", F.col("child").alias("a"), F.col("parent").alias("b")))
    own = inner.where("a = b").select("hier", F.col("a").alias("node"))
    inner = inner.where("a <> b")
    one = lambda side, other, name: inner.groupBy("hier", F.col(side).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min(other).alias(name)).where("n = 1").drop("n")
    passing = cut(one("a", "b", "up").join(one("b", "a", "down"), ["hier", "node"]))
    ends, rings = _settled(passing.select("hier", "node", F.col("up").alias("to")))
    starts, _ = _settled(passing.select("hier", "node", F.col("down").alias("to")))
    meet = inner.join(passing.select("hier", F.col("node").alias("a")), ["hier", "a"], "left_anti")
    short = meet.join(ends.select("hier", F.col("node").alias("b"), "end"), ["hier", "b"], "left").select("hier", "a", F.coalesce("end", "b").alias("b"))
    short = short.join(rings.select("hier", F.col("node").alias("b")), ["hier", "b"], "left_anti")
    close, seen = cut_counted(short.select("hier", "a", "b").distinct(), n=F.count(F.lit(1)))
    size = 0
    while seen["n"] != size:
        size = seen["n"]
        twice = close.select("hier", "a", F.col("b").alias("m")).join(close.select("hier", F.col("a").alias("m"), "b"), ["hier", "m"]).select("hier", "a", "b")
        old = close
        close, seen = cut_counted(close.unionByName(twice).distinct(), n=F.count(F.lit(1)))
        forget(old)
    runs = starts.withColumnRenamed("end", "b").join(ends.withColumnRenamed("end", "a"), ["hier", "node"])
    on_run = runs.where("a = b").select("hier", "node").unionByName(runs.join(close, ["hier", "a", "b"]).select("hier", "node"))
    return close.where("a = b").select("hier", F.col("a").alias("node")).unionByName(on_run).unionByName(rings).unionByName(own).distinct()
