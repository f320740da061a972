"""Tables found in schemaless statements: nodes that share properties, and chains that share steps."""

from __future__ import annotations

import struct
from array import array
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache
from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import cut

#: What makes a group of nodes a table.
SIMILAR, LEAST_NODES, LEAST_CORE, CORE, COLUMN = 0.80, 10, 5, 0.50, 0.33
FAN_IN, DEEP_PATHS = 3.0, 2
#: Keys that a signature is looked for under, of each size of tables; the tables found don't depend on it.
MOST_KEYS = 100


@dataclass
class Found:
    """columns: (property, coverage), widest first. cliff: mean coverage of core over tail properties."""

    number: int
    nodes: int
    core: list[str]
    columns: list[tuple[str, float]]
    tail: list[tuple[str, float]]
    cliff: float


def signatures(triples: DataFrame) -> DataFrame:
    """(node, sig): each node's sorted properties, a predicate and > where it is the subject, < where it is the object."""
    a = triples.select(F.col("s").alias("node"), F.concat(F.lit(">"), "p").alias("prop"))
    b = triples.select(F.col("o").alias("node"), F.concat(F.lit("<"), "p").alias("prop"))
    # distinct first, so that a hub's statements are reduced before they meet
    return a.unionByName(b).distinct().groupBy("node").agg(F.array_sort(F.collect_list("prop")).alias("sig"))


class Signatures:
    """Different signatures with their numbers of nodes, held as numbers of properties in flat arrays."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self.flat, self.ends, self.nodes = array("i"), array("q", [0]), array("q")

    def add(self, props: Iterable[str], nodes: int) -> None:
        self.flat.extend(self.names.setdefault(p, len(self.names)) for p in props)
        self.ends.append(len(self.flat))
        self.nodes.append(nodes)

    def __len__(self) -> int:
        return len(self.nodes)

    def __getitem__(self, i: int) -> array:
        return self.flat[self.ends[i] : self.ends[i + 1]]

    def order(self) -> list[int]:
        """Most nodes first, then by signature."""
        names = list(self.names)
        at = array("I", [0]) * len(names)
        for k, i in enumerate(sorted(range(len(names)), key=names.__getitem__)):
            at[i] = k
        return sorted(range(len(self)), key=lambda i: struct.pack(f">Q{self.ends[i + 1] - self.ends[i]}I", (1 << 63) - self.nodes[i], *(at[p] for p in self[i])))


def _shared(a: int, b: int, similar: float) -> int:
    """Properties that sets of a and b need in common; 0: they can't be similar."""
    least = max(1, int((a + b) * similar / (1 + similar)) - 1)
    return next((n for n in range(least, min(a, b) + 1) if n / (a + b - n) >= similar), 0)


def gather(sigs: Signatures, similar: float) -> array:
    """The number of the table that each signature goes to: the first that takes it, numbered in order of their founders.

    Of two sets that need n properties in common, one has at most `size - n` others; so the k first of those in common (rarest first) are among
    the first k + size - n of either set. A table is kept under each choice of k among these, with its size, and a signature looks under its own.
    k is as large as MOST_KEYS choices allow: single properties are too frequent where a few dozens make up all signatures.
    """
    held = Counter(sigs.flat)
    rank = array("i", [0]) * len(sigs.names)
    for r, (p, _) in enumerate(sorted(held.items(), key=lambda x: (x[1], x[0]))):
        rank[p] = r
    out = array("i", [0]) * len(sigs)
    sizes, founders, masks = array("i"), array("q"), array("Q")
    grown: dict[int, set[int]] = {}
    apart = (1 - similar) / (1 + similar) + 1e-9
    slots = 1 << max(10, (16 * len(sigs)).bit_length())
    # chains of the tables under each key; of keys that fall together all are looked at
    heads, tables, before = array("i", [-1]) * slots, array("i"), array("i")

    @cache
    def key(b: int) -> tuple[int, int]:
        """For tables of b properties: k, and how many of the rarest it is chosen from."""
        near = [(a, n) for a in range(1, int(b / similar) + 2) if (n := _shared(a, b, similar))]
        least, most = min(n for _, n in near), max(a - n for a, n in near)
        k = 1
        while k < least and comb(k + 1 + most, most) <= MOST_KEYS:
            k += 1
        return k, k + b - least

    @cache
    def searches(a: int) -> list[tuple[int, int, int]]:
        """For signatures of a properties: sizes of tables, k, and how many of the rarest it is chosen from."""
        return [(b, key(b)[0], key(b)[0] + a - n) for b in range(1, int(a / similar) + 2) if (n := _shared(a, b, similar))]

    def keep(t: int, ids: list[int]) -> None:
        b = len(ids)
        k, first = key(b)
        for c in combinations(ids[:first], k):
            h = hash((b, c)) & (slots - 1)
            tables.append(t)
            before.append(heads[h])
            heads[h] = len(tables) - 1

    for i in sigs.order():
        ids = sorted([rank[p] for p in sigs[i]])
        own, a, mask = set(ids), len(ids), 0
        for r in ids:
            mask |= 1 << (len(rank) - 1 - r) % 64
        near = set()
        for b, k, first in searches(a):
            for c in combinations(ids[:first], k):
                e = heads[hash((b, c)) & (slots - 1)]
                while e >= 0:
                    near.add(tables[e])
                    e = before[e]
        # each bit that is set in one mask only is a property in one set only
        for t in sorted([t for t in near if (masks[t] ^ mask).bit_count() <= (a + sizes[t]) * apart]):
            b, props = sizes[t], grown[t] if t in grown else {rank[p] for p in sigs[founders[t]]}
            both = len(own & props)
            if both / (a + b - both) >= similar:
                out[i] = t
                if both < a:
                    grown[t] = own | props
                    sizes[t], masks[t] = len(grown[t]), masks[t] | mask
                    keep(t, sorted(grown[t]))
                break
        else:
            out[i] = len(sizes)
            sizes.append(a)
            founders.append(i)
            masks.append(mask)
            keep(out[i], ids)
    return out


def merge(groups: Iterable[tuple[tuple[str, ...], int]], similar: float = SIMILAR) -> list[tuple[set[str], list[int]]]:
    """Groups of equal signatures, largest first (then by signature), each taking up all later ones whose Jaccard similarity with what it has
    become is enough. (properties, numbers of the groups taken)

    A group goes to the first of those before it that takes it, which is the same, as what these have become depends on earlier groups only.
    """
    sigs = Signatures()
    for props, nodes in groups:
        sigs.add(props, nodes)
    to, names = gather(sigs, similar), list(sigs.names)
    out: list[tuple[set[str], list[int]]] = [(set(), []) for _ in range(max(to, default=-1) + 1)]
    for i in sigs.order():
        out[to[i]][0].update(names[p] for p in sigs[i])
        out[to[i]][1].append(i)
    return out


def discover(triples: DataFrame) -> tuple[list[Found], DataFrame]:
    """Tables of nodes, and (node, number) of the nodes in them.

    Only the different signatures reach the driver, with their numbers of nodes, each property as one number; nothing else is held there.
    """
    spark = triples.sparkSession
    sig = cut(signatures(triples))
    counts = cut(sig.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()))
    sigs, keys = Signatures(), array("q")
    for r in counts.toLocalIterator(prefetchPartitions=True):
        sigs.add(r["sig"], r["n"])
        keys.append(r["id"])
    to, names = gather(sigs, SIMILAR), list(sigs.names)
    nodes = array("q", [0]) * (max(to, default=-1) + 1)
    for i, t in enumerate(to):
        nodes[t] += sigs.nodes[i]
    taken: dict[int, list[int]] = {t: [] for t, n in enumerate(nodes) if n >= LEAST_NODES}
    for i, t in enumerate(to):
        if t in taken:
            taken[t].append(i)
    found, ids, numbers = [], array("q"), array("i")
    for t, members in taken.items():
        held: Counter[int] = Counter()
        for i in members:
            for p in sigs[i]:
                held[p] += sigs.nodes[i]
        cover = sorted(((names[p], n / nodes[t]) for p, n in held.items()), key=lambda x: (-x[1], x[0]))
        core = [(p, c) for p, c in cover if c >= CORE]
        if len(core) < LEAST_CORE:
            continue
        tail = [(p, c) for p, c in cover if c < COLUMN]
        rest = sum(c for _, c in tail) / len(tail) if tail else 0.01
        found.append(Found(len(found), nodes[t], [p for p, _ in core], [(p, c) for p, c in cover if c >= COLUMN], tail, sum(c for _, c in core) / len(core) / max(rest, 0.01)))
        ids.extend(keys[i] for i in members)
        numbers.extend([found[-1].number] * len(members))
    of = spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "number": pa.array(numbers, pa.int32())}))
    return found, sig.join(counts.join(of, "id").select("sig", "number"), "sig").select("node", "number")


def build(triples: DataFrame, members: DataFrame, table: Found) -> DataFrame:
    """The table's rows: node, and of each column the smallest of its values; a column named by its property's last part (with _of behind it
    where the node is the object)."""
    names: dict[str, str] = {}
    for p, _ in table.columns:
        n = p[1:].rstrip("/").replace("#", "/").rsplit("/", 1)[-1] + ("_of" if p[0] == "<" else "")
        while n in names.values() or n == "node":
            n += "_"
        names[p] = n
    mine = members.where(F.col("number") == table.number).select("node")
    a = triples.select(F.col("s").alias("node"), F.concat(F.lit(">"), "p").alias("prop"), F.col("o").alias("v"))
    b = triples.select(F.col("o").alias("node"), F.concat(F.lit("<"), "p").alias("prop"), F.col("s").alias("v"))
    cells = a.unionByName(b).where(F.col("prop").isin(*names)).join(mine, "node")
    return cells.groupBy("node").pivot("prop", list(names)).agg(F.min("v")).withColumnsRenamed(names)


def whole(triples: DataFrame, members: DataFrame) -> dict[str, int]:
    """Predicates all of whose subjects are in one table, with its number: no other predicate's column can be exact. One job for all tables."""
    t = triples.select(F.col("s").alias("node"), "p").join(members, "node", "left")
    per = t.groupBy("p").agg(F.min("number").alias("a"), F.max("number").alias("b"), F.count(F.lit(1)).alias("n"), F.count("number").alias("held"))
    return {r["p"]: r["a"] for r in per.where("a = b and n = held").select("p", "a").toLocalIterator()}


def exact(triples: DataFrame, rows: DataFrame, table: Found) -> dict[str, bool]:
    """Which columns hold all of their predicate's statements, so that they may stand for them."""
    out = {}
    filled = rows.agg(*(F.count(c).alias(c) for c in rows.columns if c != "node")).first().asDict()
    totals = {r["p"]: r["n"] for r in triples.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("p").isin(*[p[1:] for p, _ in table.columns])).collect()}
    for (p, _), c in zip(table.columns, (c for c in rows.columns if c != "node"), strict=True):
        out[c] = totals.get(p[1:], 0) == filled[c]
    return out


def chains(triples: DataFrame) -> DataFrame:
    """(root, path): the different two-step paths that lead from each node."""
    a = triples.select(F.col("s").alias("root"), F.col("p").alias("p1"), F.col("o").alias("mid"))
    steps = triples.select(F.col("s").alias("mid"), F.col("p").alias("p2")).distinct()
    return a.distinct().join(steps, "mid").select("root", F.concat("p1", F.lit(" "), "p2").alias("path")).distinct()


def deep(triples: DataFrame, depth: int = 2, fan_in: float = FAN_IN) -> DataFrame:
    """(path, roots, coverage, fan_in): two-step paths shared by at least half of the nodes of one path signature, in groups of at least
    10 depth^2 nodes with two paths or more, where the middle nodes serve at most `fan_in` roots on average."""
    paths = cut(chains(triples))
    sig = paths.groupBy("root").agg(F.array_sort(F.collect_list("path")).alias("sig")).where(F.size("sig") >= DEEP_PATHS)
    group = sig.groupBy("sig").agg(F.count(F.lit(1)).alias("group")).where(F.col("group") >= LEAST_NODES * depth * depth)
    kept = sig.join(group, "sig").select("root", F.explode("sig").alias("path"))
    total = kept.select("root").distinct().count()
    per = kept.groupBy("path").agg(F.countDistinct("root").alias("roots")).withColumn("coverage", F.col("roots") / F.lit(max(total, 1))).where(F.col("coverage") >= CORE)
    mids = triples.select(F.col("s").alias("root"), "p", F.col("o").alias("mid")).join(kept.select("root").distinct(), "root", "left_semi").groupBy("p", "mid").agg(F.countDistinct("root").alias("n"))
    fan = mids.groupBy("p").agg(F.avg("n").alias("fan_in"))
    return per.join(fan, F.substring_index("path", " ", 1) == F.col("p")).drop("p").where(F.col("fan_in") <= fan_in)


def coverage(triples: DataFrame, type_predicate: str) -> DataFrame:
    """(cls, p, nodes, coverage): of the nodes of each class the share that has each predicate."""
    types = triples.where(F.col("p") == type_predicate).select(F.col("s").alias("node"), F.col("o").alias("cls")).distinct()
    sizes = types.groupBy("cls").agg(F.count(F.lit(1)).alias("size"))
    have = triples.select(F.col("s").alias("node"), "p").distinct()
    n = types.join(have, "node").groupBy("cls", "p").agg(F.count(F.lit(1)).alias("nodes"))
    return n.join(sizes, "cls").select("cls", "p", "nodes", (F.col("nodes") / F.col("size")).alias("coverage"))
