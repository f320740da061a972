"""Same or near-same records across splits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.terms import clean_iri, iri_of, is_blank, lexical, where_any, with_value, words
from ..runtime import cut, map_arrow

TRAIN, EVAL = "train", ("valid", "test")


def records(triples: DataFrame, predicates: DataFrame) -> DataFrame:
    """(stmt_id, train, kind, p, s, val, words): statements that can be in a pair. kind is exact or text; words are distinct, for text only."""
    declared = predicates.select(F.col("pred_iri").alias("p"), "value_type")
    ok = F.col("stmt_id").isNotNull() & F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull() & F.col("split_name").isin(TRAIN, *EVAL) & ~is_blank("s") & ~is_blank("o")
    t = triples.where(ok).select("stmt_id", (F.col("split_name") == TRAIN).alias("train"), clean_iri("s").alias("s"), clean_iri("p").alias("p"), "o")
    t = t.join(declared, "p")
    t = with_value(t, "value_type", "o", "val")
    kind = F.col("value_type")
    t = t.withColumn("val", F.coalesce("val", F.when(kind.isin("class", "entity", "external"), iri_of("o"))))
    t = t.withColumn("words", F.when(kind == "text", words(lexical("o"))))
    t = t.withColumn("words", F.when(F.size("words") > 0, F.array_distinct("words")))
    return where_any(t, "val", "words").select("stmt_id", "train", F.when(kind == "text", "text").otherwise("exact").alias("kind"), "p", "s", "val", "words")


def _needed(n: int, similarity: float) -> int:
    """Words that a set of n must share with any set similar enough."""
    return max(1, ceil(similarity * n - 1e-9))


#: Sets of this many words are matched by single words: they have too many combinations, and single rare words suffice.
LONG = 64


def _sizes(n: int, similarity: float, gram: int) -> set[int]:
    """How many words the combinations of a set of n have: for every size that a similar set may have, what both can be matched by."""

    def own(m: int) -> int:
        return 1 if m >= LONG else min(gram, _needed(m, similarity))

    if own(n) == 1:
        return {1}
    return {min(own(n), own(m)) for m in range(max(1, ceil(similarity * n - 1e-9)), int(n / similarity + 1e-9) + 1)}


def _grams(common: dict[int, int], similarity: float, gram: int):
    """Of each word set its skip-n-grams, hashed: its words stand in order of rarity, and an n-gram takes n of the rarest, whatever lies between.

    Two sets with Jaccard similarity of at least `similarity` share at least needed(n) words each, so that at least g of the shared
    ones are among the first n - needed(n) + g of either in any order common to both: they share a combination of g. Both take the g that
    fits the pair among their sizes, so no pair is lost.
    """
    sizes: dict[int, set[int]] = {}

    def signatures(hashes: np.ndarray) -> set[int]:
        n = len(hashes)
        if n not in sizes:
            sizes[n] = _sizes(n, similarity, gram)
        ranked = sorted((common.get(h, 0), h) for h in hashes.tolist())
        out: set[int] = set()
        for g in sizes[n]:
            first = sorted(h for _, h in ranked[: n - _needed(n, similarity) + g])
            out |= {hash((g, *c)) for c in combinations(first, g)}
        return out

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("hashes")
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            at, out = [], []
            for i in range(b.num_rows):
                sig = signatures(flat[offsets[i] : offsets[i + 1]])
                at += [i] * len(sig)
                out += sig
            rows = b.select(["h1", "h2", "train_too", "eval_too"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.int64())], names=["h1", "h2", "train_too", "eval_too", "sig"])

    return of


def near_classes(text: DataFrame, similarity: float = 0.7, gram: int | None = None, common_share: float = 0.0005) -> DataFrame:
    """Pairs of different word sets (eval side a, train side b) with a Jaccard similarity of at least `similarity`, and their containment.

    The hashes of the evaluation sets' n-grams are partitioned, the training sets' scanned for hits, and the containment of each evaluation set
    in each training set it hit is computed from the words. N-grams without skips would do, too (with s shared of n + m words at least
    s - 1 - (n + m - 2 s) bigrams are shared), but most of those are of words that all texts of a kind have: they hit far too often.

    text: h1, h2 (the class, of predicate and word set), ph (hash of the predicate), hashes (sorted word hashes), train_too, eval_too; one
    row per class. Words in at least common_share of all classes are ranked by their number; all rarer words come first, in hash order. As
    sets have a bounded mean size, at most size/common_share words are that common: that table may be broadcast.
    gram: None takes the fewest words that keep chance hits below one a combination, by the sizes and the vocabulary; any number gives the
    same pairs.
    """
    spark = text.sparkSession
    total = text.count()
    if not total:
        return text.select(*(F.col(c).alias(c + s) for s in ("_a", "_b") for c in ("h1", "h2")), F.lit(0.0).alias("jaccard"), F.lit(0.0).alias("containment")).limit(0)
    least = max(2, ceil(total * common_share))
    df = cut(text.select(F.explode("hashes").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    if gram is None:
        seen = df.agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("n").alias("n")).first()
        mean = seen["n"] / total
        first = mean - _needed(round(mean), similarity)
        gram = next((g for g in (2, 3, 4) if total * comb(round(first) + g, g) < comb(seen["vocabulary"], g)), 4)
    df = df.where(F.col("n") >= least)
    common = spark.sparkContext.broadcast({r["w"]: r["n"] for r in df.toLocalIterator()})

    def run(batches):
        yield from _grams(common.value, similarity, gram)(batches)

    grams = map_arrow(text.select("h1", "h2", "train_too", "eval_too", "hashes"), run, "h1 long, h2 long, train_too boolean, eval_too boolean, sig long")
    grams = cut(grams)
    wanted = grams.where("eval_too").select(F.col("h1").alias("h1_a"), F.col("h2").alias("h2_a"), "sig")
    there = grams.where("train_too").select(F.col("h1").alias("h1_b"), F.col("h2").alias("h2_b"), "sig")
    hits = wanted.join(there, "sig").where("h1_a <> h1_b or h2_a <> h2_b").select("h1_a", "h2_a", "h1_b", "h2_b").distinct()
    side = lambda s: text.select(F.col("h1").alias("h1" + s), F.col("h2").alias("h2" + s), F.col("ph").alias("ph" + s), F.col("hashes").alias("w" + s))
    both = hits.join(side("_a"), ["h1_a", "h2_a"]).join(side("_b"), ["h1_b", "h2_b"]).where("ph_a = ph_b")
    shared = F.size(F.array_intersect("w_a", "w_b"))
    both = both.withColumn("shared", shared).withColumn("jaccard", F.col("shared") / (F.size("w_a") + F.size("w_b") - F.col("shared"))).withColumn("containment", F.col("shared") / F.size("w_a"))
    # whole numbers, so that equality at the threshold doesn't depend on rounding
    return both.where(F.col("shared") * 1000 >= F.lit(round(similarity * 1000)) * (F.size("w_a") + F.size("w_b") - F.col("shared"))).select("h1_a", "h2_a", "h1_b", "h2_b", "jaccard", "containment")


def cross_split_pairs(triples: DataFrame, predicates: DataFrame, similarity: float = 0.7, gram: int | None = None) -> DataFrame:
    """(eval_id, train_id, containment): all pairs of an evaluation and a training statement that are the same or almost.

    Statements fall into classes: those of an exact kind by predicate, subject and value, which are one gram as a whole; texts by predicate
    and word set, with their n-grams. The hashes of evaluation grams are partitioned, training is scanned for hits, and only classes
    that hit are expanded to statements. Rows with null s, p, o or split, undeclared
    predicates, blank nodes, invalid values, texts without words and rows without id are in no pair; repeated ids give repeated pairs.
    """
    rows = records(triples, predicates)
    sorted_hashes = F.array_sort(F.transform("words", lambda w: F.xxhash64(w)))
    text = F.col("kind") == "text"
    keyed = rows.withColumn("hashes", sorted_hashes).select(
        "stmt_id", "train", text.alias("text"),
        F.when(text, F.xxhash64("p", "hashes")).otherwise(F.xxhash64("p", "s", "val")).alias("h1"),
        F.when(text, F.xxhash64(F.lit(7), "hashes", "p")).otherwise(F.xxhash64(F.lit(7), "val", "s", "p")).alias("h2"),
        F.when(text, F.xxhash64("p")).alias("ph"), F.when(text, F.col("hashes")).alias("hashes"),
    )
    keyed = cut(keyed)
    member = keyed.select("h1", "h2", "stmt_id", "train")
    classes = keyed.where("text").groupBy("h1", "h2").agg(F.first("ph").alias("ph"), F.first("hashes").alias("hashes"), F.max("train").alias("train_too"), F.max(~F.col("train")).alias("eval_too"))
    classes = cut(classes)
    near = near_classes(classes, similarity, gram)
    eval_side = member.where(~F.col("train")).select(F.col("h1").alias("h1_a"), F.col("h2").alias("h2_a"), F.col("stmt_id").alias("eval_id"))
    train_side = member.where("train").select(F.col("h1").alias("h1_b"), F.col("h2").alias("h2_b"), F.col("stmt_id").alias("train_id"))
    same = eval_side.withColumnsRenamed({"h1_a": "h1_b", "h2_a": "h2_b"}).join(train_side, ["h1_b", "h2_b"]).select("eval_id", "train_id", F.lit(1.0).alias("containment"))
    almost = near.join(eval_side, ["h1_a", "h2_a"]).join(train_side, ["h1_b", "h2_b"]).select("eval_id", "train_id", "containment")
    return same.unionByName(almost)
