"""Queries of this subpackage over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.terms import clean_iri, iri_of, quoted_lexical, words
from ..runtime import cut, table
from . import encode, knn, overlap, packing, repetition, skeleton, termfreq
from .oracles import ORACLES as ORACLES


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, d, "triples"), table(spark, d, "predicates"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d).select(F.least("eval_id", "train_id").alias("stmt_id_a"), F.greatest("eval_id", "train_id").alias("stmt_id_b"))
    return pairs


def p4_per_split(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation statements with a partner in train, their pairs, and how many of them a training statement contains whole, per split and source."""
    per = _pairs(spark, d).groupBy("eval_id").agg(F.count(F.lit(1)).alias("n"), F.max("containment").alias("c"))
    t = table(spark, d, "triples").select(F.col("stmt_id").alias("eval_id"), "split_name", "source")
    counts = (F.count(F.lit(1)).alias("statements"), F.sum("n").alias("pairs"), F.count_if(F.col("c") >= 1).alias("contained"))
    return t.join(per, "eval_id").groupBy("split_name", "source").agg(*counts)


def p4_containment(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation statement with its number of partners in train and the largest share of its words that one of them holds."""
    per = _pairs(spark, d).groupBy(F.col("eval_id").alias("stmt_id")).agg(F.count(F.lit(1)).alias("partners"), F.max("containment").alias("c"))
    return per.select("stmt_id", "partners", F.round("c", 6).alias("containment"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.look_alike_pairs(table(spark, d, "labels"), "label_id", "label").select(F.col("id_a").alias("label_id_a"), F.col("id_b").alias("label_id_b"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each label with the class of its look, named by the least id in it, and the number of its spellings."""
    return skeleton.classes(table(spark, d, "labels"), "label_id", "label").select("label_id", "class_id", "spellings")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = knn.usable(table(spark, d, "hnsw_nodes").where(~F.col("deleted")), "triple_id", "vec")
    near = knn.neighbours(nodes, least=0.8)
    return near.select(F.least("id", "other").alias("triple_id_a"), F.greatest("id", "other").alias("triple_id_b")).distinct()


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar of every node whose triple_id is divisible by 50, against all, however far."""
    nodes = knn.usable(table(spark, d, "hnsw_nodes").where(~F.col("deleted")), "triple_id", "vec")
    near = knn.neighbours(nodes, nodes.where("id % 50 = 0"), share=0.25)
    return near.select("id", "other", F.round("similarity", 6).alias("similarity"))


def p6_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index, asked for candidates of a third of all vectors, finds at least nine tenths of the ten most similar ones of every node whose
    triple_id is divisible by 50; what these are is found without ruling any cell out."""
    nodes = cut(knn.usable(table(spark, d, "hnsw_nodes").where(~F.col("deleted")), "triple_id", "vec"))
    asked = nodes.where("id % 50 = 0")
    near = knn.neighbours(nodes, asked, wanted=20, share=0.33).select("id", "other", F.lit(1).alias("hit"))
    true = knn.neighbours(nodes, asked, least=-1.0).select("id", "other")
    rows = true.join(near, ["id", "other"], "left").agg(F.countDistinct("id").alias("asked"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))
    return rows


def _terms(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "triples")
    as_list = lambda c: F.when(c.isNotNull(), F.array(c))
    fields = t.select(as_list(clean_iri("p")).alias("p"), as_list(iri_of("o")).alias("o_iri"), words(quoted_lexical("o")).alias("o_word"))
    return termfreq.marked(termfreq.term_counts(fields, ["p", "o_iri", "o_word"]), t.count())


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark is not null").select("field", "term", "mark")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("field", "term", "occurrences", "records")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text, encoded and decoded again."""
    return encode.decode(encode.encode(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(encode.token_counts(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "tokens", 2048)


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the assignment: every document is there, whole unless it alone is too large, no container too full, at most one in a
    hundred (and one) above the least number of containers."""
    sizes = cut(encode.token_counts(table(spark, d, "documents"), "doc_id", "text"))
    rows = cut(packing.pack(sizes, "doc_id", "tokens", 2048))
    per = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("size"), F.count_if(F.col("container").isNull()).alias("none"))
    docs = sizes.join(per, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("none").alias("without_room"), F.sum("tokens").alias("tokens"),
        F.every((F.col("size") == F.col("tokens")) & (F.col("parts") == F.greatest(F.lit(1), F.ceil(F.col("tokens") / 2048)))).alias("whole"),
    )
    full = rows.where("container is not null").groupBy("container").agg(F.sum("size").alias("fill")).agg(F.count(F.lit(1)).alias("n"), F.max("fill").alias("most"))
    both = docs.join(full)
    return both.select("documents", "without_room", "whole", (F.col("most") <= 2048).alias("fits"), (F.col("n") <= F.ceil(F.col("tokens") / 2048) * 1.01 + 1).alias("tight"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """Which texts have no token."""
    return encode.token_counts(table(spark, d, "documents"), "doc_id", "text").select("doc_id", (F.col("tokens") == 0).alias("none"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of repeated words of every text, whatever its posterior."""
    docs = table(spark, d, "documents")
    rows, _ = repetition.judged(docs, "doc_id", "text")
    return rows.select("doc_id", "n_words", "rep_words", "repeated_share")


def p10_judged(spark: SparkSession, d: str) -> DataFrame:
    """Every text's votes and posterior."""
    rows, _ = repetition.judged(table(spark, d, "documents"), "doc_id", "text")
    return rows.select("doc_id", *repetition.RULES, F.round("posterior", 9).alias("posterior"))


def p10_rules(spark: SparkSession, d: str) -> DataFrame:
    """Each rule's estimated rate of right votes, on repetitive and on other texts."""
    _, model = repetition.judged(table(spark, d, "documents"), "doc_id", "text")
    rows = [(name, *rates) for name, rates in zip(repetition.RULES, model.rates, strict=False)]
    return spark.createDataFrame(rows, "rule string, on_repetitive double, on_other double")


QUERIES = {f.__name__: f for f in (p4_found, p4_per_split, p4_containment, p5_found, p5_classes, p6_found, p6_neighbours, p6_recall, p7_found, p7_counts, p8_ids, p8_decoded, p8_counts, p9_pack, p9_invariants, p10_found, p10_shares, p10_judged, p10_rules)}
