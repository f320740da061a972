"""Statements to clean text rows: labels for names, plain values, no noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.terms import clean_iri, is_literal, lexical, where_any


def best_labels(labels: DataFrame, lang: str = "en") -> DataFrame:
    """(iri, label): of each IRI the label in force in that language, else in any; the newest, then of the smallest text."""
    rows = labels.where("iri is not null and label is not null and removed_at is null").select(clean_iri("iri").alias("iri"), "label", "lang", "fetched_at")
    order = W.partitionBy("iri").orderBy(F.coalesce(F.col("lang") == lang, F.lit(False)).desc(), F.desc("fetched_at"), "label")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").select("iri", "label")


def plain_value(o: Column) -> Column:
    """Times without their zeros, quantities without sign and unit; other literals as they are."""
    v = lexical(o)
    v = F.regexp_replace(v, r"^\+?(\d{4}-\d{2}-\d{2})T00:00:00Z?$", "$1")
    v = F.regexp_replace(v, r"^(\d{4})-00-00$", "$1")
    return F.regexp_replace(v, r"^\+(\d[\d.,]*)$", "$1")


def clean_rows(triples: DataFrame, labels: DataFrame, excluded: list[str], lang: str = "en") -> DataFrame:
    """(subject, predicate, object) texts of the statements whose names all have labels; excluded predicates, external links, blank nodes
    and empty values are left out. Each row once.

    Labels are joined by the parts' IRIs; a popular object's rows are split by the adaptive join where that is needed.
    """
    names = best_labels(labels, lang)
    t = triples.where("s is not null and p is not null and o is not null").select(clean_iri("s").alias("s"), clean_iri("p").alias("p"), "o").where(~F.col("p").isin(*excluded) if excluded else F.lit(True))
    t = t.join(names.select(F.col("iri").alias("s"), F.col("label").alias("subject")), "s").join(names.select(F.col("iri").alias("p"), F.col("label").alias("predicate")), "p")
    value = is_literal("o") | ~F.col("o").rlike(r"^\s*(<|_:|[A-Za-z][A-Za-z0-9+.\-]*:)")
    named = t.where(~value).withColumn("iri", clean_iri("o")).join(names.withColumnRenamed("label", "object"), "iri").select("subject", "predicate", "object")
    valued = where_any(t.where(value).withColumn("object", plain_value(F.col("o"))).withColumn("object", F.when(F.trim("object") != "", F.col("object"))), "object").select("subject", "predicate", "object")
    return named.unionByName(valued).distinct()
