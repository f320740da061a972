"""Checks of statements against an ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.ast import RDF_TYPE
from .hierarchy import double_pointers

RDFS, OWL = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"


def all_types(types: DataFrame, subclass: DataFrame) -> DataFrame:
    """(node, cls): each node's classes with all their ancestors. types: node, cls. subclass: child, parent."""
    h = double_pointers(subclass.select(F.lit("").alias("hier"), "child", "parent"), subclass.select(F.lit("").alias("hier"), F.explode(F.array("child", "parent")).alias("node")), targets="all")
    up = h.reached.select(F.col("node").alias("cls"), F.col("target").alias("up"))
    above = types.join(up, "cls").select("node", F.col("up").alias("cls"))
    return types.select("node", "cls").unionByName(above).distinct()


def violations(data: DataFrame, schema: DataFrame, subclass: DataFrame | None = None) -> DataFrame:
    """(kind, s, p, o): statements of data that break a domain, range, disjointness or functional property of schema; both are s, p, o.

    Domains and ranges bind only nodes whose types are known, ranges no literals; types count with all their ancestors. A functional property is
    broken by every statement of a subject with several values.
    """
    ax = lambda p: schema.where(F.col("p") == p)
    types = data.where(F.col("p") == RDF_TYPE).select(F.col("s").alias("node"), F.col("o").alias("cls")).distinct()
    below = subclass if subclass is not None else ax(RDFS + "subClassOf").select(F.col("s").alias("child"), F.col("o").alias("parent"))
    every = all_types(types, below)
    typed = types.select("node").distinct()
    out = []
    for kind, axiom, column in (("domain", RDFS + "domain", "s"), ("range", RDFS + "range", "o")):
        want = ax(axiom).select(F.col("s").alias("p"), F.col("o").alias("cls")).distinct()
        rows = data.join(want, "p").where(~F.col(column).startswith('"')).withColumn("node", F.col(column)).join(typed, "node", "left_semi")
        out.append(rows.join(every, ["node", "cls"], "left_anti").select(F.lit(kind).alias("kind"), "s", "p", "o").distinct())
    apart = ax(OWL + "disjointWith").select(F.col("s").alias("a"), F.col("o").alias("b"))
    apart = apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = types.withColumnRenamed("cls", "a").join(apart, "a").join(types.withColumnRenamed("cls", "b"), ["node", "b"])
    out.append(both.select(F.lit("disjoint").alias("kind"), F.col("node").alias("s"), F.lit(RDF_TYPE).alias("p"), F.col("b").alias("o")).distinct())
    functional = schema.where((F.col("p") == RDF_TYPE) & (F.col("o") == OWL + "FunctionalProperty")).select(F.col("s").alias("p")).distinct()
    values = data.join(functional, "p").select("s", "p", "o").distinct()
    several = values.groupBy("s", "p").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s", "p")
    out.append(values.join(several, ["s", "p"]).select(F.lit("functional").alias("kind"), "s", "p", "o"))
    df = out[0]
    for x in out[1:]:
        df = df.unionByName(x)
    return df
