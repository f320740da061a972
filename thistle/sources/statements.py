"""Statement tables of any spelling as terms of one spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.terms import clean_iri, strip, where_any
from ..plans.ast import XSD


_WHOLE = tuple(XSD + k for k in ("integer", "int", "long"))


def with_term(df: DataFrame, c: str) -> DataFrame:
    """df with column c as canonical terms: a clean IRI, a blank node, or a literal in quotes; bare whole numbers, numbers and booleans become
    typed literals.

    xsd: in a literal's tag is written out; whole numbers (also of type int or long) become integers without leading zeros and plus signs.
    Null for null and empty text. In steps (columns _t, _tag, _in and _kind, dropped again), so that nothing is computed twice.
    """
    t, tag, inner, kind = (F.col(x) for x in ("_t", "_tag", "_in", "_kind"))
    df = df.withColumn("_t", strip(c)).withColumn("_t", F.when(F.col("_t") != "", F.col("_t")))
    df = df.withColumn("_tag", F.when(t.startswith('"'), F.substring_index(t, '"', -1)))
    df = df.withColumn("_in", F.substr(t, F.lit(2), F.char_length(t) - F.char_length(tag) - 2))
    df = df.withColumn("_kind", F.when(tag.startswith("^^"), F.regexp_replace(F.regexp_replace(F.substr(tag, F.lit(3)), "^<|>$", ""), "^xsd:", XSD)))
    df = df.withColumn("_n", F.when(kind.isin(*_WHOLE), strip(inner).try_cast("bigint")).when(tag.isNull() & t.rlike("^[+\\-]?[0-9]{1,18}$"), t.try_cast("bigint")))
    typed = lambda v, k: F.concat(F.lit('"'), v, F.lit('"^^<'), k, F.lit(">"))
    out = (
        F.when(F.col("_n").isNotNull(), typed(F.col("_n").cast("string"), F.lit(XSD + "integer")))
        .when(kind.isNotNull(), typed(inner, kind))
        .when(tag.isNotNull() | t.startswith("_:"), t)
        .when(t.rlike("^[+\\-]?[0-9]*\\.[0-9]+$"), typed(t, F.lit(XSD + "decimal")))
        .when(t.isin("true", "false"), typed(t, F.lit(XSD + "boolean")))
        .otherwise(clean_iri("_t"))
    )
    return df.withColumn(c, out).drop("_t", "_tag", "_in", "_kind", "_n")


def statements(df: DataFrame, s: str = "s", p: str = "p", o: str = "o") -> DataFrame:
    """(s, p, o): each statement once. Rows with a null or empty part, or a literal as subject or predicate, are left out."""
    t = df.select(clean_iri(s).alias("s"), clean_iri(p).alias("p"), F.col(o).alias("o"))
    t = with_term(t, "o")
    fine = (F.col("s") != "") & (F.col("p") != "") & F.col("o").isNotNull() & ~F.col("s").startswith('"') & ~F.col("p").startswith('"') & ~F.col("p").startswith("_:")
    return where_any(t.withColumn("_fine", F.when(fine, F.lit(1))), "_fine").drop("_fine").distinct()
