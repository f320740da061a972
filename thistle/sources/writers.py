"""Statements and results to text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.sparql import KNOWN


def escaped(lex: Column) -> Column:
    x = lex
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def nt_term(c: Column) -> Column:
    tag = F.substring_index(c, '"', -1)
    lex = F.substr(c, F.lit(2), F.char_length(c) - F.char_length(tag) - 2)
    return F.when(c.startswith('"'), F.concat(F.lit('"'), escaped(lex), F.lit('"'), tag)).when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def ntriples(triples: DataFrame, quoted: DataFrame | None = None) -> DataFrame:
    """(value): one line a statement; statements about quoted ones need `quoted` to be written."""
    t = triples.select("s", "p", "o")
    if quoted is not None:
        shown = quoted.select("key", F.concat(F.lit("<< "), nt_term(F.col("qs")), F.lit(" "), nt_term(F.col("qp")), F.lit(" "), nt_term(F.col("qo")), F.lit(" >>")).alias("shown"))
        for c in "so":
            t = t.join(shown.select(F.col("key").alias(c), F.col("shown").alias(f"{c}_shown")), c, "left")
        s, o = (F.coalesce(f"{c}_shown", nt_term(F.col(c))) for c in "so")
    else:
        s, o = nt_term(F.col("s")), nt_term(F.col("o"))
    return t.select(F.concat(s, F.lit(" "), nt_term(F.col("p")), F.lit(" "), o, F.lit(" .")).alias("value"))


def _short(c: Column, prefixes: Mapping[str, str]) -> Column:
    out = nt_term(c)
    for k, v in prefixes.items():
        rest = F.substr(c, F.lit(len(v) + 1))
        out = F.when(c.startswith(v) & rest.rlike(r"^[A-Za-z_][\w\-]*$"), F.concat(F.lit(k + ":"), rest)).otherwise(out)
    return out


def turtle(triples: DataFrame, prefixes: Mapping[str, str] = KNOWN) -> DataFrame:
    """(value): a block a subject, its statements by predicate and object; the prefix lines come first when written by write_turtle()."""
    line = F.concat(_short(F.col("p"), prefixes), F.lit(" "), _short(F.col("o"), prefixes))
    per = triples.select("s", line.alias("line")).groupBy("s").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return per.select(F.concat(_short(F.col("s"), prefixes), F.lit(" "), F.array_join("lines", " ;\n    "), F.lit(" .")).alias("value"))


def header(prefixes: Mapping[str, str] = KNOWN) -> list[str]:
    return [f"@prefix {k}: <{v}> ." for k, v in prefixes.items()]


def write_ntriples(triples: DataFrame, path: str, quoted: DataFrame | None = None) -> None:
    ntriples(triples, quoted).write.text(path)


def write_turtle(triples: DataFrame, path: str, prefixes: Mapping[str, str] = KNOWN) -> None:
    """Blocks with full IRIs, so that every file can be read alone."""
    del prefixes
    turtle(triples, {}).write.text(path)


def results(df: DataFrame, kind: str) -> DataFrame:
    """(value): one row a solution as json, csv, tsv or xml text, values quoted where they must be; unbound is null or empty."""
    if kind == "json":
        return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("value"))
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    if kind == "csv":
        quote = lambda x: F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
        return df.select(F.concat_ws(",", *(quote(x) for x in text)).alias("value"))
    if kind == "tsv":
        return df.select(F.concat_ws("\t", *(F.replace(F.replace(x, F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")) for x in text)).alias("value"))
    if kind == "xml":
        def safe(x: Column) -> Column:
            for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
                x = F.replace(x, F.lit(a), F.lit(b))
            return x

        cells = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f'<binding name="{c}"><literal>'), safe(x), F.lit("</literal></binding>"))) for c, x in zip(df.columns, text, strict=True)]
        return df.select(F.concat(F.lit("<result>"), F.concat_ws("", *cells), F.lit("</result>")).alias("value"))
    raise ValueError(f"unknown kind {kind!r}")


def service_description(triples: DataFrame) -> str:
    """Numbers of statements, subjects, predicates and objects as VoID."""
    r = triples.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("s"), F.countDistinct("p").alias("p"), F.countDistinct("o").alias("o")).first()
    return f"@prefix void: <http://rdfs.org/ns/void#> .\n[] a void:Dataset ;\n  void:triples {r['n']} ;\n  void:distinctSubjects {r['s']} ;\n  void:properties {r['p']} ;\n  void:distinctObjects {r['o']} .\n"
