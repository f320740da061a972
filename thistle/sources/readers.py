"""RDF files to statements."""

from __future__ import annotations

import json
import re
from hashlib import md5
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.values import literal_term
from ..plans import ast as A
from ..plans.compile import constant_term, quoted_key
from ..plans.sparql import Parser
from ..runtime import cut, map_arrow

_IRI, _BLANK, _TEXT = r"<[^<>\"\s]*>", r"_:[A-Za-z0-9_.\-]+", r"\"(?:[^\"\\]|\\.)*\"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^>]*>)?"
_FLAT = f"(?:{_IRI}|{_BLANK}|{_TEXT})"
_QUOTED = rf"<<\s*(?:{_FLAT})\s*(?:{_IRI})\s*(?:{_FLAT})\s*>>"
_LINE = rf"^\s*({_QUOTED}|{_IRI}|{_BLANK})\s*({_IRI})\s*({_QUOTED}|{_FLAT})\s*({_IRI}|{_BLANK})?\s*\.\s*(?:#.*)?$"
_INNER = rf"^<<\s*({_FLAT})\s*({_IRI})\s*({_FLAT})\s*>>$"


def _plain(t: Column) -> Column:
    """One flat term as written to one as kept: IRIs bare, escapes decoded, whole numbers in one form."""
    mark = "\u0001"
    x = t
    for a, b in (("\\\\", mark), ('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), (mark, "\\")):
        x = F.replace(x, F.lit(a), F.lit(b))
    text = F.when(F.contains(t, F.lit("\\")), x).otherwise(t)
    kind = f'"^^<{A.XSD}integer>'
    number = F.regexp_extract(t, r'^"([+\-]?\d{1,18})"\^\^<[^>]*#(?:integer|int|long)>$', 1)
    return F.when(t.startswith("<"), F.substr(t, F.lit(2), F.char_length(t) - 2)).when(number != "", F.concat(F.lit('"'), number.try_cast("bigint").cast("string"), F.lit(kind))).otherwise(text)


def _inner(t: Column) -> list[Column]:
    return [_plain(F.regexp_extract(t, _INNER, k)) for k in (1, 2, 3)]


def _key(t: Column) -> Column:
    s, p, o = _inner(t)
    return F.when(t.startswith("<<"), F.concat(F.lit("<< "), s, F.lit(" "), p, F.lit(" "), o, F.lit(" >>"))).otherwise(_plain(t))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(line, s, p, o, g, ok) of N-Triples-star and N-Quads lines; blank lines and comments are left out, malformed ones have ok = false.

    All in the JVM: one match a line. Quoted statements may be nested one level; load_lines() reads deeper ones.
    """
    rows = lines.select(F.col(column).alias("line")).where(~F.trim("line").startswith("#") & (F.trim("line") != ""))
    part = [F.regexp_extract("line", _LINE, k) for k in (1, 2, 3, 4)]
    rows = rows.select("line", F.col("line").rlike(_LINE).alias("ok"), *(p.alias(c) for p, c in zip(part, "spog", strict=True)))
    good = lambda c: F.when(F.col("ok"), c)
    return rows.select("line", good(_key(F.col("s"))).alias("s"), good(_plain(F.col("p"))).alias("p"), good(_key(F.col("o"))).alias("o"), good(F.when(F.col("g") != "", _plain(F.col("g")))).alias("g"), "ok", *(F.when(F.col(c).startswith("<<"), F.col(c)).alias(f"raw_{c}") for c in "so"))


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with quoted statements in quoted ones: kind s is a statement, q a quoted one with its key, e a line that can't be read."""
    names = ("line", "kind", "key", "s", "p", "o")
    for b in batches:
        out: list[tuple] = []
        for line in b.column(0).to_pylist():
            try:
                g = A.Group()
                parser = _Turtle(line)
                parser.triples(g)
                parser.need(".")
                found: list[tuple] = []

                def add(t, line=line, found=found) -> None:
                    found.append((line, "s", None, *(constant_term(x) for x in (t.s, t.p, t.o))))
                    for x in (t.s, t.o):
                        if isinstance(x, A.Quoted):
                            found.append((line, "q", constant_term(x), *(constant_term(y) for y in (x.s, x.p, x.o))))
                            add(x)

                for t in g.parts:
                    add(t)
                out += found
            except (A.QueryError, ValueError, AttributeError, KeyError, IndexError):
                out.append((line, "e", None, None, None, None))
        yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(names)}, schema=pa.schema([(n, pa.string()) for n in names]))


def load_lines(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(triples, quoted, errors): statements each once, with those that are quoted asserted, too; quoted statements by key; malformed lines.

    Lines with quotes in quotes, at any depth, are read by the parser of whole documents, all others by one match in the JVM.
    """
    rows = cut(parse_lines(lines, column))  # read several times below
    ok, rest = rows.where("ok"), rows.where("not ok").select("line")
    raw = ok.select(F.explode(F.array_compact(F.array("raw_s", "raw_o"))).alias("raw")).distinct()
    s, p, o = _inner(F.col("raw"))
    quoted = raw.select(_key(F.col("raw")).alias("key"), s.alias("qs"), p.alias("qp"), o.alias("qo")).distinct()
    inner = quoted.select(F.col("qs").alias("s"), F.col("qp").alias("p"), F.col("qo").alias("o"))
    deep = F.col("line").rlike(r"<<.*<<")
    nested = map_arrow(rest.where(deep), _nested, "line string, kind string, key string, s string, p string, o string")
    triples = ok.select("s", "p", "o").unionByName(inner).unionByName(nested.where("kind = 's'").select("s", "p", "o")).distinct()
    quoted = quoted.unionByName(nested.where("kind = 'q'").select("key", F.col("s").alias("qs"), F.col("p").alias("qp"), F.col("o").alias("qo"))).distinct()
    return triples, quoted, rest.where(~deep).unionByName(nested.where("kind = 'e'").select("line"))


def read_ntriples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return load_lines(spark.read.text(path))


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, g), each once; malformed lines are left out."""
    return parse_lines(spark.read.text(path)).where("ok").select("s", "p", "o", "g").distinct()


# formats of whole documents


class _Turtle(Parser):
    def __init__(self, text: str):
        text = re.sub(r"@(prefix|base)\b", lambda m: m[1].upper(), text)
        super().__init__(text)

    def statements(self) -> Iterator[tuple]:
        while self.peek()[0] != "end":
            if self.is_word("PREFIX"):
                self.next()
                name = self.next()[1][:-1]
                iri = self.next()[1][1:-1]
                self.prefixes[name] = iri if ":" in iri else self.base + iri
                self.take_op(".")
            elif self.take_word("BASE"):
                self.base = self.next()[1][1:-1]
                self.take_op(".")
            else:
                g = A.Group()
                self.triples(g)
                self.need(".")
                for t in g.parts:
                    if isinstance(t, A.Triple):
                        yield tuple(_node(x) for x in (t.s, t.p, t.o))


def _node(x) -> str:
    return "_:" + x.name.removeprefix("__") if isinstance(x, A.Var) else constant_term(x)


def turtle(text: str) -> list[tuple[str, str, str]]:
    """Prefixes, base, lists with ; and , blank nodes in brackets, typed and tagged literals, numbers and booleans."""
    return list(_Turtle(text).statements())


_R = "{" + A.RDF + "}"


def rdfxml(text: str) -> list[tuple[str, str, str]]:
    """Typed and plain nodes, about, ID and nodeID, property attributes, resource, nested nodes, datatype and lang."""
    out: list[tuple[str, str, str]] = []
    fresh = count()
    name = lambda tag: tag[1:].replace("}", "", 1) if tag.startswith("{") else tag
    lang = "{http://www.w3.org/XML/1998/namespace}lang"

    def node(e: ET.Element, tag: str | None) -> str:
        if (a := e.get(_R + "about")) is not None:
            s = a
        elif (a := e.get(_R + "ID")) is not None:
            s = "#" + a
        else:
            s = "_:" + (e.get(_R + "nodeID") or f"x{next(fresh)}")
        tag = e.get(lang, tag)
        if e.tag != _R + "Description":
            out.append((s, A.RDF_TYPE, name(e.tag)))
        for k, v in e.attrib.items():
            if not k.startswith((_R, "{http://www.w3.org/XML")) and k.startswith("{"):
                out.append((s, name(k), literal_term(A.Lit(v, None, tag))))
        for p in e:
            own = p.get(lang, tag)
            if (r := p.get(_R + "resource")) is not None:
                o = r
            elif (r := p.get(_R + "nodeID")) is not None:
                o = "_:" + r
            elif p.get(_R + "parseType") == "Resource":
                inner = ET.Element(_R + "Description", {})
                inner.extend(list(p))
                o = node(inner, own)
            elif len(p):
                o = node(p[0], own)
            else:
                dt = p.get(_R + "datatype")
                o = literal_term(A.Lit(p.text or "", dt, None if dt else own))
            out.append((s, name(p.tag), o))
        return s

    root = ET.fromstring(text)
    for e in root if root.tag == _R + "RDF" else [root]:
        node(e, root.get(lang))
    return out


def jsonld(text: str) -> list[tuple[str, str, str]]:
    """@context (terms, prefixes, @vocab, @type coercion), @graph, @id, @type, @value, @language, @list as its values, nested nodes."""
    out: list[tuple[str, str, str]] = []
    fresh = count()

    def expand(x: str, ctx: dict, vocab: bool = True) -> str:
        term = ctx.get(x) if vocab else None
        if isinstance(term, dict):
            term = term.get("@id")
        if isinstance(term, str) and term != x:
            return expand(term, ctx, False) if ":" in term else term
        if ":" in x and not x.startswith("_:"):
            prefix, rest = x.split(":", 1)
            base = ctx.get(prefix)
            if isinstance(base, str) and not rest.startswith("//"):
                return base + rest
            return x
        return ctx["@vocab"] + x if vocab and "@vocab" in ctx and not x.startswith("_:") else x

    def value(v, ctx: dict, how: str | None) -> list[str]:
        if v is None:
            return []
        if isinstance(v, list):
            return [y for x in v for y in value(x, ctx, how)]
        if isinstance(v, dict):
            if "@value" in v:
                raw = v["@value"]
                if isinstance(raw, bool | int | float) and "@type" not in v:
                    return value(raw, ctx, None)
                return [literal_term(A.Lit(str(raw), expand(v["@type"], ctx) if "@type" in v else None, v.get("@language")))]
            if "@list" in v or "@set" in v:
                return value(v.get("@list", v.get("@set")), ctx, how)
            return [node(v, ctx)]
        if isinstance(v, bool):
            return [literal_term(A.Lit(str(v).lower(), A.XSD + "boolean"))]
        if isinstance(v, int):
            return [literal_term(A.Lit(str(v), A.XSD + "integer"))]
        if isinstance(v, float):
            return [literal_term(A.Lit(repr(v), A.XSD + "double"))]
        if how in ("@id", "@vocab"):
            return [expand(v, ctx, how == "@vocab")]
        return [literal_term(A.Lit(v, expand(how, ctx) if how else None, None if how else ctx.get("@language")))]

    def node(n: dict, ctx: dict) -> str:
        ctx = context(n.get("@context"), ctx)
        s = expand(n["@id"], ctx, False) if "@id" in n else f"_:j{next(fresh)}"
        for t in n.get("@type", []) if isinstance(n.get("@type"), list) else [n["@type"]] if "@type" in n else []:
            out.append((s, A.RDF_TYPE, expand(t, ctx)))
        for k, v in n.items():
            if k == "@graph":
                for x in v if isinstance(v, list) else [v]:
                    node(x, ctx)
            if k.startswith("@"):
                continue
            p = expand(k, ctx)
            if ":" not in p:
                continue
            how = ctx[k].get("@type") if isinstance(ctx.get(k), dict) else None
            out.extend((s, p, o) for o in value(v, ctx, how))
        return s

    def context(c, old: dict) -> dict:
        for x in c if isinstance(c, list) else [c]:
            if isinstance(x, dict):
                old = {**old, **x}
        return old

    data = json.loads(text)
    for x in data if isinstance(data, list) else [data]:
        if "@graph" in x and set(x) <= {"@context", "@graph"}:
            ctx = context(x.get("@context"), {})
            for y in x["@graph"]:
                node(y, ctx)
        else:
            node(x, {})
    return out


def _documents(parse: Callable[[str], list[tuple[str, str, str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    rows, error = [(s, p, o, None) for s, p, o in parse(text)], None
                except (A.QueryError, ET.ParseError, ValueError, KeyError, IndexError) as e:
                    rows, error = [(None, None, None, str(e) or type(e).__name__)], e
                # blank nodes belong to their file
                mine = f"_:f{md5(file.encode()).hexdigest()}x" if error is None else ""
                own = lambda x, mine=mine: mine + x[2:] if isinstance(x, str) and x.startswith("_:") else x
                yield pa.RecordBatch.from_pydict({"file": [file] * len(rows), "s": [own(r[0]) for r in rows], "p": [r[1] for r in rows], "o": [own(r[2]) for r in rows], "error": [r[3] for r in rows]}, schema=pa.schema([(c, pa.string()) for c in ("file", "s", "p", "o", "error")]))

    return run


_FORMATS = {"turtle": turtle, "rdfxml": rdfxml, "jsonld": jsonld}


def read_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, s, p, o, error) of turtle, rdfxml or jsonld files, each file read by one task; a file that can't be read gives one row with
    its error. Blank nodes of different files stay apart."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return map_arrow(files, _documents(_FORMATS[kind]), "file string, s string, p string, o string, error string")


__all__ = ["jsonld", "load_lines", "parse_lines", "quoted_key", "rdfxml", "read_documents", "read_nquads", "read_ntriples", "turtle"]
