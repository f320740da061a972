"""RDF values as columns, typed where the type is known, and the functions of the query language over them.

A value is a column and a kind: int, double, string, bool, ts (timestamp without zone), vec, lang (struct of lex and lang), iri (its text),
tpl:<prefix> (the key behind an IRI made by a template), or term (any RDF term as text: IRIs bare, blank nodes with _:, quoted statements
with <<, literals in quotes with their tag). Unbound is null. An expression that can't be computed is null, too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..plans.ast import XSD, Call, Iri, Lit, QueryError

NUMERIC = ("int", "double")
_NUMERIC_TYPES = tuple(XSD + t for t in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger"))


@dataclass(frozen=True)
class Value:
    col: Column
    kind: str


# terms as text


def tag(t: Column) -> Column:
    """What follows the closing quote of a literal."""
    return F.substring_index(t, '"', -1)


def lex(v: Value) -> Column:
    """STR: the lexical form."""
    c = v.col
    if v.kind == "term":
        size = F.char_length(c) - F.char_length(tag(c)) - 2
        return F.when(c.startswith('"'), F.substr(c, F.lit(2), size)).otherwise(c)
    if v.kind == "lang":
        return c["lex"]
    if v.kind.startswith("tpl:"):
        return F.concat(F.lit(v.kind[4:]), key_text(c))
    if v.kind == "ts":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if v.kind == "vec":
        return F.array_join(F.transform(c, lambda x: F.format_number(x, 6)), " ")
    return c.cast("string")


def key_text(c: Column) -> Column:
    return c.cast("string")


def datatype(v: Value) -> Column:
    known = {"int": "integer", "double": "double", "bool": "boolean", "ts": "dateTime", "string": "string"}
    if v.kind in known:
        return F.when(v.col.isNotNull(), F.lit(XSD + known[v.kind]))
    if v.kind == "term":
        t = tag(v.col)
        dt = F.regexp_replace(F.substr(t, F.lit(3)), "^<|>$", "")
        return F.when(v.col.startswith('"') & t.startswith("^^"), dt).when(v.col.startswith('"') & (t == ""), F.lit(XSD + "string"))
    return F.lit(None).cast("string")


def lang(v: Value) -> Column:
    if v.kind == "lang":
        return v.col["lang"]
    if v.kind == "term":
        t = tag(v.col)
        return F.when(v.col.startswith('"'), F.when(t.startswith("@"), F.substr(t, F.lit(2))).otherwise(F.lit("")))
    if v.kind in ("iri",) or v.kind.startswith("tpl:"):
        return F.lit(None).cast("string")
    return F.when(v.col.isNotNull(), F.lit(""))


def number(v: Value) -> Column:
    if v.kind == "int" or v.kind == "double":
        return v.col
    if v.kind == "bool":
        return F.lit(None).cast("double")
    if v.kind == "term":
        t = tag(v.col)
        numeric = F.regexp_replace(F.substr(t, F.lit(3)), "^<|>$", "").isin(*_NUMERIC_TYPES)
        return F.when(v.col.startswith('"') & t.startswith("^^") & numeric, lex(v).try_cast("double"))
    return F.lit(None).cast("double")


def as_term(v: Value) -> Column:
    c = v.col
    if v.kind in ("term", "iri"):
        return c
    if v.kind.startswith("tpl:"):
        return lex(v)
    if v.kind == "string":
        return F.concat(F.lit('"'), c, F.lit('"'))
    if v.kind == "lang":
        return F.when(c["lang"].isNull(), F.concat(F.lit('"'), c["lex"], F.lit('"'))).otherwise(F.concat(F.lit('"'), c["lex"], F.lit('"@'), c["lang"]))
    dt = {"int": "integer", "double": "double", "bool": "boolean", "ts": "dateTime", "vec": "f32vec"}[v.kind]
    return F.concat(F.lit('"'), lex(v), F.lit(f'"^^<{XSD}{dt}>'))


def literal_term(x: Lit) -> str:
    if x.dt and x.dt.startswith(XSD) and x.dt[len(XSD) :] in ("integer", "int", "long") and re.fullmatch(r"[+-]?\d+", x.lex.strip()):
        return f'"{int(x.lex)}"^^<{XSD}integer>'
    if x.dt == XSD + "string":
        return f'"{x.lex}"'
    return f'"{x.lex}"' + (f"@{x.lang}" if x.lang else f"^^<{x.dt}>" if x.dt else "")


def constant(x: Iri | Lit) -> Value:
    if isinstance(x, Iri):
        return Value(F.lit(x.value), "iri")
    dt = (x.dt or "").removeprefix(XSD)
    if x.dt in _NUMERIC_TYPES:
        try:
            return Value(F.lit(int(x.lex)), "int") if re.fullmatch(r"[+-]?\d+", x.lex) else Value(F.lit(float(x.lex)), "double")
        except ValueError:
            return Value(F.lit(literal_term(x)), "term")
    if dt == "boolean":
        return Value(F.lit(x.lex in ("true", "1")), "bool")
    if dt in ("dateTime", "date"):
        return Value(F.lit(x.lex.replace("T", " ").rstrip("Z")).try_cast("timestamp_ntz"), "ts")
    if x.lang or x.dt and x.dt != XSD + "string":
        return Value(F.lit(literal_term(x)), "term")
    return Value(F.lit(x.lex), "string")


def template_key(iri: str, prefix: str, key_type: str) -> Column | None:
    """The key of an IRI under a template, or None where it can't be one of its IRIs."""
    if not iri.startswith(prefix):
        return None
    rest = iri[len(prefix) :]
    if key_type in ("int", "bigint"):
        return F.lit(int(rest)).cast(key_type) if re.fullmatch(r"-?\d{1,18}", rest) and str(int(rest)) == rest else None
    return F.lit(rest) if key_type == "string" else None


# comparison


def _families(a: Value, b: Value) -> str:
    iri = lambda k: k == "iri" or k.startswith("tpl:")
    if a.kind in NUMERIC and b.kind in NUMERIC:
        return "number"
    if a.kind == b.kind and a.kind in ("string", "bool", "ts"):
        return "same"
    if iri(a.kind) and iri(b.kind):
        return "iri"
    if "term" in (a.kind, b.kind) or "lang" in (a.kind, b.kind):
        return "term"
    return "none"


def equal(a: Value, b: Value) -> Column:
    """=: numbers by value, everything else by term."""
    f = _families(a, b)
    if f in ("number", "same"):
        return a.col == b.col
    if f == "iri":
        return a.col == b.col if a.kind == b.kind else lex(a) == lex(b)
    if f == "term":
        if a.kind in NUMERIC or b.kind in NUMERIC:
            same = number(a) == number(b)
            return F.when(a.col.isNotNull() & b.col.isNotNull(), F.coalesce(same, F.lit(False)))
        return (as_term(a) == as_term(b)) | F.coalesce(number(a) == number(b), F.lit(False))
    return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))


def compare(op: str, a: Value, b: Value) -> Column:
    """< > <= >=: numbers, texts of one sort, times; anything else has no value."""
    do = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    f = _families(a, b)
    if f in ("number", "same"):
        return do(a.col, b.col)
    if f == "iri":
        return do(lex(a), lex(b))
    if f == "term":
        x, y = number(a), number(b)
        if a.kind in NUMERIC or b.kind in NUMERIC:
            return do(x, y)
        plain = lambda v: F.lit(True) if v.kind in ("string", "lang") else F.lit(False) if v.kind != "term" else v.col.startswith('"') & number(v).isNull()
        named = lambda v: F.lit(v.kind == "iri" or v.kind.startswith("tpl:")) if v.kind != "term" else ~v.col.startswith('"')
        return F.when(x.isNotNull() & y.isNotNull(), do(x, y)).when((plain(a) & plain(b)) | (named(a) & named(b)), do(lex(a), lex(b)))
    return F.lit(None).cast("boolean")


def truth(v: Value) -> Column:
    """The effective boolean value."""
    if v.kind == "bool":
        return v.col
    if v.kind in NUMERIC:
        return v.col != 0
    if v.kind == "string":
        return F.char_length(v.col) > 0
    if v.kind == "lang":
        return F.char_length(v.col["lex"]) > 0
    if v.kind == "term":
        n = number(v)
        boolean = tag(v.col) == f"^^<{XSD}boolean>"
        return F.when(n.isNotNull(), n != 0).when(boolean, lex(v).isin("true", "1")).when(v.col.startswith('"'), F.char_length(lex(v)) > 0)
    return F.lit(None).cast("boolean")


def _is_iri(v: Value) -> Column:
    if v.kind == "term":
        return ~v.col.startswith('"') & ~v.col.startswith("_:") & ~v.col.startswith("<<")
    return F.when(v.col.isNotNull(), F.lit(v.kind == "iri" or v.kind.startswith("tpl:")))


def _is_literal(v: Value) -> Column:
    if v.kind == "term":
        return v.col.startswith('"')
    return F.when(v.col.isNotNull(), F.lit(v.kind != "iri" and not v.kind.startswith("tpl:")))


def java_replacement(r: str) -> str:
    """$name and ${1} as Java writes them."""
    return re.sub(r"\$\{(\d+)\}", r"$\1", r)


def _pattern(x: object, flags: object = None) -> str:
    if not isinstance(x, Lit):
        raise QueryError("a regular expression must be a constant")
    try:
        re.compile(x.lex)
    except re.error as e:
        raise QueryError(f"bad regular expression {x.lex!r}: {e}") from None
    return (f"(?{flags.lex})" if isinstance(flags, Lit) and flags.lex else "") + x.lex


def unify(values: list[Value]) -> list[Value]:
    """The same values with one kind."""
    kinds = {v.kind for v in values}
    if len(kinds) == 1:
        return values
    if kinds <= set(NUMERIC):
        return [Value(v.col.cast("double"), "double") for v in values]
    if all(k == "iri" or k.startswith("tpl:") for k in kinds):
        return [Value(lex(v), "iri") for v in values]
    return [Value(as_term(v), "term") for v in values]


def function(call: Call, args: list[Value], raw: tuple, registered: dict | None = None) -> Value:
    """A call whose arguments are compiled; raw are the same as written."""
    n = call.name
    text = lambda k: lex(args[k])
    if registered and n in registered:
        f, kind = registered[n]
        return Value(f(*(a.col for a in args)), kind)
    if n in ("&&", "||", "!"):
        t = [truth(a) for a in args]
        return Value(t[0] & t[1] if n == "&&" else t[0] | t[1] if n == "||" else ~t[0], "bool")
    if n == "=":
        return Value(equal(*args), "bool")
    if n == "!=":
        return Value(~equal(*args), "bool")
    if n in ("<", ">", "<=", ">="):
        return Value(compare(n, *args), "bool")
    if n in ("+", "-", "*", "/"):
        a, b = number(args[0]), number(args[1])
        if n == "/":
            return Value(F.try_divide(a.cast("double"), b.cast("double")), "double")
        f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[n]
        whole = args[0].kind == args[1].kind == "int"
        return Value(f(a.cast("bigint"), b.cast("bigint")) if whole else f(a.cast("double"), b.cast("double")), "int" if whole else "double")
    if n == "NEG":
        return Value(-number(args[0]), args[0].kind if args[0].kind in NUMERIC else "double")
    if n in ("IN", "NOT IN"):
        hit = F.lit(False)
        for o in args[1:]:
            hit = hit | equal(args[0], o)
        return Value(hit if n == "IN" else ~hit, "bool")
    if n == "BOUND":
        return Value(args[0].col.isNotNull(), "bool")
    if n == "STR":
        return Value(text(0), "string")
    if n in ("LCASE", "UCASE"):
        return Value((F.lower if n == "LCASE" else F.upper)(text(0)), "string")
    if n == "STRLEN":
        return Value(F.char_length(text(0)).cast("bigint"), "int")
    if n == "SUBSTR":
        start = args[1].col.cast("int")
        return Value(F.substr(text(0), start, args[2].col.cast("int")) if len(args) > 2 else F.substr(text(0), start), "string")
    if n == "REPLACE":
        if not isinstance(raw[2], Lit):
            raise QueryError("the replacement must be a constant")
        return Value(F.regexp_replace(text(0), _pattern(raw[1], raw[3] if len(raw) > 3 else None), java_replacement(raw[2].lex)), "string")
    if n == "CONCAT":
        return Value(F.concat(*(lex(a) for a in args)), "string")
    if n in ("CONTAINS", "STRSTARTS", "STRENDS"):
        f = {"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[n]
        return Value(f(text(0), text(1)), "bool")
    if n in ("STRBEFORE", "STRAFTER"):
        at = F.locate(raw[1].lex, text(0))
        cut = F.substr(text(0), F.lit(1), at - 1) if n == "STRBEFORE" else F.substr(text(0), at + len(raw[1].lex))
        return Value(F.when(at > 0, cut).otherwise(F.lit("")), "string")
    if n == "REGEX":
        return Value(text(0).rlike(_pattern(raw[1], raw[2] if len(raw) > 2 else None)), "bool")
    if n == "LANG":
        return Value(lang(args[0]), "string")
    if n == "LANGMATCHES":
        a, b = F.lower(text(0)), F.lower(text(1))
        return Value(F.when(b == "*", a != "").otherwise((a == b) | F.startswith(a, F.concat(b, F.lit("-")))), "bool")
    if n == "DATATYPE":
        return Value(datatype(args[0]), "iri")
    if n in ("ISIRI", "ISURI"):
        return Value(_is_iri(args[0]), "bool")
    if n == "ISLITERAL":
        return Value(_is_literal(args[0]), "bool")
    if n == "ISBLANK":
        return Value(args[0].col.startswith("_:") if args[0].kind == "term" else F.when(args[0].col.isNotNull(), F.lit(False)), "bool")
    if n == "ISNUMERIC":
        return Value(F.when(args[0].col.isNotNull(), number(args[0]).isNotNull()), "bool")
    if n == "SAMETERM":
        return Value(as_term(args[0]) == as_term(args[1]), "bool")
    if n == "COALESCE":
        u = unify(args)
        return Value(F.coalesce(*(x.col for x in u)), u[0].kind)
    if n == "IF":
        a, b = unify(args[1:])
        t = truth(args[0])
        return Value(F.when(t, a.col).when(~t, b.col), a.kind)
    if n in ("IRI", "URI"):
        return Value(text(0), "iri")
    if n in ("ABS", "CEIL", "FLOOR", "ROUND"):
        x = number(args[0])
        f = {"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": F.round}[n]
        return Value(f(x).cast("bigint" if args[0].kind == "int" else "double"), args[0].kind if args[0].kind == "int" else "double")
    if n in ("YEAR", "MONTH", "DAY", "HOURS", "MINUTES"):
        c = args[0].col if args[0].kind == "ts" else F.replace(text(0), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")
        f = {"YEAR": F.year, "MONTH": F.month, "DAY": F.day, "HOURS": F.hour, "MINUTES": F.minute}[n]
        return Value(f(c).cast("bigint"), "int")
    if n in ("MD5", "SHA1", "SHA256"):
        f = {"MD5": F.md5, "SHA1": F.sha1, "SHA256": lambda c: F.sha2(c, 256)}[n]
        return Value(f(text(0)), "string")
    if n.startswith(XSD):
        to = n[len(XSD) :]
        if to in ("integer", "int", "long"):
            return Value((number(args[0]) if args[0].kind in NUMERIC else text(0).try_cast("double")).try_cast("bigint"), "int")
        if to in ("double", "float", "decimal"):
            return Value(text(0).try_cast("double"), "double")
        if to == "string":
            return Value(text(0), "string")
        if to == "boolean":
            return Value(text(0).try_cast("boolean"), "bool")
        if to in ("dateTime", "date"):
            return Value(F.replace(text(0), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz"), "ts")
    raise QueryError(f"unknown function {n}")


# order


def order_columns(v: Value, ascending: bool) -> list[Column]:
    """Unbound, then blank nodes, IRIs, numbers by value, other literals by text; all turned round for a descending order."""
    if v.kind == "term":
        n, c = number(v), v.col
        rank = F.when(c.isNull(), 0).when(c.startswith("_:"), 1).when(~c.startswith('"'), 2).when(n.isNotNull(), 3).otherwise(4)
        keys = [rank, n, F.when(n.isNull(), lex(v))]
    elif v.kind.startswith("tpl:"):
        keys = [lex(v)]
    elif v.kind == "lang":
        keys = [v.col["lex"]]
    else:
        keys = [v.col]
    return [k.asc_nulls_first() if ascending else k.desc_nulls_last() for k in keys]
