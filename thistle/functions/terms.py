"""Column expressions over RDF terms written as text. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

KG = "http://kg.example/"
#: The prefixes of TESTDATA.md.
PREFIXES = {"kge": KG + "entity/", "kgc": KG + "class/", "kgp": KG + "prop/"}
ENTITY = PREFIXES["kge"]
#: All white space of Unicode.
_WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ABSOLUTE = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)(.*)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without outer white space of any kind."""
    return F.btrim(_col(c), F.lit(_WS))


def _usual(c: Column, usual: str) -> Column:
    """Clean as it is: most terms are, and take no regular expression but on one character."""
    return c.startswith(usual) & F.right(c, F.lit(1)).rlike("[A-Za-z0-9/]")


def _cleaned(c: Column, prefixes: Mapping[str, str]) -> Column:
    t = F.btrim(c, F.lit(_WS + "<>"))
    scheme = F.lower(F.regexp_extract(t, _ABSOLUTE, 1))
    whole = F.concat(
        F.when(scheme == "https", F.lit("http")).otherwise(scheme),
        F.lit("://"),
        F.lower(F.regexp_extract(t, _ABSOLUTE, 2)),
        F.regexp_extract(t, _ABSOLUTE, 3),
    )
    other = F.when(F.contains(t, F.lit("://")) & t.rlike(_ABSOLUTE), whole).otherwise(t)
    for k, v in prefixes.items():
        other = F.when(t.startswith(k + ":"), F.concat(F.lit(v), F.substr(t, F.lit(len(k) + 2)))).otherwise(other)
    return other


def clean_iri(c: Column | str, prefixes: Mapping[str, str] = PREFIXES, usual: str = KG) -> Column:
    """One spelling for every IRI: outer white space and angle brackets removed, prefixes expanded, scheme and host in lower case, https as http.

    Null stays null, an empty string stays empty, text that is no IRI comes back trimmed. Terms that begin with `usual` and end in a
    letter, digit or slash are clean already and skip the regular expressions.
    """
    c = _col(c)
    return F.when(_usual(c, usual), c).otherwise(_cleaned(c, prefixes))


def is_literal(c: Column | str) -> Column:
    return strip(c).startswith('"')


def is_blank(c: Column | str) -> Column:
    return strip(c).startswith("_:")


def iri_of(c: Column | str, prefixes: Mapping[str, str] = PREFIXES, usual: str = KG) -> Column:
    """The clean IRI, or null where the term is anything else (literal, blank node, bare number or boolean, empty)."""
    c = _col(c)
    named = F.contains(c, F.lit("://"))
    for k in prefixes:
        named = named | F.contains(c, F.lit(k + ":"))
    x = _cleaned(c, prefixes)
    return F.when(_usual(c, usual), c).when(named & ~is_literal(c) & ~is_blank(c), F.when(x.rlike("^[a-z][a-z0-9+.\\-]*://"), x))


def lexical(c: Column | str) -> Column:
    """The text of a literal in quotes, escapes decoded; a bare value as it is; null for IRIs and blank nodes.

    A literal ends at its last quote; what follows is its tag. One without a closing quote goes to the end.
    """
    t = strip(c)
    tag = F.substring_index(t, '"', -1)
    size = F.char_length(t) - F.char_length(tag) - 2
    inner = F.substr(t, F.lit(2), F.when(size >= 0, size).otherwise(F.char_length(t)))
    mark = "\u0001"
    plain = inner
    for a, b in (("\\\\", mark), ('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), (mark, "\\")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    decoded = F.when(F.contains(t, F.lit("\\")), plain).otherwise(inner)
    return F.when(t.startswith('"'), decoded).when(~t.startswith("_:") & ~t.startswith("<") & ~(F.contains(t, F.lit(":")) & t.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*:")), t)


def quoted_lexical(c: Column | str) -> Column:
    """As lexical(), but null for everything that isn't in quotes."""
    return F.when(is_literal(c), lexical(c))


def words(c: Column | str) -> Column:
    """Maximal runs of letters of the lower-cased text, in order, repeats kept; null for null."""
    return F.filter(F.split(F.lower(_col(c)), r"[^\p{L}]+"), lambda w: w != "")


SIMPLE = ("integer", "decimal", "boolean", "date", "string")


_NUMBER = r"^[+\-]?([0-9]*)[.,]?([0-9]*)(?:[eE]([+\-]?[0-9]+))?$"


def _strip_zeros(c: Column) -> Column:
    return F.coalesce(F.nullif(F.ltrim(c, F.lit("0")), F.lit("")), F.lit("0"))


def _digits(v: Column) -> tuple[Column, Column]:
    """Of a number's text of any length the digits before and behind its mark, the exponent worked in."""
    whole, part = F.regexp_extract(v, _NUMBER, 1), F.regexp_extract(v, _NUMBER, 2)
    at = F.length(whole) + F.coalesce(F.regexp_extract(v, _NUMBER, 3).try_cast("int"), F.lit(0))
    every = F.concat(whole, part)
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
    front = F.concat(F.substr(every, F.lit(1), F.greatest(at, F.lit(0))), zeros(at - F.length(every)))
    back = F.concat(zeros(-at), F.substr(every, F.greatest(at, F.lit(0)) + 1))
    return front, back


def _plus_one(c: Column) -> Column:
    """A text of digits, of any length, one more."""
    head = F.rtrim(c, F.lit("9"))
    carried = F.repeat(F.lit("0"), F.length(c) - F.length(head))
    last = (F.right(head, F.lit(1)).try_cast("int") + 1).cast("string")
    return F.when(head == "", F.concat(F.lit("1"), carried)).otherwise(F.concat(F.substr(head, F.lit(1), F.length(head) - 1), last, carried))


def _any_length(v: Column) -> Column:
    """The integer and decimal normal forms of a number's text of any length, worked out on its digits; the integer is null where it isn't whole."""
    front, back = _digits(v)
    minus = lambda text, zero: F.when(v.startswith("-") & (text != zero), F.concat(F.lit("-"), text)).otherwise(text)
    whole = F.when(F.rtrim(back, F.lit("0")) == "", minus(_strip_zeros(front), "0"))
    cents = F.concat(front, F.rpad(F.substr(back, F.lit(1), F.lit(2)), 2, "0"))
    cents = F.when(F.substr(back, F.lit(3), F.lit(1)) >= "5", _plus_one(cents)).otherwise(cents)
    fixed = F.concat(_strip_zeros(F.substr(cents, F.lit(1), F.length(cents) - 2)), F.lit("."), F.right(cents, F.lit(2)))
    return F.struct(whole.alias("whole"), minus(fixed, "0.00").alias("fixed"))


def with_value(df: DataFrame, kind: str, term: str, out: str) -> DataFrame:
    """df with `out`: the normal form of a literal of a simple type, or null where it doesn't read as one value of the type.

    integer and decimal: an optional sign, any number of digits, a point or comma as decimal mark, an exponent of up to three digits; an
    integer must be whole, a decimal is rounded half up to two places, zero has no sign. Short numbers are worked out as decimals, all others
    on their digits, so none is lost or rounded. Worked out in steps (columns _v, _n and _l, dropped again), so that nothing is computed twice.
    """
    k, v, num = F.col(kind), F.col("_v"), F.col("_n")
    df = df.withColumn("_v", F.when(k.isin(*SIMPLE), strip(lexical(term))))
    is_number = k.isin("integer", "decimal") & v.rlike(r"^[+\-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+\-]?[0-9]{1,3})?$")
    short = v.rlike(r"^[+\-]?[0-9]{0,28}([.,][0-9]{0,10})?$")
    df = df.withColumn("_n", F.when(is_number & short, F.replace(v, F.lit(","), F.lit(".")).try_cast("decimal(38,10)")))
    # inside a lambda, as such rows are few and the expression is too large to be compiled into every query
    df = df.withColumn("_l", F.when(is_number & num.isNull(), F.transform(F.array(v), _any_length)[0]))
    whole = F.when(num.isNotNull(), F.when(num == F.floor(num), num.cast("decimal(38,0)").cast("string"))).otherwise(F.col("_l.whole"))
    fixed = F.when(num.isNotNull(), F.round(num, 2).cast("decimal(38,2)").cast("string")).otherwise(F.col("_l.fixed"))
    low = F.lower(v)
    truth = F.when(low.isin("true", "yes", "t", "1"), F.lit("true")).when(low.isin("false", "no", "f", "0"), F.lit("false"))
    iso, dot, run = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?:[Tt ].*|Z|[+\-][0-9:]+)?$", r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})(?:[Tt ].*)?$", r"^([0-9]{4})([0-9]{2})([0-9]{2})(?:[Tt ].*)?$"

    def day(pattern: str, y: int, m: int, d: int) -> Column:
        part = lambda k: F.lpad(F.regexp_extract(v, pattern, k), 4 if k == y else 2, "0")
        return F.concat_ws("-", part(y), part(m), part(d)).try_cast("date")

    date = F.when(v.rlike(iso), day(iso, 1, 2, 3)).when(v.rlike(dot), day(dot, 3, 2, 1)).when(v.rlike(run), day(run, 1, 2, 3))
    text = (
        F.when(k == "integer", whole)
        .when(k == "decimal", fixed)
        .when(k == "boolean", truth)
        .when(k == "date", F.date_format(date, "yyyy-MM-dd"))
        .when(k == "string", F.when(v != "", v))
    )
    return df.withColumn(out, text).drop("_v", "_n", "_l")


def where_any(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which one of the columns isn't null, without computing what is behind these columns a second time for the test.

    An ordinary filter is pushed below the projection and takes the expressions with it.
    """
    cols = [F.col(c) for c in columns]
    keep = F.array_compact(F.array(*(F.when(c.isNotNull(), F.lit(1)) for c in cols)))
    return df.select("*", F.explode(F.slice(keep, 1, 1)).alias("_keep")).drop("_keep")


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, read as UTC whatever the session's zone."""
    c = _col(c)
    clock = (F.hour(c).cast("long") * 3600 + F.minute(c) * 60) * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.date_diff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000 + clock
