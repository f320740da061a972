"""What a query means, independent of the language it was written in."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = RDF + "type"
#: Neutral vocabulary for vectors, temporal annotations and provenance; a Graph can be given another.
VOCABULARY = "http://thistle.example/vocab#"


class QueryError(ValueError):
    """The query is malformed, or asks for what can't be given."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Lit:
    lex: str
    dt: str | None = None
    lang: str | None = None


@dataclass(frozen=True)
class Quoted:
    s: Any
    p: Any
    o: Any


@dataclass(frozen=True)
class Inverse:
    path: Any


@dataclass(frozen=True)
class Sequence:
    steps: tuple


@dataclass(frozen=True)
class Alternative:
    choices: tuple


@dataclass(frozen=True)
class Repeat:
    """kind: + * or ?"""

    path: Any
    kind: str


@dataclass(frozen=True)
class Call:
    """An expression: operators by their sign, functions by their upper-case name."""

    name: str
    args: tuple
    distinct: bool = False


@dataclass(frozen=True)
class Exists:
    group: Any
    negated: bool = False


@dataclass(frozen=True)
class VectorScore:
    subject: Any
    predicate: Any
    vector: tuple


@dataclass
class Triple:
    s: Any
    p: Any
    o: Any
    exit: tuple | None = None


@dataclass
class Filter:
    expr: Any


@dataclass
class Optional:
    group: Group


@dataclass
class Minus:
    group: Group


@dataclass
class Union:
    branches: list[Group]


@dataclass
class Bind:
    expr: Any
    var: Var


@dataclass
class Values:
    vars: list[Var]
    rows: list[tuple]


@dataclass
class SubSelect:
    query: Query


@dataclass
class VectorSearch:
    subject: Any
    predicate: Any
    vector: tuple
    threshold: float
    k: int | None = None
    ef: int | None = None
    metric: str | None = None


@dataclass
class Temporal:
    """kind: at, during or diff"""

    kind: str
    times: tuple
    group: Group


@dataclass
class Group:
    parts: list = field(default_factory=list)


@dataclass
class Query:
    form: str = "SELECT"
    select: list = field(default_factory=list)  # (expression or None, Var); empty: all
    distinct: bool = False
    where: Group = field(default_factory=Group)
    group_by: list = field(default_factory=list)  # (expression, Var or None)
    having: list = field(default_factory=list)
    order_by: list = field(default_factory=list)  # (expression, ascending)
    limit: int | None = None
    offset: int | None = None
    template: list = field(default_factory=list)
    describe: list = field(default_factory=list)
    prefixes: dict = field(default_factory=dict)


def variables(x: Any) -> list[str]:
    """Names of the variables in a pattern, group or expression, in order of appearance."""
    out: dict[str, None] = {}

    def walk(y: Any) -> None:
        if isinstance(y, Var):
            out.setdefault(y.name)
        elif isinstance(y, SubSelect):
            for e, v in y.query.select:
                walk(v)
            if not y.query.select:
                walk(y.query.where)
        elif isinstance(y, list | tuple):
            for z in y:
                walk(z)
        elif hasattr(y, "__dataclass_fields__"):
            for f in y.__dataclass_fields__:
                walk(getattr(y, f))

    walk(x)
    return list(out)


def renamed(x: Any, old: str, new: str) -> Any:
    """x with a variable's name changed throughout."""
    if isinstance(x, Var):
        return Var(new) if x.name == old else x
    if isinstance(x, list):
        return [renamed(y, old, new) for y in x]
    if isinstance(x, tuple):
        return tuple(renamed(y, old, new) for y in x)
    if hasattr(x, "__dataclass_fields__"):
        return type(x)(**{f: renamed(getattr(x, f), old, new) for f in x.__dataclass_fields__})
    return x
