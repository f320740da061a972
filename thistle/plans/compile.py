"""Query algebra to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import count
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from ..functions.values import Value
from ..operators import paths, temporal, vector
from ..runtime import cut
from . import ast as A
from .mapping import TableMap
from .sparql import is_aggregate

if TYPE_CHECKING:
    from ..graph import Graph


@dataclass
class Rel:
    """Solutions: a column per variable. maybe: variables that can be unbound. scores: vector score -> column."""

    df: DataFrame
    vars: dict[str, str]
    maybe: set[str] = field(default_factory=set)
    scores: dict[A.VectorScore, str] = field(default_factory=dict)
    size: float = 1e6

    def value(self, name: str) -> Value:
        return Value(F.col(f"`{name}`"), self.vars[name]) if name in self.vars else Value(F.lit(None).cast("string"), "term")

    def where(self, cond: Column) -> Rel:
        return replace(self, df=self.df.where(cond))


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


class Compiler:
    def __init__(self, graph: Graph):
        self.g, self.scope, self.fresh = graph, None, count()
        self.spark = graph.spark

    def name(self, hint: str) -> str:
        return f"__{hint}{next(self.fresh)}"

    def unit(self) -> Rel:
        return Rel(self.spark.range(1).select(F.lit(True).alias("__unit")), {}, size=1)

    def empty(self, names: list[str]) -> Rel:
        return Rel(self.spark.range(0).select(*(F.lit(None).cast("string").alias(n) for n in names), F.lit(True).alias("__unit")), {n: "term" for n in names}, size=0)

    # joins

    def project(self, r: Rel, names: list[str]) -> Rel:
        keep = [n for n in names if n in r.vars]
        return Rel(r.df.select(*(_q(n) for n in keep), *(_q(c) for c in r.scores.values())) if keep or r.scores else r.df.select(F.lit(True).alias("__unit")), {n: r.vars[n] for n in keep}, r.maybe & set(keep), r.scores, r.size)

    def _conditions(self, a: Rel, b: Rel, shared: list[str], right: dict[str, str]) -> Column | None:
        cond = None
        for x in shared:
            va, vb = a.value(x), Value(_q(right[x]), b.vars[x])
            c = self._same(va, vb)
            if x in a.maybe:
                c = c | va.col.isNull()
            if x in b.maybe:
                c = c | vb.col.isNull()
            cond = c if cond is None else cond & c
        return cond

    @staticmethod
    def _same(a: Value, b: Value) -> Column:
        """Join equality; plain on one kind, so that it stays an equi-join."""
        if a.kind == b.kind and a.kind not in ("lang", "vec"):
            return a.col == b.col
        if {a.kind, b.kind} <= set(V.NUMERIC):
            return a.col.cast("double") == b.col.cast("double")
        iri = lambda k: k == "iri" or k.startswith("tpl:")
        if iri(a.kind) and iri(b.kind):
            return V.lex(a) == V.lex(b)
        return V.as_term(a) == V.as_term(b)

    def _split(self, a: Rel, x: str, bound: bool) -> Rel:
        if bound:
            return Rel(a.df.where(_q(x).isNotNull()), a.vars, a.maybe - {x}, a.scores, a.size)
        return Rel(a.df.where(_q(x).isNull()).drop(x), {k: v for k, v in a.vars.items() if k != x}, a.maybe - {x}, a.scores, a.size)

    def join(self, a: Rel, b: Rel, how: str = "inner", extra: Any = None) -> Rel:
        """Joins on all shared variables; an unbound variable fits anything. extra: filters that belong to the condition."""
        if not a.vars and not a.scores and how == "inner" and a.size == 1 and a.df.columns == ["__unit"]:
            return b
        shared = [x for x in a.vars if x in b.vars]
        for x in shared:
            if x in a.maybe:
                return self.union([self.join(self._split(a, x, True), b, how, extra), self.join(self._split(a, x, False), b, how, extra)])
            if x in b.maybe and how == "inner":
                return self.union([self.join(a, self._split(b, x, True), how, extra), self.join(a, self._split(b, x, False), how, extra)])
        right = {x: self.name("r") for x in shared}
        other = b.df.drop("__unit").withColumnsRenamed(right) if shared or "__unit" in b.df.columns else b.df
        clash = {c: self.name("c") for c in other.columns if c in a.df.columns}
        other = other.withColumnsRenamed(clash)
        scores = {**a.scores, **{k: clash.get(c, c) for k, c in b.scores.items()}}
        cond = self._conditions(a, b, shared, right)
        for f in extra or []:
            both = Rel(a.df, {**b.vars, **a.vars}, a.maybe | b.maybe, scores)
            c = V.truth(self.expr(f, both))
            cond = c if cond is None else cond & c
        if how in ("left_semi", "left_anti"):
            df = a.df.join(other, cond if cond is not None else F.lit(True), how)
            return replace(a, df=df)
        if cond is None:
            df = a.df.crossJoin(other) if how == "inner" else a.df.join(other, F.lit(True), how)
        else:
            df = a.df.join(other, cond, how)
        maybe = a.maybe | b.maybe | ({x for x in b.vars if x not in a.vars} if how == "left" else set())
        df = df.drop(*right.values())
        est = max(a.size, b.size) if shared else a.size * b.size
        return Rel(df, {**b.vars, **a.vars}, maybe - {x for x in shared if x not in a.maybe}, scores, est)

    def union(self, rels: list[Rel]) -> Rel:
        names = list(dict.fromkeys(x for r in rels for x in r.vars))
        kinds, columns = {}, [[] for _ in rels]
        for x in names:
            have = [(i, r.value(x)) for i, r in enumerate(rels) if x in r.vars]
            same = V.unify([v for _, v in have])
            kinds[x] = same[0].kind
            of = {i: v.col for (i, _), v in zip(have, same, strict=True)}
            for i, _r in enumerate(rels):
                columns[i].append(of[i].alias(x) if i in of else F.lit(None).alias(x))
        keys = list(dict.fromkeys(k for r in rels for k in r.scores))
        scores = {k: self.name("score") for k in keys}
        parts = [r.df.select(*columns[i], *((_q(r.scores[k]) if k in r.scores else F.lit(None).cast("double")).alias(scores[k]) for k in keys), F.lit(True).alias("__unit")) for i, r in enumerate(rels)]
        df = parts[0]
        for p in parts[1:]:
            df = df.union(p)
        maybe = {x for x in names if any(x not in r.vars or x in r.maybe for r in rels)}
        return Rel(df.drop("__unit") if names or keys else df, kinds, maybe, scores, sum(r.size for r in rels))

    # groups

    def group(self, g: A.Group, filters: list | None = None, seed: Rel | None = None) -> Rel:
        """filters: takes the group's own filters instead of their being applied (they are then part of an outer join's condition)."""
        r, own, basic, hidden = seed or self.unit(), [], [], []
        for part in g.parts:
            # steps of a path that are single patterns take part in the order of joins like all others
            if (plain := self._plain(part, hidden)) is not None:
                basic += plain
                continue
            if isinstance(part, A.Filter):
                own.append(part.expr)
                continue
            if basic:
                r, basic = self.join(r, self.basic(basic)), []
            r = self.part(r, part)
        if basic:
            r = self.join(r, self.basic(basic))
        if gone := [x for x in hidden if x in r.vars]:
            r = Rel(r.df.drop(*gone), {k: v for k, v in r.vars.items() if k not in gone}, r.maybe - set(gone), r.scores, r.size)
        if filters is not None:
            filters.extend(own)
            return r
        for f in own:
            r = self.filter(r, f)
        return r

    def _plain(self, t: Any, hidden: list[str]) -> list[A.Triple] | None:
        """A pattern as patterns without paths, with the names of the variables between; None where that isn't possible."""
        if not isinstance(t, A.Triple) or isinstance(t.p, A.Repeat | A.Alternative):
            return None
        if isinstance(t.p, A.Inverse):
            return self._plain(A.Triple(t.o, t.p.path, t.s), hidden)
        if not isinstance(t.p, A.Sequence):
            return [t]
        if len(t.p.steps) == 2 and self._kept(t.p) is not None:
            return None
        out, at, names = [], t.s, [self.name("m") for _ in t.p.steps[1:]]
        for step, to in zip(t.p.steps, [*map(A.Var, names), t.o], strict=True):
            plain = self._plain(A.Triple(at, step, to), hidden)
            if plain is None:
                return None
            out += plain
            at = to
        hidden += names
        return out

    def _kept(self, path: A.Sequence) -> DataFrame | None:
        if not all(isinstance(x, A.Iri) for x in path.steps) or self.scope is not None or self.g.tables:
            return None
        return self.g.chains.get(tuple(x.value for x in path.steps))

    def part(self, r: Rel, p: Any) -> Rel:
        if isinstance(p, A.Triple):
            return self.path_pattern(r, p)
        if isinstance(p, A.Group):
            return self.join(r, self.group(p)) if any(not isinstance(x, A.Filter) for x in p.parts) else self._all(r, p)
        if isinstance(p, A.Optional):
            extra: list = []
            inner = self.group(p.group, extra)
            plain = [f for f in extra if not _has_exists(f)]
            for f in extra:
                if _has_exists(f):
                    inner = self.filter(inner, f)
            return self.join(r, inner, "left", plain)
        if isinstance(p, A.Minus):
            inner = self.group(p.group)
            shared = [x for x in r.vars if x in inner.vars]
            return self.join(r, self.project(inner, shared), "left_anti") if shared else r
        if isinstance(p, A.Union):
            return self.join(r, self.union([self.group(b) for b in p.branches]))
        if isinstance(p, A.Bind):
            if p.var.name in r.vars:
                raise A.QueryError(f"?{p.var.name} is bound already")
            r = self.prepare(r, [p.expr])
            v = self.expr(p.expr, r)
            return Rel(r.df.withColumn(p.var.name, v.col), {**r.vars, p.var.name: v.kind}, r.maybe | {p.var.name}, r.scores, r.size)
        if isinstance(p, A.Values):
            return self.join(r, self.inline(p))
        if isinstance(p, A.SubSelect):
            return self.join(r, self.select(p.query))
        if isinstance(p, A.VectorSearch):
            return self.search(r, p)
        if isinstance(p, A.Temporal):
            return self.in_time(r, p)
        raise A.QueryError(f"can't evaluate {p!r}")

    def _all(self, r: Rel, g: A.Group) -> Rel:
        for f in g.parts:
            r = self.filter(r, f.expr)
        return r

    def inline(self, p: A.Values) -> Rel:
        columns = []
        for k in range(len(p.vars)):
            vals = [V.constant(row[k]) if row[k] is not None else None for row in p.rows]
            kinds = V.unify([v for v in vals if v is not None]) if any(v is not None for v in vals) else []
            it = iter(kinds)
            columns.append(([next(it).col if v is not None else F.lit(None) for v in vals], kinds[0].kind if kinds else "term"))
        names = [v.name for v in p.vars]
        if not p.rows:
            return self.empty(names)
        rows = F.array(*(F.struct(*(c[i].alias(n) for (c, _), n in zip(columns, names, strict=True))) for i in range(len(p.rows))))
        maybe = {n for k, n in enumerate(names) if any(row[k] is None for row in p.rows)}
        return Rel(self.spark.range(1).select(F.inline(rows)), {n: k for (_, k), n in zip(columns, names, strict=True)}, maybe, size=len(p.rows))

    # scans

    def basic(self, triples: list[A.Triple]) -> Rel:
        """A set of triple patterns: those of one subject are merged into one scan, scans are joined cheapest first, along shared variables."""
        extra: list[A.Triple] = []
        plain: list[A.Triple] = []
        for t in triples:
            s, p, o = t.s, t.p, t.o
            if isinstance(s, A.Quoted):
                s = self._quoted_var(s, extra)
            if isinstance(o, A.Quoted):
                o = self._quoted_var(o, extra)
            plain.append(A.Triple(s, p, o))
        stars: dict[Any, list[A.Triple]] = {}
        for t in plain:
            stars.setdefault(t.s, []).append(t)
        rels = [self.star(s, ts) for s, ts in stars.items()] + [self.quoted_scan(t) for t in extra]
        done = rels.pop(min(range(len(rels)), key=lambda i: (rels[i].size, i)))
        while rels:
            linked = [i for i, r in enumerate(rels) if any(x in done.vars for x in r.vars)] or range(len(rels))
            done = self.join(done, rels.pop(min(linked, key=lambda i: (rels[i].size, i))))
        return done

    def _quoted_var(self, q: A.Quoted, extra: list) -> Any:
        parts = []
        for x in (q.s, q.p, q.o):
            parts.append(self._quoted_var(x, extra) if isinstance(x, A.Quoted) else x)
        if not any(isinstance(x, A.Var) for x in parts):
            return A.Iri(quoted_key(*(constant_term(x) for x in parts)))
        v = A.Var(self.name("q"))
        extra.append(A.Triple(v, ("quoted",), tuple(parts)))
        return v

    def quoted_scan(self, t: A.Triple) -> Rel:
        if self.g.quoted is None:
            return self.empty([t.s.name, *(x.name for x in t.o if isinstance(x, A.Var))])
        df = self.g.quoted
        out = {t.s.name: "term"}
        cols = [_q("key").alias(t.s.name)]
        for x, c in zip(t.o, ("qs", "qp", "qo"), strict=True):
            if isinstance(x, A.Var):
                if x.name in out:
                    df = df.where(_q(c) == next(k for k, n in zip(("qs", "qp", "qo"), t.o, strict=True) if n == x and k != c))
                    continue
                out[x.name] = "term"
                cols.append(_q(c).alias(x.name))
            else:
                df = df.where(_q(c) == constant_term(x))
        return Rel(df.select(*cols), out)

    def star(self, s: Any, triples: list[A.Triple]) -> Rel:
        fixed = [t for t in triples if isinstance(t.p, A.Iri)]
        free = [t for t in triples if not isinstance(t.p, A.Iri)]
        rels = []
        if fixed:
            tables = [m for m in self.g.tables if all(self._fits(m, t) for t in fixed)]
            if tables and self.g.merge_stars:
                rels.append(self._one([self.scan_table(m, s, fixed) for m in tables] + ([self.scan_triples(s, fixed)] if self.g.could_hold(fixed) else []), s, fixed))
            else:
                for t in fixed:
                    parts = [self.scan_table(m, s, [t]) for m in self.g.tables if self._fits(m, t)]
                    if self.g.could_hold([t]):
                        parts.append(self.scan_triples(s, [t]))
                    rels.append(self._one(parts, s, [t]))
                if not self.g.tables and (one := self.scan_star(s, fixed)) is not None:
                    rels[-len(fixed) :] = [one]
        for t in free:
            parts = [self.scan_any(m, s, t) for m in self.g.tables]
            if self.g.triples is not None:
                parts.append(self.scan_triples(s, [t]))
            rels.append(self._one([p for p in parts if p is not None], s, [t]))
        done = rels[0]
        for r in rels[1:]:
            done = self.join(done, r)
        return done

    def _one(self, parts: list[Rel | None], s: Any, triples: list[A.Triple]) -> Rel:
        parts = [p for p in parts if p is not None]
        if not parts:
            return self.empty(A.variables([s, [(t.p, t.o) for t in triples]]))
        return parts[0] if len(parts) == 1 else self.union(parts)

    @staticmethod
    def _fits(m: TableMap, t: A.Triple) -> bool:
        if t.p.value == A.RDF_TYPE and isinstance(t.o, A.Iri):
            return t.o.value == m.cls
        return m.has(t.p.value)

    def _visible(self, starts: Column, ends: Column, asserted: Column) -> Column:
        kind, *times = self.scope
        return temporal.visible_at(starts, ends, asserted, times[0]) if kind == "at" else temporal.overlaps(starts, ends, asserted, *times)

    def _table(self, m: TableMap) -> DataFrame:
        if self.scope is None or not (m.valid_from or m.valid_to or m.asserted_at):
            return m.df
        secs = lambda c: F.array(seconds(m.df, c)) if c else F.array().cast("array<bigint>")
        return m.df.where(self._visible(secs(m.valid_from), secs(m.valid_to), secs(m.asserted_at)))

    def _subject(self, m: TableMap, df: DataFrame, s: Any) -> tuple[DataFrame | None, list[Column], dict[str, str]]:
        key = F.col(m.key) if m.key else F.struct(*m.df.columns)
        if isinstance(s, A.Var):
            return df, [key.alias(s.name)], {s.name: "tpl:" + m.prefix}
        k = V.template_key(s.value, m.prefix, m.df.schema[m.key].dataType.simpleString()) if m.key and isinstance(s, A.Iri) else None
        return (None, [], {}) if k is None else (df.where(key == k), [], {})

    def scan_table(self, m: TableMap, s: Any, triples: list[A.Triple]) -> Rel | None:
        df, cols, kinds = self._subject(m, self._table(m), s)
        if df is None:
            return None
        size, where = m.size, {}
        if isinstance(s, A.Var):
            where[s.name] = F.col(m.key) if m.key else F.struct(*m.df.columns)
        for t in triples:
            if t.p.value == A.RDF_TYPE:
                if isinstance(t.o, A.Var) and t.o.name not in kinds:
                    kinds[t.o.name] = "iri"
                    cols.append(F.lit(m.cls).alias(t.o.name))
                continue
            prop = m.props[t.p.value]
            c = F.col(prop.column)
            if prop.kind == "ts":
                c = c.cast("timestamp_ntz")
            elif prop.kind == "int":
                c = c.cast("bigint")
            kind = "tpl:" + prop.target if prop.kind == "tpl" else prop.kind
            if isinstance(t.o, A.Var):
                df = df.where(F.col(prop.column).isNotNull())
                if t.o.name in kinds:
                    df = df.where(self._same(Value(where[t.o.name], kinds[t.o.name]), Value(c, kind)))
                else:
                    kinds[t.o.name], where[t.o.name] = kind, c
                    cols.append(c.alias(t.o.name))
                continue
            size /= 20
            if kind.startswith("tpl:"):
                k = V.template_key(t.o.value, prop.target, m.df.schema[prop.column].dataType.simpleString()) if isinstance(t.o, A.Iri) else None
                if k is None:
                    return None
                df = df.where(F.col(prop.column) == k)
            else:
                df = df.where(V.equal(Value(F.col(prop.column), prop.kind), V.constant(t.o)))
        if not isinstance(s, A.Var):
            size = 1
        return Rel(df.select(*cols) if cols else df.select(F.lit(True).alias("__unit")), kinds, size=max(size, 1))

    def scan_any(self, m: TableMap, s: Any, t: A.Triple) -> Rel | None:
        """A variable predicate over one table: all columns turned into rows in one scan."""
        df, cols, kinds = self._subject(m, self._table(m), s)
        if df is None:
            return None
        cells = [F.struct(F.lit(A.RDF_TYPE).alias("p"), F.lit(m.cls).alias("o"))]
        for iri, prop in m.props.items():
            c = F.col(prop.column)
            v = Value(c.cast("timestamp_ntz") if prop.kind == "ts" else c, "tpl:" + prop.target if prop.kind == "tpl" else prop.kind)
            cells.append(F.struct(F.lit(iri).alias("p"), V.as_term(v).alias("o")))
        df = df.select(*cols, F.inline(F.array(*cells))).where("o is not null")
        rename = {}
        out = [_q(s.name)] if isinstance(s, A.Var) else []
        for x, c, kind in ((t.p, "p", "iri"), (t.o, "o", "term")):
            if isinstance(x, A.Var):
                if x.name in kinds:
                    df = df.where(self._same(Value(rename.get(x.name, _q(x.name)), kinds[x.name]), Value(F.col(c), kind)))
                    continue
                kinds[x.name], rename[x.name] = kind, F.col(c)
                out.append(F.col(c).alias(x.name))
            else:
                df = df.where(V.equal(Value(F.col(c), kind), V.constant(x)) if c == "o" else F.col(c) == x.value)
        return Rel(df.select(*out) if out else df.select(F.lit(True).alias("__unit")), kinds, size=m.size * len(m.props))

    def scan_star(self, s: Any, triples: list[A.Triple]) -> Rel | None:
        """Patterns of one subject over a table found among the statements, where its columns hold all of the predicates' statements."""
        if self.scope is not None or len(triples) < 2 or any(not isinstance(t.p, A.Iri) for t in triples):
            return None
        for rows, columns in self.g.stars if self.g.merge_stars else []:
            if not all(t.p.value in columns for t in triples):
                continue
            names: dict[str, str] = {s.name: "node"} if isinstance(s, A.Var) else {}
            df = rows if names else rows.where(F.col("node") == constant_term(s))
            size = self.g.size
            for t in triples:
                c = columns[t.p.value]
                if not isinstance(t.o, A.Var):
                    df, size = df.where(_q(c) == constant_term(t.o)), size / 20
                elif t.o.name in names:
                    df = df.where(_q(c) == _q(names[t.o.name]))
                else:
                    df = df.where(_q(c).isNotNull())
                    names[t.o.name] = c
            return Rel(df.select(*(_q(c).alias(n) for n, c in names.items())) if names else df.select(F.lit(True).alias("__unit")), dict.fromkeys(names, "term"), size=max(1, size / 100))
        return None

    def scan_triples(self, s: Any, triples: list[A.Triple]) -> Rel | None:
        """Patterns over the statement table, one scan each, unless a table found in it serves them all."""
        if (done := self.scan_star(s, triples)) is not None:
            return done
        for t in triples:
            df = self.g.statements(self.scope, self._visible)
            kinds, cols = {}, []
            size = self.g.estimate(t.p.value if isinstance(t.p, A.Iri) else None)
            for x, c, kind in ((s, "s", "term"), (t.p, "p", "iri"), (t.o, "o", "term")):
                if isinstance(x, A.Var):
                    if x.name in kinds:
                        first = next(k for k, a in zip(("s", "p"), (s, t.p), strict=True) if a == x)
                        df = df.where(F.col(first) == F.col(c))
                        continue
                    kinds[x.name] = kind
                    cols.append(F.col(c).alias(x.name))
                else:
                    size /= 20 if c != "p" or not self.g.rows_of else 1
                    df = df.where(F.col(c) == constant_term(x))
            r = Rel(df.select(*cols) if cols else df.select(F.lit(True).alias("__unit")), kinds, size=max(1, size))
            done = r if done is None else self.join(done, r)
        return done

    # paths

    def path_pattern(self, r: Rel, t: A.Triple) -> Rel:
        if isinstance(t.p, A.Sequence):
            kept = self._kept(t.p) if len(t.p.steps) == 2 else None
            if kept is not None:
                return self.join(r, self._pairs(kept.select(F.col("s").alias("src"), F.col("o").alias("dst")), t))
            parts, at = [], t.s
            for k, step in enumerate(t.p.steps):
                to = t.o if k == len(t.p.steps) - 1 else A.Var(self.name("m"))
                parts.append(A.Triple(at, step, to))
                at = to
            out = self.group(A.Group(parts), seed=r)
            hidden = [p.o.name for p in parts[:-1]]
            return Rel(out.df.drop(*hidden), {k: v for k, v in out.vars.items() if k not in hidden}, out.maybe - set(hidden), out.scores, out.size)
        if isinstance(t.p, A.Alternative):
            return self.join(r, self.union([self.group(A.Group([A.Triple(t.s, c, t.o)])) for c in t.p.choices]))
        if isinstance(t.p, A.Inverse):
            return self.group(A.Group([A.Triple(t.o, t.p.path, t.s)]), seed=r)
        return self.join(r, self.repeat(r, t))

    def edges(self, path: Any) -> DataFrame:
        r = self.group(A.Group([A.Triple(A.Var("__s"), path, A.Var("__o"))]))
        return r.df.select(V.as_term(r.value("__s")).alias("src"), V.as_term(r.value("__o")).alias("dst"))

    def repeat(self, r: Rel, t: A.Triple) -> Rel:
        """+, * and ?, each pair once. The side that is known already (a constant, or a variable bound before) is where the search begins."""
        e = self.edges(t.p.path)
        kind = t.p.kind

        def known(x: Any) -> DataFrame | None:
            if not isinstance(x, A.Var):
                return self.spark.range(1).select(F.lit(constant_term(x)).alias("src"))
            if x.name in r.vars and x.name not in r.maybe:
                return cut(r.df.select(V.as_term(r.value(x.name)).alias("src")).distinct())
            return None

        start, end = known(t.s), known(t.o)
        backwards = start is None and end is not None and not t.exit
        if backwards:
            e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            start = end
        if t.exit and start is None:
            start = e.select("src").distinct()
        if kind == "?":
            pairs = e if start is None else e.join(start, "src", "left_semi")
            pairs = pairs.distinct()
        elif t.exit and t.exit[0] != "until":
            scores = self.similarity(t.exit[1])
            pairs = paths.greedy(e, scores, start, self.g.depth) if t.exit[0] == "greedy" else paths.beam(e, scores, start, t.exit[2])
        else:
            stop = None
            if t.exit:
                if not isinstance(t.o, A.Var):
                    raise A.QueryError("UNTIL needs a variable at the path's end")
                nodes = e.select(F.col("dst").alias(t.o.name)).unionByName(start.select(F.col("src").alias(t.o.name))).distinct()
                hit = self.filter(Rel(nodes, {t.o.name: "term"}), t.exit[1])
                stop = cut(hit.df.select(F.col(t.o.name).alias("node")))
                if kind == "*":
                    own = start.join(stop.select(F.col("node").alias("src")), "src", "left_semi")
                    start = start.join(stop.select(F.col("node").alias("src")), "src", "left_anti")
            pairs = paths.closure(e, start, self.g.depth, stop)
            if t.exit and kind == "*":
                pairs = pairs.unionByName(own.select("src", F.col("src").alias("dst")))
        if kind in "*?" and not t.exit:
            zero = start if start is not None else self._nodes()
            pairs = pairs.unionByName(zero.select("src", F.col("src").alias("dst"))).distinct()
        if backwards:
            pairs = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return self._pairs(pairs, t)

    @staticmethod
    def _pairs(pairs: DataFrame, t: A.Triple) -> Rel:
        """(src, dst) pairs as solutions of a pattern's ends."""
        kinds, cols = {}, []
        for x, c in ((t.s, "src"), (t.o, "dst")):
            if not isinstance(x, A.Var):
                pairs = pairs.where(F.col(c) == constant_term(x))
            elif x.name in kinds:
                pairs = pairs.where("src = dst")
            else:
                kinds[x.name] = "term"
                cols.append(F.col(c).alias(x.name))
        return Rel(pairs.select(*cols) if cols else pairs.select(F.lit(True).alias("__unit")), kinds)

    def _nodes(self) -> DataFrame:
        """Every subject and object."""
        r = self.star(A.Var("__s"), [A.Triple(A.Var("__s"), A.Var("__p"), A.Var("__o"))])
        both = F.explode(F.array(V.as_term(r.value("__s")), V.as_term(r.value("__o"))))
        return r.df.select(both.alias("src")).distinct()

    def similarity(self, vec: tuple) -> DataFrame:
        """(node, score): of every node with vectors of that length the best cosine."""
        parts = [self.vectors(p).df for p in self.g.vector_predicates()]
        if not parts:
            raise A.QueryError("the graph has no vectors")
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        return df.select(F.col("node"), vector.score(F.col("vec"), vec).alias("score")).where("score is not null").groupBy("node").agg(F.max("score").alias("score"))

    # vectors

    def vectors(self, predicate: str) -> Rel:
        r = self.star(A.Var("__s"), [A.Triple(A.Var("__s"), A.Iri(predicate), A.Var("__v"))])
        v = r.value("__v")
        vec = v.col if v.kind == "vec" else F.transform(F.split(F.trim(V.lex(v)), r"\s+"), lambda x: x.try_cast("double"))
        return Rel(r.df.select(V.as_term(r.value("__s")).alias("node"), vec.cast("array<double>").alias("vec")), {})

    def scored(self, key: A.VectorScore, metric: str | None, k: int | None = None, least: float | None = None) -> Rel:
        """Subjects with their best score. Without k every vector is scored exactly; with k only the k best pass."""
        if not isinstance(key.predicate, A.Iri):
            raise A.QueryError("a vector search needs a constant predicate")
        known = self.g.vector_metric(key.predicate.value)
        if known is None and key.predicate.value not in self.g.vector_predicates():
            raise A.QueryError(f"no vectors under <{key.predicate.value}>")
        name = key.subject.name if isinstance(key.subject, A.Var) else self.name("s")
        triple = A.Triple(A.Var(name), key.predicate, A.Var("__v"))
        r = self.basic([triple])
        v = r.value("__v")
        vec = v.col if v.kind == "vec" else F.transform(F.split(F.trim(V.lex(v)), r"\s+"), lambda x: x.try_cast("double"))
        score = self.name("score")
        df = r.df.select(_q(name), vector.score(vec, key.vector, metric or known or "cosine").alias(score)).where(_q(score).isNotNull())
        if k is not None:
            df = df.orderBy(F.desc(score), V.as_term(Value(_q(name), r.vars[name]))).limit(k)
        if least is not None:
            df = df.where(_q(score) >= least)
        df = df.groupBy(_q(name)).agg(F.max(score).alias(score))
        out = Rel(df, {name: r.vars[name]}, scores={key: score}, size=max(1, r.size / 10))
        if not isinstance(key.subject, A.Var):
            out = out.where(self._same(out.value(name), Value(F.lit(constant_term(key.subject)), "term")))
            out = Rel(out.df.drop(name), {}, scores=out.scores)
        return out

    def search(self, r: Rel, p: A.VectorSearch) -> Rel:
        subject, extra = p.subject, []
        if isinstance(subject, A.Quoted):
            subject = self._quoted_var(subject, extra)
        if subject != p.subject:
            for t in extra:
                r = self.join(r, self.quoted_scan(t))
        found = self.scored(A.VectorScore(subject, p.predicate, p.vector), p.metric, p.k, p.threshold)
        out = self.join(r, found)
        return out

    def prepare(self, r: Rel, exprs: list) -> Rel:
        """Adds a column for each VECTOR_SCORE that the expressions need and no search has left."""
        for s in _find(exprs, A.VectorScore):
            if s not in r.scores:
                found = self.scored(s, None)
                if isinstance(s.subject, A.Var) and s.subject.name in r.vars:
                    r = self.join(r, found, "left")
                else:
                    r = self.join(r, found)
        return r

    # time

    def moment(self, x: Any, r: Rel) -> int:
        if isinstance(x, A.Var):
            v = r.value(x.name)
            row = r.df.where(v.col.isNotNull()).select((v.col if v.kind == "int" else V.lex(v)).alias("t")).limit(1).collect()
            if not row:
                raise A.QueryError(f"?{x.name} is unbound")
            return row[0]["t"] if isinstance(row[0]["t"], int) else temporal.parse(row[0]["t"])[0]
        if isinstance(x, A.Lit):
            return int(x.lex) if x.dt == A.XSD + "integer" else temporal.parse(x.lex)[0]
        raise A.QueryError("a time must be a literal or a variable")

    def in_time(self, r: Rel, p: A.Temporal) -> Rel:
        times = [self.moment(t, r) for t in p.times]
        outer = self.scope
        try:
            if p.kind != "diff":
                self.scope = (p.kind, *times)
                return self.join(r, self.group(p.group))
            sides = []
            for t in times:
                self.scope = ("at", t)
                sides.append(self.group(p.group))
        finally:
            self.scope = outer
        both = self.union([Rel(x.df.withColumn("__t", F.lit(k)), {**x.vars, "__t": "int"}, x.maybe) for k, x in enumerate(sides)])
        names = [n for n in both.vars if n != "__t"]
        change = F.when(F.min("__t") != F.max("__t"), "unchanged").when(F.max("__t") == 1, "added").otherwise("removed")
        df = both.df.groupBy(*(_q(n) for n in names)).agg(change.alias("change_type"))
        return self.join(r, Rel(df, {**{n: both.vars[n] for n in names}, "change_type": "string"}, both.maybe))

    # expressions and filters

    def expr(self, e: Any, r: Rel) -> Value:
        if isinstance(e, Value):
            return e
        if isinstance(e, A.Var):
            return r.value(e.name)
        if isinstance(e, A.Iri | A.Lit):
            return V.constant(e)
        if isinstance(e, A.VectorScore):
            if e not in r.scores:
                raise A.QueryError("VECTOR_SCORE isn't possible here")
            return Value(_q(r.scores[e]), "double")
        if isinstance(e, A.Quoted):
            return Value(F.lit(constant_term(e)), "term")
        if isinstance(e, A.Call):
            args = [self.expr(x, r) for x in e.args]
            if e.name in ("=", "!="):
                args = self._by_key(args, e.args)
            return V.function(e, args, e.args, self.g.functions)
        raise A.QueryError(f"can't evaluate {e!r}")

    @staticmethod
    def _by_key(args: list[Value], raw: tuple) -> list[Value]:
        """An IRI made by a template and a constant IRI are compared by the key."""
        for k in (0, 1):
            if args[k].kind.startswith("tpl:") and isinstance(raw[1 - k], A.Iri):
                for t in ("bigint", "string"):
                    key = V.template_key(raw[1 - k].value, args[k].kind[4:], t)
                    if key is not None and t == "bigint":
                        out = [args[k], Value(key, args[k].kind)]
                        return out
        return args

    def filter(self, r: Rel, e: Any) -> Rel:
        if isinstance(e, A.Call) and e.name == "&&":
            return self.filter(self.filter(r, e.args[0]), e.args[1])
        if isinstance(e, A.Call) and e.name == "!" and isinstance(e.args[0], A.Exists):
            e = replace(e.args[0], negated=not e.args[0].negated)
        if isinstance(e, A.Exists):
            inner, extra, needed = self._inner(r, e)
            return self.join(r, self.project(inner, needed), "left_anti" if e.negated else "left_semi", extra)
        e, r, marks = self._mark(e, r)
        r = self.prepare(r, [e])
        out = r.where(V.truth(self.expr(e, r)))
        return replace(out, df=out.df.drop(*marks)) if marks else out

    def _inner(self, r: Rel, e: A.Exists) -> tuple[Rel, list, list[str]]:
        extra: list = []
        inner = self.group(e.group, extra)
        correlated = []
        for f in extra:
            names = A.variables(f)
            if _has_exists(f) or all(n in inner.vars or n not in r.vars for n in names):
                inner = self.filter(inner, f)
            else:
                correlated.append(f)
        needed = [x for x in inner.vars if x in r.vars or x in A.variables(correlated)]
        return inner, correlated, needed

    def _mark(self, e: Any, r: Rel) -> tuple[Any, Rel, list[str]]:
        """EXISTS inside other expressions: the solutions that have a match are marked."""
        marks: list[str] = []

        def walk(x: Any) -> Any:
            nonlocal r
            if isinstance(x, A.Exists):
                inner, extra, needed = self._inner(r, x)
                mark = self.name("mark")
                marks.append(mark)
                shared = [n for n in needed if n in r.vars]
                if extra or any(n in r.maybe or n in inner.maybe for n in shared):
                    outer = self.project(r, [n for n in r.vars if n in set(shared) | set(A.variables(extra))])
                    keys = list(outer.vars)
                    base = replace(outer, df=outer.df.select(*(_q(n) for n in keys)).distinct())
                    hit = self.join(base, self.project(inner, needed), "left_semi", extra).df
                    names = {n: self.name("k") for n in keys}
                    hit = hit.withColumnsRenamed(names).withColumn(mark, F.lit(True))
                    cond = F.lit(True)
                    for n in keys:
                        cond = cond & r.df[f"`{n}`"].eqNullSafe(hit[names[n]])
                    r = replace(r, df=r.df.join(hit, cond, "left").drop(*names.values()))
                else:
                    small = self.project(inner, shared)
                    small = Rel(small.df.distinct().withColumn(mark, F.lit(True)), {**small.vars, mark: "bool"})
                    joined = self.join(r, small, "left")
                    r = Rel(joined.df, {k: v for k, v in joined.vars.items() if k != mark}, joined.maybe - {mark}, joined.scores, r.size)
                got = _q(mark).isNotNull()
                return Value(~got if x.negated else got, "bool")
            if isinstance(x, A.Call):
                return replace(x, args=tuple(walk(y) for y in x.args))
            return x

        e = walk(e)
        return e, r, marks

    # queries

    def select(self, q: A.Query) -> Rel:
        r = self.group(q.where)
        wanted = list(q.select)
        aggregated = bool(q.group_by) or any(e is not None and is_aggregate(e) for e, _ in wanted) or any(is_aggregate(h) for h in q.having)
        order = list(q.order_by)
        if aggregated:
            r, wanted, having, order = self.aggregate(r, q, wanted, order)
            for h in having:
                r = self.filter(r, h)
        else:
            for h in q.having:
                r = self.filter(r, h)
        named = [v.name for _, v in wanted] if wanted else [n for n in r.vars if not n.startswith("__")]
        for e, v in wanted:
            if e is not None:
                r = self.prepare(r, [e])
                if v.name in r.vars and not aggregated:
                    raise A.QueryError(f"?{v.name} is bound already")
                x = self.expr(e, r)
                r = Rel(r.df.withColumn(v.name, x.col), {**r.vars, v.name: x.kind}, r.maybe | {v.name}, r.scores, r.size)
        r = self.prepare(r, [e for e, _ in order])
        for n in named:
            if n not in r.vars:
                r = Rel(r.df.withColumn(n, F.lit(None).cast("string")), {**r.vars, n: "term"}, r.maybe | {n}, r.scores, r.size)
        keys = [k for e, up in order for k in V.order_columns(self.expr(e, r), up)]
        if q.distinct:
            if set(A.variables([e for e, _ in order])) - set(named):
                raise A.QueryError("ORDER BY with DISTINCT must use selected variables")
            scores = list(r.scores.values()) if any(_find([e], A.VectorScore) for e, _ in order) else []
            r = Rel(r.df.select(*(_q(n) for n in named), *(_q(c) for c in scores)).distinct(), {n: r.vars[n] for n in named}, r.maybe & set(named), r.scores if scores else {}, r.size)
        if keys:
            r = replace(r, df=r.df.orderBy(*keys))
        if q.offset:
            r = replace(r, df=r.df.offset(q.offset))
        if q.limit is not None:
            r = replace(r, df=r.df.limit(q.limit), size=min(r.size, q.limit))
        out = self.project(r, named)
        return replace(out, scores={}, df=out.df.select(*(_q(n) for n in out.vars)) if out.vars else out.df)

    def aggregate(self, r: Rel, q: A.Query, wanted: list, order: list) -> tuple[Rel, list, list, list]:
        keys: list[str] = []
        for e, v in q.group_by:
            if isinstance(e, A.Var) and v is None:
                keys.append(e.name)
                if e.name not in r.vars:
                    r = Rel(r.df.withColumn(e.name, F.lit(None).cast("string")), {**r.vars, e.name: "term"}, r.maybe | {e.name}, r.scores)
                continue
            n = v.name if v else self.name("group")
            x = self.expr(e, r)
            r = Rel(r.df.withColumn(n, x.col), {**r.vars, n: x.kind}, r.maybe | {n}, r.scores, r.size)
            keys.append(n)
        made: dict[Any, tuple[str, Column, str]] = {}

        def lift(e: Any) -> Any:
            if isinstance(e, A.Call) and is_aggregate(e) and not any(is_aggregate(x) for x in e.args) and e.name in AGGREGATES:
                if e not in made:
                    c, kind = self.one_aggregate(e, r)
                    made[e] = (self.name("agg"), c, kind)
                return A.Var(made[e][0])
            if isinstance(e, A.Call):
                for (ge, _), k in zip(q.group_by, keys, strict=True):
                    if e == ge:
                        return A.Var(k)
                return replace(e, args=tuple(lift(x) for x in e.args))
            return e

        names = {v.name for e, v in wanted if e is not None}
        alias = {v.name: e for e, v in wanted if e is not None}

        def named(e: Any) -> Any:
            """HAVING and ORDER BY may use the names that SELECT gives."""
            if isinstance(e, A.Var) and e.name in names and e.name not in keys:
                return alias[e.name]
            return replace(e, args=tuple(named(x) for x in e.args)) if isinstance(e, A.Call) else e

        lifted = [(lift(e) if e is not None else None, v) for e, v in wanted]
        having = [lift(named(h)) for h in q.having]
        order = [(lift(named(e)), up) for e, up in order]
        for e, v in wanted:
            if e is None and v.name not in keys:
                raise A.QueryError(f"?{v.name} is neither grouped nor aggregated")
        aggs = [c.alias(n) for n, c, _ in made.values()] or [F.count(F.lit(1)).alias("__rows")]
        df = r.df.groupBy(*(_q(k) for k in keys)).agg(*aggs) if keys else r.df.agg(*aggs)
        kinds = {**{k: r.vars[k] for k in keys}, **{n: kind for n, _, kind in made.values()}}
        return Rel(df, kinds, (r.maybe & set(keys)) | {n for n, _, _ in made.values()}), lifted, having, order

    def one_aggregate(self, e: A.Call, r: Rel) -> tuple[Column, str]:
        if e.name == "COUNT" and not e.args:
            cols = [_q(n) for n in r.vars]
            return (F.count_distinct(F.struct(*cols)) if e.distinct and cols else F.count(F.lit(1))), "int"
        v = self.expr(e.args[0], r)
        if e.name == "COUNT":
            return (F.count_distinct(v.col) if e.distinct else F.count(v.col)), "int"
        if e.name in ("SUM", "AVG"):
            n = V.number(v)
            if e.name == "AVG":
                return F.coalesce((F.avg(n.cast("double")) if not e.distinct else F.sum_distinct(n.cast("double")) / F.count_distinct(n)), F.lit(0.0)), "double"
            whole = v.kind == "int"
            f = F.sum_distinct if e.distinct else F.sum
            return F.coalesce(f(n.cast("bigint" if whole else "double")), F.lit(0).cast("bigint" if whole else "double")), "int" if whole else "double"
        if e.name in ("MIN", "MAX"):
            f = F.min if e.name == "MIN" else F.max
            if v.kind == "term":
                n = V.number(v)
                rank = F.when(v.col.startswith("_:"), 1).when(~v.col.startswith('"'), 2).when(n.isNotNull(), 3).otherwise(4)
                return f(F.when(v.col.isNotNull(), F.struct(rank.alias("r"), n.alias("n"), V.lex(v).alias("l"), v.col.alias("t"))))["t"], "term"
            return (f(V.lex(v)), "iri") if v.kind.startswith("tpl:") else (f(v.col), v.kind)
        if e.name == "SAMPLE":
            return F.min(v.col), v.kind
        sep = e.args[1].lex if len(e.args) > 1 else " "
        texts = F.collect_set(V.lex(v)) if e.distinct else F.collect_list(V.lex(v))
        return F.array_join(F.array_sort(texts), sep), "string"

    def run(self, q: A.Query) -> DataFrame:
        if q.form == "SELECT":
            return self.render(self.select(q))
        if q.form == "ASK":
            return self.group(q.where).df.select(F.lit(1)).limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))
        if q.form == "CONSTRUCT":
            return self.construct(q)
        if q.form == "DESCRIBE":
            return self.describe(q)
        raise A.QueryError(f"{q.form} is an update")

    def _solutions(self, q: A.Query) -> Rel:
        names = [n for n in A.variables(q.where)]
        inner = replace(q, form="SELECT", select=[(None, A.Var(n)) for n in names], template=[], describe=[])
        return self.select(inner)

    def construct(self, q: A.Query) -> DataFrame:
        r = self._solutions(q)
        part = lambda x: V.as_term(r.value(x.name)) if isinstance(x, A.Var) else F.lit(constant_term(x))
        rows = F.array(*(F.struct(part(t.s).alias("s"), part(t.p).alias("p"), part(t.o).alias("o")) for t in q.template))
        out = r.df.select(F.inline(rows)).where("s is not null and p is not null and o is not null")
        return out.where(~F.col("s").startswith('"') & ~F.col("p").startswith('"')).distinct()

    def describe(self, q: A.Query) -> DataFrame:
        v = A.Var
        parts = []
        fixed = [x for x in q.describe if not isinstance(x, A.Var)]
        free = [x for x in q.describe if isinstance(x, A.Var)]
        for x in fixed:
            for t in (A.Triple(x, v("__p"), v("__o")), A.Triple(v("__s"), v("__p"), x)):
                r = self.basic([t])
                get = lambda y, r=r: V.as_term(r.value(y.name)) if isinstance(y, A.Var) else F.lit(constant_term(y))
                parts.append(r.df.select(get(t.s).alias("s"), get(t.p).alias("p"), get(t.o).alias("o")))
        if free:
            r = self._solutions(q)
            some = self.union([Rel(r.df.select(_q(x.name).alias("__x")), {"__x": r.vars[x.name]}, {"__x"} if x.name in r.maybe else set()) for x in free if x.name in r.vars])
            some = Rel(cut(some.df.where("__x is not null").distinct()), some.vars)
            for t in (A.Triple(v("__x"), v("__p"), v("__o")), A.Triple(v("__s"), v("__p"), v("__x"))):
                found = self.join(self.basic([t]), some, "left_semi")
                parts.append(found.df.select(*(V.as_term(found.value(y.name)).alias(c) for y, c in ((t.s, "s"), (t.p, "p"), (t.o, "o")))))
        if not parts:
            return self.empty(["s", "p", "o"]).df.drop("__unit")
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        return df.distinct()

    def render(self, r: Rel) -> DataFrame:
        """Keys become IRIs, tagged literals their text; everything else stays typed."""
        out = []
        for n, kind in r.vars.items():
            v = r.value(n)
            c = V.lex(v) if kind.startswith("tpl:") else v.col["lex"] if kind == "lang" else v.col
            out.append(c.alias(n))
        return r.df.select(*out)


AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


def _find(x: Any, kind: type) -> list:
    out = []
    if isinstance(x, kind):
        out.append(x)
    elif isinstance(x, list | tuple):
        for y in x:
            out += _find(y, kind)
    elif isinstance(x, A.Call):
        for y in x.args:
            out += _find(y, kind)
    return list(dict.fromkeys(out))


def _has_exists(e: Any) -> bool:
    return isinstance(e, A.Exists) or (isinstance(e, A.Call) and any(_has_exists(x) for x in e.args))


def constant_term(x: Any) -> str:
    if isinstance(x, A.Iri):
        return x.value
    if isinstance(x, A.Lit):
        return V.literal_term(x)
    if isinstance(x, A.Quoted):
        return quoted_key(*(constant_term(y) for y in (x.s, x.p, x.o)))
    raise A.QueryError(f"{x!r} isn't constant")


def quoted_key(s: str, p: str, o: str) -> str:
    return f"<< {s} {p} {o} >>"


def seconds(df: DataFrame, column: str) -> Column:
    t = df.schema[column].dataType.simpleString()
    if t in ("timestamp_ntz", "timestamp", "date"):
        c = F.col(column).cast("timestamp_ntz")
        return F.date_diff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return F.col(column).cast("bigint")
