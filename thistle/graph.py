"""Graphs: statements and mapped tables, queried together."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .operators import proptable, vector
from .plans import ast as A
from .plans.compile import Compiler
from .plans.mapping import TableMap
from .plans.sparql import parse
from .runtime import cut, cut_counted


class Graph:
    """triples: s, p, o as terms (IRIs bare, blank nodes _:x, quoted statements << s p o >>, literals in quotes with their tag), maybe g.
    quoted: key, qs, qp, qo of the quoted statements in them. tables: relational tables seen as graphs.

    vectors: predicate -> metric (cosine, euclidean or dot); columns of vectors in mapped tables count as cosine without being named.
    merge_stars: patterns of one subject become one scan (a switch for tests; the rows are the same either way).
    """

    def __init__(
        self, spark: SparkSession, tables: list[TableMap] | None = None, triples: DataFrame | None = None, quoted: DataFrame | None = None,
        vectors: dict[str, str] | None = None, vocabulary: str = A.VOCABULARY, prefixes: dict[str, str] | None = None, merge_stars: bool = True, depth: int | None = None, compact_after: int = 8,
    ):
        self.spark, self.tables, self.triples, self.quoted = spark, tables or [], triples, quoted
        self.vocabulary, self.prefixes, self.merge_stars, self.depth = vocabulary, {"tv": vocabulary, **(prefixes or {})}, merge_stars, depth
        self.declared = dict(vectors or {})
        self.functions: dict[str, tuple[Callable, str]] = {}
        self.size = 1e7
        self.compact_after, self.updates = compact_after, 0
        self._annotated: DataFrame | None = None
        self.rows_of: dict[str, int] = {}
        self.dimensions: dict[str, int] = {}
        self.stars: list[tuple[DataFrame, dict[str, str]]] = []
        self.chains: dict[tuple[str, str], DataFrame] = {}

    # what the compiler asks

    def could_hold(self, triples: list[A.Triple]) -> bool:
        return self.triples is not None

    def vector_predicates(self) -> list[str]:
        own = [iri for m in self.tables for iri, p in m.props.items() if p.kind == "vec"]
        return list(dict.fromkeys([*self.declared, *own]))

    def vector_metric(self, predicate: str) -> str | None:
        return self.declared.get(predicate)

    def statements(self, scope: tuple | None, visible: Callable[[Column, Column, Column], Column]) -> DataFrame:
        """The statements, in a temporal scope only those that may hold then. Statements without annotations always do."""
        if scope is None or self.quoted is None:
            return self.triples.select("s", "p", "o")
        t = self.triples.join(self.annotations(), ["s", "p", "o"], "left")
        return t.where(visible(F.col("starts"), F.col("ends"), F.col("asserted"))).select("s", "p", "o")

    def annotations(self) -> DataFrame:
        """(s, p, o, starts, ends, asserted): epoch seconds from the annotations validFrom, validTo and assertedAt of quoted statements."""
        if self._annotated is None:
            names = {self.vocabulary + n: c for n, c in (("validFrom", "starts"), ("validTo", "ends"), ("assertedAt", "asserted"))}
            a = self.triples.where(F.col("p").isin(*names)).select(F.col("s").alias("key"), "p", epoch("o").alias("at")).join(self.quoted.distinct(), "key")
            pick = lambda iri: F.collect_list(F.when(F.col("p") == iri, F.col("at")))
            self._annotated = cut(a.groupBy(F.col("qs").alias("s"), F.col("qp").alias("tp"), F.col("qo").alias("o")).agg(*(pick(iri).alias(c) for iri, c in names.items())).withColumnRenamed("tp", "p"))
        return self._annotated

    def estimate(self, predicate: str | None) -> float:
        return self.rows_of.get(predicate, 1) if predicate and self.rows_of else self.size

    # derived data; any update drops it

    def analyze(self, most: int = 10_000) -> None:
        """Counts the statements of the `most` frequent predicates, for the order of joins; results don't depend on it."""
        rows = self.triples.groupBy("p").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p").limit(most).collect()
        self.rows_of = {r["p"]: r["n"] for r in rows}
        self.size = float(max(1, sum(self.rows_of.values())))

    def find_tables(self) -> list[proptable.Found]:
        """Looks for tables in the statements and keeps those columns that hold all of their predicate's statements: patterns of one subject that
        need only such columns are then one scan of a table."""
        found, members = proptable.discover(self.triples)
        self.stars = []
        if not found:
            return found
        members = cut(members)
        where = proptable.whole(self.triples, members)
        for t in found:
            if not any(p[0] == ">" and where.get(p[1:]) == t.number for p, _ in t.columns):
                continue  # none of its columns could stand for a predicate
            rows = cut(proptable.build(self.triples, members, t))
            full = proptable.exact(self.triples, rows, t)
            columns = {p[1:]: c for (p, _), c in zip(t.columns, (c for c in rows.columns if c != "node"), strict=True) if p[0] == ">" and full[c]}
            if columns:
                self.stars.append((rows, columns))
        return found

    def keep_chain(self, first: str, second: str) -> None:
        """Joins two predicates once, for paths first/second."""
        a = self.triples.where(F.col("p") == first).select("s", F.col("o").alias("m"))
        b = self.triples.where(F.col("p") == second).select(F.col("s").alias("m"), "o")
        self.chains[first, second] = cut(a.join(b, "m").select("s", "o"))

    def _changed(self) -> None:
        self._annotated, self.stars, self.chains, self.rows_of = None, [], {}, {}

    # vectors

    def declare_vectors(self, predicate: str, dimensions: int, metric: str = "cosine") -> None:
        if metric not in vector.METRICS or dimensions < 1:
            raise A.QueryError(f"no metric {metric!r} or no dimensions")
        self.declared[predicate], self.dimensions[predicate] = metric, dimensions

    def insert_vectors(self, predicate: str, vectors: DataFrame) -> int:
        """vectors: s, vec. All or nothing: a vector of another length, or null, raises QueryError. Texts have six decimals."""
        n = self.dimensions.get(predicate)
        if n is None:
            raise A.QueryError(f"<{predicate}> isn't declared for vectors")
        wrong = vectors.where(F.col("vec").isNull() | (F.size("vec") != n)).limit(1).collect()
        if wrong:
            raise A.QueryError(f"<{predicate}> takes vectors of {n} numbers")
        text = F.array_join(F.transform("vec", lambda x: F.format_string("%.6f", x.cast("double"))), " ")
        rows = vectors.select("s", F.lit(predicate).alias("p"), F.concat(F.lit('"'), text, F.lit(f'"^^<{self.vocabulary}f32vec>')).alias("o"))
        return self.insert(rows)

    def index_vectors(self, predicate: str, m: int = 16) -> DataFrame:
        """Puts the neighbour graph of a vector predicate among the statements: hnswHorizontalNeighbor on one layer, hnswLayerDescend from a node
        to itself for each layer it leaves, hnswNeighbor for either. An earlier index goes. Returns the edges with layers and similarities."""
        v = cut(Compiler(self).vectors(predicate).df.select(F.col("node").alias("id"), "vec").where("vec is not null").dropDuplicates(["id"]))
        edges = cut(vector.knn_edges(v, m))
        tops = edges.groupBy(F.col("src").alias("s")).agg(F.max("layer").alias("top")).where("top > 0").select("s", F.col("s").alias("o"))
        flat = edges.select(F.col("src").alias("s"), F.col("dst").alias("o")).distinct()
        name = lambda n: F.lit(self.vocabulary + n)
        rows = flat.select("s", name("hnswHorizontalNeighbor").alias("p"), "o").unionByName(tops.select("s", name("hnswLayerDescend").alias("p"), "o")).unionByName(flat.unionByName(tops).select("s", name("hnswNeighbor").alias("p"), "o"))
        self.triples = cut(self.triples.where(~F.col("p").isin(*(self.vocabulary + n for n in ("hnswHorizontalNeighbor", "hnswLayerDescend", "hnswNeighbor")))))
        self.insert(rows)
        return edges

    # queries

    def query(self, q: A.Query) -> DataFrame:
        return Compiler(self).run(q)

    def sparql(self, text: str) -> DataFrame:
        return self.query(parse(text, self.prefixes))

    def rows(self, text: str, timeout: float | None = None) -> list:
        """All solutions; a query that takes longer than timeout seconds is stopped and raises TimeoutError."""
        sc = self.spark.sparkContext
        group = f"thistle-{uuid.uuid4().hex}"
        late = threading.Event()

        def stop() -> None:
            late.set()
            sc._jsc.sc().cancelJobGroupAndFutureJobs(group)  # a query is several jobs

        timer = threading.Timer(timeout, stop) if timeout else None
        sc.setJobGroup(group, text[:100], True)
        try:
            if timer:
                timer.start()
            found = self.sparql(text).collect()
            if late.is_set():
                raise TimeoutError(f"stopped after {timeout} s")
            return found
        except TimeoutError:
            raise
        except Exception:
            if late.is_set():
                raise TimeoutError(f"stopped after {timeout} s") from None
            raise
        finally:
            if timer:
                timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    def ask(self, text: str) -> bool:
        return self.sparql(text).first()["result"]

    def cypher(self, text: str) -> DataFrame:
        from .plans.cypher import translate

        return self.query(translate(text, self.base))

    def gql(self, text: str) -> DataFrame:
        from .plans.gql import translate

        return self.query(translate(text, self.base))

    @property
    def base(self) -> str:
        return self.prefixes.get("", self.vocabulary)

    def register_function(self, iri: str, function: Callable[..., Column], kind: str) -> None:
        """A function of columns under an IRI, for expressions; kind is that of its result."""
        self.functions[iri] = (function, kind)

    # updates

    def update(self, text: str) -> int:
        """INSERT DATA or DELETE DATA; the number of statements that came or went. Quoted statements that are inserted are asserted, too."""
        from .plans.compile import constant_term

        q = parse(text, self.prefixes)
        if q.form not in ("INSERT", "DELETE"):
            raise A.QueryError("not an update")
        rows, quoted = [], []

        def add(t: A.Triple | A.Quoted) -> None:
            rows.append((constant_term(t.s), constant_term(t.p), constant_term(t.o)))
            for x in (t.s, t.o):
                if isinstance(x, A.Quoted):
                    quoted.append((constant_term(x), constant_term(x.s), constant_term(x.p), constant_term(x.o)))
                    if q.form == "INSERT":
                        add(x)

        for t in q.template:
            add(t)
        data = self.spark.createDataFrame(rows, "s string, p string, o string").distinct()
        return self.insert(data, self.spark.createDataFrame(quoted, "key string, qs string, qp string, qo string") if quoted else None) if q.form == "INSERT" else self.delete(data)

    def insert(self, data: DataFrame, quoted: DataFrame | None = None) -> int:
        """Adds what isn't there; the number added. Only the new statements are written: the graph is a table, what came since, and what went."""
        data = data.select("s", "p", "o").distinct()
        new, seen = cut_counted(data if self.triples is None else data.join(self.triples, ["s", "p", "o"], "left_anti"), n=F.count(F.lit(1)))
        if seen["n"]:
            self.triples = new if self.triples is None else self.triples.select("s", "p", "o").unionByName(new)
            self._grown()
        if quoted is not None:
            self.quoted = cut((quoted if self.quoted is None else self.quoted.unionByName(quoted)).distinct())
        self._changed()
        return seen["n"]

    def delete(self, data: DataFrame) -> int:
        """Takes statements away; the number that were there. Only these are written, as tombstones."""
        if self.triples is None:
            return 0
        gone, seen = cut_counted(self.triples.select("s", "p", "o").join(data.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_semi").distinct(), n=F.count(F.lit(1)))
        if seen["n"]:
            self.triples = self.triples.join(gone, ["s", "p", "o"], "left_anti")
            self._grown()
        self._changed()
        return seen["n"]

    def _grown(self) -> None:
        """After `compact_after` updates the graph is written as one table again."""
        self.updates += 1
        if self.updates >= self.compact_after:
            self.compact()

    def compact(self) -> None:
        self.triples, self.updates = cut(self.triples), 0


def epoch(c: str) -> Column:
    """Epoch seconds of a term: an integer as it is, an ISO form of any precision from the year on, with a sign for BCE; else null."""
    t = F.regexp_replace(F.regexp_replace(F.col(c), r'"(?:\^\^.*|@[A-Za-z\-]+)?$', ""), '^"', "")
    form = r"^(-?\d{1,6})(?:-(\d{2})(?:-(\d{2})(?:[T ](\d{2})(?::(\d{2})(?::(\d{2})(?:\.\d+)?)?)?)?)?)?Z?$"
    part = lambda k, d: F.coalesce(F.regexp_extract(t, form, k).try_cast("bigint"), F.lit(d))
    y, m, d = part(1, 1970), part(2, 1), part(3, 1)
    # days of the proleptic Gregorian calendar, counted in years that begin in March
    y2 = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(y2 / 400)
    yoe = y2 - era * 400
    doy = F.floor((F.lit(153) * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    days = era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468
    iso = (days * 86400 + part(4, 0) * 3600 + part(5, 0) * 60 + part(6, 0)).cast("bigint")
    plain = F.contains(F.col(c), F.lit(A.XSD + "integer"))
    return F.when(plain, t.try_cast("bigint")).when(t.rlike(form), iso)
