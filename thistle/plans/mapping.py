"""Relational tables seen as graphs: a row is a subject, a column a predicate, a foreign key a link."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, types as T

from .ast import RDF_TYPE

EX = "http://ex.example/"


@dataclass(frozen=True)
class Property:
    """A column's predicate. target: prefix of the IRIs that a foreign key's values stand for."""

    column: str
    kind: str
    target: str | None = None


@dataclass
class TableMap:
    """prefix + the key column's value is a row's IRI; with key None the whole row is the key, and has no IRI that could be written.

    valid_from, valid_to, asserted_at: columns of epoch seconds or timestamps that hold for all statements of the row.
    """

    name: str
    df: DataFrame
    prefix: str
    key: str | None
    cls: str
    props: dict[str, Property] = field(default_factory=dict)
    valid_from: str | None = None
    valid_to: str | None = None
    asserted_at: str | None = None
    size: float = 1e6

    def has(self, predicate: str) -> bool:
        return predicate == RDF_TYPE or predicate in self.props


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.NumericType):
        return "double"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.TimestampNTZType | T.TimestampType | T.DateType):
        return "ts"
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.NumericType):
        return "vec"
    return "string"


def map_table(name: str, df: DataFrame, key: str | None, base: str = EX, links: dict[str, str] | None = None, size: float = 1e6, **temporal) -> TableMap:
    """Every column under base + its name; links: column -> table whose rows it refers to (its number stays readable as column + "_id")."""
    out = TableMap(name, df, f"{base}{name}/", key, base + name.capitalize(), size=size, **temporal)
    for f in df.schema.fields:
        if links and f.name in links:
            out.props[base + f.name] = Property(f.name, "tpl", f"{base}{links[f.name]}/")
            out.props[base + f.name + "_id"] = Property(f.name, kind_of(f.dataType))
        else:
            out.props[base + f.name] = Property(f.name, kind_of(f.dataType))
    return out


#: Keys, links and usual relative sizes of the test tables.
_TABLES = {
    "region": ("r_regionkey", {}, 5),
    "nation": ("n_nationkey", {"n_regionkey": "region"}, 25),
    "customer": ("c_custkey", {"c_nationkey": "nation"}, 1.5e5),
    "supplier": ("s_suppkey", {"s_nationkey": "nation"}, 1e4),
    "part": ("p_partkey", {}, 2e5),
    "orders": ("o_orderkey", {"o_custkey": "customer"}, 1.5e6),
    "lineitem": (None, {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, 6e6),
    "events": ("event_id", {"user_id": "user"}, 1e6),
    "embeddings": ("vec_id", {}, 1e5),
    "documents": ("doc_id", {}, 1e5),
}


def test_tables(spark: SparkSession, sf_dir: str, *names: str) -> list[TableMap]:
    out = []
    for name in names or _TABLES:
        key, links, size = _TABLES[name]
        out.append(map_table(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), key, links=links, size=size))
    return out
