"""Queries of paths, vectors, time, provenance, discovery, front ends and data processing over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.terms import PREFIXES, clean_iri, iri_of
from .graph import Graph
from .graph_queries import EX, XSD, iri, tables_graph
from .operators import corpus, health, owl, proptable, ranks, retract, vector
from .oracles import sql_clean, sql_iri, sql_lexical
from .plans.ast import RDF_TYPE, VOCABULARY
from .plans.mapping import map_table, test_tables
from .runtime import cut, ship, table
from .sources import readers, writers
from .sources.statements import statements
from .streaming.statements import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SUB = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
KG = {"kge": PREFIXES["kge"], "kgc": PREFIXES["kgc"], "kgp": PREFIXES["kgp"]}


def query(sql: str | None = None):
    def take(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return take


def text_query(name: str, make: Callable[[SparkSession, str], Graph], text: str, sql: str, language: str = "sparql") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return getattr(make(spark, d), language)(text)

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, sql


# paths, over the class hierarchy


def classes(spark: SparkSession, d: str) -> Graph:
    ship(spark)
    rows = table(spark, d, "subclass_of").select(clean_iri("class_iri").alias("s"), F.lit(SUB).alias("p"), clean_iri("parent_iri").alias("o"))
    return Graph(spark, triples=cut(rows.where("s is not null and o is not null").distinct()), prefixes=KG)


_E = f"WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT {sql_clean('class_iri')} AS a, {sql_clean('parent_iri')} AS b FROM subclass_of WHERE class_iri IS NOT NULL AND parent_iri IS NOT NULL), "
_R = _E + "r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), n AS (SELECT a FROM e UNION SELECT b FROM e) "
ROOT = f"{PREFIXES['kgc']}C500"
text_query("path_plus", classes, "SELECT ?a ?b WHERE { ?a rdfs:subClassOf+ ?b }", _R + "SELECT a, b FROM r")
text_query("path_star", classes, "SELECT ?a ?b WHERE { ?a rdfs:subClassOf* ?b }", _R + "SELECT a, b FROM r UNION SELECT a, a FROM n")
text_query("path_zero_or_one", classes, "SELECT ?a ?b WHERE { ?a rdfs:subClassOf? ?b }", _R + "SELECT a, b FROM e UNION SELECT a, a FROM n")
text_query("path_sequence", classes, "SELECT ?a ?b WHERE { ?a rdfs:subClassOf/rdfs:subClassOf ?b }", _R + "SELECT x.a, y.b FROM e x JOIN e y ON x.b = y.a")
text_query("path_reverse", classes, "SELECT ?a WHERE { ?a rdfs:subClassOf+ kgc:C500 }", _R + f"SELECT a FROM r WHERE b = '{ROOT}'")
text_query("path_constant_start", classes, "SELECT ?b WHERE { kgc:C612 rdfs:subClassOf* ?b }", _R + f"SELECT b FROM r WHERE a = '{PREFIXES['kgc']}C612' UNION SELECT '{PREFIXES['kgc']}C612'")
text_query("path_inverse_alternative", classes, "SELECT ?a ?b WHERE { ?a (^rdfs:subClassOf|rdfs:subClassOf) ?b }", _R + "SELECT a, b FROM e UNION ALL SELECT b, a FROM e")
text_query("path_loop", classes, "SELECT ?a WHERE { ?a rdfs:subClassOf+ ?a }", _R + "SELECT a FROM r WHERE a = b")
text_query("path_joined", classes, "SELECT ?a ?b WHERE { ?a rdfs:subClassOf kgc:C500 . ?b rdfs:subClassOf+ ?a }", _R + f"SELECT x.a, r.a AS b FROM e x JOIN r ON r.b = x.a WHERE x.b = '{ROOT}'")
text_query("path_until", classes, 'SELECT ?a ?b WHERE { ?a rdfs:subClassOf+ ?b UNTIL(REGEX(STR(?b), "[05]$")) }',
           _E + "r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a WHERE NOT regexp_matches(r.b, '[05]$')) SELECT a, b FROM r WHERE regexp_matches(b, '[05]$')")
text_query("path_star_until", classes, "SELECT ?a ?b WHERE { ?a rdfs:subClassOf+ kgc:C500 . ?a rdfs:subClassOf* ?b UNTIL(EXISTS { ?b rdfs:subClassOf kgc:C500 }) }",
           _R + f""", t AS (SELECT a FROM e WHERE b = '{ROOT}'), w AS (SELECT DISTINCT a, a AS b FROM r WHERE b = '{ROOT}' UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a WHERE w.b NOT IN (SELECT a FROM t)) SELECT a, b FROM w WHERE b IN (SELECT a FROM t)""")


# vectors


def vector_text(spark: SparkSession, d: str) -> str:
    row = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id = 0").select("embedding").first()
    return " ".join(repr(float(x)) for x in row["embedding"])


def vector_query(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = tables_graph(spark, d, "embeddings")
        return g.sparql(text.replace("$V", f'"{vector_text(spark, d)}"^^tv:f32vec'))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, q FROM embeddings, q), c AS (SELECT vec_id, label, list_cosine_similarity(v, q) AS s, list_dot_product(v, q) AS d, -pow(list_distance(v, q), 2) AS e FROM v) " + sql


_VEC = iri("embeddings", "vec_id")
vector_query("v1_similar", "SELECT ?x WHERE { VECTOR_SIMILAR(?x ex:embedding $V, 0.2) }", f"SELECT {_VEC} AS x FROM c WHERE s >= 0.2")
vector_query("v1_similar_joined", "SELECT ?x ?l WHERE { ?x ex:label ?l . FILTER(?l < 3) VECTOR_SIMILAR(?x ex:embedding $V, 0.1) }", f"SELECT {_VEC} AS x, CAST(label AS BIGINT) AS l FROM c WHERE s >= 0.1 AND label < 3")
vector_query("v2_euclid", "SELECT ?x WHERE { EUCLID_SEARCH(?x ex:embedding $V, -1.6) }", f"SELECT {_VEC} AS x FROM c WHERE e >= -1.6")
vector_query("v2_dot", "SELECT ?x WHERE { DOTPRODUCT_SEARCH(?x ex:embedding $V, 0.15) }", f"SELECT {_VEC} AS x FROM c WHERE d >= 0.15")
vector_query("v2_cosine_top", "SELECT ?x WHERE { COSINE_SEARCH(?x ex:embedding $V, -1, k:=12) }", f"SELECT {_VEC} AS x FROM c ORDER BY s DESC LIMIT 12")
vector_query("v6_bound_top", "SELECT ?x WHERE { ?x ex:label 1 . VECTOR_SIMILAR(?x ex:embedding $V, 0.0, k:=40) }", f"SELECT {_VEC} AS x FROM (SELECT * FROM c ORDER BY s DESC LIMIT 40) WHERE label = 1 AND s >= 0")
vector_query("v7_order_by_score", "SELECT ?x (ROUND(VECTOR_SCORE(?x ex:embedding $V) * 100000) / 100000 AS ?s) WHERE { ?x ex:label 2 } ORDER BY DESC(VECTOR_SCORE(?x ex:embedding $V)) LIMIT 10",
             f"SELECT {_VEC} AS x, round(s * 100000) / 100000 AS s FROM c WHERE label = 2 ORDER BY c.s DESC LIMIT 10")


@query()
def v11_knn_edges(spark: SparkSession, d: str) -> DataFrame:
    """The neighbour graph of all embeddings; layers and cells have no SQL form."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return vector.knn_edges(v, m=8)


@query("""WITH s AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT src, dst, 0 AS layer, round(sim, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 16""")
def v11_bottom_layer(spark: SparkSession, d: str) -> DataFrame:
    """The bottom layer alone, every cell compared, so exact."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return vector.knn_edges(v, m=8, layer_of=F.lit(0), probes=4096).select("src", "dst", "layer", F.round("similarity", 6).alias("similarity"))


def neighbour_graph(spark: SparkSession, d: str) -> Graph:
    g = tables_graph(spark, d, "embeddings")
    e = cut(v11_knn_edges(spark, d).where("layer = 0"))
    name = lambda c: F.concat(F.lit(EX + "embeddings/"), F.col(c).cast("string"))
    g.triples = e.select(name("src").alias("s"), F.lit(VOCABULARY + "hnswNeighbor").alias("p"), name("dst").alias("o"))
    return g


@query()
def path_greedy(spark: SparkSession, d: str) -> DataFrame:
    """From every vector of one label greedily towards vector 0; the tests compare the walk with brute force."""
    return neighbour_graph(spark, d).sparql(f'SELECT ?a ?b WHERE {{ ?a ex:label 3 . ?a tv:hnswNeighbor+ ?b GREEDY("{vector_text(spark, d)}"^^tv:f32vec) }}')


@query()
def path_beam(spark: SparkSession, d: str) -> DataFrame:
    return neighbour_graph(spark, d).sparql(f'SELECT ?a ?b WHERE {{ ?a ex:label 3 . ?a tv:hnswNeighbor+ ?b BEAM("{vector_text(spark, d)}"^^tv:f32vec, 4) }}')


@query()
def v13_health(spark: SparkSession, d: str) -> DataFrame:
    edges = cut(v11_knn_edges(spark, d))
    nodes = edges.groupBy(F.col("src").alias("id")).agg(F.max("layer").alias("layer")).withColumn("deleted", F.lit(False))
    return health.index_health(nodes, edges, 8)


# time: an order holds from its date to its last shipment, an event when it happens


def timed(spark: SparkSession, d: str) -> Graph:
    ship(spark)
    last = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("until"))
    orders = table(spark, d, "orders").join(last, "o_orderkey", "left")
    m = map_table("orders", orders, "o_orderkey", links={"o_custkey": "customer"}, valid_from="o_orderdate", valid_to="until")
    e = map_table("events", table(spark, d, "events"), "event_id", links={"user_id": "user"}, asserted_at="ts")
    return Graph(spark, [m, e, *test_tables(spark, d, "customer")], prefixes={"ex": EX})


_O = "WITH o AS (SELECT orders.*, (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey) AS u FROM orders) "
_OK = iri("orders", "o_orderkey")
text_query("t1_at_time", timed, 'SELECT ?o ?n WHERE { AT_TIME("1996-03-15"^^xsd:date) { ?o ex:o_custkey ?c } ?c ex:c_name ?n }', _O + f"SELECT {_OK} AS o, c_name AS n FROM o JOIN customer ON o_custkey = c_custkey WHERE o_orderdate <= '1996-03-15' AND (u IS NULL OR u >= '1996-03-15')")
text_query("t3_world_state", timed, 'SELECT ?s (COUNT(*) AS ?n) WHERE { WORLD_STATE("1997-01-01T00:00:00"^^xsd:dateTime) { ?o ex:o_orderstatus ?s } } GROUP BY ?s', _O + "SELECT o_orderstatus AS s, count(*) AS n FROM o WHERE o_orderdate <= '1997-01-01' AND (u IS NULL OR u >= '1997-01-01') GROUP BY 1")
text_query("t2_during", timed, 'SELECT ?o WHERE { DURING("1996-03-01", "1996-03-10") { ?o ex:o_orderstatus "F" } }', _O + f"SELECT {_OK} AS o FROM o WHERE o_orderstatus = 'F' AND o_orderdate <= '1996-03-10' AND (u IS NULL OR u >= '1996-03-01')")
text_query("t4_diff", timed, 'SELECT ?change_type (COUNT(*) AS ?n) WHERE { TEMPORAL_DIFF("1996-01-01", "1996-07-01") { ?o ex:o_orderstatus ?s } } GROUP BY ?change_type',
           _O + """SELECT CASE WHEN a AND b THEN 'unchanged' WHEN b THEN 'added' ELSE 'removed' END AS change_type, count(*) AS n FROM (SELECT o_orderdate <= '1996-01-01' AND (u IS NULL OR u >= '1996-01-01') AS a, o_orderdate <= '1996-07-01' AND (u IS NULL OR u >= '1996-07-01') AS b FROM o) WHERE a OR b GROUP BY 1""")
text_query("t7_asserted_at_time", timed, 'SELECT (COUNT(*) AS ?n) WHERE { AT_TIME("1999") { ?e ex:event_type "error" } }', "SELECT count(*) AS n FROM events WHERE event_type = 'error'")
text_query("t7_asserted_during", timed, 'SELECT ?e WHERE { DURING("2024-01-10", "2024-01-11") { ?e ex:event_type "error" } }', f"SELECT {iri('events', 'event_id')} AS e FROM events WHERE event_type = 'error' AND epoch(date_trunc('second', ts)) BETWEEN epoch(TIMESTAMP '2024-01-10') AND epoch(TIMESTAMP '2024-01-11')")


# quoted statements and provenance

HOT = f"{PREFIXES['kge']}E1000"


def annotated(spark: SparkSession, d: str) -> Graph:
    """The links between entities and classes, with what they were made from as annotations."""
    ship(spark)
    t = cut(table(spark, d, "triples").select("stmt_id", clean_iri("s").alias("s"), clean_iri("p").alias("p"), iri_of("o").alias("o")).where("s is not null and p is not null and o is not null"))
    key = F.concat(F.lit("<< "), F.col("s"), F.lit(" "), F.col("p"), F.lit(" "), F.col("o"), F.lit(" >>"))
    k = t.select(F.col("stmt_id"), key.alias("key"))
    part = F.regexp_extract(clean_iri("p"), "([^/]*)$", 1)
    prov = table(spark, d, "provenance").select("generated_id", F.concat(F.lit(VOCABULARY), part).alias("p"), "source_id", "agent")
    cites = prov.join(k.select(F.col("stmt_id").alias("generated_id"), F.col("key").alias("s")), "generated_id").join(k.select(F.col("stmt_id").alias("source_id"), F.col("key").alias("o")), "source_id").select("s", "p", "o")
    agents = prov.where("agent is not null").join(k.select(F.col("stmt_id").alias("generated_id"), F.col("key").alias("s")), "generated_id").select("s", "p", F.concat(F.lit('"'), "agent", F.lit('"')).alias("o"))
    rows = cut(t.select("s", "p", "o").unionByName(cites).unionByName(agents).distinct())
    quoted = cut(t.select(key.alias("key"), F.col("s").alias("qs"), F.col("p").alias("qp"), F.col("o").alias("qo")).distinct())
    return Graph(spark, triples=rows, quoted=quoted, prefixes=KG)


_Q = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT stmt_id, {sql_clean('s')} AS s, {sql_clean('p')} AS p, {sql_iri('o')} AS o FROM triples WHERE s IS NOT NULL AND p IS NOT NULL AND {sql_iri('o')} IS NOT NULL),
pr AS MATERIALIZED (SELECT generated_id, regexp_extract({sql_clean('p')}, '([^/]*)$', 1) AS p, source_id, agent FROM provenance),
k AS MATERIALIZED (SELECT stmt_id, '<< ' || s || ' ' || p || ' ' || o || ' >>' AS key, s, p, o FROM t),
n AS MATERIALIZED (SELECT DISTINCT g.key AS s, '{VOCABULARY}' || pr.p AS p, c.key AS o FROM pr JOIN k g ON g.stmt_id = generated_id JOIN k c ON c.stmt_id = source_id
 UNION SELECT g.key, '{VOCABULARY}' || pr.p, '"' || agent || '"' FROM pr JOIN k g ON g.stmt_id = generated_id WHERE agent IS NOT NULL),
q AS MATERIALIZED (SELECT DISTINCT key, s, p, o FROM k),
"""
text_query("f6_quoted_subject", annotated, "SELECT ?s ?o ?a WHERE { << ?s kgp:instanceOf ?o >> tv:generatedBy ?a }", _Q + f"z AS (SELECT 1) SELECT q.s, q.o, n.o AS a FROM q JOIN n ON n.s = q.key WHERE q.p = '{PREFIXES['kgp']}instanceOf' AND n.p = '{VOCABULARY}generatedBy'")
text_query("f7_quoted_object", annotated, "SELECT ?a ?b ?s ?p ?o WHERE { << ?a kgp:locatedIn ?b >> tv:selectedFrom << ?s ?p ?o >> }", _Q + f"z AS (SELECT 1) SELECT g.s AS a, g.o AS b, c.s, c.p, c.o FROM n JOIN q g ON g.key = n.s JOIN q c ON c.key = n.o WHERE g.p = '{PREFIXES['kgp']}locatedIn' AND n.p = '{VOCABULARY}selectedFrom'")
_FALL = f"""f AS (SELECT key, 0 AS d FROM q WHERE s = '{HOT}' OR o = '{HOT}' UNION SELECT n.s, f.d + 1 FROM f JOIN n ON n.o = f.key AND n.p IN ('{VOCABULARY}selectedFrom', '{VOCABULARY}inferredFrom') WHERE f.d < 40),
m AS (SELECT key, min(d) AS d FROM f GROUP BY 1)
SELECT s, p, o, CAST(min(d) AS INTEGER) AS depth FROM (SELECT q.s, q.p, q.o, d FROM m JOIN q ON q.key = m.key UNION ALL SELECT n.s, n.p, n.o, d FROM m JOIN n ON n.s = m.key) GROUP BY 1, 2, 3"""  # fmt: skip


@query(_Q + _FALL)
def r1_retraction_set(spark: SparkSession, d: str) -> DataFrame:
    g = annotated(spark, d)
    return retract.retraction_set(g.triples, g.quoted, HOT)


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT generated_id AS c, source_id AS p FROM provenance WHERE regexp_matches({sql_clean('p')}, '/(selectedFrom|inferredFrom)$') AND source_id IS NOT NULL AND generated_id IS NOT NULL),
f AS (SELECT stmt_id AS id, 0 AS depth FROM triples WHERE {sql_clean('s')} = '{HOT}' UNION SELECT e.c, f.depth + 1 FROM f JOIN e ON e.p = f.id WHERE f.depth < 60) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM f GROUP BY 1""")
def r1_cascade(spark: SparkSession, d: str) -> DataFrame:
    p = clean_iri("p")
    cites = table(spark, d, "provenance").where(p.endswith("/selectedFrom") | p.endswith("/inferredFrom")).select(F.col("generated_id").alias("child"), F.col("source_id").alias("parent"))
    return retract.cascade(table(spark, d, "triples").where(clean_iri("s") == HOT).select(F.col("stmt_id").alias("id")), cites)


# discovery


def links(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "triples").select(clean_iri("s").alias("s"), clean_iri("p").alias("p"), iri_of("o").alias("o"))
    return t.where("s is not null and p is not null and o is not null").distinct()


_L = f"WITH t AS MATERIALIZED (SELECT DISTINCT {sql_clean('s')} AS s, {sql_clean('p')} AS p, {sql_iri('o')} AS o FROM triples WHERE s IS NOT NULL AND p IS NOT NULL AND {sql_iri('o')} IS NOT NULL) "


@query(_L + ", x AS (SELECT DISTINCT s AS node, '>' || p AS prop FROM t UNION SELECT o, '<' || p FROM t), g AS (SELECT node, string_agg(prop, ' ' ORDER BY prop) AS sig FROM x GROUP BY 1) SELECT sig, count(*) AS nodes FROM g GROUP BY 1")
def d1_signatures(spark: SparkSession, d: str) -> DataFrame:
    return proptable.signatures(links(spark, d)).groupBy(F.array_join("sig", " ").alias("sig")).agg(F.count(F.lit(1)).alias("nodes"))


@query()
def d2_tables(spark: SparkSession, d: str) -> DataFrame:
    """Found tables, a row per column; merging is in order of size and has no SQL form."""
    found, _ = proptable.discover(links(spark, d))
    rows = [(t.number, t.nodes, p, c, t.cliff) for t in found for p, c in t.columns]
    return spark.createDataFrame(rows, "number int, nodes long, property string, coverage double, cliff double")


@query(_L + f", ty AS (SELECT DISTINCT s, o AS cls FROM t WHERE p = '{PREFIXES['kgp']}instanceOf'), z AS (SELECT cls, count(*) AS n FROM ty GROUP BY 1) SELECT ty.cls, t.p, count(DISTINCT ty.s) AS nodes, count(DISTINCT ty.s) / max(n) AS coverage FROM ty JOIN t ON t.s = ty.s JOIN z ON z.cls = ty.cls GROUP BY 1, 2")
def d_coverage(spark: SparkSession, d: str) -> DataFrame:
    return proptable.coverage(links(spark, d), PREFIXES["kgp"] + "instanceOf")


@query(_L + ", c AS (SELECT DISTINCT a.s AS root, a.p || ' ' || b.p AS path FROM t a JOIN t b ON b.s = a.o) SELECT path, count(*) AS roots FROM c GROUP BY 1")
def d4_chains(spark: SparkSession, d: str) -> DataFrame:
    return proptable.chains(links(spark, d)).groupBy("path").agg(F.count(F.lit(1)).alias("roots"))


@query()
def d4_deep(spark: SparkSession, d: str) -> DataFrame:
    return proptable.deep(links(spark, d))


# ontology, ranks, neighbourhoods

CLASS = PREFIXES["kgc"] + "C3"


@query(_L + f""", RECURSIVE_OFF AS (SELECT 1), sub AS (SELECT DISTINCT {sql_clean('class_iri')} AS a, {sql_clean('parent_iri')} AS b FROM subclass_of WHERE class_iri IS NOT NULL AND parent_iri IS NOT NULL),
ty AS (SELECT DISTINCT s AS node, o AS cls FROM t WHERE p = '{PREFIXES['kgp']}instanceOf'), up AS (SELECT node, cls FROM ty UNION SELECT up.node, sub.b FROM up JOIN sub ON sub.a = up.cls),
f AS (SELECT s, p FROM t WHERE p = '{PREFIXES['kgp']}locatedIn' GROUP BY 1, 2 HAVING count(*) > 1)
SELECT 'domain' AS kind, s, p, o FROM t WHERE p = '{PREFIXES['kgp']}hasMember' AND s IN (SELECT node FROM ty) AND NOT EXISTS (SELECT 1 FROM up WHERE up.node = t.s AND up.cls = '{CLASS}')
UNION ALL SELECT 'range', s, p, o FROM t WHERE p = '{PREFIXES['kgp']}createdBy' AND o IN (SELECT node FROM ty) AND NOT EXISTS (SELECT 1 FROM up WHERE up.node = t.o AND up.cls = '{CLASS}')
UNION ALL SELECT 'functional', t.s, t.p, t.o FROM t JOIN f ON f.s = t.s AND f.p = t.p""".replace(", RECURSIVE_OFF AS (SELECT 1)", ""))
def x1_violations(spark: SparkSession, d: str) -> DataFrame:
    data = cut(links(spark, d).withColumn("p", F.when(F.col("p") == PREFIXES["kgp"] + "instanceOf", RDF_TYPE).otherwise(F.col("p"))))
    k = PREFIXES["kgp"]
    schema = spark.createDataFrame([(k + "hasMember", owl.RDFS + "domain", CLASS), (k + "createdBy", owl.RDFS + "range", CLASS), (k + "locatedIn", RDF_TYPE, owl.OWL + "FunctionalProperty")], "s string, p string, o string")
    sub = table(spark, d, "subclass_of").select(clean_iri("class_iri").alias("child"), clean_iri("parent_iri").alias("parent")).where("child is not null and parent is not null")
    return owl.violations(data, schema, sub)


ORACLES["x1_violations"] = ORACLES["x1_violations"].replace("WITH t AS", "WITH RECURSIVE t AS", 1)


def _rank_sql(rounds: int) -> str:
    sql = _L + ", e AS MATERIALIZED (SELECT DISTINCT s AS src, o AS dst FROM t), d AS (SELECT src, count(*) AS n FROM e GROUP BY 1), v AS MATERIALIZED (SELECT node, n, (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS total FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) x LEFT JOIN d ON d.src = node), r0 AS (SELECT node, n, total, 1.0::DOUBLE / total AS rank FROM v)"
    for k in range(rounds):
        sql += f", g{k} AS (SELECT e.dst, sum(rank / n) AS got FROM r{k} JOIN e ON e.src = r{k}.node GROUP BY 1), r{k + 1} AS MATERIALIZED (SELECT v.node, v.n, v.total, 0.15 / v.total + 0.85 * coalesce((SELECT sum(rank) FROM r{k} WHERE n IS NULL), 0) / v.total + 0.85 * coalesce(got, 0) AS rank FROM v LEFT JOIN g{k} ON g{k}.dst = v.node)"
    return sql + f" SELECT node, round(rank * 1e9) / 1e9 AS rank FROM r{rounds}"


@query(_rank_sql(5))
def s18_pagerank(spark: SparkSession, d: str) -> DataFrame:
    r = ranks.pagerank(links(spark, d).select(F.col("s").alias("src"), F.col("o").alias("dst")), rounds=5)
    return r.select("node", (F.round(F.col("rank") * 1e9) / 1e9).alias("rank"))


@query(_L + f", a AS (SELECT * FROM t WHERE s = '{HOT}' OR o = '{HOT}'), n AS (SELECT s AS x FROM a UNION SELECT o FROM a), b AS (SELECT * FROM t WHERE s IN (SELECT x FROM n) OR o IN (SELECT x FROM n)) SELECT s, p, o, CAST(CASE WHEN s = '{HOT}' OR o = '{HOT}' THEN 1.0 ELSE 0.75 END AS DOUBLE) AS score FROM b ORDER BY score DESC, s, p, o LIMIT 50")
def s19_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return ranks.neighbourhood(links(spark, d), HOT, hops=1, budget=50)


# data processing


_BEST = f"lab AS (SELECT {sql_clean('iri')} AS iri, label FROM labels WHERE iri IS NOT NULL AND label IS NOT NULL AND removed_at IS NULL QUALIFY row_number() OVER (PARTITION BY {sql_clean('iri')} ORDER BY coalesce(lang = 'en', false) DESC, fetched_at DESC, label) = 1)"
_PLAIN = rf"""regexp_replace(regexp_replace(regexp_replace({sql_lexical('o')}, '^\+?([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})T00:00:00Z?$', '\1'), '^([0-9]{{4}})-00-00$', '\1'), '^\+([0-9][0-9.,]*)$', '\1')"""


@query(f"""WITH {_BEST}, t AS (SELECT {sql_clean('s')} AS s, {sql_clean('p')} AS p, o, {sql_lexical('o')} AS lex, {sql_clean('o')} AS oi, {_PLAIN} AS plain FROM triples WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND {sql_clean('p')} NOT IN ('{PREFIXES['kgp']}seeAlso')),
x AS (SELECT a.label AS subject, b.label AS predicate, lex, oi, plain FROM t JOIN lab a ON a.iri = t.s JOIN lab b ON b.iri = t.p)
SELECT subject, predicate, c.label AS object FROM x JOIN lab c ON c.iri = oi WHERE lex IS NULL UNION SELECT subject, predicate, plain FROM x WHERE lex IS NOT NULL AND trim(plain) <> ''""")
def s17_clean_corpus(spark: SparkSession, d: str) -> DataFrame:
    return corpus.clean_rows(table(spark, d, "triples"), table(spark, d, "labels"), [PREFIXES["kgp"] + "seeAlso"])


def sql_term(c: str) -> str:
    t = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    tag = f"""string_split({t}, '"')[-1]"""
    inner = f"substr({t}, 2, length({t}) - length({tag}) - 2)"
    kind = f"regexp_replace(regexp_replace(substr({tag}, 3), '^<|>$', '', 'g'), '^xsd:', '{XSD}')"
    return rf"""(CASE WHEN {t} = '' THEN NULL WHEN starts_with({t}, '"') THEN CASE WHEN starts_with({tag}, '^^') THEN CASE WHEN {kind} IN ('{XSD}integer', '{XSD}int', '{XSD}long') AND TRY_CAST({inner} AS BIGINT) IS NOT NULL AND regexp_matches({inner}, '^\s*[+-]?[0-9]+\s*$') THEN '"' || TRY_CAST({inner} AS BIGINT) || '"^^<{XSD}integer>' ELSE '"' || {inner} || '"^^<' || {kind} || '>' END ELSE {t} END
 WHEN starts_with({t}, '_:') THEN {t} WHEN regexp_matches({t}, '^[+-]?[0-9]+$') THEN '"' || CAST({t} AS BIGINT) || '"^^<{XSD}integer>' WHEN regexp_matches({t}, '^[+-]?[0-9]*\.[0-9]+$') THEN '"' || {t} || '"^^<{XSD}decimal>'
 WHEN {t} IN ('true', 'false') THEN '"' || {t} || '"^^<{XSD}boolean>' ELSE {sql_clean(c)} END)"""


_S = f"WITH t AS (SELECT DISTINCT {sql_clean('s')} AS s, {sql_clean('p')} AS p, {sql_term('o')} AS o FROM triples WHERE s IS NOT NULL AND p IS NOT NULL AND {sql_term('o')} IS NOT NULL) "


@query(_S + "SELECT * FROM t")
def s1_ntriples_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every statement written as a line and read again."""
    lines = writers.ntriples(cut(statements(table(spark, d, "triples"))))
    return readers.load_lines(lines)[0]


@query(_S + f"SELECT s, count(*) AS n FROM t WHERE p IN ('{PREFIXES['kgp']}population', '{PREFIXES['kgp']}pageCount') AND TRY_CAST(regexp_extract(o, '^\"([0-9-]+)\"\\^\\^<{XSD}integer>$', 1) AS BIGINT) > 300 GROUP BY 1")
def e2_generic_numbers(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    g = Graph(spark, triples=cut(statements(table(spark, d, "triples")), "p", "s"), prefixes=KG)
    return g.sparql("SELECT ?s (COUNT(*) AS ?n) WHERE { VALUES ?p { kgp:population kgp:pageCount } ?s ?p ?v FILTER(?v > 300 && DATATYPE(?v) = xsd:integer) } GROUP BY ?s")


@query(_S + "SELECT s, o FROM t WHERE p = '" + PREFIXES["kgp"] + "description' AND regexp_matches(o, '\"@(en|EN)(-[A-Za-z]+)?$')")
def e15_langmatches(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    g = Graph(spark, triples=cut(statements(table(spark, d, "triples")), "p", "s"), prefixes=KG)
    return g.sparql('SELECT ?s ?o WHERE { ?s kgp:description ?o FILTER(LANGMATCHES(LANG(?o), "en")) }')


@query("SELECT n_nationkey || ',' || n_name || ',' || n_regionkey AS value FROM nation")
def s11_csv(spark: SparkSession, d: str) -> DataFrame:
    return writers.results(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "csv")


@query(_L + "SELECT p, count(*) AS n FROM t GROUP BY 1")
def m_predicate_counts(spark: SparkSession, d: str) -> DataFrame:
    return health.predicate_statistics(links(spark, d)).select("p", "n")


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windowed counts of streams, over the whole table as one batch."""
    return windowed_counts(table(spark, d, "events"), "ts", "event_type", "6 hours")


@query("SELECT md5(text) AS h, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def s_duplicate_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


# front ends


def relations(spark: SparkSession, d: str) -> Graph:
    return tables_graph(spark, d, "customer", "orders", "nation", "region")


_TWINS = {
    "lookup": ('MATCH (c:Customer {c_mktsegment: "BUILDING"}) WHERE c.c_acctbal > 9000 RETURN c.c_name AS name', 'MATCH (c IS Customer {c_mktsegment: "BUILDING"}) FILTER c.c_acctbal > 9000 RETURN c.c_name AS name', "SELECT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000"),
    "hops": ("MATCH (o:Orders)-[:o_custkey]->(c)-[:c_nationkey]->(n) WHERE o.o_totalprice > 400000 RETURN o, c.c_name AS name, n.n_name AS nation", "MATCH (o IS Orders)-[:o_custkey]->(c)-[:c_nationkey]->(n) FILTER WHERE o.o_totalprice > 400000 RETURN o, c.c_name AS name, n.n_name AS nation",
             f"SELECT {iri('orders', 'o_orderkey')} AS o, c_name AS name, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 400000"),
    "logic": ('MATCH (c:Customer) WHERE NOT (c.c_acctbal > 0 OR c.c_mktsegment = "MACHINERY") RETURN c', 'MATCH (c :Customer) FILTER NOT (c.c_acctbal > 0 OR c.c_mktsegment = "MACHINERY") RETURN c', f"SELECT {iri('customer', 'c_custkey')} AS c FROM customer WHERE NOT (c_acctbal > 0 OR c_mktsegment = 'MACHINERY')"),
    "optional": ('MATCH (c:Customer) WHERE c.c_acctbal > 9800 OPTIONAL MATCH (o:Orders)-[:o_custkey]->(c) WHERE o.o_totalprice > 300000 RETURN c, o', 'MATCH (c IS Customer) WHERE c.c_acctbal > 9800 OPTIONAL MATCH (o IS Orders)-[:o_custkey]->(c) FILTER o.o_totalprice > 300000 RETURN c, o',
                 f"SELECT {iri('customer', 'c_custkey')} AS c, {iri('orders', 'o_orderkey')} AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 WHERE c_acctbal > 9800"),
    "top": ("MATCH (o:Orders)<-[:none]-(x) RETURN o", "", ""),
    "order": ("MATCH (o:Orders) RETURN o.o_orderkey AS k, o.o_totalprice AS t ORDER BY t DESC, k SKIP 5 LIMIT 10", "MATCH (o IS Orders) RETURN o.o_orderkey AS k, o.o_totalprice AS t ORDER BY t DESC, k OFFSET 5 LIMIT 10", "SELECT o_orderkey AS k, o_totalprice AS t FROM orders ORDER BY 2 DESC, 1 LIMIT 10 OFFSET 5"),
    "distinct": ("MATCH (c:Customer)-[:c_nationkey]->(n)-[:n_regionkey]->(r) RETURN DISTINCT r.r_name AS r, c.c_mktsegment AS m", "MATCH (c IS Customer)-[:c_nationkey]->(n)-[:n_regionkey]->(r) RETURN DISTINCT r.r_name AS r, c.c_mktsegment AS m", "SELECT DISTINCT r_name AS r, c_mktsegment AS m FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
}
del _TWINS["top"]
for _name, (_cypher, _gql, _sql) in _TWINS.items():
    def _relations(spark: SparkSession, d: str) -> Graph:
        g = relations(spark, d)
        g.prefixes[""] = EX
        return g

    text_query(f"cypher_{_name}", _relations, _cypher, _sql, "cypher")
    text_query(f"gql_{_name}", _relations, _gql, _sql, "gql")
text_query("cypher_reachable", classes, "MATCH (a)-[:subClassOf*]->(b) RETURN DISTINCT a, b", _R + "SELECT a, b FROM r", "cypher")


def _reachable(spark: SparkSession, d: str) -> DataFrame:
    g = classes(spark, d)
    g.prefixes[""] = "http://www.w3.org/2000/01/rdf-schema#"
    return g.cypher("MATCH (a)-[:subClassOf*]->(b) RETURN DISTINCT a, b")


QUERIES["cypher_reachable"] = _reachable
