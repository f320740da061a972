"""Queries of files, stores, updates, retraction, discovery and maintenance over the test tables, with their SQL.

Each writes what it needs into the shared folder and reads it back, so a row that comes out right has gone through writer and reader.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.terms import PREFIXES, clean_iri
from .graph import Graph
from .graph_queries import EX, XSD, iri, tables_graph
from .more_queries import _FALL, _L, _Q, _S, HOT, KG, annotated, classes, links, vector_text
from .operators import health, owl, proptable, retract
from .oracles import sql_clean, sql_iri
from .plans.ast import RDF_TYPE, VOCABULARY
from .runtime import cut, scratch, ship, table
from .sources import readers, writers
from .sources.statements import statements
from .sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KGP = PREFIXES["kgp"]
RDFS_SUB = owl.RDFS + "subClassOf"


def query(sql: str | None = None):
    def take(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return take


def _nt(c: str):
    return F.concat(F.lit("<"), F.col(c), F.lit(">"))


# files


@query(f"SELECT DISTINCT {sql_clean('s')} AS s, {sql_clean('p')} AS p, {sql_iri('o')} AS o, {sql_clean('graph_iri')} AS g FROM triples WHERE s IS NOT NULL AND p IS NOT NULL AND {sql_iri('o')} IS NOT NULL AND graph_iri IS NOT NULL AND s <> '' AND p <> '' AND NOT starts_with({sql_clean('s')}, '_:')")
def s2_nquads(spark: SparkSession, d: str) -> DataFrame:
    """The links with their graphs, written as N-Quads and read again."""
    from .functions.terms import iri_of

    ship(spark)
    t = table(spark, d, "triples").select(clean_iri("s").alias("s"), clean_iri("p").alias("p"), iri_of("o").alias("o"), clean_iri("graph_iri").alias("g")).where("s <> '' and p <> '' and o is not null and g is not null and not startswith(s, '_:')")
    to = scratch(spark)
    t.select(F.concat_ws(" ", *(_nt(c) for c in "spog"), F.lit(".")).alias("value")).write.text(to)
    return readers.read_nquads(spark, to)


@query(_L + "SELECT * FROM t WHERE s <> '' AND p <> '' AND NOT starts_with(s, '_:')")
def s3_turtle(spark: SparkSession, d: str) -> DataFrame:
    """The links, written as Turtle and read again."""
    ship(spark)
    to = scratch(spark)
    writers.write_turtle(links(spark, d).where("s <> '' and p <> '' and not startswith(s, '_:')"), to)
    return readers.read_documents(spark, to, "turtle").where("error is null").select("s", "p", "o").distinct()


def _files(spark: SparkSession, parts: DataFrame, head: str, between: str, tail: str) -> str:
    """parts: value, n. One text file a group of values, as a whole document each."""
    to = scratch(spark)
    whole = parts.groupBy("n").agg(F.concat(F.lit(head), F.array_join(F.collect_list("value"), between), F.lit(tail)).alias("value"))
    whole.repartition("n").write.partitionBy("n").text(to)
    return to


_CUSTOMERS = f"""SELECT {iri('customer', 'c_custkey')} AS s, '{EX}c_name' AS p, '"' || c_name || '"' AS o FROM customer
UNION ALL SELECT {iri('customer', 'c_custkey')}, '{EX}c_nationkey', {iri('nation', 'c_nationkey')} FROM customer UNION ALL SELECT {iri('customer', 'c_custkey')}, '{RDF_TYPE}', '{EX}Customer' FROM customer"""


@query(_CUSTOMERS)
def s4_rdfxml(spark: SparkSession, d: str) -> DataFrame:
    """The customers as RDF/XML documents."""
    ship(spark)
    node = F.format_string(f'<e:Customer r:about="{EX}customer/%s"><e:c_name>%s</e:c_name><e:c_nationkey r:resource="{EX}nation/%s"/></e:Customer>', F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string"))
    parts = table(spark, d, "customer").select(node.alias("value"), (F.col("c_custkey") % 8).alias("n"))
    to = _files(spark, parts, f'<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="{EX}">', "", "</r:RDF>")
    return readers.read_documents(spark, f"{to}/*", "rdfxml").where("error is null").select("s", "p", "o")


@query(_CUSTOMERS)
def s5_jsonld(spark: SparkSession, d: str) -> DataFrame:
    """The customers as JSON-LD documents."""
    ship(spark)
    node = F.format_string(f'{{"@id": "{EX}customer/%s", "@type": "e:Customer", "e:c_name": "%s", "e:c_nationkey": {{"@id": "{EX}nation/%s"}}}}', F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string"))
    parts = table(spark, d, "customer").select(node.alias("value"), (F.col("c_custkey") % 8).alias("n"))
    to = _files(spark, parts, f'{{"@context": {{"e": "{EX}"}}, "@graph": [', ", ", "]}")
    return readers.read_documents(spark, f"{to}/*", "jsonld").where("error is null").select("s", "p", "o")


@query(_S + "SELECT (SELECT count(*) FROM t) AS statements, (SELECT count(*) FROM events) AS errors")
def s6_import(spark: SparkSession, d: str) -> DataFrame:
    """Good lines and lines that are none, in one file: how many statements, how many errors."""
    ship(spark)
    to = scratch(spark)
    good = writers.ntriples(cut(statements(table(spark, d, "triples"))))
    good.unionByName(table(spark, d, "events").select(F.col("props").alias("value"))).write.text(to)
    triples, _, errors = readers.read_ntriples(spark, to)
    return triples.agg(F.count(F.lit(1)).alias("statements")).join(errors.agg(F.count(F.lit(1)).alias("errors")))


@query("SELECT '<' || s || '> <' || p || '> <' || o || '> .' AS value FROM (" + _L + "SELECT * FROM t WHERE s <> '' AND p <> '' AND NOT starts_with(s, '_:'))")
def s8_export(spark: SparkSession, d: str) -> DataFrame:
    """The links through a store and out again as lines."""
    store = Store(spark, scratch(spark))
    store.insert(links(spark, d).where("s <> '' and p <> '' and not startswith(s, '_:')"))
    return store.export()


@query(_L + f"""SELECT 'whole' AS step, count(*) AS n, 0::BIGINT AS twice FROM t WHERE p = '{KGP}instanceOf' UNION ALL SELECT 'added', count(*) FILTER (p <> '{KGP}instanceOf'), count(*) FILTER (p = '{KGP}instanceOf') FROM t
UNION ALL SELECT 'removed', count(*), 0 FROM t WHERE p = '{KGP}locatedIn' UNION ALL SELECT 'left', count(*), 0 FROM t WHERE p <> '{KGP}locatedIn'""")
def s7_bulk_insert(spark: SparkSession, d: str) -> DataFrame:
    """What a store says of two insertions and a removal, and what is left."""
    t = cut(links(spark, d))
    store = Store(spark, scratch(spark))
    steps = [("whole", *store.insert(t.where(F.col("p") == KGP + "instanceOf"))), ("added", *store.insert(t)), ("removed", store.delete(t.where(F.col("p") == KGP + "locatedIn")), 0)]
    return spark.createDataFrame([*steps, ("left", store.triples().count(), 0)], "step string, n long, twice long")


@query(_L + f"SELECT * FROM t WHERE p <> '{KGP}locatedIn'")
def s12_store(spark: SparkSession, d: str) -> DataFrame:
    """Versions that are changes of the one before, made whole, verified and read."""
    t = cut(links(spark, d))
    store = Store(spark, scratch(spark))
    store.insert(t.where(F.col("p") == KGP + "instanceOf"))
    store.insert(t)
    store.delete(t.where(F.col("p") == KGP + "locatedIn"))
    store.compact()
    assert not store.verify().where("not ok").count()
    return store.triples()


@query(_L + f"SELECT s, o FROM t WHERE p = '{KGP}locatedIn'")
def s12_predicate_scan(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, scratch(spark))
    store.insert(links(spark, d))
    return store.triples(predicate=KGP + "locatedIn").select("s", "o")


@query(_L + f"SELECT * FROM t WHERE p = '{KGP}instanceOf'")
def s10_replace(spark: SparkSession, d: str) -> DataFrame:
    t = cut(links(spark, d))
    store = Store(spark, scratch(spark))
    store.insert(t)
    store.replace(t.where(F.col("p") == KGP + "instanceOf"))
    return store.triples()


_SHOWN = "coalesce(lang, '') AS lang, coalesce(text, '') AS text, doc_id FROM documents"


@query(f"""SELECT doc_id || ',' || lang || ',' || CASE WHEN regexp_matches(text, '[",\r\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS value FROM (SELECT {_SHOWN})""")
def s11_csv_texts(spark: SparkSession, d: str) -> DataFrame:
    return writers.results(table(spark, d, "documents").select("doc_id", "lang", "text"), "csv")


@query(f"SELECT doc_id || chr(9) || lang || chr(9) || replace(replace(text, chr(9), '\\t'), chr(10), '\\n') AS value FROM (SELECT {_SHOWN})")
def s11_tsv_texts(spark: SparkSession, d: str) -> DataFrame:
    return writers.results(table(spark, d, "documents").select("doc_id", "lang", "text"), "tsv")


@query("""SELECT '<result><binding name="doc_id"><literal>' || doc_id || '</literal></binding>' || CASE WHEN text IS NULL THEN '' ELSE '<binding name="text"><literal>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</literal></binding>' END || '</result>' AS value FROM documents""")
def s11_xml_texts(spark: SparkSession, d: str) -> DataFrame:
    return writers.results(table(spark, d, "documents").select("doc_id", "text"), "xml")


@query("SELECT doc_id, lang, text FROM documents")
def s11_json_texts(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines, read again."""
    lines = writers.results(table(spark, d, "documents").select("doc_id", "lang", "text"), "json")
    return lines.select(F.from_json("value", "doc_id bigint, lang string, text string").alias("x")).select("x.*")


@query(f"WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) SELECT {iri('embeddings', 'vec_id')} AS x FROM embeddings, q WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) >= 0.2")
def s13_vectors_inserted(spark: SparkSession, d: str) -> DataFrame:
    """Vectors declared, inserted as literals, and searched."""
    ship(spark)
    g = Graph(spark, prefixes={"ex": EX})
    g.declare_vectors(EX + "near", 64)
    g.insert_vectors(EX + "near", table(spark, d, "embeddings").select(F.concat(F.lit(EX + "embeddings/"), F.col("vec_id").cast("string")).alias("s"), F.col("embedding").alias("vec")))
    return g.sparql(f'SELECT ?x WHERE {{ VECTOR_SIMILAR(?x ex:near "{vector_text(spark, d)}"^^tv:f32vec, 0.2) }}')


@query(_L + "SELECT count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT p) AS properties, count(DISTINCT o) AS objects FROM t")
def s14_service_description(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of the description, taken from its text."""
    text = writers.service_description(links(spark, d))
    names = {"triples": "triples", "distinctSubjects": "subjects", "properties": "properties", "distinctObjects": "objects"}
    return spark.range(1).select(*(F.regexp_extract(F.lit(text), rf"void:{k} (\d+)", 1).cast("long").alias(v) for k, v in names.items()))


@query(f"""SELECT {iri('nation', 'n_nationkey')} AS s, '{EX}n_name' AS p, '"' || n_name || '"' AS o FROM nation
UNION ALL SELECT '<< {EX}nation/' || n_nationkey || ' {EX}n_name "' || n_name || '" >>', '{EX}source', '{EX}census' FROM nation
UNION ALL SELECT '<< << {EX}nation/' || n_nationkey || ' {EX}n_name "' || n_name || '" >> {EX}source {EX}census >>', '{EX}checkedBy', {iri('region', 'n_regionkey')} FROM nation""")
def f8_nested_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Statements about statements about statements, read from lines."""
    inner = F.format_string(f'<< <{EX}nation/%s> <{EX}n_name> "%s" >>', F.col("n_nationkey").cast("string"), "n_name")
    line = F.concat(F.lit("<< "), inner, F.lit(f" <{EX}source> <{EX}census> >> <{EX}checkedBy> <{EX}region/"), F.col("n_regionkey").cast("string"), F.lit("> ."))
    return readers.load_lines(table(spark, d, "nation").select(line.alias("value")))[0]


# updates


_SUBS = f"SELECT DISTINCT {sql_clean('class_iri')} AS s, {sql_clean('parent_iri')} AS o FROM subclass_of WHERE class_iri IS NOT NULL AND parent_iri IS NOT NULL"


@query(f"SELECT s, o FROM ({_SUBS}) UNION SELECT * FROM (VALUES ('{EX}a', '{EX}b'), ('{EX}b', '{PREFIXES['kgc']}C500'))")
def q6_insert_data(spark: SparkSession, d: str) -> DataFrame:
    g = classes(spark, d)
    g.prefixes["ex"] = EX
    n = g.update("INSERT DATA { ex:a rdfs:subClassOf ex:b . ex:b rdfs:subClassOf kgc:C500 . ex:a rdfs:subClassOf ex:b }")
    assert n == 2
    return g.sparql("SELECT ?s ?o WHERE { ?s rdfs:subClassOf ?o }")


@query(f"SELECT s, o FROM ({_SUBS}) EXCEPT SELECT s, o FROM ({_SUBS} ORDER BY 1, 2 LIMIT 1)")
def q7_delete_data(spark: SparkSession, d: str) -> DataFrame:
    """The first edge by name goes, and one that never was."""
    g = classes(spark, d)
    g.prefixes["ex"] = EX
    r = g.triples.orderBy("s", "o").first()
    assert g.update(f"DELETE DATA {{ <{r['s']}> rdfs:subClassOf <{r['o']}> . ex:a rdfs:subClassOf ex:b }}") == 1
    return g.sparql("SELECT ?s ?o WHERE { ?s rdfs:subClassOf ?o }")


@query(_Q + _FALL.split("SELECT s, p, o, CAST")[0] + """, gone AS (SELECT q.s, q.p, q.o FROM m JOIN q ON q.key = m.key UNION SELECT n.s, n.p, n.o FROM m JOIN n ON n.s = m.key)
SELECT p, count(*) AS n FROM (SELECT s, p, o FROM q UNION SELECT s, p, o FROM n EXCEPT SELECT s, p, o FROM gone) GROUP BY 1""")
def r2_commit(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each predicate after a retraction is carried out."""
    g = annotated(spark, d)
    retract.retract(g, HOT, commit=True)
    return g.triples.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query(_Q + f"""one AS (SELECT s, p, o, key FROM q WHERE key IN (SELECT s FROM n WHERE p = '{VOCABULARY}generatedBy') ORDER BY key LIMIT 1) SELECT n.o AS a FROM n JOIN one ON n.s = one.key WHERE n.p = '{VOCABULARY}generatedBy'""")
def f5_ground_quoted(spark: SparkSession, d: str) -> DataFrame:
    """Who made one statement that is given in full: the first by name that has a maker."""
    g = annotated(spark, d)
    made = g.triples.where(F.col("p") == VOCABULARY + "generatedBy").select(F.col("s").alias("key"))
    r = g.quoted.join(made, "key", "left_semi").orderBy("key").first()
    return g.sparql(f"SELECT ?a WHERE {{ << <{r['qs']}> <{r['qp']}> <{r['qo']}> >> tv:generatedBy ?a }}")


@query(_S + f"""SELECT s, o FROM t WHERE p = '{KGP}description' AND regexp_matches(o, '"@(en-gb|EN-GB|en-GB)$')""")
def e14_lang_equals(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    g = Graph(spark, triples=cut(statements(table(spark, d, "triples")), "p", "s"), prefixes=KG)
    return g.sparql('SELECT ?s ?o WHERE { ?s kgp:description ?o FILTER(LANG(?o) = "en-gb") }')


# time


@query(f"""WITH x AS (SELECT l_orderkey, list_sort(list(epoch(l_shipdate)::BIGINT)) AS s, list_sort(list(epoch(l_shipdate)::BIGINT + 86400 * CAST(l_quantity AS BIGINT))) AS e FROM lineitem GROUP BY 1)
SELECT {iri('orders', 'l_orderkey')} AS o FROM x WHERE len(list_filter(list_zip(s, e), lambda z: z[1] <= epoch(TIMESTAMP '1997-05-01') AND z[2] >= epoch(TIMESTAMP '1997-05-01'))) > 0""")
def t5_several_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Orders on their way at a moment: each line item is one start and one end of the same statement."""
    ship(spark)
    line = table(spark, d, "lineitem")
    key = lambda c: F.concat(F.lit(EX + "orders/"), F.col(c).cast("string"))
    who = line.select(key("l_orderkey").alias("s"), F.lit(EX + "state").alias("p"), F.lit('"shipping"').alias("o"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"), F.col("l_quantity").cast("long").alias("q"))
    quoted = F.concat(F.lit("<< "), "s", F.lit(" "), "p", F.lit(" "), "o", F.lit(" >>"))
    at = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit(f'"^^<{XSD}integer>'))
    starts = F.floor(F.col("us") / 1_000_000)
    notes = who.select(quoted.alias("s"), F.lit(VOCABULARY + "validFrom").alias("p"), at(starts).alias("o")).unionByName(who.select(quoted.alias("s"), F.lit(VOCABULARY + "validTo").alias("p"), at(starts + 86400 * F.col("q")).alias("o")))
    base = who.select("s", "p", "o").distinct()
    g = Graph(spark, triples=cut(base.unionByName(notes)), quoted=cut(base.select(quoted.alias("key"), F.col("s").alias("qs"), F.col("p").alias("qp"), F.col("o").alias("qo"))), prefixes={"ex": EX})
    return g.sparql('SELECT ?o WHERE { AT_TIME("1997-05-01") { ?o ex:state ?x } }')


# paths, vectors


ORACLES["path_greedy"] = f"""WITH RECURSIVE q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS sc FROM embeddings, q),
e AS MATERIALIZED (SELECT a.vec_id AS src, b.vec_id AS dst, b.sc FROM v a JOIN v b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id) <= 16),
best AS MATERIALIZED (SELECT src, dst, sc FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY sc DESC, '{EX}embeddings/' || dst) = 1),
w AS (SELECT vec_id AS a, vec_id AS b, sc, 0 AS k FROM v WHERE label = 3 UNION ALL SELECT w.a, best.dst, best.sc, k + 1 FROM w JOIN best ON best.src = w.b WHERE best.sc > w.sc)
SELECT '{EX}embeddings/' || a AS a, '{EX}embeddings/' || b AS b FROM w QUALIFY row_number() OVER (PARTITION BY a ORDER BY k DESC) = 1"""


@query("""WITH e AS (SELECT a.vec_id AS src FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) <= 16), p AS (SELECT src, count(*) AS n FROM e GROUP BY 1)
SELECT (SELECT count(*) FROM embeddings) AS active, CAST(avg(n) AS DOUBLE) AS avg_neighbours, min(n) AS min_neighbours, max(n) AS max_neighbours, CAST(sum(n) AS BIGINT) AS horizontal_edges, 'healthy' AS status FROM p""")
def v13_bottom_health(spark: SparkSession, d: str) -> DataFrame:
    from .more_queries import v11_bottom_layer

    edges = cut(v11_bottom_layer(spark, d))
    nodes = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).alias("layer"), F.lit(False).alias("deleted"))
    return health.index_health(nodes, edges, 8).select("active", "avg_neighbours", "min_neighbours", "max_neighbours", "horizontal_edges", "status")


# discovery and upkeep

ORACLES["d4_deep"] = _L + """, x AS (SELECT DISTINCT a.s AS root, a.p || ' ' || b.p AS path FROM t a JOIN (SELECT DISTINCT s, p FROM t) b ON b.s = a.o), sig AS (SELECT root, string_agg(path, ',' ORDER BY path) AS sig FROM x GROUP BY 1 HAVING count(*) >= 2),
kept AS MATERIALIZED (SELECT root FROM sig WHERE sig IN (SELECT sig FROM sig GROUP BY 1 HAVING count(*) >= 40)), per AS (SELECT path, count(*) AS roots, count(*) / (SELECT count(*) FROM kept) AS coverage FROM x WHERE root IN (SELECT root FROM kept) GROUP BY 1),
fan AS (SELECT p, avg(n) AS fan_in FROM (SELECT p, o, count(DISTINCT s) AS n FROM t WHERE s IN (SELECT root FROM kept) GROUP BY 1, 2) GROUP BY 1)
SELECT path, roots, coverage, fan_in FROM per JOIN fan ON p = split_part(path, ' ', 1) WHERE coverage >= 0.5 AND fan_in <= 3"""


def facts(spark: SparkSession, d: str) -> DataFrame:
    """All statements, those with literals, too."""
    ship(spark)
    return cut(statements(table(spark, d, "triples")), "p", "s")


@query(_S + ", x AS (SELECT DISTINCT s AS node, '>' || p AS prop FROM t UNION SELECT o, '<' || p FROM t), g AS (SELECT node, string_agg(prop, ' ' ORDER BY prop) AS sig FROM x GROUP BY 1) SELECT sig, count(*) AS nodes FROM g GROUP BY 1")
def d1_signatures_of_facts(spark: SparkSession, d: str) -> DataFrame:
    return proptable.signatures(facts(spark, d)).groupBy(F.array_join("sig", " ").alias("sig")).agg(F.count(F.lit(1)).alias("nodes"))


@query(_S + f"SELECT a.s AS x, a.o AS c, b.o AS n FROM t a JOIN t b ON b.s = a.s WHERE a.p = '{KGP}instanceOf' AND b.p = '{KGP}regCode'")
def d3_found_tables_serve(spark: SparkSession, d: str) -> DataFrame:
    """A star over found tables gives what the statements give."""
    g = Graph(spark, triples=facts(spark, d), prefixes=KG)
    g.find_tables()
    return g.sparql("SELECT ?x ?c ?n WHERE { ?x kgp:instanceOf ?c ; kgp:regCode ?n }")


@query(_L + f"SELECT a.s AS x, b.o AS y FROM t a JOIN t b ON b.s = a.o WHERE a.p = '{KGP}locatedIn' AND b.p = '{KGP}instanceOf'")
def j9_kept_chain(spark: SparkSession, d: str) -> DataFrame:
    """A two-step path from a table joined beforehand."""
    ship(spark)
    g = Graph(spark, triples=cut(links(spark, d), "p", "s"), prefixes=KG)
    g.keep_chain(KGP + "locatedIn", KGP + "instanceOf")
    return g.sparql("SELECT ?x ?y WHERE { ?x kgp:locatedIn/kgp:instanceOf ?y }")


_STEPS = ["c_acctbal", "c_custkey", "c_mktsegment", "c_name", "c_nationkey", "c_nationkey_id"]


@query("SELECT path, (SELECT count(*) FROM orders) AS roots, 1.0::DOUBLE AS coverage, (SELECT count(*) / count(DISTINCT o_custkey) FROM orders) AS fan_in FROM (VALUES " + ", ".join(f"('{EX}o_custkey {x}')" for x in [RDF_TYPE, *(EX + c for c in _STEPS)]) + ") v(path)")
def d4_deep_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two-step paths that all orders share, through customers with up to twenty orders on average."""
    g = tables_graph(spark, d, "orders", "customer")
    return proptable.deep(cut(g.sparql("CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }")), fan_in=20)


@query(_L + "SELECT count(*) AS statements, count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates, 'healthy' AS status FROM t")
def m3_report(spark: SparkSession, d: str) -> DataFrame:
    r = health.report(Graph(spark, triples=cut(links(spark, d))))
    return spark.createDataFrame([(r["statements"], r["subjects"], r["predicates"], r["status"])], "statements long, subjects long, predicates long, status string")


@query(_L + f"SELECT 2::BIGINT AS updates, (SELECT count(DISTINCT p) FROM t WHERE p <> '{KGP}locatedIn') + 1 AS predicates, (SELECT count(*) FROM t WHERE p <> '{KGP}locatedIn') + 1 AS statements")
def m1_maintenance(spark: SparkSession, d: str) -> DataFrame:
    """Two updates, then a maintenance run that writes them as one table."""
    ship(spark)
    t = cut(links(spark, d))
    g = Graph(spark, triples=t, prefixes={"ex": EX})
    g.update("INSERT DATA { ex:a ex:p ex:b }")
    g.delete(t.where(F.col("p") == KGP + "locatedIn"))
    done = health.maintain(g, tables=False)
    assert g.updates == 0
    return g.triples.agg(F.lit(done["updates"]).cast("long").alias("updates"), F.lit(done["predicates"]).cast("long").alias("predicates"), F.count(F.lit(1)).alias("statements"))


@query("SELECT 3::BIGINT AS queries, (SELECT count(*) FROM nation) + 2 * (SELECT count(*) FROM region) AS rows")
def m2_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = health.QueryMetrics()
    for name in ("nation", "region", "region"):
        m.timed(table(spark, d, name), shape=name)
    s = m.summary()
    return spark.createDataFrame([(s["queries"], s["rows"])], "queries long, rows long")


@query(_L.replace("WITH t", "WITH RECURSIVE t", 1) + f""", ty AS (SELECT DISTINCT s AS node, o AS cls FROM t WHERE p = '{KGP}instanceOf'), pair AS (SELECT a.cls AS a, b.cls AS b FROM ty a JOIN ty b ON a.node = b.node AND a.cls < b.cls ORDER BY 1, 2 LIMIT 1)
SELECT 'disjoint' AS kind, x.node AS s, '{RDF_TYPE}' AS p, x.cls AS o FROM ty x JOIN ty y ON x.node = y.node, pair WHERE (x.cls = a AND y.cls = b) OR (x.cls = b AND y.cls = a)""")
def x1_disjoint(spark: SparkSession, d: str) -> DataFrame:
    """Entities with two classes that exclude each other: the first pair of classes, by name, that any entity has together."""
    data = cut(links(spark, d).withColumn("p", F.when(F.col("p") == KGP + "instanceOf", RDF_TYPE).otherwise(F.col("p"))))
    ty = data.where(F.col("p") == RDF_TYPE).select("s", "o").distinct()
    first = ty.select("s", F.col("o").alias("a")).join(ty.select("s", F.col("o").alias("b")), "s").where("a < b").orderBy("a", "b").select("a", "b").first()
    schema = spark.createDataFrame([(first["a"], owl.OWL + "disjointWith", first["b"])] if first else [], "s string, p string, o string")
    sub = table(spark, d, "subclass_of").select(clean_iri("class_iri").alias("child"), clean_iri("parent_iri").alias("parent")).where("child is not null and parent is not null")
    return owl.violations(data, schema, sub)
