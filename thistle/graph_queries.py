"""Queries of the graph engine over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .graph import Graph
from .plans.mapping import test_tables
from .runtime import ship

EX = "http://ex.example/"
XSD = "http://www.w3.org/2001/XMLSchema#"


def tables_graph(spark: SparkSession, d: str, *names: str, **options) -> Graph:
    ship(spark)
    return Graph(spark, test_tables(spark, d, *names), prefixes={"ex": EX, "": EX}, **options)


#: name -> (tables, query, SQL)
TABLE_QUERIES: dict[str, tuple[str, str, str]] = {}


def add(name: str, tables: str, query: str, sql: str) -> None:
    TABLE_QUERIES[name] = (tables, query, sql)


def iri(name: str, column: str) -> str:
    return f"'{EX}{name}/' || {column}"


# scans

add("f1_predicate_scan", "nation", "SELECT ?s ?n WHERE { ?s ex:n_name ?n }", f"SELECT {iri('nation', 'n_nationkey')} AS s, n_name AS n FROM nation")
add("f1_constant_object", "customer", 'SELECT ?c WHERE { ?c ex:c_mktsegment "BUILDING" }', f"SELECT {iri('customer', 'c_custkey')} AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
add("f1_constant_subject", "orders", "SELECT ?t ?d WHERE { <http://ex.example/orders/7> ex:o_totalprice ?t ; ex:o_orderdate ?d }", "SELECT o_totalprice AS t, o_orderdate AS d FROM orders WHERE o_orderkey = 7")
add("f3_repeated_variable", "customer supplier", "SELECT ?c ?s WHERE { ?c ex:c_nationkey ?n ; ex:c_custkey ?k . ?s ex:s_nationkey ?n ; ex:s_suppkey ?k }",
    f"SELECT {iri('customer', 'c_custkey')} AS c, {iri('supplier', 's_suppkey')} AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey")
add("f2_full_scan", "region", "SELECT ?s ?p ?o WHERE { ?s ?p ?o }", f"""SELECT {iri('region', 'r_regionkey')} AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, '{EX}Region' AS o FROM region
UNION ALL SELECT {iri('region', 'r_regionkey')}, '{EX}r_regionkey', '"' || r_regionkey || '"^^<{XSD}integer>' FROM region
UNION ALL SELECT {iri('region', 'r_regionkey')}, '{EX}r_name', '"' || r_name || '"' FROM region""")
add("f4_variable_predicate", "nation", 'SELECT ?s ?p WHERE { ?s ?p "NATION_3" }', f"SELECT {iri('nation', 'n_nationkey')} AS s, '{EX}n_name' AS p FROM nation WHERE n_name = 'NATION_3'")
add("f11_values", "orders", 'SELECT ?o ?p WHERE { VALUES ?p { "1-URGENT" "5-LOW" } ?o ex:o_orderpriority ?p ; ex:o_totalprice ?t FILTER(?t > 400000) }',
    f"SELECT {iri('orders', 'o_orderkey')} AS o, o_orderpriority AS p FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_totalprice > 400000")
add("f11_values_rows", "customer", 'SELECT ?c ?seg ?n WHERE { VALUES (?seg ?n) { ("BUILDING" ex:n1) ("MACHINERY" UNDEF) } ?c ex:c_mktsegment ?seg }',
    f"SELECT {iri('customer', 'c_custkey')} AS c, c_mktsegment AS seg, CASE c_mktsegment WHEN 'BUILDING' THEN '{EX}n1' END AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")

# joins

add("j2_foreign_key", "nation region", "SELECT ?n ?r WHERE { ?x ex:n_name ?n ; ex:n_regionkey ?k . ?k ex:r_name ?r }", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
add("j9_chain", "customer nation region orders", "SELECT ?r (COUNT(*) AS ?n) (ROUND(SUM(?t)) AS ?total) WHERE { ?o ex:o_custkey/ex:c_nationkey/ex:n_regionkey ?g ; ex:o_totalprice ?t . ?g ex:r_name ?r } GROUP BY ?r",
    "SELECT r_name AS r, count(*) AS n, round(sum(o_totalprice)) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
add("j10_star", "part", "SELECT ?p ?n ?b ?s WHERE { ?p a ex:Part ; ex:p_name ?n ; ex:p_brand ?b ; ex:p_size ?s ; ex:p_retailprice ?r FILTER(?r > 950 && ?s < 10) }",
    f"SELECT {iri('part', 'p_partkey')} AS p, p_name AS n, p_brand AS b, CAST(p_size AS BIGINT) AS s FROM part WHERE p_retailprice > 950 AND p_size < 10")
add("j6_cross_product", "region", "SELECT ?a ?b WHERE { ?x ex:r_name ?a . ?y ex:r_name ?b }", "SELECT x.r_name AS a, y.r_name AS b FROM region x, region y")
add("j8_theta", "region", "SELECT ?a ?b WHERE { ?x ex:r_name ?a . ?y ex:r_name ?b FILTER(?a < ?b) }", "SELECT x.r_name AS a, y.r_name AS b FROM region x JOIN region y ON x.r_name < y.r_name")
add("j_self_join", "supplier", "SELECT ?a ?b WHERE { ?a ex:s_nationkey ?n . ?b ex:s_nationkey ?n ; ex:s_acctbal ?v FILTER(?v > 9000 && ?a != ?b) }",
    f"SELECT {iri('supplier', 'a.s_suppkey')} AS a, {iri('supplier', 'b.s_suppkey')} AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE b.s_acctbal > 9000 AND a.s_suppkey <> b.s_suppkey")
add("j_lineitem_star", "lineitem orders", 'SELECT ?f (COUNT(*) AS ?n) (SUM(?q) AS ?qty) WHERE { ?l ex:l_orderkey ?o ; ex:l_quantity ?q ; ex:l_returnflag ?f . ?o ex:o_orderstatus "F" } GROUP BY ?f',
    "SELECT l_returnflag AS f, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
add("j4_optional", "orders lineitem", "SELECT ?o (COUNT(?q) AS ?n) WHERE { ?o ex:o_totalprice ?t OPTIONAL { ?l ex:l_orderkey ?o ; ex:l_quantity ?q } } GROUP BY ?o",
    f"SELECT {iri('orders', 'o_orderkey')} AS o, count(l_quantity) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
add("j4_optional_filter", "orders lineitem", "SELECT ?o ?q WHERE { ?o ex:o_totalprice ?t OPTIONAL { ?l ex:l_orderkey ?o ; ex:l_quantity ?q FILTER(?q > 49 && ?t > 200000) } }",
    f"SELECT {iri('orders', 'o_orderkey')} AS o, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 49 AND o_totalprice > 200000")
add("j4_nested_optional", "customer orders lineitem", 'SELECT ?c ?o ?q WHERE { ?c ex:c_mktsegment "BUILDING" OPTIONAL { ?o ex:o_custkey ?c ; ex:o_orderstatus "P" OPTIONAL { ?l ex:l_orderkey ?o ; ex:l_quantity ?q FILTER(?q = 50) } } }',
    f"""SELECT {iri('customer', 'c_custkey')} AS c, {iri('orders', 'o_orderkey')} AS o, l_quantity AS q FROM customer LEFT JOIN (SELECT * FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity = 50 WHERE o_orderstatus = 'P') x
 ON x.o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
add("j7_maybe_unbound", "customer supplier nation", "SELECT ?x ?n ?name WHERE { { ?x ex:c_acctbal ?b FILTER(?b > 9900) } UNION { ?x ex:s_nationkey ?n } ?n ex:n_name ?name . ?n ex:n_nationkey 3 }",
    f"SELECT {iri('customer', 'c_custkey')} AS x, '{EX}nation/3' AS n, (SELECT n_name FROM nation WHERE n_nationkey = 3) AS name FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT {iri('supplier', 's_suppkey')}, '{EX}nation/3', (SELECT n_name FROM nation WHERE n_nationkey = 3) FROM supplier WHERE s_nationkey = 3")
add("o6_union", "customer supplier", "SELECT ?x ?b WHERE { { ?x ex:c_acctbal ?b } UNION { ?x ex:s_acctbal ?b } FILTER(?b < 0) }",
    f"SELECT {iri('customer', 'c_custkey')} AS x, c_acctbal AS b FROM customer WHERE c_acctbal < 0 UNION ALL SELECT {iri('supplier', 's_suppkey')}, s_acctbal FROM supplier WHERE s_acctbal < 0")
add("o6_union_other_variables", "nation region", "SELECT ?n ?r WHERE { { ?x ex:n_name ?n } UNION { ?y ex:r_name ?r } }", "SELECT n_name AS n, NULL AS r FROM nation UNION ALL SELECT NULL, r_name FROM region")
add("e4_not_bound", "orders lineitem", "SELECT ?o WHERE { ?o ex:o_totalprice ?t OPTIONAL { ?l ex:l_orderkey ?o ; ex:l_quantity ?q } FILTER(!BOUND(?q)) }",
    f"SELECT {iri('orders', 'o_orderkey')} AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
add("f12_exists", "orders lineitem", "SELECT ?o WHERE { ?o ex:o_totalprice ?t FILTER EXISTS { ?l ex:l_orderkey ?o ; ex:l_quantity ?q FILTER(?q > 49) } }",
    f"SELECT {iri('orders', 'o_orderkey')} AS o FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
add("f12_not_exists", "customer orders", "SELECT ?c WHERE { ?c ex:c_name ?n FILTER NOT EXISTS { ?o ex:o_custkey ?c ; ex:o_totalprice ?t FILTER(?t > 400000) } }",
    f"SELECT {iri('customer', 'c_custkey')} AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
add("f12_exists_correlated", "customer orders", "SELECT ?c WHERE { ?c ex:c_acctbal ?b FILTER EXISTS { ?o ex:o_custkey ?c ; ex:o_totalprice ?t FILTER(?t < ?b * 10) } }",
    f"SELECT {iri('customer', 'c_custkey')} AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < c_acctbal * 10)")
add("f12_exists_or", "orders lineitem", 'SELECT ?o WHERE { ?o ex:o_orderstatus ?s ; ex:o_totalprice ?t FILTER(?t > 450000 || EXISTS { ?l ex:l_orderkey ?o ; ex:l_discount 0.1 ; ex:l_quantity 50 }) }',
    f"SELECT {iri('orders', 'o_orderkey')} AS o FROM orders WHERE o_totalprice > 450000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount = 0.1 AND l_quantity = 50)")
add("x_minus", "customer orders", 'SELECT ?c WHERE { ?c ex:c_mktsegment "MACHINERY" MINUS { ?o ex:o_custkey ?c ; ex:o_orderpriority "1-URGENT" } }',
    f"SELECT {iri('customer', 'c_custkey')} AS c FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")

add("f13_hidden_variables", "nation region", 'SELECT * WHERE { ?n ex:n_regionkey/ex:r_name ?r ; ex:n_name ?x FILTER(?r != "ASIA") } ORDER BY STRLEN(?x)', f"SELECT {iri('nation', 'n_nationkey')} AS n, r_name AS r, n_name AS x FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
add("o7_sub_group", "orders customer", 'SELECT ?o ?m WHERE { ?o ex:o_custkey ?c ; ex:o_totalprice ?t . { ?c ex:c_mktsegment ?m ; ex:c_acctbal ?b FILTER(?b > 9000) { ?c ex:c_nationkey ?n FILTER(?t > 0 || ?n != ex:none) } } FILTER(?t > 300000) }',
    f"SELECT {iri('orders', 'o_orderkey')} AS o, c_mktsegment AS m FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000 AND c_acctbal > 9000")
add("a9_hidden_group_key", "part", "SELECT (COUNT(*) AS ?n) (MIN(?s) AS ?low) WHERE { ?p ex:p_type ?t ; ex:p_size ?s } GROUP BY (STRLEN(?t))", "SELECT count(*) AS n, CAST(min(p_size) AS BIGINT) AS low FROM part GROUP BY length(p_type)")
add("j_chain_of_links", "customer nation region orders", "SELECT ?r (COUNT(*) AS ?n) WHERE { ?o ex:o_custkey ?c . ?c ex:c_nationkey ?k . ?k ex:n_regionkey ?r } GROUP BY ?r", f"SELECT {iri('region', 'n_regionkey')} AS r, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")

# expressions

add("e1_equal", "customer", 'SELECT ?c WHERE { ?c ex:c_mktsegment ?m ; ex:c_nationkey_id ?n FILTER(?m = "BUILDING" && ?n != 3) }', f"SELECT {iri('customer', 'c_custkey')} AS c FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey <> 3")
add("e2_order_comparison", "orders", 'SELECT ?o WHERE { ?o ex:o_orderdate ?d ; ex:o_orderpriority ?p FILTER(?d >= "1996-01-01T00:00:00"^^xsd:dateTime && ?d < "1996-02-01T00:00:00"^^xsd:dateTime && ?p <= "2-HIGH") }',
    f"SELECT {iri('orders', 'o_orderkey')} AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01' AND o_orderpriority <= '2-HIGH'")
add("e3_precedence", "part", 'SELECT ?p WHERE { ?p ex:p_size ?s ; ex:p_brand ?b FILTER(?s = 1 || ?s = 2 && ?b = "Brand#11" || !(?s < 49)) }',
    f"SELECT {iri('part', 'p_partkey')} AS p FROM part WHERE p_size = 1 OR p_size = 2 AND p_brand = 'Brand#11' OR NOT (p_size < 49)")
add("e5_arithmetic", "part", "SELECT ?p ?v WHERE { ?p ex:p_size ?s ; ex:p_retailprice ?r BIND((?r + 2 * ?s) / (?s - 5) AS ?v) FILTER(?s < 12) }",
    f"SELECT {iri('part', 'p_partkey')} AS p, CASE WHEN p_size <> 5 THEN (p_retailprice + 2 * p_size) / (p_size - 5) END AS v FROM part WHERE p_size < 12")
add("e8_case_and_length", "part", "SELECT ?p ?u ?l ?n WHERE { ?p ex:p_name ?x ; ex:p_size 7 BIND(UCASE(?x) AS ?u) BIND(LCASE(STR(?x)) AS ?l) BIND(STRLEN(?x) AS ?n) }",
    f"SELECT {iri('part', 'p_partkey')} AS p, upper(p_name) AS u, lower(p_name) AS l, length(p_name) AS n FROM part WHERE p_size = 7")
add("e9_strlen", "documents", "SELECT ?d ?n ?m WHERE { ?d ex:text ?t ; ex:n_chars ?n BIND(STRLEN(?t) AS ?m) FILTER(?m = ?n) }", f"SELECT {iri('documents', 'doc_id')} AS d, n_chars AS n, length(text) AS m FROM documents WHERE length(text) = n_chars")
add("e10_replace", "part", 'SELECT ?p ?x WHERE { ?p ex:p_type ?t BIND(REPLACE(?t, "([A-Z])[a-z]+ ", "$1-") AS ?x) }', f"SELECT {iri('part', 'p_partkey')} AS p, regexp_replace(p_type, '([A-Z])[a-z]+ ', '\\1-', 'g') AS x FROM part")
add("e11_concat", "nation region", 'SELECT ?x WHERE { ?k ex:n_name ?n ; ex:n_regionkey ?g . ?g ex:r_name ?r BIND(CONCAT(?n, " in ", ?r) AS ?x) }', "SELECT n_name || ' in ' || r_name AS x FROM nation JOIN region ON n_regionkey = r_regionkey")
add("e12_contains", "part", 'SELECT ?p WHERE { ?p ex:p_name ?n FILTER(CONTAINS(?n, "lt") && STRSTARTS(?n, "blue") || STRENDS(?n, "gear")) }', f"SELECT {iri('part', 'p_partkey')} AS p FROM part WHERE contains(p_name, 'lt') AND starts_with(p_name, 'blue') OR ends_with(p_name, 'gear')")
add("e13_regex", "documents", r'SELECT ?d WHERE { ?d ex:text ?t FILTER(REGEX(?t, "^[A-Z][a-z]+ was ")) }', f"SELECT {iri('documents', 'doc_id')} AS d FROM documents WHERE regexp_matches(text, '^[A-Z][a-z]+ was ')")
add("e16_datatype", "orders", "SELECT ?o WHERE { ?o ex:o_totalprice ?t ; ex:o_custkey ?c ; ex:o_orderstatus ?s FILTER(DATATYPE(?t) = xsd:double && isIRI(?c) && isLiteral(?s) && !isLiteral(?c) && ?t > 440000) }",
    f"SELECT {iri('orders', 'o_orderkey')} AS o FROM orders WHERE o_totalprice > 440000")
add("e18_coalesce", "orders lineitem", "SELECT ?o ?x WHERE { ?o ex:o_totalprice ?t OPTIONAL { ?l ex:l_orderkey ?o ; ex:l_quantity ?q FILTER(?q > 49) } BIND(COALESCE(?q, ?t) AS ?x) }",
    f"SELECT {iri('orders', 'o_orderkey')} AS o, coalesce(l_quantity, o_totalprice) AS x FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 49")
add("e19_if", "customer", 'SELECT ?x (COUNT(*) AS ?n) WHERE { ?c ex:c_acctbal ?b BIND(IF(?b < 0, "owes", "has") AS ?x) } GROUP BY ?x', "SELECT CASE WHEN c_acctbal < 0 THEN 'owes' ELSE 'has' END AS x, count(*) AS n FROM customer GROUP BY 1")
add("e20_in_and_casts", "orders", 'SELECT ?o ?y ?k WHERE { ?o ex:o_orderdate ?d ; ex:o_orderstatus ?s ; ex:o_totalprice ?t BIND(YEAR(?d) AS ?y) BIND(xsd:integer(FLOOR(?t)) AS ?k) FILTER(?s IN ("P", "F") && ?t NOT IN (1, 2) && ?t > 430000) }',
    f"SELECT {iri('orders', 'o_orderkey')} AS o, year(o_orderdate) AS y, CAST(floor(o_totalprice) AS BIGINT) AS k FROM orders WHERE o_orderstatus IN ('P', 'F') AND o_totalprice > 430000")

# aggregates

add("a1_group_by_expression", "part", "SELECT ?k (COUNT(*) AS ?n) WHERE { ?p ex:p_type ?t } GROUP BY (STRLEN(?t) AS ?k)", "SELECT length(p_type) AS k, count(*) AS n FROM part GROUP BY 1")
add("a2_implicit_group", "orders", "SELECT (COUNT(*) AS ?n) (SUM(?t) AS ?s) WHERE { ?o ex:o_totalprice ?t FILTER(?t < 0) }", "SELECT count(*) AS n, coalesce(sum(o_totalprice), 0) AS s FROM orders WHERE o_totalprice < 0")
add("a3_counts", "orders lineitem", "SELECT ?s (COUNT(*) AS ?n) (COUNT(?q) AS ?m) WHERE { ?o ex:o_orderstatus ?s OPTIONAL { ?l ex:l_orderkey ?o ; ex:l_quantity ?q FILTER(?q > 40) } } GROUP BY ?s",
    "SELECT o_orderstatus AS s, count(*) AS n, count(l_quantity) AS m FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40 GROUP BY 1")
add("a4_count_distinct", "lineitem", "SELECT ?f (COUNT(DISTINCT ?p) AS ?n) WHERE { ?l ex:l_partkey ?p ; ex:l_returnflag ?f } GROUP BY ?f", "SELECT l_returnflag AS f, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
add("a5_sum_avg_min_max", "lineitem", "SELECT ?f ?s (SUM(?q) AS ?qty) (ROUND(AVG(?d) * 100000) / 100000 AS ?disc) (MIN(?x) AS ?low) (MAX(?x) AS ?high) (SUM(?n) AS ?lines) WHERE { ?l ex:l_returnflag ?f ; ex:l_linestatus ?s ; ex:l_quantity ?q ; ex:l_discount ?d ; ex:l_extendedprice ?x ; ex:l_linenumber ?n } GROUP BY ?f ?s",
    "SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS qty, round(avg(l_discount) * 100000) / 100000 AS disc, min(l_extendedprice) AS low, max(l_extendedprice) AS high, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY 1, 2")
add("a8_having", "orders", "SELECT ?c (COUNT(*) AS ?n) WHERE { ?o ex:o_custkey ?c ; ex:o_totalprice ?t } GROUP BY ?c HAVING(COUNT(*) > 15 && SUM(?t) > 1000)",
    f"SELECT {iri('customer', 'o_custkey')} AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND sum(o_totalprice) > 1000")
add("a_group_concat", "nation region", 'SELECT ?r (GROUP_CONCAT(?n; SEPARATOR="|") AS ?all) WHERE { ?k ex:n_name ?n ; ex:n_regionkey ?g . ?g ex:r_name ?r } GROUP BY ?r',
    "SELECT r_name AS r, string_agg(n_name, '|' ORDER BY n_name) AS \"all\" FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
add("a_aggregate_expression", "lineitem", "SELECT ?f (ROUND(SUM(?x * (1 - ?d)) / COUNT(*) * 100) / 100 AS ?v) WHERE { ?l ex:l_returnflag ?f ; ex:l_extendedprice ?x ; ex:l_discount ?d } GROUP BY ?f", "SELECT l_returnflag AS f, round(sum(l_extendedprice * (1 - l_discount)) / count(*) * 100) / 100 AS v FROM lineitem GROUP BY 1")

# modifiers and forms

add("q2_distinct", "customer", "SELECT DISTINCT ?m ?n WHERE { ?c ex:c_mktsegment ?m ; ex:c_nationkey ?n }", f"SELECT DISTINCT c_mktsegment AS m, {iri('nation', 'c_nationkey')} AS n FROM customer")
add("o1_order_limit_offset", "orders", "SELECT ?o ?t WHERE { ?o ex:o_totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 20 OFFSET 10", f"SELECT {iri('orders', 'o_orderkey')} AS o, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, 1 LIMIT 20 OFFSET 10")
add("o1_order_by_expression", "part", "SELECT ?p ?n WHERE { ?p ex:p_name ?n ; ex:p_size ?s ; ex:p_partkey ?k } ORDER BY (?s * 100 - ?k) DESC(STRLEN(?n)) LIMIT 15", f"SELECT {iri('part', 'p_partkey')} AS p, p_name AS n FROM part ORDER BY p_size * 100 - p_partkey, length(p_name) DESC LIMIT 15")
add("q8_subquery", "orders customer", "SELECT ?n ?total WHERE { { SELECT ?c (ROUND(SUM(?t)) AS ?total) WHERE { ?o ex:o_custkey ?c ; ex:o_totalprice ?t } GROUP BY ?c ORDER BY DESC(?total) LIMIT 10 } ?c ex:c_name ?n }",
    "SELECT c_name AS n, total FROM (SELECT o_custkey, round(sum(o_totalprice)) AS total FROM orders GROUP BY 1 ORDER BY 2 DESC LIMIT 10) JOIN customer ON c_custkey = o_custkey")
add("q3_ask_true", "region", 'ASK { ?r ex:r_name "ASIA" }', "SELECT count(*) > 0 AS result FROM region WHERE r_name = 'ASIA'")
add("q3_ask_false", "region", 'ASK { ?r ex:r_name "ATLANTIS" }', "SELECT count(*) > 0 AS result FROM region WHERE r_name = 'ATLANTIS'")
add("q4_construct", "nation region", "CONSTRUCT { ?n ex:inRegion ?r . ?r ex:label ?x } WHERE { ?n ex:n_regionkey ?r . ?r ex:r_name ?x }",
    f"""SELECT {iri('nation', 'n_nationkey')} AS s, '{EX}inRegion' AS p, {iri('region', 'n_regionkey')} AS o FROM nation UNION SELECT {iri('region', 'r_regionkey')}, '{EX}label', '"' || r_name || '"' FROM region JOIN nation ON n_regionkey = r_regionkey""")
add("q5_describe", "nation region", "DESCRIBE <http://ex.example/region/2>", f"""SELECT '{EX}region/2' AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, '{EX}Region' AS o
UNION SELECT '{EX}region/2', '{EX}r_regionkey', '"2"^^<{XSD}integer>' UNION SELECT '{EX}region/2', '{EX}r_name', '"' || r_name || '"' FROM region WHERE r_regionkey = 2
UNION SELECT {iri('nation', 'n_nationkey')}, '{EX}n_regionkey', '{EX}region/2' FROM nation WHERE n_regionkey = 2""")
add("q5_describe_variable", "nation region", 'DESCRIBE ?r WHERE { ?r ex:r_name "ASIA" }', f"""SELECT {iri('region', 'r_regionkey')} AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, '{EX}Region' AS o FROM region WHERE r_name = 'ASIA'
UNION SELECT {iri('region', 'r_regionkey')}, '{EX}r_regionkey', '"' || r_regionkey || '"^^<{XSD}integer>' FROM region WHERE r_name = 'ASIA' UNION SELECT {iri('region', 'r_regionkey')}, '{EX}r_name', '"ASIA"' FROM region WHERE r_name = 'ASIA'
UNION SELECT {iri('nation', 'n_nationkey')}, '{EX}n_regionkey', {iri('region', 'n_regionkey')} FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
add("flagship", "orders customer", 'SELECT ?name (ROUND(SUM(?price)) AS ?total) WHERE { ?o a ex:Orders ; ex:o_custkey ?c ; ex:o_totalprice ?price . ?c ex:c_name ?name ; ex:c_mktsegment "BUILDING" FILTER(?price > 1000) } GROUP BY ?name',
    "SELECT c_name AS name, round(sum(o_totalprice)) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 1000 GROUP BY 1")


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        tables, query, _ = TABLE_QUERIES[name]
        return tables_graph(spark, d, *tables.split()).sparql(query)

    run.__name__ = name
    return run


QUERIES = {name: _run(name) for name in TABLE_QUERIES}
ORACLES = {name: sql for name, (_, _, sql) in TABLE_QUERIES.items()}
