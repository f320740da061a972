"""SQL for DuckDB that gives the same rows as the core queries."""

from __future__ import annotations

from .functions.terms import PREFIXES

_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*"


def sql_clean(c: str) -> str:
    t = rf"regexp_replace({c}, '^[\s<>]+|[\s<>]+$', '', 'g')"
    scheme = f"lower(regexp_extract({t}, '^({_SCHEME})://', 1))"
    prefixes = " ".join(f"WHEN starts_with({t}, '{k}:') THEN '{v}' || substr({t}, {len(k) + 2})" for k, v in PREFIXES.items())
    return (
        f"(CASE {prefixes} WHEN regexp_matches({t}, '^{_SCHEME}://') THEN (CASE {scheme} WHEN 'https' THEN 'http' ELSE {scheme} END) || '://' || "
        f"lower(regexp_extract({t}, '^{_SCHEME}://([^/?#]*)', 1)) || regexp_extract({t}, '(?s)^{_SCHEME}://[^/?#]*(.*)$', 1) ELSE {t} END)"
    )


def sql_iri(c: str) -> str:
    return f"""(CASE WHEN NOT starts_with(ltrim({c}), '"') AND NOT starts_with(ltrim({c}), '_:') AND regexp_matches({sql_clean(c)}, '^[a-z][a-z0-9+.-]*://') THEN {sql_clean(c)} END)"""


def sql_lexical(c: str) -> str:
    t = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    inner = rf"""regexp_extract({t}, '(?s)^"(.*)"(?:@[^"]*|\^\^[^"]*)?$', 1)"""
    for a, b in (("\\\\", "chr(1)"), ('\\"', "'\"'"), ("\\n", "chr(10)"), ("\\t", "chr(9)"), ("\\r", "chr(13)")):
        inner = f"replace({inner}, '{a}', {b})"
    inner = f"replace({inner}, chr(1), '\\')"
    return rf"""(CASE WHEN starts_with({t}, '"') THEN {inner} WHEN NOT starts_with({t}, '_:') AND NOT starts_with({t}, '<') AND NOT regexp_matches({t}, '^{_SCHEME}:') THEN {t} END)"""


def sql_value(kind: str, lex: str) -> str:
    v = rf"regexp_replace({lex}, '^\s+|\s+$', '', 'g')"
    num = rf"(CASE WHEN regexp_matches({v}, '^[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(replace({v}, ',', '.') AS DECIMAL(38,10)) END)"
    iso, dot, run = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})", r"^([0-9]{4})([0-9]{2})([0-9]{2})"
    day = lambda rx, y, m, d: f"TRY_CAST(regexp_extract({v}, '{rx}', {y}) || '-' || lpad(regexp_extract({v}, '{rx}', {m}), 2, '0') || '-' || lpad(regexp_extract({v}, '{rx}', {d}), 2, '0') AS DATE)"
    date = f"(CASE WHEN regexp_matches({v}, '{iso}([T ].*)?$') THEN {day(iso, 1, 2, 3)} WHEN regexp_matches({v}, '{dot}([T ].*)?$') THEN {day(dot, 3, 2, 1)} WHEN regexp_matches({v}, '{run}([T ].*)?$') THEN {day(run, 1, 2, 3)} END)"
    return f"""(CASE {kind} WHEN 'integer' THEN CASE WHEN {num} = floor({num}) THEN CAST(CAST({num} AS DECIMAL(38,0)) AS VARCHAR) END
 WHEN 'decimal' THEN CAST(CAST({num} AS DECIMAL(38,2)) AS VARCHAR)
 WHEN 'boolean' THEN CASE WHEN lower({v}) IN ('true','yes','t','1') THEN 'true' WHEN lower({v}) IN ('false','no','f','0') THEN 'false' END
 WHEN 'date' THEN strftime({date}, '%Y-%m-%d') WHEN 'string' THEN nullif({v}, '') END)"""


_P1 = f"""WITH t AS (SELECT stmt_id, {sql_iri('o')} AS o, epoch_us(asserted_at) AS ts FROM triples),
l AS (SELECT label_id, {sql_clean('iri')} AS iri, CAST(round(fetched_at * 1e6) AS BIGINT) AS f, CAST(round(removed_at * 1e6) AS BIGINT) AS r FROM labels),
found AS (
SELECT 'triples' AS tbl, stmt_id AS row_id, ts FROM t WHERE starts_with(o, 'http://kg.example/entity/')
 AND NOT EXISTS (SELECT 1 FROM l WHERE l.iri = t.o AND l.f <= t.ts AND (l.r IS NULL OR l.r > t.ts))
UNION ALL
SELECT 'labels', label_id, f FROM l WHERE starts_with(iri, 'http://kg.example/entity/')
 AND iri NOT IN (SELECT {sql_clean('s')} FROM triples WHERE s IS NOT NULL))
"""

_P1_ALL = f"""WITH b AS (SELECT * FROM (VALUES (1, epoch_us(TIMESTAMP '2025-01-01')), (2, epoch_us(TIMESTAMP '2026-01-01')), (3, 4611686018427387904)) x(batch, until)),
t AS MATERIALIZED (SELECT stmt_id, {sql_clean('s')} AS s, {sql_iri('o')} AS o, epoch_us(asserted_at) AS ts, epoch_us(ingested_at) AS arrived FROM triples),
l AS MATERIALIZED (SELECT label_id, {sql_clean('iri')} AS iri, CAST(round(fetched_at * 1e6) AS BIGINT) AS f, CAST(round(removed_at * 1e6) AS BIGINT) AS r FROM labels),
found AS (
SELECT batch, 'triples' AS tbl, o AS key, ts FROM t JOIN b ON arrived < until WHERE starts_with(o, 'http://kg.example/entity/')
 AND NOT EXISTS (SELECT 1 FROM l WHERE l.iri = t.o AND l.f < b.until AND l.f <= t.ts AND (l.r IS NULL OR l.r >= b.until OR l.r > t.ts))
UNION ALL
SELECT batch, 'labels', iri, f FROM l JOIN b ON f < until WHERE starts_with(iri, 'http://kg.example/entity/') AND NOT EXISTS (SELECT 1 FROM t WHERE t.s = l.iri AND t.arrived < b.until))
"""

_P2 = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT * FROM (
 SELECT 'subclass_of' AS hier, {sql_clean('class_iri')} AS child, {sql_clean('parent_iri')} AS parent FROM subclass_of
 UNION ALL SELECT 'provenance', CAST(generated_id AS VARCHAR), CAST(source_id AS VARCHAR) FROM provenance
 WHERE regexp_matches({sql_clean('p')}, '/(selectedFrom|inferredFrom)$') AND generated_id IS NOT NULL AND source_id IS NOT NULL)),
n AS (SELECT DISTINCT hier, node FROM (SELECT hier, child AS node FROM e UNION ALL SELECT hier, parent FROM e) WHERE node IS NOT NULL),
g AS MATERIALIZED (SELECT * FROM e WHERE child IS NOT NULL AND parent IS NOT NULL),
root AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.hier = n.hier AND g.child = n.node)),
"""
_WALK = """walk AS (SELECT hier, node, node AS top, 0 AS d FROM n
 UNION SELECT w.hier, w.node, g.parent, w.d + 1 FROM walk w JOIN g ON g.hier = w.hier AND g.child = w.top WHERE w.d < 100)
"""

_P3 = f"""WITH v AS (SELECT {sql_clean('s')} AS s, pred_iri AS p, asserted_at, stmt_id, {sql_value('value_type', sql_lexical('o'))} AS val
 FROM triples JOIN predicates ON pred_iri = {sql_clean('p')} WHERE s IS NOT NULL AND o IS NOT NULL AND value_type IN ('integer','decimal','boolean','date','string')),
best AS (SELECT s, p, val AS val_text FROM v WHERE val IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s, p ORDER BY asserted_at DESC NULLS LAST, stmt_id DESC) = 1)
"""
#: The declared predicates of simple types.
_WIDE = {
    "integer": ("BIGINT", "memberCount foundedYear pageCount floorCount population"),
    "decimal": ("DOUBLE", "heightM massKg lengthKm ratingAvg"),
    "boolean": ("BOOLEAN", "isActive isProtected isVerified"),
    "date": ("DATE", "foundedOn dissolvedOn surveyedOn"),
    "string": ("VARCHAR", "regCode shortName statusCode"),
}

ORACLES = {
    "p1_found": _P1 + "SELECT tbl, row_id FROM found",
    "p1_per_month": _P1 + "SELECT tbl, strftime(make_timestamp(ts), '%Y-%m') AS month, count(*) AS orphans FROM found GROUP BY 1, 2",
    "p1_snapshots": _P1_ALL + "SELECT tbl, strftime(make_timestamp(ts), '%Y-%m') AS month, count(*) AS orphans, count(DISTINCT key) AS missing_keys, CAST(batch AS INTEGER) AS batch FROM found GROUP BY ALL",
    "p2_found": _P2 + _WALK + """SELECT w.hier, w.node, w.top AS root, CAST(min(w.d) AS INTEGER) AS node_depth FROM walk w JOIN root r ON r.hier = w.hier AND r.node = w.top GROUP BY 1, 2, 3
UNION ALL SELECT DISTINCT hier, node, 'cycle', -1 FROM walk WHERE d > 0 AND node = top""",
    "p2_descendants": _P2 + _WALK + "SELECT hier, top AS node, node AS descendant, CAST(min(d) AS INTEGER) AS levels FROM walk GROUP BY 1, 2, 3 HAVING min(d) > 0",
    "p2_paths": _P2 + """walk AS (SELECT hier, node, node AS top, [node] AS way FROM n
 UNION ALL SELECT w.hier, w.node, g.parent, list_append(w.way, g.parent) FROM walk w JOIN g ON g.hier = w.hier AND g.child = w.top WHERE NOT list_contains(w.way, g.parent))
SELECT w.hier, w.node, w.top AS root, CAST(len(way) - 1 AS INTEGER) AS node_depth, array_to_string(way, ' ') AS path FROM walk w JOIN root r ON r.hier = w.hier AND r.node = w.top
QUALIFY row_number() OVER (PARTITION BY w.hier, w.node, w.top ORDER BY len(way), way) = 1""",
    "p3_found": _P3 + "SELECT s, p, val_text FROM best",
    "p3_wide": _P3 + "SELECT s, " + ", ".join(f"max(CAST(CASE WHEN p = 'http://kg.example/prop/{c}' THEN val_text END AS {t})) AS \"{c}\"" for t, cs in _WIDE.values() for c in cs.split()) + " FROM best GROUP BY s",
}
