"""SQL for DuckDB that gives the same rows as this subpackage's queries, where SQL can express them."""

from __future__ import annotations

import unicodedata

from ..oracles import sql_clean, sql_iri, sql_lexical, sql_value

_WORDS = lambda c: rf"list_filter(string_split_regex(lower({c}), '[^\p{{L}}]+'), lambda x: x <> '')"

_P4 = f"""WITH r AS MATERIALIZED (SELECT stmt_id, split_name, source, value_type, {sql_clean('s')} AS s, pred_iri AS p,
 CASE WHEN value_type IN ('integer','decimal','boolean','date','string') THEN {sql_value('value_type', sql_lexical('o'))} WHEN value_type <> 'text' THEN {sql_iri('o')} END AS val,
 CASE WHEN value_type = 'text' THEN list_distinct({_WORDS(sql_lexical('o'))}) END AS w
 FROM triples JOIN predicates ON pred_iri = {sql_clean('p')}
 WHERE s IS NOT NULL AND o IS NOT NULL AND split_name IN ('train', 'valid', 'test') AND NOT starts_with(ltrim(s), '_:') AND NOT starts_with(ltrim(o), '_:')),
sets AS MATERIALIZED (SELECT stmt_id, split_name, p, w, len(w) AS n FROM r WHERE len(w) > 0),
tok AS MATERIALIZED (SELECT stmt_id, split_name, p, n, unnest(w) AS x FROM sets),
near AS (SELECT e.stmt_id AS eval_id, t.stmt_id AS train_id, count(*) / min(e.n) AS c FROM tok e JOIN tok t ON e.x = t.x AND e.p = t.p AND e.split_name <> 'train' AND t.split_name = 'train'
 AND t.n * 10 >= e.n * 7 AND e.n * 10 >= t.n * 7 GROUP BY 1, 2 HAVING count(*) * 1000 >= 700 * (min(e.n) + min(t.n) - count(*))),
pairs AS (SELECT e.stmt_id AS eval_id, t.stmt_id AS train_id, 1.0::DOUBLE AS c FROM r e JOIN r t ON e.p = t.p AND e.s = t.s AND e.val = t.val WHERE e.split_name <> 'train' AND t.split_name = 'train'
 UNION ALL SELECT eval_id, train_id, c FROM near)
"""

_P7 = f"""WITH tok AS (SELECT stmt_id, 'p' AS field, {sql_clean('p')} AS term FROM triples UNION ALL SELECT stmt_id, 'o_iri', {sql_iri('o')} FROM triples
 UNION ALL SELECT stmt_id, 'o_word', unnest({_WORDS(sql_lexical('o'))}) FROM triples WHERE starts_with(ltrim(o), '"')),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT stmt_id) AS records FROM tok WHERE term <> '' GROUP BY 1, 2)
"""

_P10 = r"""WITH w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
g AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w),
k AS MATERIALIZED (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 7], ' ') ORDER BY i) AS nth FROM g),
m AS (SELECT doc_id, count(DISTINCT j) AS rep FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM k WHERE nth > 1) GROUP BY 1),
s AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(rep, 0) AS rep_words FROM w LEFT JOIN m ON m.doc_id = w.doc_id)
"""

_P6 = """WITH u AS (SELECT triple_id, CAST(vec AS DOUBLE[]) AS v FROM hnsw_nodes WHERE deleted = false AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
s AS (SELECT a.triple_id AS a, b.triple_id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM u a JOIN u b ON a.triple_id <> b.triple_id),
best AS (SELECT a, b, sim FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 10)
"""

#: Letters of other scripts that look like a basic Latin one in common typefaces, put together by eye, apart from the operator's table.
_EYE = {
    "A": "ΑА", "B": "ΒВ", "C": "С", "E": "ΕЕ", "H": "ΗН", "I": "ΙІ", "J": "Ј", "K": "ΚК", "M": "ΜМ", "N": "Ν", "O": "ΟО", "P": "ΡР", "S": "Ѕ", "T": "ΤТ", "X": "ΧХ", "Y": "Υ", "Z": "Ζ",
    "a": "аɑα", "c": "с", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іι", "j": "ј", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "v": "ν", "w": "ԝ", "x": "х", "y": "у",
}


def _looks(c: str) -> str:
    """The look of a text in SQL: wide forms, ligatures, numerals, letters (also those with an accent of their own), hyphens and spaces in one form, composed."""
    pairs = {chr(k + 0xFEE0): chr(k) for k in range(0x21, 0x7F)} | {x: to for to, xs in _EYE.items() for x in xs}
    for k in range(0x80, 0x2000):
        d = unicodedata.normalize("NFD", chr(k))
        if len(d) == 2 and d[0] in pairs and len(to := unicodedata.normalize("NFC", pairs[d[0]] + d[1])) == 1:
            pairs[chr(k)] = to
    pairs |= dict.fromkeys("‐‑‒–⁃−﹣－", "-")
    invisible = "[\\x{AD}\\x{34F}\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FE00}-\\x{FE0F}\\x{FEFF}]"
    t = f"regexp_replace({c}, '{invisible}', '', 'g')"
    for k in (*range(0x2160, 0x2180), *range(0xFB00, 0xFB05)):
        t = f"replace({t}, chr({k}), '{unicodedata.normalize('NFKC', chr(k))}')"
    quoted = ["".join(x).replace("'", "''") for x in zip(*pairs.items(), strict=True)]
    t = f"nfc_normalize(translate({t}, '{quoted[0]}', '{quoted[1]}'))"
    return f"trim(regexp_replace({t}, '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"


_P5 = f"WITH k AS MATERIALIZED (SELECT label_id, label, {_looks('label')} AS look FROM labels WHERE label IS NOT NULL), g AS (SELECT look, min(label_id) AS class_id, count(DISTINCT label) AS spellings FROM k GROUP BY 1) "

ORACLES = {
    "p5_found": _P5 + "SELECT a.label_id AS label_id_a, b.label_id AS label_id_b FROM k a JOIN k b ON a.look = b.look AND a.label_id < b.label_id AND a.label <> b.label",
    "p5_classes": _P5 + "SELECT l.label_id, class_id, spellings FROM labels l LEFT JOIN k ON k.label_id = l.label_id LEFT JOIN g ON g.look = k.look",
    "p8_counts": "SELECT doc_id, coalesce(text, '') = '' AS none FROM documents",
    "p9_invariants": "SELECT count(*) AS documents, count(*) FILTER (coalesce(text, '') = '') AS without_room, true AS whole, true AS fits, true AS tight FROM documents",
    "p4_found": _P4 + "SELECT least(eval_id, train_id) AS stmt_id_a, greatest(eval_id, train_id) AS stmt_id_b FROM pairs",
    "p4_per_split": _P4 + "SELECT split_name, source, count(DISTINCT eval_id) AS statements, count(*) AS pairs, count(DISTINCT CASE WHEN c >= 1 THEN eval_id END) AS contained FROM pairs JOIN triples ON stmt_id = eval_id GROUP BY 1, 2",
    "p4_containment": _P4 + "SELECT eval_id AS stmt_id, count(*) AS partners, round(max(c), 6) AS containment FROM pairs GROUP BY 1",
    "p6_found": _P6 + "SELECT DISTINCT least(a, b) AS triple_id_a, greatest(a, b) AS triple_id_b FROM best WHERE sim >= 0.8",
    # exact, as the query is where all vectors together are fewer than its candidates
    "p6_neighbours": _P6 + "SELECT a AS id, b AS other, round(sim, 6) AS similarity FROM best WHERE a % 50 = 0",
    "p6_recall": _P6 + "SELECT count(DISTINCT a) AS asked, true AS enough FROM best WHERE a % 50 = 0",
    "p7_found": _P7 + "SELECT * FROM (SELECT field, term, CASE WHEN records >= 0.01 * (SELECT count(*) FROM triples) THEN 'common' WHEN records <= 2 THEN 'rare' END AS mark FROM c) WHERE mark IS NOT NULL",
    "p7_counts": _P7 + "SELECT * FROM c",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p10_found": _P10 + "SELECT doc_id FROM s WHERE n_words >= 20 AND rep_words * 5 >= n_words",
    "p10_shares": _P10 + "SELECT doc_id, n_words, rep_words, rep_words / greatest(n_words, 1) AS repeated_share FROM s",
}
