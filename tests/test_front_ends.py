"""Cypher and GQL over a small shop: customers, orders, nations, with the names of the test tables."""

from __future__ import annotations

import pytest

from thistle.plans import cypher, gql
from thistle.plans.ast import QueryError
from thistle.plans.cypher import UnsupportedError

from .graphs import ask, graph

SHOP = [
    ("o1", "placedBy", "c1"), ("o2", "placedBy", "c1"), ("o3", "placedBy", "c2"), ("o4", "placedBy", "c9"), ("c1", "nation", "n7"), ("c2", "nation", "n8"), ("n7", "within", "r1"), ("n8", "within", "r1"), ("r1", "within", "r0"),
    ("o1", "total", 120), ("o2", "total", 80), ("o3", "total", 310), ("o1", "status", "'open"), ("o2", "status", "'shipped"), ("o3", "status", "'open"), ("c1", "segment", "'tools"), ("c2", "segment", "'toys"), ("n7", "title", "'Norway is & {1,}"),
    ("o1", "a", "Order"), ("o2", "a", "Order"), ("o3", "a", "Order"), ("o3", "a", "Urgent"), ("c1", "a", "Buyer"), ("c2", "a", "Buyer"),
]


@pytest.fixture(scope="module")
def shop(spark):
    return graph(spark, SHOP)


BOTH = {
    "MATCH (o)-[:placedBy]->(c) WHERE o.total >= 100 RETURN o, c": [("o1", "c1"), ("o3", "c2")],
    "MATCH (c)<-[:placedBy]-(o) RETURN c, o ORDER BY o": [("c1", "o1"), ("c1", "o2"), ("c2", "o3"), ("c9", "o4")],
    "MATCH (o {status: 'open'})-[:placedBy]->(c)-[:nation]->(n) RETURN n": [("n7",), ("n8",)],
    "MATCH (o)-[:placedBy]->(c), (c)-[:nation]->(n) WHERE c.segment = \"toys\" RETURN o, n": [("o3", "n8")],
    "MATCH (o)-[:placedBy]->(c) WHERE c.segment IS NULL RETURN o": [("o4",)],
    "MATCH (o)-[:placedBy]->(c) WHERE NOT (o.total < 100 OR o.status = 'open') RETURN o": [],
    "MATCH (o) WHERE o.status ENDS WITH 'ped' RETURN o AS late": [("o2",)],
    "MATCH (n) WHERE n.title CONTAINS '{1,}' AND n.title STARTS WITH 'Norway is' RETURN n": [("n7",)],
    "MATCH (o)-[:placedBy]->(c) OPTIONAL MATCH (c)-[:nation]->(n) WHERE n.title IS NOT NULL RETURN o, n": [("o1", "n7"), ("o2", "n7"), ("o3", None), ("o4", None)],
    "MATCH (o)-[:placedBy]->(c) RETURN DISTINCT c": [("c1",), ("c2",), ("c9",)],
}
APART = [
    ("MATCH (o:Order:Urgent) RETURN o.total AS t", "MATCH (o IS Order & Urgent) RETURN o.total AS t", [(310,)]),
    ("MATCH (:Buyer)-[:nation]->(n) RETURN n", "MATCH (IS Buyer)-[IS nation]->(n) RETURN n", [("n7",), ("n8",)]),
    ("MATCH (n)-[:within*]->(r) RETURN DISTINCT n, r", "MATCH (n)-[:within]->+(r) RETURN DISTINCT n, r", [("n7", "r0"), ("n7", "r1"), ("n8", "r0"), ("n8", "r1"), ("r1", "r0")]),
    ("MATCH (n)-[:within*1..]->(r {x: 1}) RETURN DISTINCT n", "MATCH (n)-[:within]->{1,}(r {x: 1}) RETURN DISTINCT n", []),
    ("MATCH (n)-[:within*1]->(r) WHERE r.x IS NULL RETURN n", "MATCH (n)-[:within]->{1}(r) FILTER WHERE r.x IS NULL RETURN n", [("n7",), ("n8",), ("r1",)]),
    ("MATCH (o:Order) RETURN o ORDER BY o.total DESC SKIP 1 LIMIT 1", "MATCH (o :Order) RETURN o ORDER BY o.total DESC OFFSET 1 LIMIT 1", [("o1",)]),
    ("MATCH (o:Order) WHERE o.total <> 80 RETURN o", "MATCH (o IS Order) FILTER o.total <> 80 RETURN o", [("o1",), ("o3",)]),
]


@pytest.mark.parametrize("text", BOTH)
def test_what_both_write_alike(shop, text):
    for language in ("cypher", "gql"):
        assert ask(shop, text, language) == BOTH[text]


@pytest.mark.parametrize("one, other, want", APART)
def test_what_they_write_differently(shop, one, other, want):
    assert ask(shop, one, "cypher") == want
    assert ask(shop, other, "gql") == want


#: From the grammar: each place where something else than what is read could stand.
NOT_READ = {
    "a clause": ["CREATE (o)", "MATCH (o) DELETE o", "MATCH (o) WITH o RETURN o", "MATCH (o) RETURN o UNION MATCH (c) RETURN c", "OPTIONAL MATCH (o) RETURN o"],
    "an edge": ["MATCH (o)-[e:placedBy]->(c) RETURN o", "MATCH (o)-[:placedBy]-(c) RETURN o", "MATCH (o)-->(c) RETURN o", "MATCH (o)-[:placedBy|nation]->(c) RETURN o", "MATCH (o)-[:placedBy {x: 1}]->(c) RETURN o"],
    "a length": ["MATCH (n)-[:within*0..]->(r) RETURN DISTINCT n", "MATCH (n)-[:within*2..4]->(r) RETURN DISTINCT n", "MATCH (n)-[:within*]->(r) RETURN n"],
    "a value": ["MATCH (o {total: null}) RETURN o", "MATCH (o {total: [1, 2]}) RETURN o", "MATCH (o) WHERE o.total IN [1] RETURN o", "MATCH (o) WHERE o.total = $t RETURN o", "MATCH (o) RETURN sum(o)", "MATCH (o) WHERE o.total = 1 XOR o.total = 2 RETURN o"],
    "a path": ["MATCH p = (n)-[:within]->(r) RETURN p"],
}


@pytest.mark.parametrize("text", [t for ts in NOT_READ.values() for t in ts])
def test_what_is_not_read_in_cypher(text):
    with pytest.raises(UnsupportedError) as e:
        cypher.translate(text)
    assert e.value.construct and e.value.reason


@pytest.mark.parametrize("text", ["MATCH (o IS Order | Urgent) RETURN o", "MATCH (o IS ! Order) RETURN o", "MATCH (o IS %) RETURN o", "MATCH (n)-[:within]->*(r) RETURN DISTINCT n", "MATCH (n)-[:within]->{2,3}(r) RETURN DISTINCT n", "MATCH (n)-[:within]->{,3}(r) RETURN DISTINCT n", "LET t = 1 RETURN t", "MATCH (n)-[:within*]->(r) RETURN DISTINCT n", "MATCH ((n)-[:within]->(r))+ RETURN n"])
def test_what_is_not_read_in_gql(text):
    with pytest.raises(QueryError):
        gql.translate(text)


@pytest.mark.parametrize("text", ["", "MATCH", "MATCH (o RETURN o", "MATCH (o) RETURN", "MATCH (o) RETURN o LIMIT many", "MATCH (o) RETURN o more", "MATCH (o) WHERE RETURN o", "MATCH (o)-[:within]->{}(r) RETURN o", "MATCH (o) ~ RETURN o"])
def test_what_is_no_query(text):
    for language in (cypher, gql):
        with pytest.raises(QueryError):
            language.translate(text)
