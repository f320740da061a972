from __future__ import annotations

import random

from thistle.operators.orphans import DAY, FIRST, OrphanTracker, probe

REFS, PARENTS = "key string, at long, id int", "key string, from_us long, to_us long"


def brute(refs, parents):
    out = {}
    for key, at, i in refs:
        if key is None:
            out[i] = None
        else:
            out[i] = not any(k == key and f is not None and at is not None and f <= at and (t is None or t > at) for k, f, t in parents)
    return out


def test_probe_against_brute_force(spark):
    r = random.Random(3)
    day = lambda: r.randrange(-20, 20) * DAY // 2
    keys = ["a", "b", "c", None, "hot"]
    refs = [(r.choice([*keys, "hot", "hot"]), r.choice([day(), day(), None]), i) for i in range(400)]
    parents = [(r.choice(keys), r.choice([day(), day(), day(), None]), r.choice([day(), None])) for _ in range(60)]
    parents += parents[:10]
    got = {x["id"]: x["orphan"] for x in probe(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)).collect()}
    assert got == brute(refs, parents)


def test_probe_at_the_edges(spark):
    refs = [("a", 10, 1), ("a", 20, 2), ("a", 9, 3), ("b", 5, 4)]
    parents = [("a", 10, 20), ("b", 5, 5), ("b", 9, 3)]
    assert {x["id"]: x["orphan"] for x in probe(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)).collect()} == {1: False, 2: True, 3: True, 4: True}


def test_empty_tables_and_repeated_rows(spark):
    none, some = spark.createDataFrame([], REFS), spark.createDataFrame([("a", 1, 1), ("a", 1, 1)], REFS)
    no_parents = spark.createDataFrame([], PARENTS)
    assert probe(none, no_parents).count() == 0
    assert [x["orphan"] for x in probe(some, no_parents).collect()] == [True, True]


def test_batches_equal_one_batch(spark):
    r = random.Random(5)
    refs = [(i, r.choice("tu"), r.choice(["a", "b", "c"]), r.randrange(100) * DAY) for i in range(80)]
    parents = [(r.choice(["a", "b", "c"]), f := r.randrange(100) * DAY, r.choice([None, f + r.randrange(30) * DAY]), i) for i in range(12)]
    rs, ps = "id int, tbl string, key string, at long", "key string, from_us long, to_us long, parent_id int"
    one = OrphanTracker(spark)
    want = {x["id"] for x in one.advance(spark.createDataFrame(refs, rs), spark.createDataFrame(parents, ps)).collect()}
    for compact in (8, 2):
        step = OrphanTracker(spark, compact=compact)
        for k in range(5):
            got = step.advance(spark.createDataFrame(refs[k::5], rs), spark.createDataFrame(parents[k::5], ps))
        assert {x["id"] for x in got.collect()} == want
        assert sum(x["orphans"] for x in step.snapshot().collect()) == len(want)


def test_parents_arrive_and_leave(spark):
    t = OrphanTracker(spark)
    rs, ps = "id int, tbl string, key string, at long", "key string, from_us long, to_us long, parent_id int"
    ids = lambda df: sorted(x["id"] for x in df.collect())
    assert ids(t.advance(spark.createDataFrame([(1, "t", "a", 5), (2, "t", "a", 9)], rs), spark.createDataFrame([], ps))) == [1, 2]
    assert ids(t.advance(spark.createDataFrame([], rs), spark.createDataFrame([("a", 4, None, 7)], ps))) == []
    assert ids(t.advance(spark.createDataFrame([], rs), spark.createDataFrame([("a", 4, 8, 7)], ps))) == [2]


def test_timeless_parents_and_the_moment_of_report(spark):
    t = OrphanTracker(spark)
    rs, ps = "id int, tbl string, key string, at long, on_us long", "key string, from_us long, to_us long"
    t.advance(spark.createDataFrame([(1, "t", "a", 0, None), (2, "t", "b", 5, 40 * DAY), (3, "t", None, 5, 5)], rs), spark.createDataFrame([("b", FIRST, None)], ps))
    assert [(x["month"], x["orphans"], x["missing_keys"]) for x in t.snapshot().collect()] == [(None, 1, 1)]
    # a parent that is known already touches nothing
    t.advance(spark.createDataFrame([(4, "t", "c", 1, 40 * DAY)], rs), spark.createDataFrame([("b", FIRST, None), ("a", FIRST, None)], ps))
    assert [(x["month"], x["orphans"]) for x in t.snapshot().collect()] == [("1970-02", 1)]
    assert [x["id"] for x in t.pending.collect()] == [4]
