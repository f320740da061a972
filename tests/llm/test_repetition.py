from __future__ import annotations

import random
import re

from thistle.llm.repetition import RULES, accuracies, features, judged, repetitive

S = "doc_id long, text string, n_words string, posterior string, w string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], S)


def brute(text, run):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    seen, hit = {}, set()
    for i in range(len(w) - run + 1):
        g = tuple(w[i : i + run])
        if g in seen:
            hit |= set(range(i, i + run))
        seen.setdefault(g, i)
    return len(w), len(hit)


def texts():
    r = random.Random(8)
    out = ["", None, "   ", "one two", "a " * 400, "x y " * 30, "Same sentence here. " * 12, "w " * 7, "W w W w w w w w w", "word" * 50_000]
    for _ in range(60):
        base = [r.choice("abcdefghij") + r.choice("klmnop") for _ in range(r.randrange(5, 120))]
        k = r.randrange(len(base))
        out.append(" ".join(base + base[k : k + r.randrange(0, 60)] + ["zz"]))
    return out


def test_features_against_brute_force(spark):
    for batch in ("10000", "4"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {r["id"]: r for r in features(frame(spark, texts()), "doc_id", "text").collect()}
        for i, t in enumerate(texts()):
            n, rep = brute(t, 8)
            assert (got[i]["n_words"], got[i]["rep_words"], got[i]["rep4_words"]) == (n, rep, brute(t, 4)[1]), t
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_posterior_finds_what_the_definition_names(spark):
    """The posterior at its fixed threshold loses no case, with all texts labelled, with some and with the fewest; rows are kept."""
    many = texts() * 8 + ["Alpha beta gamma delta. Epsilon zeta! " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))] * 300
    df = frame(spark, many)
    for labelled in (5000, 300, 60):
        rows, model = judged(df, "doc_id", "text", labelled=labelled)
        rows = rows.collect()
        assert len(rows) == len(many) and all(0 <= r["posterior"] <= 1 for r in rows)
        cases = {r["doc_id"] for r in rows if r["n_words"] >= 20 and r["rep_words"] * 5 >= r["n_words"]}
        kept = {r["doc_id"] for r in rows if r["posterior"] >= 0.5}
        assert cases and cases <= kept
        assert len(model.rates) == len(RULES) and model.rates[0][0] > 0.9
    assert {r["doc_id"] for r in repetitive(df, "doc_id", "text").collect()} == cases


def test_accuracies_find_the_better_rule():
    r = random.Random(9)
    counts = {}
    truth = {}
    for k in range(20_000):
        y = r.random() < 0.2
        p = tuple(int(y) if r.random() < a else int(not y) for a in (0.97, 0.9, 0.6)) + (-1,)
        c = counts.setdefault(p, [0, 0, 0])
        c[(1 if y else 2) if k < 500 else 0] += 1
        truth.setdefault(p, []).append(y)
    model = accuracies([(p, *c) for p, c in counts.items()])
    right = sum((model.posterior[p] > 0.5) == y for p, ys in truth.items() for y in ys)
    assert right / 20_000 > 0.96
    assert abs(model.rates[0][0] - 0.97) < 0.02 and abs(model.rates[2][1] - 0.6) < 0.03
    assert accuracies([]).posterior == {}


def test_empty(spark):
    assert judged(frame(spark, []), "doc_id", "text")[0].count() == 0
