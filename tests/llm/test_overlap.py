from __future__ import annotations

import random

from thistle.llm.overlap import _needed, _sizes, cross_split_pairs

T = "stmt_id long, s string, p string, o string, split_name string, hashes string, h1 long, value_type string, val int"
PRED = [("http://kg.example/prop/n", "integer"), ("http://kg.example/prop/k", "entity"), ("http://kg.example/prop/t", "text")]


def run(spark, facts, **options):
    rows = [(i, s, p, o, split, "x", 0, "text", 1) for i, (s, p, o, split) in enumerate(facts)]
    pairs = cross_split_pairs(spark.createDataFrame(rows, T), spark.createDataFrame(PRED, "pred_iri string, value_type string"), **options)
    return sorted((r["eval_id"], r["train_id"]) for r in pairs.collect())


def text(words):
    return '"' + " ".join(words) + '"@en'


def test_exact_kinds(spark):
    facts = [("kge:a", "kgp:n", '"+7"', "train"), ("<http://kg.example/entity/a>", "kgp:n", "7.0", "test"), ("kge:b", "kgp:n", "7", "valid"), ("kge:a", "kgp:n", '"x"', "test"), ("kge:a", "kgp:n", '"x"', "train"),
             ("kge:a", "kgp:k", "kge:z", "valid"), ("kge:a", "kgp:k", "HTTP://kg.example/entity/z", "train"), ("kge:a", "kgp:k", "_:b", "train"), ("kge:a", "kgp:k", "_:b", "test"), (None, "kgp:n", "7", "test"), ("kge:a", "kgp:n", "7", None), ("kge:a", "kgp:n", None, "test"), ("kge:a", "kgp:u", "7", "test"), ("kge:a", None, "7", "test")]
    assert run(spark, facts) == [(1, 0), (5, 6)]


def test_repeated_rows_give_all_their_pairs(spark):
    facts = [("kge:a", "kgp:n", "7", "train")] * 30 + [("kge:a", "kgp:n", "7", "test")] * 4
    assert len(run(spark, facts)) == 120


def test_text_against_brute_force(spark):
    r = random.Random(1)
    vocabulary = [f"w{''.join(r.choices('abcdefgh', k=3))}" for _ in range(60)]
    facts = []
    base = [r.sample(vocabulary, r.choice([1, 2, 3, 6, 10, 14])) for _ in range(25)]
    for _ in range(250):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            if w and r.random() < 0.5:
                w.pop(r.randrange(len(w)))
            else:
                w.append(r.choice(vocabulary))
        r.shuffle(w)
        facts.append((r.choice(["kge:a", "kge:b"]), "kgp:t", text(w), r.choice(["train", "train", "train", "valid", "test"])))
    facts += [("kge:a", "kgp:t", '"... 12"', "train"), ("kge:a", "kgp:t", '""', "test")]
    sets = [{w.lower() for w in f[2][1:].split('"')[0].split() if w.isalpha()} for f in facts]
    want = sorted((i, j) for i, f in enumerate(facts) if f[3] != "train" for j, g in enumerate(facts) if g[3] == "train" and sets[i] and len(sets[i] & sets[j]) * 10 >= 7 * len(sets[i] | sets[j]))
    for gram in (None, 1, 2, 3, 4):
        assert run(spark, facts, gram=gram) == want


def test_every_pair_of_sizes_is_matched_by_something():
    """For all sizes and overlaps at the threshold: both sets take combinations of one size, and the needed words hold one."""
    for similarity in (0.5, 0.7, 0.8, 0.95):
        for gram in (1, 2, 3, 4):
            for a in range(1, 110):
                for b in range(a, int(a / similarity + 1e-9) + 1):
                    least = min(o for o in range(1, a + 1) if o >= similarity * (a + b - o) - 1e-9) if a >= similarity * b - 1e-9 else None
                    if least is None:
                        continue
                    both = _sizes(a, similarity, gram) & _sizes(b, similarity, gram)
                    assert both and min(both) <= min(_needed(a, similarity), _needed(b, similarity)) and least >= max(_needed(a, similarity), _needed(b, similarity))


def test_long_text_and_empty_table(spark):
    long = [f"x{''.join(chr(97 + int(c)) for c in str(i))}" for i in range(3000)]
    facts = [("kge:a", "kgp:t", text(long), "train"), ("kge:b", "kgp:t", text(long[::-1]), "test"), ("kge:b", "kgp:t", text(long[:2100]), "test"), ("kge:b", "kgp:t", text(long[:2099]), "valid")]
    assert run(spark, facts) == [(1, 0), (2, 0)]
    assert run(spark, []) == []
