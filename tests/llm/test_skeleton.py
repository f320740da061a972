from __future__ import annotations

import unicodedata

from thistle.llm.skeleton import Skeleton, classes, look_alike_pairs, prototypes

SAME = [("Ａｒｃｈｉｖ", "Archiv"), ("Kanè", "Kanè"), ("Tower Ⅳ", "Tower IV"), ("ﬁeld", "field"), ("Re­gion", "Region"), ("a​b‎", "ab"), ("а‐b", "a-b"), ("x y", "x  y"), ("Оld", "Old"), ("　x ", "x"), ("ɑɡе", "age"), ("a֊", "a֊"), ("Kelvin K", "Kelvin K"), ("ё", "ë"), ("q̣̇", "q̣̇"), ("a－b", "a-b"), ("᠎a⁠", "a")]
DIFFERENT = [("m²", "m2"), ("Canal", "canal"), ("Kane", "Kanè"), ("a-b", "ab"), ("a b", "ab"), ("l", "I"), ("O", "0"), ("①", "1"), ("x_y", "x-y"), ("я", "R")]


def test_pairs_of_looks(spark):
    skeleton_of = Skeleton(prototypes(spark))
    assert [p for p in SAME if skeleton_of(p[0]) != skeleton_of(p[1])] == []
    assert [p for p in DIFFERENT if skeleton_of(p[0]) == skeleton_of(p[1])] == []


def test_prototypes_keep_scripts_and_cases_apart(spark):
    table = {c: to for c, to in prototypes(spark).items() if c.isalpha()}
    assert len(table) > 100
    seen = set()
    for c, to in table.items():
        key = (unicodedata.name(c).split()[0], to)
        assert key not in seen and c.isupper() == to.isupper() and to.isascii()
        seen.add(key)
    #: Letters that look alike in every common typeface.
    for to, letters in {"A": "ΑА", "B": "ΒВ", "E": "ΕЕ", "H": "ΗН", "I": "ΙІ", "J": "Ј", "K": "ΚК", "M": "ΜМ", "N": "Ν", "O": "ΟО", "P": "ΡР", "S": "Ѕ", "T": "ΤТ", "X": "ΧХ", "Y": "Υ", "Z": "Ζ", "a": "аɑ", "c": "с", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "ј", "o": "οоօ", "p": "р", "q": "ԛ", "s": "ѕ", "v": "ν", "w": "ԝ", "x": "х", "y": "у"}.items():
        assert all(table.get(c) == to for c in letters), (to, letters)


def test_skeleton_is_stable(spark):
    skeleton_of = Skeleton(prototypes(spark))
    for a, _ in SAME + DIFFERENT:
        assert skeleton_of(skeleton_of(a)) == skeleton_of(a)
    assert skeleton_of("") == skeleton_of("​ ") == ""
    assert len(skeleton_of("ａ" * 500_000)) == 500_000


S = "label_id int, label string, skeleton string, text string, _text int"


def test_classes_and_pairs(spark):
    labels = [(1, "Old"), (2, "Оld"), (3, "Old"), (4, "old"), (5, None), (None, "Old"), (6, ""), (7, "​"), (8, "Ｏld")]
    df = spark.createDataFrame([(i, t, "clash", "clash", 0) for i, t in labels], S)
    pairs = sorted((r["id_a"], r["id_b"]) for r in look_alike_pairs(df, "label_id", "label").collect())
    assert pairs == [(1, 2), (1, 8), (2, 3), (2, 8), (3, 8), (6, 7)]
    got = {r["label_id"]: (r["class_id"], r["spellings"]) for r in classes(df.where("label_id is not null"), "label_id", "label").collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 8: (1, 3), 4: (4, 1), 5: (None, None), 6: (6, 2), 7: (6, 2)}


def test_empty(spark):
    df = spark.createDataFrame([], S)
    assert look_alike_pairs(df, "label_id", "label").count() == 0 and classes(df, "label_id", "label").count() == 0
