"""Visually identical text with different characters: one form under which look-alikes are equal."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import cut, map_arrow

#: Hyphens and dashes of hyphen length.
HYPHENS = "‐‑‒–⁃˗−﹘﹣－"
#: Latin letters that are another way to draw a basic one.
DRAWN = {"ɑ": "a", "ɡ": "g"}
#: Compatibility forms that look different from what they stand for.
_KEEP = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<vertical>")
#: Characters without a look of their own besides those of category Cf: joiners, fillers, variation selectors.
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def _decompose(c: str, depth: int = 0) -> str:
    d = unicodedata.decomposition(c)
    if not d or d.startswith(_KEEP) or depth > 9:
        return unicodedata.normalize("NFD", c) if not d else c
    parts = d.split()
    return "".join(_decompose(chr(int(x, 16)), depth + 1) for x in parts[parts[0].startswith("<") :])


def prototypes(spark: SparkSession) -> dict[str, str]:
    """The look-alike table: letters of other scripts, by the basic Latin letter they look like.

    It is drawn from Unicode's confusables, as Spark's own ICU library holds them: of the letters with case those whose confusables skeleton is
    that of a basic Latin letter of the same case. Within a script no two letters get the same one, so texts of one script that differ
    stay different: the letter that looks alike in both cases comes first, then the first by code point. Latin letters stay as they are, but
    for DRAWN: the skeleton of ICU itself would also make I, l and 1 equal, or m and rn.
    """
    jvm = spark.sparkContext._jvm
    cased = [c for c in map(chr, range(128, 0x1F000)) if not "\ud800" <= c <= "\udfff" and unicodedata.category(c) in ("Lu", "Ll") and not unicodedata.decomposition(c)]
    other = [c for c in cased if not unicodedata.name(c, "LATIN").startswith("LATIN")]
    basic = [c for c in map(chr, range(128)) if c.isalpha()]
    looks = jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton(1, "\n".join(basic + other)).split("\n")
    look = dict(zip(basic + other, looks, strict=True))
    latin = {(look[c], c.isupper()): c for c in basic}
    found: dict[tuple[str, str], list[tuple[bool, str]]] = {}
    for c in other:
        to = latin.get((look[c], c.isupper()))
        if to:
            twin = c.swapcase()
            both = twin != c and latin.get((look.get(twin), twin.isupper())) == to.swapcase()
            found.setdefault((unicodedata.name(c).split()[0], to), []).append((not both, c))
    return {min(cs)[1]: to for (_, to), cs in found.items()} | DRAWN | dict.fromkeys(HYPHENS, "-")


def _character(c: str, prototype: dict[str, str]) -> str:
    """A character's prototype: decomposed, invisible ones dropped, spaces as one kind, look-alikes replaced, decomposed again."""
    out = []
    for x in _decompose(c):
        if ord(x) in _INVISIBLE or unicodedata.category(x) == "Cf":
            continue
        x = prototype.get(x, x)
        out.append(" " if x.isspace() or unicodedata.category(x) in ("Zs", "Zl", "Zp", "Cc") else x)
    return "".join(_decompose(x) for x in out)


class Skeleton(dict):
    """skeleton(text) is equal for texts that look the same: letters, accents, case, digits and marks count, their encoding doesn't."""

    def __init__(self, prototype: dict[str, str]):
        super().__init__()
        self.prototype = prototype

    def __missing__(self, k: int) -> str:
        self[k] = v = _character(chr(k), self.prototype)
        return v

    def __call__(self, text: str) -> str:
        t = text.translate(self)
        if not t.isascii():
            t = unicodedata.normalize("NFD", t)  # puts several accents of one letter in order
        return " ".join(x for x in t.split(" ") if x)


def _skeletons(prototype: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeleton = Skeleton(prototype)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([skeleton(t) for t in b.column(0).to_pylist()], pa.string())], names=["text", "skeleton"])

    return run


def _texts(df: DataFrame, column: str) -> DataFrame:
    """(text, skeleton) of every distinct text."""
    return map_arrow(df.select(F.col(f"`{column}`").alias("text")).where("text is not null").distinct(), _skeletons(prototypes(df.sparkSession)), "text string, skeleton string")


def skeletons(df: DataFrame, column: str) -> DataFrame:
    """df with `skeleton` (null for null; empty for texts without anything visible) beside every row.

    Only distinct texts are worked on. A column of df named skeleton is replaced, all others stay.
    """
    rows = df.drop("skeleton") if column != "skeleton" else df.withColumnRenamed("skeleton", column := "text")
    free = next(n for n in ("_text", "_text_", "_text__", "_text___") if n not in rows.columns)
    return rows.join(_texts(rows, column).withColumnRenamed("text", free), F.col(f"`{column}`") == F.col(free), "left").drop(free)


def classes(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, skeleton, class_id, spellings): one row per row of df; class_id is the least id with that skeleton, spellings its different texts.

    Null texts have a null skeleton and class.
    """
    rows = skeletons(df.select(F.col(id_column).alias("_id"), F.col(column).alias("_label")), "_label")
    seen = rows.where("skeleton is not null")
    per = seen.groupBy("skeleton").agg(F.min("_id").alias("class_id"))
    texts = seen.select("skeleton", "_label").distinct().groupBy("skeleton").agg(F.count(F.lit(1)).alias("spellings"))
    return rows.join(per.join(texts, "skeleton"), "skeleton", "left").select(F.col("_id").alias(id_column), "skeleton", "class_id", "spellings")


def look_alike_pairs(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id_a, id_b), a < b: rows whose texts differ as stored and have one skeleton. Null texts and rows without id are in no pair.

    Different spellings are paired first, so that copies of one spelling meet only rows they make a pair with.
    """
    texts = cut(_texts(df, column))
    several = texts.groupBy("skeleton").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("skeleton")
    texts = texts.join(several, "skeleton")
    other = texts.withColumnRenamed("text", "other")
    spelled = texts.join(other, "skeleton").where("text < other").select("text", "other")
    rows = df.select(F.col(id_column).alias("id"), F.col(column).alias("text")).where("id is not null")
    pairs = spelled.join(rows, "text").select(F.col("id").alias("a"), F.col("other").alias("text")).join(rows, "text").select("a", F.col("id").alias("b"))
    return pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
