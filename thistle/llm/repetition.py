"""Repetition inside single documents, judged by weak supervision."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import cut, map_arrow

RUN = 8
RULES = ("run8", "run4", "words", "lines", "sentences")
SHARE, LEAST_WORDS = 0.2, 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _repeated(code: np.ndarray, doc: np.ndarray, run: int) -> np.ndarray:
    """Which words lie in a run that occurred earlier in their document. code: word numbers, doc: document numbers, ascending."""
    n = len(code)
    hit = np.zeros(n, bool)
    if n < run:
        return hit
    m = n - run + 1
    with np.errstate(over="ignore"):
        mixed = (code.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
        h = np.zeros(m, np.uint64)
        for j in range(run):
            h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[j : j + m]
        h ^= doc[:m].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    whole = np.flatnonzero(doc[:m] == doc[run - 1 :])  # runs that don't cross into the next document
    order = whole[np.argsort(h[whole], kind="stable")]
    again = order[1:][(h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])]
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, again, 1)
    np.add.at(marks, again + run, -1)
    return np.cumsum(marks[:-1]) > 0


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(1)
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        code = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(b.num_rows), length)
        sums = lambda x: np.bincount(doc[x], minlength=b.num_rows)
        first = np.zeros(len(code), bool)
        if len(code):
            order = np.lexsort((code, doc))
            first[order] = np.append(True, (code[order][1:] != code[order][:-1]) | (doc[order][1:] != doc[order][:-1]))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(length), pa.array(sums(_repeated(code, doc, RUN))), pa.array(sums(_repeated(code, doc, 4))), pa.array(sums(first)), *b.columns[2:]],
            names=["id", "n_words", "rep_words", "rep4_words", "distinct_words", *b.schema.names[2:]],
        )


def features(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, n_words, rep_words, rep4_words, distinct_words, lines, distinct_lines, sentences, distinct_sentences); all 0 for null and empty texts.

    Words are maximal runs of letters and digits of the lower-cased text. rep_words lie in a run of eight words that occurred earlier in
    the same text (overlapping counts), rep4_words in one of four.
    """
    kind = df.schema[id_column].dataType.simpleString()
    t = F.coalesce(F.col(text), F.lit(""))
    units = lambda pattern: F.filter(F.transform(F.split(t, pattern), F.trim), lambda x: x != "")
    rows = df.select(F.col(id_column).alias("id"), F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("w"), units(r"[\r\n]+").alias("l"), units(r"[.!?\r\n]+").alias("s"))
    rows = rows.select("id", "w", *(f(F.col(c)).cast("long").alias(n) for c, k in (("l", "lines"), ("s", "sentences")) for n, f in ((k, F.size), (f"distinct_{k}", lambda x: F.size(F.array_distinct(x))))))
    schema = f"id {kind}, n_words long, rep_words long, rep4_words long, distinct_words long, lines long, distinct_lines long, sentences long, distinct_sentences long"
    return map_arrow(rows, _features, schema)


def _rules() -> dict[str, Column]:
    """Votes: 1 repetitive, 0 not, -1 abstains."""
    c = F.col
    share = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    vote = lambda able, yes, no: F.when(able & yes, 1).when(able & no, 0).otherwise(-1)
    enough = c("n_words") >= LEAST_WORDS
    fresh = share("distinct_words", "n_words")
    lines, sentences = 1 - share("distinct_lines", "lines"), 1 - share("distinct_sentences", "sentences")
    return {
        "run8": F.when(enough & (c("rep_words") * 5 >= c("n_words")), 1).when(c("n_words") > 0, 0).otherwise(-1),
        "run4": vote(enough, share("rep4_words", "n_words") >= 0.3, share("rep4_words", "n_words") < 0.15),
        "words": vote(c("n_words") >= 50, fresh < 0.35, fresh > 0.6),
        "lines": vote(c("lines") >= 4, lines >= 0.25, lines == 0),
        "sentences": vote(c("sentences") >= 4, sentences >= 0.2, sentences < 0.05),
    }


@dataclass
class Model:
    """posterior: of each vote pattern. rates: how often each rule is right on repetitive and on other texts. prior: the share of repetitive texts."""

    posterior: dict[tuple[int, ...], float]
    rates: list[tuple[float, float]]
    prior: float


def accuracies(patterns: list[tuple[tuple[int, ...], int, int, int]], rounds: int = 100) -> Model:
    """The rules' rates of right votes, and with them each vote pattern's posterior probability of repetition, by expectation-maximisation.

    patterns: votes, number of texts without a label, with the label repetitive, with the label other. Model: independent rules, each with a
    rate of right votes on repetitive and on other texts; abstaining says nothing. Labelled texts keep their class, all others have their
    posterior. Rates stay between 0.5 and 1 - 1e-6, so a rule never counts against its own vote, and classes can't change places.
    """
    if not patterns:
        return Model({}, [], 0.0)
    votes = np.array([p[0] for p in patterns])
    n, labelled, other = (np.array([p[k] for p in patterns], float) for k in (1, 2, 3))
    yes, no = votes == 1, votes == 0
    right = np.full((2, votes.shape[1]), 0.8)  # of repetitive, of other texts
    prior, post = 0.1, np.full(len(n), -1.0)
    little = 0.01
    for _ in range(rounds):
        a = np.log(prior) + (yes * np.log(right[0]) + no * np.log(1 - right[0])).sum(1)
        b = np.log(1 - prior) + (no * np.log(right[1]) + yes * np.log(1 - right[1])).sum(1)
        new = 1 / (1 + np.exp(np.clip(b - a, -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
        w, v = n * post + labelled, n * (1 - post) + other
        right[0] = np.clip(((w[:, None] * yes).sum(0) + little) / ((w[:, None] * (yes | no)).sum(0) + 2 * little), 0.5, 1 - 1e-6)
        right[1] = np.clip(((v[:, None] * no).sum(0) + little) / ((v[:, None] * (yes | no)).sum(0) + 2 * little), 0.5, 1 - 1e-6)
        prior = float(np.clip((w.sum() + 1) / (w.sum() + v.sum() + 10), 1e-3, 0.5))
    return Model({tuple(int(x) for x in p[0]): float(q) for p, q in zip(patterns, post, strict=True)}, [(float(x), float(y)) for x, y in right.T], prior)


def judged(df: DataFrame, id_column: str, text: str, labelled: int = 5000) -> tuple[DataFrame, Model]:
    """Features, repeated_share, the rules' votes and `posterior`, the probability that a text is repetitive; one row per row of df. And the model.

    At most `labelled` texts, chosen by a hash of the id, get the label that the definition gives them (at least 20 words, a fifth of them
    repeated); the rules' rates are estimated on these and on all texts without a label together. The posterior alone says which texts are
    repetitive: 0.5 is the threshold at every size. Texts with no vote at all get the prior.
    Only the number of texts of each vote pattern reaches the driver, at most 243.
    """
    rules = _rules()
    rows = cut(features(df, id_column, text).withColumns(rules))
    few = rows.orderBy(F.xxhash64("id"), "id").limit(labelled).withColumn("case", (F.col("n_words") >= LEAST_WORDS) & (F.col("rep_words") * 5 >= F.col("n_words")))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    known = {tuple(r[k] for k in rules): (r["yes"], r["no"]) for r in few.groupBy(*rules).agg(count(F.col("case")).alias("yes"), count(~F.col("case")).alias("no")).collect()}
    patterns = []
    for r in rows.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")).collect():
        votes = tuple(r[k] for k in rules)
        yes, no = known.get(votes, (0, 0))
        patterns.append((votes, r["n"] - yes - no, yes, no))
    model = accuracies(patterns)
    found = df.sparkSession.createDataFrame([(*p, q) for p, q in model.posterior.items()], ", ".join(f"{k} int" for k in rules) + ", posterior double")
    out = rows.join(F.broadcast(found), list(rules))
    return out.withColumn("repeated_share", F.col("rep_words") / F.greatest(F.col("n_words"), F.lit(1))).withColumnRenamed("id", id_column), model


def repetitive(df: DataFrame, id_column: str, text: str, threshold: float = 0.5) -> DataFrame:
    """The rows of judged() whose posterior is at least `threshold`, checked against the definition: the few that other rules outvoted it on go."""
    rows, _ = judged(df, id_column, text)
    return rows.where(F.col("posterior") >= threshold).where((F.col("n_words") >= LEAST_WORDS) & (F.col("rep_words") * 5 >= F.col("n_words")))
