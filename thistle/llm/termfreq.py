"""Frequency of every distinct term, with marks on the too rare and too common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..runtime import map_arrow

COUNTERS = "field string, term string, occurrences long, records long, first long, last long"
SCHEMA = "field string, term string, occurrences long, records long"


def _combine(fields: list[str]):
    """Map side: a batch's tokens of one term, in order of records, become one counter with the first and the last record it saw."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = b.column("_record").to_numpy()
            for name in fields:
                lists = b.column(name)
                terms = lists.flatten()
                if not len(terms):
                    continue
                record = pc.list_parent_indices(lists).to_numpy()
                coded = terms.dictionary_encode()
                code = coded.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                c, r = code[order], record[order]
                new = np.append(True, c[1:] != c[:-1])
                starts = np.flatnonzero(new)
                ends = np.append(starts[1:], len(c))
                fresh = new | np.append(True, r[1:] != r[:-1])
                columns = [ends - starts, np.add.reduceat(fresh.astype(np.int64), starts), number[r[starts]], number[r[ends - 1]]]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(starts)), coded.dictionary.take(pa.array(c[starts])), *map(pa.array, columns)], names=["field", "term", "occurrences", "records", "first", "last"])

    return count


def _last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: counters come sorted by term and first record. A term's state is its occurrences, its records and the last record seen; a
    counter that begins with that record doesn't count it again. The last term of a batch goes on into the next one."""
    held: tuple | None = None  # field, term, occurrences, records, last
    for b in batches:
        if not b.num_rows:
            continue
        field, term = b.column("field"), b.column("term")
        occ, rec, first, last = (b.column(c).to_numpy() for c in ("occurrences", "records", "first", "last"))
        new = np.append(True, pc.or_(pc.not_equal(field[1:], field[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False))
        same = held is not None and held[:2] == (field[0].as_py(), term[0].as_py())
        seen = np.append(held[4] if same else -1, last[:-1])
        rec = rec - ((first == seen) & (~new | np.append(same, np.zeros(len(new) - 1, bool))))
        starts = np.flatnonzero(new)
        o, r = np.add.reduceat(occ, starts), np.add.reduceat(rec, starts)
        if same:
            o[0] += held[2]
            r[0] += held[3]
        elif held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held[:4]], names=["field", "term", "occurrences", "records"])
        k = len(starts) - 1
        if k:
            yield pa.RecordBatch.from_arrays([field.take(pa.array(starts[:k])), term.take(pa.array(starts[:k])), pa.array(o[:k]), pa.array(r[:k])], names=["field", "term", "occurrences", "records"])
        held = (field[int(starts[k])].as_py(), term[int(starts[k])].as_py(), int(o[k]), int(r[k]), int(last[-1]))
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held[:4]], names=["field", "term", "occurrences", "records"])


def term_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, term, occurrences, records) of every distinct term of the array columns named; null and empty terms don't count.

    Every row is a record, with an identifier that grows along its partition. Tokens are combined to one counter a batch and term, hash-
    partitioned by term, ordered by record, and run through last-seen states; no set of records is kept anywhere. However common a term,
    it is one row a batch, so the reducer that has it gets a ten thousandth of its occurrences.
    """
    tokens = df.select(*(F.filter(F.coalesce(F.col(f), F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != "")).alias(f) for f in fields), F.monotonically_increasing_id().alias("_record"))
    part = map_arrow(tokens, _combine(fields), COUNTERS)
    return map_arrow(part.repartition("field", "term").sortWithinPartitions("field", "term", "first"), _last_seen, SCHEMA)


def marked(counts: DataFrame, total: int, rare: int = 2, common: float = 0.01) -> DataFrame:
    """counts with `mark`: rare (in at most `rare` records), common (in at least that share of all records; it wins over rare), or null."""
    return counts.withColumn("mark", F.when(F.col("records") >= F.lit(common) * F.lit(total), "common").when(F.col("records") <= rare, "rare"))
