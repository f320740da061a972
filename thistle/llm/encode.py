"""Encoding of a corpus with a public byte-level BPE tokenizer, by a table of distinct words."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..runtime import cut, cut_counted, forget, map_arrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the vocabulary. (?U) makes \s all Unicode white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The most frequent words that are held by every worker: at most so many, of at most so many characters each, so at most some 100 MB.
HELD, HELD_LENGTH = 200_000, 100
_encoders: dict[str, object] = {}
_held: dict[int, tuple] = {}


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(path: str):
    """The encoder, kept by the Python worker from task to task."""
    if path not in _encoders:
        import tiktoken

        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})
    return _encoders[path]


def split_words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit("(?U)" + PATTERN), F.lit(0))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = b.column(0).flatten().value_counts()
        yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoder(path)
        for b in batches:
            ids = [encoding.encode_ordinary(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return run


def word_table(df: DataFrame, text: str, path: str = VOCABULARY) -> tuple[DataFrame, int]:
    """(word, n, ids): every distinct word of the texts, its number and its ids, each encoded once; and the number of words. Counted in batches first."""
    words = map_arrow(df.select(split_words(F.coalesce(F.col(text), F.lit(""))).alias("w")), _count, "word string, n long")
    table = map_arrow(words.groupBy("word").agg(F.sum("n").alias("n")), _encode_words(path), "word string, n long, ids array<int>")
    table, seen = cut_counted(table, words=F.count(F.lit(1)))
    return table, seen["words"]


def _look_up(held: Broadcast, key: int):
    """Ids of the held words put at their words' positions. A word that isn't held leaves a -1 there and goes, in order, into `missing`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _held:
            _held.clear()
            words, start, length, flat = held.value
            _held[key] = ({w: i for i, w in enumerate(words.to_pylist())}, start, length, flat)
        at, start, length, flat = _held[key]
        unknown = len(start) - 1
        for b in batches:
            lists = b.column(1)
            words = lists.flatten()
            coded = words.dictionary_encode()
            code = np.array([at.get(w, unknown) for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
            n = length[code]
            ends = np.append(0, np.cumsum(n))
            counts = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
            ids = flat[np.repeat(start[code] - ends[:-1], n) + np.arange(ends[-1])]
            none = np.append(0, np.cumsum(code == unknown))[counts]
            missing = words.filter(pa.array(code == unknown))
            out = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), x) for o, x in ((ends[counts], pa.array(ids)), (none, missing))]
            yield pa.RecordBatch.from_arrays([b.column(0), *out], names=["id", "ids", "missing"])

    return run


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that were joined, (at, ids) in any order, put where the -1 are."""
    for b in batches:
        out = []
        for ids, found in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            parts = iter(f["ids"] for f in sorted(found, key=lambda f: f["at"]))
            row = ids.values.to_numpy()
            holes = np.flatnonzero(row == -1)
            pieces: list[np.ndarray] = []
            last = 0
            for h in holes:
                pieces += [row[last:h], np.array(next(parts), np.int32)]
                last = h + 1
            out.append(np.concatenate([*pieces, row[last:]]) if len(holes) else row)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], names=["id", "ids"])


def encode(df: DataFrame, id_column: str, text: str, path: str = VOCABULARY, held: int = HELD) -> DataFrame:
    """(id, ids array<int>) of every row of df, ids empty for null and empty texts; no special tokens, their strings are ordinary text.

    Words are split in Spark and every distinct one is encoded once, into a table. Its ids are joined back by position: the `held` most
    frequent words, which nearly all positions have, by a table in every worker; where there are more words, or ones of more than 100
    characters, their positions alone are joined with the table by word and put in by position, rows numbered for that in a written table.
    """
    spark = df.sparkSession
    kind = df.schema[id_column].dataType.simpleString()
    table, n = word_table(df, text, path)
    rows = table.where(F.length("word") <= HELD_LENGTH).orderBy(F.desc("n"), "word").limit(held).select("word", "ids").toArrow()
    lists = rows.column("ids").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    length = np.append(pc.list_value_length(lists).to_numpy(zero_copy_only=False), 1).astype(np.int64)
    flat = np.append(lists.flatten().to_numpy(zero_copy_only=False), -1).astype(np.int32)
    every = spark.sparkContext.broadcast((rows.column("word").combine_chunks(), np.cumsum(length) - length, length, flat))
    split = df.select(F.col(id_column).alias("id"), split_words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    out = map_arrow(split, _look_up(every, every._jbroadcast.id()), f"id {kind}, ids array<int>, missing array<string>")
    if rows.num_rows == n:
        forget(table)
        return out.select(F.col("id").alias(id_column), "ids")
    out = cut(out.withColumn("row", F.monotonically_increasing_id()))
    asked = out.select("row", F.posexplode("missing").alias("at", "word"))
    found = asked.join(table.select("word", "ids"), "word").groupBy("row").agg(F.collect_list(F.struct("at", "ids")).alias("found"))
    holes = out.where(F.size("missing") > 0).select("row", "id", F.col("ids").alias("part")).join(found, "row").select("id", "part", "found")
    filled = map_arrow(holes, _fill, f"id {kind}, ids array<int>")
    return out.where(F.size("missing") == 0).select("id", "ids").unionByName(filled).select(F.col("id").alias(id_column), "ids")


def token_counts(df: DataFrame, id_column: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(id, tokens long), 0 for null and empty texts."""
    return encode(df, id_column, text, path).select(id_column, F.size("ids").cast("long").alias("tokens"))


def pieces(spark: SparkSession, path: str = VOCABULARY) -> DataFrame:
    """(id, piece binary): the vocabulary, of a fixed size."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in _ranks(path).items()], "id int, piece binary")


def decode(encoded: DataFrame, id_column: str, path: str = VOCABULARY) -> DataFrame:
    """(id, text) from (id, ids), by a join of the ids with the piece table; null ids give an empty text, an id outside the vocabulary fails.

    Rows are shuffled once, by a number of their own; their ids are then joined with the table (of the vocabulary's fixed size, so a
    broadcast) and put together again where they are.
    """
    rows = encoded.select(F.col(id_column).alias("_id"), "ids").withColumn("_row", F.monotonically_increasing_id()).repartition("_row")
    one = rows.select("_row", "_id", F.posexplode_outer("ids").alias("at", "token"))
    known = F.broadcast(pieces(encoded.sparkSession, path).select(F.col("id").alias("token"), F.hex("piece").alias("piece")))
    piece = F.when(F.col("token").isNull(), F.lit("")).otherwise(F.coalesce("piece", F.raise_error(F.concat(F.lit("index out of the vocabulary: "), F.col("token").cast("string")))))
    joined = one.join(known, "token", "left").select("_row", "_id", "at", piece.alias("piece"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("at", F.lit(-1)).alias("at"), "piece"))), lambda x: x["piece"]), "")
    whole = joined.groupBy("_row").agg(F.first("_id").alias(id_column), text.alias("x"))
    return whole.select(id_column, F.decode(F.unhex("x"), "UTF-8").alias("text"))
