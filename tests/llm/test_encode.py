from __future__ import annotations

import os

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from thistle.llm.encode import VOCABULARY, decode, encode, pieces, token_counts, word_table

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
S = "doc_id long, text string, ids int, tokens string, w string"
TEXTS = ["Hello world's  end", "", None, " \n\t ", "<|endoftext|> is text", "mixed\r\n\r\nlines  　x", "naïve Ünïcödé 12345 ½ ⅷ", "'s 'LL don't", "日本語のテキスト", "a" * 20_000, "😀😀 x", "  leading", "tail   ", " \n"]


def want(texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 0, "", "") for i, t in enumerate(texts)], S)


def test_ids_equal_the_public_tokenizers(spark):
    got = {r["doc_id"]: r["ids"] for r in encode(frame(spark, TEXTS), "doc_id", "text").collect()}
    assert [got[i] for i in range(len(TEXTS))] == want(TEXTS)
    assert got[1] == got[2] == []
    # whatever the workers hold, down to nothing
    for held in (0, 3):
        few = {r["doc_id"]: r["ids"] for r in encode(frame(spark, TEXTS + TEXTS[:3]), "doc_id", "text", held=held).collect()}
        assert [few[i] for i in range(len(TEXTS) + 3)] == want(TEXTS + TEXTS[:3])


def test_every_word_once(spark):
    table, n = word_table(frame(spark, TEXTS * 3), "text")
    words = [r["word"] for r in table.collect()]
    assert len(words) == n == len(set(words)) and sum(r["n"] for r in table.where("word = ' text'").collect()) == 3


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60), min_size=1, max_size=30))
def test_round_trip(spark, texts):
    df = frame(spark, texts)
    e = encode(df, "doc_id", "text")
    assert {r["doc_id"]: r["text"] for r in decode(e, "doc_id").collect()} == dict(enumerate(texts))


def test_decode_of_nothing_and_of_the_unknown(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [50255])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in decode(df, "doc_id").collect()}.keys() == {1, 2, 3}
    assert decode(df.where("doc_id < 3"), "doc_id").where("text <> ''").count() == 0
    with pytest.raises(Exception, match="(?i)index"):
        decode(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>"), "doc_id").collect()


def test_counts_batches_and_empty(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {r["doc_id"]: r["tokens"] for r in token_counts(frame(spark, TEXTS), "doc_id", "text").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got[i] for i in range(len(TEXTS))] == [len(x) for x in want(TEXTS)]
    assert encode(frame(spark, []), "doc_id", "text").count() == 0
    assert pieces(spark).count() == 50_256
