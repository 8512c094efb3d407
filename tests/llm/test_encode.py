import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nodeloom.llm import encode

enc = encode.Encoder()
PIECES = [" ", "  ", "\n", "\r\n", "\t", " ", "　", "'", "'s", "'ll", "'T", "a", "Word", "é", "é", "日本", "привет", "12", "٣", "!", "—", "…", "😀", "<|endoftext|>", "_", "​", "ﬁ", "\x1c", "\x85", "ß'ré", "©'s"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PIECES), max_size=30).map("".join)))
def test_ids_equal_whole_text_encoding(text):
    assert enc.ids(text) == enc._encode(text)
    assert "".join(enc.fragments(text)) == text or not text


def test_long_random_texts():
    r = random.Random(3)
    for _ in range(30):
        text = "".join(r.choice(PIECES) for _ in range(5000))
        assert enc.ids(text) == enc._encode(text)


def test_forced_cuts_are_many():
    assert enc.fragments("one two, three") == ["one", " two,", " three"] or len(enc.fragments("one two, three")) >= 3


def test_whole_table(spark, sf):
    from nodeloom.session import table

    docs = table(spark, sf, "documents")
    got = {r.doc_id: r.ids for r in encode.encode_texts(docs).collect()}
    assert got == {d.doc_id: enc._encode(d.text) if d.text else [] for d in docs.collect()}
    counts = {r.doc_id: r.n_tokens for r in encode.token_counts(docs).collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def test_same_as_the_other_library(spark, sf):
    tokenizers = pytest.importorskip("tokenizers")
    from nodeloom.session import table

    t = tokenizers.Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for d in table(spark, sf, "documents").where("text IS NOT NULL").collect():
        assert enc.ids(d.text) == t.encode(d.text, add_special_tokens=False).ids


def test_nulls_ties_clashes_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, [5]), (2, "", None), (3, "a b", None), (3, "a b", None), (4, "x" * 200_000, None)], "doc_id long, text string, ids array<int>")
    got = sorted((r.doc_id, len(r.ids)) for r in encode.encode_texts(docs).collect())
    assert got[:4] == [(1, 0), (2, 0), (3, 2), (3, 2)] and got[4][1] == len(enc._encode("x" * 200_000))
    assert encode.encode_texts(docs.limit(0)).collect() == []
