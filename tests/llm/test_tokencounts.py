"""Token counts against the library they must equal."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cuboid.llm.queries import COUNTED_VOCABULARY, QUERIES
from cuboid.llm.tokencounts import Counter, Merges, count_tokens, newer_letters, whole_strings

LIBRARY = Tokenizer.from_file(COUNTED_VOCABULARY)


def expected(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    with open(COUNTED_VOCABULARY, encoding="utf-8") as f:
        merges = Merges(json.load(f))
    return Counter(whole_strings(merges), merges, newer_letters())


def test_whole_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op12_token_counts"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = expected(docs[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from(["<|endoftext|>", " ", "\n\n", "'ll", "'LL", "\x1c", "\u0088f", "\U00018e00", "12345", "  a"])), max_size=12).map("".join))
def test_any_text(counter, text):
    assert counter.tokens(text) == expected(text)


def test_every_code_point(counter):
    for start in range(0, 0x110000, 0x2000):
        chars = [chr(c) for c in range(start, start + 0x2000) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c} {c}" for c in chars)
        assert counter.tokens(text) == expected(text), hex(start)


def test_whole_strings_are_one_token(counter):
    """The proof, seen from the other side: a vocabulary string is whole exactly if the library makes one token of it."""
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    with open(COUNTED_VOCABULARY, encoding="utf-8") as f:
        merges = Merges(json.load(f))
    whole = set(whole_strings(merges))
    for s in merges.strings[::17]:
        try:
            text = s.decode()
        except UnicodeDecodeError:
            continue
        if len(cut(text)) == 1:
            assert (text in whole) == (expected(text) == 1), text


def test_long_parts_and_texts(counter):
    for text in ("ab" * 50_000, "é" * 30_001, " " * 40_000 + "x", "word, " * 300_000):
        assert counter.tokens(text) == expected(text)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (None, "two words", "y"), (1, "", "z"), (1, None, "x"), (5, "<|endoftext|>", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, COUNTED_VOCABULARY, limit=1).collect()))
    assert got == [(0, 9, 2, True), (1, 0, 0, False), (1, 0, 0, False), (1, 0, 0, False), (5, 13, 1, False)]
    assert count_tokens(df, COUNTED_VOCABULARY).columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    assert count_tokens(df.limit(0), COUNTED_VOCABULARY).count() == 0


def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert count_tokens(df, COUNTED_VOCABULARY).first().n_tokens == expected("a�b")


def test_unsupported_files():
    with open(COUNTED_VOCABULARY, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"model": spec["model"] | {"ignore_merges": True}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        with pytest.raises(ValueError):
            Merges(spec | change)
