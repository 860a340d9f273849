"""Encoding: exact against direct encoding for texts of any form and cut."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canopyq.llm import bpe, encoding

PATH = bpe.default_path()


def direct(text):
    return bpe.load(PATH).encode_ordinary(text)


def by_tree(text, size):
    blocks = bpe.cuts(text, size)
    assert "".join(b for b, _ in blocks) == text
    return bpe.tree(PATH, [bpe.block(PATH, b) for b, _ in blocks], [i for _, i in blocks])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'sll \n\t09.,!é中文🙂ก", max_size=400), st.integers(8, 60))
def test_tree_concatenation_is_exact(text, size):
    assert by_tree(text, size) == direct(text)


@pytest.mark.parametrize("bit", ["a", "ab", " ", "\n", "7", ".", "é", "中", "🙂", "'s", "a. "])
def test_unsplit_runs(bit):
    text = bit * 3000
    for size in (16, 300):
        assert by_tree(text, size) == direct(text)


def test_leaves(monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_BYTES", 16)
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["abc", "x", "é", " ", "...", "99"]) * rng.randint(1, 30) for _ in range(8))
        assert bpe.text_ids(PATH, text) == direct(text)


def test_reference_library_agrees():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for text in ("Hello world's <|endoftext|> x", "中文 é\n\n  a", " "):
        assert t.encode(text, add_special_tokens=False).ids == bpe.text_ids(PATH, text)


def test_operator(spark):
    texts = [None, "", "  ", "hello <|endoftext|>", "ab" * 5000, "word " * 4000, "é" * 9000, "hello <|endoftext|>", "ab" * 5000]
    df = spark.createDataFrame([(k, t, [1]) for k, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in encoding.encode(df, ["doc_id"], long_chars=1000, block_chars=400).collect()}
    assert got == {k: direct(t) if t else [] for k, t in enumerate(texts)}
    n = {r.doc_id: r.n_tokens for r in encoding.encode(df, ["doc_id"], ids=False, long_chars=1000).collect()}
    assert n == {k: len(v) for k, v in got.items()}
    twice = encoding.encode(df.unionByName(df), ["doc_id"], long_chars=1000).collect()
    assert len(twice) == 2 * len(texts)
    assert encoding.encode(df.limit(0), ["doc_id"]).collect() == []
    clash = df.withColumnRenamed("text", "body").withColumnRenamed("doc_id", "h").withColumn("text", F.lit("other")).drop("ids")
    assert {r.h: r.ids for r in encoding.encode(clash, ["h", "text"], text="body", long_chars=1000).collect()} == got
    with pytest.raises(ValueError, match="keep"):
        encoding.encode(df, ["ids"])


def test_ids_stand_for_their_texts(spark):
    texts = [None, "", " ", "plain", "人们说 \U0001f469\u200d\U0001f52c", "<|endoftext|>", "x" * 9000, "word " * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(map(tuple, encoding.decoded(encoding.encode(df, ["doc_id"]), ["doc_id"]).collect()))
    assert got == {k: t or "" for k, t in enumerate(texts)}
