"""Operator 1: the tokens of the whole text, whatever way it was cut, and exact round trips."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lexigrove.llm import bpe
from tests.llm.util import SF, documents, same

TEXT = st.text(st.one_of(st.sampled_from("aeinst  \n\t.,'’0123éß漢字🎉"), st.characters(exclude_categories=["Cs"])), max_size=300)


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.vocabulary_path())


def tree(codec, text, size):
    data = text.encode()
    starts = bpe.cuts(data, size)
    leaves = [(codec.encode(data[a:b].decode()), a) for a, b in zip(starts, [*starts[1:], len(data)])]
    return codec.concatenate(data, leaves if data else [])


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 40))
def test_tree_of_any_text(text, size):
    c = bpe.codec(bpe.vocabulary_path())
    assert np.array_equal(tree(c, text, size), c.encode(text))


@pytest.mark.parametrize("text", ["a" * 5_000, " " * 3_000, "ab" * 2_000, "\n \n" * 900, "'s" * 1_500, "1" * 3_000, "é" * 2_500, "漢字仮名" * 700, "the cat " * 900, "x" * 50 + " " * 500 + "y" * 50 + "\n" * 400])
@pytest.mark.parametrize("size", [7, 64, 1_000])
def test_tree_of_hard_texts(codec, text, size):
    assert np.array_equal(tree(codec, text, size), codec.encode(text))


def corpus():
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "straße", "Ωmega", "don't", "1234", "\n\n", "  "]) for _ in range(2_000))
    return [(1, "Hello, world"), (2, ""), (3, None), (None, "no key"), (4, long), (4, long), (5, "z" * 4_000), (None, long), (6, "🎉" * 500), (7, long + "."), (7, "short, same key")]


@pytest.mark.parametrize("long_chars,leaf", [(65_536, 16_384), (100, 64), (0, 33)])
def test_encode(spark, codec, long_chars, leaf):
    df = documents(spark, corpus()).selectExpr("*", "1 as leaf", "'x' as tokens", "'y' as text_hash", "2 as n_tokens")
    out = bpe.encode(df, verify=True, long_chars=long_chars, leaf_bytes=leaf)
    assert out.columns == ["doc_id", "n_tokens", "tokens", "round_trip"]
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["tokens"], r["round_trip"]) for r in out.where("tokens is not null").collect())
    want = sorted((str(i), len(codec.encode(t)), codec.encode(t).tolist(), True) for i, t in corpus() if t is not None)
    assert got == want
    assert [tuple(r) for r in out.where("tokens is null").collect()] == [(3, None, None, None)]


def test_decode(spark):
    texts = [x for x in corpus() if x[0] is not None]
    same(bpe.decode(bpe.encode(documents(spark, texts), long_chars=1_000)), texts)


def test_decode_of_parts_of_characters(spark):
    rows = spark.createDataFrame([(1, [bpe.codec(bpe.vocabulary_path()).encode("漢").tolist()[0]]), (2, []), (3, None)], "doc_id bigint, tokens array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe.decode(rows).collect()}
    assert "�" in got[1] and got[2] == "" and got[3] is None


def test_empty_table(spark):
    assert bpe.encode(documents(spark, [])).collect() == []


def test_special_tokens_are_text(spark, codec):
    text = "a <|endoftext|> b"
    row = bpe.encode(documents(spark, [(1, text)]), verify=True).first()
    assert row["round_trip"] and 50256 not in row["tokens"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_other_vocabularies(spark, name):
    path = bpe.vocabulary_path(name)
    out = bpe.encode(documents(spark, corpus()), path, verify=True, long_chars=500, leaf_bytes=200)
    assert out.where("tokens is not null and not round_trip").count() == 0
    c = bpe.codec(path)
    assert {tuple(r["tokens"]) for r in out.collect() if r["tokens"]} == {tuple(c.encode(t).tolist()) for _, t in corpus() if t}


def test_query(spark, codec):
    from lexigrove.llm.queries import op1_bpe

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_tokens"], r["tokens"], r["round_trip"]) for r in op1_bpe(spark, SF).collect()}
    assert got == {i: (len(x := codec.encode(t)), x.tolist(), True) for i, t in docs}


@pytest.mark.parametrize("key", ["tokens", "n_tokens", "text", "TEXT_HASH", "leaf", "key", "round_trip"])
def test_keys_with_the_names_of_new_columns(spark, key):
    long = "a long text, " * 9
    df = spark.createDataFrame([("k1", "short"), ("k2", long)], f"`{key}` string, body string")
    out = bpe.encode(df, key=key, text="body", verify=True, long_chars=20, leaf_bytes=16)
    assert len({c.lower() for c in out.columns}) == 4 and out.columns[0] == key
    name = out.columns[2]
    back = bpe.decode(out, key=key, tokens=name)
    assert sorted(tuple(r) for r in back.collect()) == [("k1", "short"), ("k2", long)] and back.columns == [key, "text_" if key == "text" else "text"]


def test_a_text_over_the_default_threshold(spark):
    """70,000 characters, of several bytes each at places, as a tree and whole."""
    text = ("word über 12 字 " * 6_000)[:70_000]
    got = bpe.encode(documents(spark, [(1, text), (2, text + "x")]), verify=True).collect()
    c = bpe.codec(bpe.vocabulary_path())
    assert {r["doc_id"]: r["tokens"] for r in got} == {1: c.encode(text).tolist(), 2: c.encode(text + "x").tolist()} and all(r["round_trip"] for r in got)
