"""Operator 3: profiles against plain loops, and held-out accuracy."""

from __future__ import annotations

import numpy as np
import pytest

from lexigrove.llm import langid
from tests.llm.util import documents

DATA = "/root/testdata/sf0.01"
EN, DE = "the house and the river were there with other things that they had", "das haus und der fluss waren da mit anderen dingen die sie hatten"


def bound(text, dimensions=64, seed=langid.SEED):
    """A text's vector, one n-gram at a time."""
    rng = np.random.default_rng(seed)
    base = rng.choice(np.array([-1, 1], np.int8), (langid.LETTERS, dimensions)).astype(int)
    permutation = rng.permutation(dimensions)
    out = np.zeros(dimensions)
    c = langid.letters(text)
    for i in range(len(c) - langid.GRAM + 1):
        v = np.ones(dimensions)
        for k in range(langid.GRAM):
            letter = base[c[i + k]]
            for _ in range(langid.GRAM - 1 - k):
                letter = letter[permutation]
            v = v * letter
        out += v
    return out


@pytest.mark.parametrize("text", [EN, "Zürich, 12 Straßen!", "ab", "a", "漢字 и буквы", ""])
def test_bundle(text):
    assert np.allclose(langid.bundle(text, langid.gram_vectors(64)), bound(text))


def test_letters():
    assert np.array_equal(langid.letters("Ab,  c1"), langid.letters("aB.c"))
    assert len(langid.letters("")) == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("lang is not null")
    profiles = langid.prototypes(docs.where("doc_id % 2 = 0"))
    out = langid.identify(docs.where("doc_id % 2 = 1"), profiles).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars >= 60").toPandas()
    assert (out["language"] == out["lang"]).mean() > 0.9


def test_prototypes_against_plain_loops(spark):
    texts = [(i, f"{EN} {i}", "en") for i in range(5)] + [(10 + i, f"{DE} {i}", "de") for i in range(4)]
    docs = documents(spark, [x[:2] for x in texts], [x[2] for x in texts])
    got = langid.prototypes(docs, dimensions=64)
    for lang in ("en", "de"):
        v = sum(bound(t) / np.linalg.norm(bound(t)) for _, t, own in texts if own == lang)
        assert np.allclose(got[lang], v / np.linalg.norm(v), atol=1e-5)


def test_cosine_and_margin(spark):
    docs = documents(spark, [(1, EN), (2, DE)], ["en", "de"])
    profiles = langid.prototypes(docs, dimensions=64)
    for r in langid.identify(docs, profiles, dimensions=64).collect():
        v = bound(EN if r["doc_id"] == 1 else DE)
        c = {k: float(v @ p / np.linalg.norm(v)) for k, p in profiles.items()}
        best, second = sorted(c, key=lambda k: -c[k])
        assert r["language"] == best and r["cosine"] == pytest.approx(c[best], abs=1e-5) and r["margin"] == pytest.approx(c[best] - c[second], abs=1e-5)


def test_nulls_empty_repeated_rows_and_clashing_names(spark):
    texts = [(1, EN), (1, EN), (None, DE), (2, None), (3, ""), (4, "123 !?"), (5, DE)]
    docs = documents(spark, texts, ["en", "en", "de", None, "de", "en", "de"]).selectExpr("*", "1 as language", "2 as cosine", "3 as nth", "4 as v")
    profiles = langid.prototypes(docs)
    assert sorted(profiles) == ["de", "en"]
    out = langid.identify(docs, profiles)
    assert out.columns == ["doc_id", "language", "cosine", "margin"]
    got = sorted((str(r["doc_id"]), str(r["language"])) for r in out.collect())
    assert got == [("1", "en"), ("1", "en"), ("2", "None"), ("3", "None"), ("4", "None"), ("5", "de"), ("None", "de")]


def test_ties_go_to_the_first_name(spark):
    docs = documents(spark, [(1, EN), (2, EN)], ["zz", "aa"])
    assert {r["language"] for r in langid.identify(docs, langid.prototypes(docs)).collect()} == {"aa"}


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert langid.prototypes(empty) == {}
    assert langid.identify(empty, {}).collect() == []
    row = langid.identify(documents(spark, [(1, EN)]), {}).first()
    assert tuple(row) == (1, None, None, None)


def test_very_long_text(spark):
    docs = documents(spark, [(1, EN), (2, DE), (3, (DE + " ") * 40_000)], ["en", "de", "de"])
    assert langid.identify(docs, langid.prototypes(docs)).where("doc_id = 3").first()["language"] == "de"


def test_query(spark):
    """Every document against all prototypes in numpy."""
    from lexigrove.llm.queries import op3_language_id

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    profiles, vectors = langid.prototypes(docs), langid.gram_vectors()
    got = {r["doc_id"]: r for r in op3_language_id(spark, sf).collect()}
    for r in docs.collect():
        v = langid.bundle(r["text"], vectors)
        if np.linalg.norm(v):
            c = {k: float(v @ p / np.linalg.norm(v)) for k, p in profiles.items()}
            assert got[r["doc_id"]]["cosine"] == pytest.approx(max(c.values()), abs=1e-5)
            assert c[got[r["doc_id"]]["language"]] == pytest.approx(max(c.values()), abs=1e-5)
        else:
            assert got[r["doc_id"]]["language"] is None
    assert len(got) == docs.count()
