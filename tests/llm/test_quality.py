"""Operator 9: held-out accuracy, calibration and odd rows."""

from __future__ import annotations

import pickle

import numpy as np
import pytest

from lexigrove.llm import quality
from tests.llm.util import documents

DATA = "/root/testdata/sf0.1"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def held_out(spark):
    """Labels and probabilities of documents that no fit has seen."""
    docs, marks = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    marks = marks.dropDuplicates(["doc_id"])
    train, test = marks.where("doc_id % 3 <> 0"), marks.where("doc_id % 3 = 0")
    model = quality.train(docs, train)
    return quality.score(docs.join(test, "doc_id"), model).select("quality", "toxic", "p_quality", "p_toxic").toPandas()


@pytest.mark.parametrize("target,least", [("quality", 0.8), ("toxic", 0.9)])
def test_held_out_accuracy(held_out, target, least):
    y, p = held_out[target].to_numpy(), held_out[f"p_{target}"].to_numpy()
    assert ((p > 0.5) == (y > 0)).mean() >= max(least, max(y.mean(), 1 - y.mean()) - 1e-9)


@pytest.mark.parametrize("target", ["quality", "toxic"])
def test_probabilities_are_calibrated(held_out, target):
    y, p = held_out[target].to_numpy(), held_out[f"p_{target}"].to_numpy()
    bins = np.minimum((p * 5).astype(int), 4)
    error = sum(abs(y[bins == b].mean() - p[bins == b].mean()) * (bins == b).mean() for b in range(5) if (bins == b).any())
    assert error < 0.08


def corpus():
    good = [(i, f"a fine and careful sentence number {i} about the river and the wood") for i in range(60)]
    bad = [(100 + i, f"buy buy cheap cheap click click now {i} $$$ win win win") for i in range(60)]
    toxic = [(200 + i, f"a fine sentence {i} but you are a vile wretch and a fool about the river") for i in range(60)]
    marks = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(i, 1, 1) for i, _ in toxic]
    return good + bad + toxic, marks


def test_rejects_bad_and_toxic_texts(spark):
    texts, marks = corpus()
    model = quality.train(documents(spark, texts), labels(spark, marks))
    new = [(1, "a fine and careful sentence about the wood and the river"), (2, "cheap cheap click click buy buy win win $$$"), (3, "you are a vile wretch and a fool and a fine sentence about the river")]
    assert [r["doc_id"] for r in quality.keep(documents(spark, new), model).collect()] == [1]


def test_score_is_that_of_one_text_alone(spark):
    """A text's score doesn't depend on the batch that it comes in."""
    texts, marks = corpus()
    model = quality.train(documents(spark, texts), labels(spark, marks))
    together = {r["doc_id"]: r["p_quality"] for r in quality.score(documents(spark, texts).coalesce(1), model).collect()}
    for i, t in texts[::40]:
        assert quality.score(documents(spark, [(i, t)]), model).first()["p_quality"] == pytest.approx(together[i], abs=1e-9)


def test_scores_against_plain_loops():
    """Features and sums, one n-gram at a time."""
    texts = ["alpha beta beta gamma", "", "αβγ δ alpha alpha", "xyz"]
    buf, offsets = next((b, o) for _, _, b, o in quality._slices(texts))
    rows, ids = quality.word_features(buf, offsets)
    chosen = np.unique(ids)
    f = quality.Features(buf, offsets, chosen)
    rng = np.random.default_rng(1)
    w = {"bias": 0.25, "words": rng.normal(size=len(chosen)), "chars": rng.normal(size=1 << quality.CHAR_BITS)}
    got = f.scores(w)
    for k, t in enumerate(texts):
        data = t.encode()
        n = max(len(data) - quality.CHARACTERS + 1, 0)
        total = w["bias"] + sum(w["words"][np.searchsorted(chosen, x)] for x in ids[rows == k])
        for i in range(n):
            code = int.from_bytes(data[i : i + quality.CHARACTERS], "big")
            total += w["chars"][(code * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - quality.CHAR_BITS)] * 4.0 / n
        assert got[k] == pytest.approx(total)


def test_platt_recovers_a_curve():
    rng = np.random.default_rng(2)
    z = rng.normal(size=20_000)
    y = (rng.random(20_000) < quality.sigmoid(2.5 * z - 0.7)).astype(float)
    slope, intercept = quality.platt(z, y)
    assert slope == pytest.approx(2.5, abs=0.15) and intercept == pytest.approx(-0.7, abs=0.1)


def test_nulls_empty_repeated_rows_and_clashing_names(spark):
    texts, marks = corpus()
    model = quality.train(documents(spark, [*texts, *texts[:9], (None, "x"), (7_000, None)]), labels(spark, [*marks, *marks[:5], (None, 1, 0), (8, None, 0), (7_000, 1, 0)]))
    odd = [(1, None), (2, ""), (3, "..."), (None, texts[0][1]), (4, texts[0][1]), (4, texts[0][1])]
    df = documents(spark, odd).selectExpr("*", "1 as p_quality", "2 as P_toxic")
    out = quality.score(df, model)
    assert out.columns == [*df.columns, "p_quality_", "p_toxic_"] and out.count() == 6
    rows = {r["doc_id"]: (r["p_quality_"], r["p_toxic_"]) for r in out.collect()}
    assert rows[1] == (None, None) and None not in rows[2] and None not in rows[3]
    kept = [r["doc_id"] for r in quality.keep(df, model).collect()]
    assert 1 not in kept and kept.count(4) == 2 and kept.count(None) == 1


def test_no_labels(spark):
    df = documents(spark, [(1, "a"), (2, None)])
    for marks in ([], [(99, 1, 0)]):
        model = quality.train(df, labels(spark, marks))
        assert {tuple(r)[-2:] for r in quality.score(df, model).collect()} == {(None, None)}
        assert [r["doc_id"] for r in quality.keep(df, model).collect()] == [1]


def test_labels_of_one_class(spark):
    df = documents(spark, [(1, "a b c"), (2, "d e f")])
    model = quality.train(df, labels(spark, [(1, 1, 0), (2, 1, 0)]))
    assert {tuple(r)[-2:] for r in quality.score(df, model).collect()} == {(1.0, 0.0)}
    assert quality.keep(df, model).count() == 2


def test_empty_table(spark):
    empty = documents(spark, [])
    model = quality.train(empty, labels(spark, []))
    assert quality.score(empty, model).collect() == [] and quality.keep(empty, model).collect() == []


def test_sample_is_bounded(spark):
    texts, marks = corpus()
    model = pickle.loads(quality.train(documents(spark, texts), labels(spark, marks), sample_rows=10))
    assert set(model["targets"]) == {"quality", "toxic"}


def test_very_long_text(spark):
    texts, marks = corpus()
    model = quality.train(documents(spark, texts), labels(spark, marks))
    row = quality.score(documents(spark, [(1, (texts[0][1] + " ") * 60_000)]), model).first()
    assert 0.0 <= row["p_quality"] <= 1.0


def test_query_keeps_what_its_model_keeps(spark):
    """All documents, each scored alone in numpy."""
    from lexigrove.llm.queries import op9_quality

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = pickle.loads(quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    want = {}
    for r in docs.collect():
        buf, offsets = next((b, o) for _, _, b, o in quality._slices([r["text"]]))
        f = quality.Features(buf, offsets, model["chosen"])
        q, t = (float(quality.probabilities(f, model, x)[0]) for x in ("quality", "toxic"))
        if q >= quality.MIN_QUALITY and t < quality.MAX_TOXIC:
            want[r["doc_id"]] = (q, t)
    got = {r["doc_id"]: (r["p_quality"], r["p_toxic"]) for r in op9_quality(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in got)


def test_ids_that_are_strings(spark):
    """The same model as with numbers, up to which texts are held out."""
    texts = [(f"d{i}", ("good plain words about things " if i % 2 else "zz qq xx yy ") * (3 + i % 5)) for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    labels = spark.createDataFrame([(k, int(int(k[1:]) % 2), 0) for k, _ in texts], "doc_id string, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.keep(docs, quality.train(docs, labels)).collect()}
    assert kept == {k for k, _ in texts if int(k[1:]) % 2}


def test_ties_at_the_thresholds(spark, monkeypatch):
    """Probabilities equal to the thresholds: quality passes, toxicity doesn't."""
    docs = documents(spark, [(1, "a text")])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels)  # one class each: 1 and 0 for every text
    assert quality.keep(docs, model, min_quality=1.0, max_toxic=1e-9).count() == 1
    assert quality.keep(docs, model, min_quality=1.0, max_toxic=0.0).count() == 0
