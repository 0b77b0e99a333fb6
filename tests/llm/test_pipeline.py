"""The corpus pipeline: its stages' inputs and outputs, and its rows against the operators' plain versions."""

from __future__ import annotations

import inspect

import numpy as np
import pytest

import corpus_pipeline
from lexigrove.llm import bpe, decontam, linededup, quality, simhash
from tests.llm.util import SF, documents, leaks, lines, words


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "bpe"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def after(spark, tmp_path_factory):
    """The rows after each stage, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns(spark, after):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(d.columns == columns for d in after[:-1])
    assert after[-1].columns == ["doc_id", "n_tokens", "tokens", "round_trip"]


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_quality_stage(spark, after):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = quality.score(docs, model).collect()
    assert rows(after[0]) == {r["doc_id"]: r["text"] for r in scored if r["p_quality"] >= quality.MIN_QUALITY and r["p_toxic"] < quality.MAX_TOXIC}


def test_line_stage(after):
    assert rows(after[1]) == {i: t for i, (t, _) in lines(list(rows(after[0]).items())).items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after[1].collect())


def test_near_stage(spark, after):
    gone = {r["doc_id"] for r in simhash.groups(after[1]).where("not kept").collect()}
    assert rows(after[2]) == {i: t for i, t in rows(after[1]).items() if i not in gone}


def test_decontamination_stage(spark, after):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    grams = {}
    for _, b in items:
        x = words(b)
        n = min(13, len(x))
        for q in range(len(x) - n + 1) if len(x) >= 5 else ():
            grams.setdefault(n, set()).add(tuple(x[q : q + n]))

    def clean(t):
        x = words(t)
        return not any(tuple(x[p : p + n]) in own for n, own in grams.items() for p in range(len(x) - n + 1))

    assert rows(after[3]) == {i: t for i, t in rows(after[2]).items() if clean(t)}


def test_tokens(after):
    codec = bpe.codec(bpe.vocabulary_path())
    got = {r["doc_id"]: r["tokens"] for r in after[4].collect()}
    assert got == {i: codec.encode(t).tolist() for i, t in rows(after[3]).items()}
    assert after[4].where("not round_trip or size(tokens) <> n_tokens").count() == 0


def test_run_gives_the_last_stage(spark, after):
    assert {r["doc_id"]: r["tokens"] for r in corpus_pipeline.run(spark, SF).collect()} == {r["doc_id"]: r["tokens"] for r in after[4].collect()}


def test_no_tables(spark, tmp_path):
    """Empty documents, labels and benchmark go through every stage."""
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_rows(spark, tmp_path):
    """Null ids and texts, empty texts, repeated rows, and columns of other names that the stages use."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    odd = [(1, None), (2, ""), (None, "some text"), (3, "one and two"), (3, "one and two"), (4, "quite another text about nothing at all")]
    documents(spark, odd).selectExpr("*", "1 as deleted_lines", "2 as p_quality", "3 as gone", "4 as ranges").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r["doc_id"]), r["n_tokens"] is None) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == [("2", False), ("3", False), ("3", False), ("4", False), ("None", False)]
