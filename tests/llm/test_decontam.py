"""Operator 10: longest matches with test items, against every pair of words."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lexigrove.llm import decontam
from lexigrove.llm.common import tokens
from tests.llm.util import SF, documents, leaks, same


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def corpus(seed, vocabulary=60):
    rng = random.Random(seed)
    take = lambda n: [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    items = [(j, " ".join(take(rng.choice([0, 3, 5, 8, 13, 14, 30])))) for j in range(15)]
    docs = []
    for i in range(40):
        t = take(rng.choice([0, 5, 40, 80]))
        for _ in range(rng.randrange(3)):
            x = rng.choice(items)[1].split()
            s = rng.randrange(len(x) + 1)
            at = rng.randrange(len(t) + 1)
            t[at:at] = x[s : s + rng.choice([5, 12, 13, 14, 30])]
        docs.append((i, rng.choice([" ", "\n", "  "]).join(t)))
    return docs, items


@pytest.mark.parametrize("seed,vocabulary", [(1, 60), (2, 3), (3, 1000)])
def test_against_every_pair(spark, seed, vocabulary):
    docs, items = corpus(seed, vocabulary)
    want = leaks(docs, items)
    same(decontam.matches(documents(spark, docs), benchmark(spark, items)), want)
    kept = {r["doc_id"] for r in decontam.decontaminate(documents(spark, docs), benchmark(spark, items)).collect()}
    assert kept == {i for i, _ in docs} - {x[0] for x in want}


def test_many_parts_of_the_tests(spark, monkeypatch):
    docs, items = corpus(4)
    monkeypatch.setattr(decontam, "TEST_BYTES", 300)
    monkeypatch.setattr(decontam, "PAIRS", 7)
    want = leaks(docs, items)
    same(decontam.matches(documents(spark, docs), benchmark(spark, items)), want)
    left = decontam.decontaminate(documents(spark, [*docs, (None, docs[0][1]), (99, None)]), benchmark(spark, items)).collect()
    near = {x[0] for x in want}
    assert sorted(str(r["doc_id"]) for r in left) == sorted(str(i) for i in [*({i for i, _ in docs} - near), 99, *([] if 0 in near else [None])])


def test_bitmap_leaves_what_has_a_run(spark):
    docs, items = corpus(6)
    rows, tests = decontam.known(documents(spark, docs)), decontam.known(benchmark(spark, items), "item_id")
    assert {r["doc_id"] for r in decontam._candidates(rows, tests, 13).collect()} == {x[0] for x in leaks(docs, items)}


@pytest.mark.parametrize("word", [["a"], ["a", "b"], ["a", "b", "a", "a", "b"]])
def test_a_text_that_repeats_itself(spark, word):
    """An item of 2,000 words in a text of 100,000: 199 million pairs of places, of which few are looked at."""
    item, text = (word * 2_000)[:2_000], (word * 100_000)[:100_000]
    texts = [(1, " ".join(["x", *text])), (2, " ".join(["y", *item[3:], "z"])), (3, " ".join(item[:12]))]
    got = decontam.matches(documents(spark, texts), benchmark(spark, [(9, " ".join(item))]))
    same(got, [(1, 9, 2_000, 1, 0), (2, 9, 1_997, 1, 0 if len(word) == 1 else 1 if len(word) == 2 else 3)])
    built = decontam.Tests(np.zeros(1, np.int64), [" ".join(item)])
    h, _, _, first = tokens(np.frombuffer(texts[0][1].encode(), np.uint8), np.array([0, len(texts[0][1])]))
    array = decontam.SuffixArray(h, first, 13)
    which = np.arange(len(built.suffix))
    assert sum(len(t) for t, _ in built._pairs(array, which, *array.bounds(built.keys, built.masks))) < 500_000


def test_ids_of_other_types_and_texts_of_one_id(spark):
    t, u = (" ".join(f"{c}{i}" for i in range(20)) for c in "vw")
    docs = spark.createDataFrame([("d", t), ("d", f"x {u}"), ("e", "nothing")], "doc_id string, text string")
    items = spark.createDataFrame([("one", t), ("one", u), ("two", u[3:])], "item_id string, text string")
    same(decontam.matches(docs, items), [("d", "one", 20, 0, 0), ("d", "one", 20, 1, 0), ("d", "two", 19, 2, 0)])
    assert [r["doc_id"] for r in decontam.decontaminate(docs, items).collect()] == ["e"]


def test_twelve_words_are_clean_and_thirteen_are_not(spark):
    x = [f"x{i}" for i in range(40)]
    docs = [(1, "a " + " ".join(x[5:17]) + " b"), (2, "a " + " ".join(x[5:18]) + " b"), (3, " ".join(x[:5])), (4, " ".join(x))]
    out = decontam.decontaminate(documents(spark, docs), benchmark(spark, [(7, " ".join(x))]))
    assert {r["doc_id"] for r in out.collect()} == {1, 3}


def test_nulls_empty_repeated_rows_and_clashing_names(spark):
    t = " ".join(f"v{i}" for i in range(20))
    texts = [(1, t), (1, t), (None, t), (2, None), (3, ""), (4, "v1 v2")]
    items = [(5, t), (5, t), (None, t), (6, None), (7, "")]
    df = documents(spark, texts).selectExpr("*", "1 as item_id", "2 as n_words", "3 as m", "4 as row")
    same(decontam.matches(df, benchmark(spark, items)), [(1, 5, 20, 0, 0)])
    out = decontam.decontaminate(df, benchmark(spark, items))
    assert out.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["2", "3", "4"]


def test_empty_tables(spark):
    docs, items = documents(spark, [(1, "a b c d e f g")]), benchmark(spark, [(1, "a b c d e f g")])
    assert decontam.matches(documents(spark, []), items).collect() == []
    assert decontam.matches(docs, benchmark(spark, [])).collect() == []
    assert decontam.decontaminate(docs, benchmark(spark, [])).count() == 1
    assert decontam.decontaminate(documents(spark, []), items).count() == 0


def test_very_long_text(spark):
    rng = random.Random(5)
    t = [f"u{rng.randrange(10**6)}" for _ in range(300_000)]
    item = [f"i{k}" for k in range(30)]
    t[250_000:250_020] = item[3:23]
    same(decontam.matches(documents(spark, [(1, " ".join(t))]), benchmark(spark, [(9, " ".join(item))])), [(1, 9, 20, 250_000, 3)])


def test_query(spark):
    from lexigrove.llm.queries import op10_decontamination

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    grams = {}
    for j, b in items:
        x = b.split()
        n = min(13, len(x))
        for q in range(len(x) - n + 1) if len(x) >= 5 else ():
            grams.setdefault((n, tuple(x[q : q + n])), set()).add(j)
    want = set()
    for i, t in docs:
        x = t.split()
        for n in {n for n, _ in grams}:
            for p in range(len(x) - n + 1):
                want |= {(i, j) for j in grams.get((n, tuple(x[p : p + n])), ())}
    got = op10_decontamination(spark, SF).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and want
    near = {d for d, _ in want}
    same(op10_decontamination(spark, SF), leaks([x for x in docs if x[0] in near and len(x[1]) < 3_000], items) + [tuple(r) for r in got if len(dict(docs)[r["doc_id"]]) >= 3_000])
