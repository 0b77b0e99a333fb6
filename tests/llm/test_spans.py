"""Operators 4 and 7: repeated passages, against every run of words."""

from __future__ import annotations

import random

import pytest

from lexigrove.llm import levels, suffixtree
from tests.llm.util import SF, documents, repeats, same

BOTH = [suffixtree.repeated_passages, levels.repeated_passages]


def corpus(seed, n=60, vocabulary=400):
    """Texts with passages in common, whole copies, and texts that repeat themselves."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.choice([7, 8, 9, 15, 40]))] for _ in range(8)]
    out = []
    for i in range(n):
        t = [word() for _ in range(rng.choice([0, 3, 8, 30, 90]))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            t[at:at] = rng.choice(passages)
        out.append((i * 7 - 50, rng.choice([" ", "\n", " \t "]).join(t)))
    return out + [(i + 1000, t) for i, t in out[:5]]


@pytest.mark.parametrize("passages", BOTH)
@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_run(spark, passages, seed):
    texts = corpus(seed)
    same(passages(documents(spark, texts), min_words=8), repeats(texts, 8))


@pytest.mark.parametrize("passages", BOTH)
def test_runs_that_overlap_themselves(spark, passages):
    texts = [(1, "a " * 40), (2, "a b " * 20), (3, "x " + "a b " * 9), (4, "c d e"), (5, "a " * 40)]
    same(passages(documents(spark, texts), min_words=8), repeats(texts, 8))


def test_prefixes_of_groups_too_large_for_memory(spark):
    texts = corpus(3) + [(2000 + i, "same words in a row of all these many texts " * 3 + f"end{i % 4}") for i in range(40)]
    same(suffixtree.repeated_passages(documents(spark, texts), min_words=8, group_rows=5), repeats(texts, 8))


@pytest.mark.parametrize("min_words,group_rows", [(50, 3), (50, 10), (20, 1), (8, 2)])
def test_prefixes_as_long_as_it_takes(spark, min_words, group_rows):
    """A passage that is hot and has anything before it, nearly equal ones, and ones that repeat themselves, split down to single nodes."""
    rng = random.Random(min_words)
    hot = [f"h{i}" for i in range(70)]
    texts = []
    for k in range(40):
        t = [f"o{rng.randrange(50)}" for _ in range(rng.randrange(60))]
        own = list(hot)
        if k % 3 == 0:
            own[rng.randrange(70)] = f"changed{k}"
        at = rng.randrange(len(t) + 1)
        t[at:at] = own[rng.randrange(10) :] if k % 2 else own
        texts.append((k, " ".join(t)))
    texts += [(100 + k, " ".join(["again and"] * (30 + k % 3))) for k in range(9)]
    same(suffixtree.repeated_passages(documents(spark, texts), min_words=min_words, group_rows=group_rows), repeats(texts, min_words))


@pytest.mark.parametrize("kind", ["binary", "string"])
def test_split_groups_with_ids_of_other_types(spark, kind):
    t = " ".join(f"v{i}" for i in range(12))
    rows = [("d", t + " p"), ("d", t + " q"), ("c", "x " + t), ("c", "x " + t)]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    got = suffixtree.repeated_passages(df, min_words=8, group_rows=1)
    assert got.schema["doc_id"].dataType.simpleString() == kind
    assert sorted((r["start_word"], r["end_word"], r["later_words"], r["copies"]) for r in got.collect()) == [(0, 12, 12, 3), (0, 12, 12, 3), (1, 13, 0, 3)]


def test_hot_passages_are_written_once(spark, monkeypatch):
    """No table of a split group has a row per suffix and beginning of a passage: equal surroundings are one row."""
    from lexigrove.llm.common import Shared

    rng, sizes, write = random.Random(7), [], Shared.write

    def counted(self, df):
        out = write(self, df)
        sizes.append(out[0].count())
        return out

    monkeypatch.setattr(Shared, "write", counted)
    hot = [f"h{i}" for i in range(150)]
    texts = [(k, " ".join([f"o{rng.randrange(10**6)}", *hot[: rng.choice([150, 150, 149, 100])], f"p{rng.randrange(10**6)}"])) for k in range(200)]
    same(suffixtree.repeated_passages(documents(spark, texts), group_rows=20), repeats(texts, 50))
    assert max(sizes) == sizes[0]  # all sampled suffixes


@pytest.mark.parametrize("passages", BOTH)
def test_ids_of_other_types_and_texts_of_one_id(spark, passages):
    t = " ".join(f"v{i}" for i in range(12))
    rows = [("b", t), ("a", "x " + t), ("c", t + " y"), ("c", "nothing of this"), ("c", "nothing of this")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    same(passages(df, min_words=8), [("a", 1, 13, 12, 0, 3), ("b", 0, 12, 12, 12, 3), ("c", 0, 12, 12, 12, 3)])
    for kind in ("binary", "string"):
        two = spark.createDataFrame([("d", t + " p"), ("d", t + " q")], "doc_id string, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
        assert sorted((r["start_word"], r["end_word"], r["later_words"], r["copies"]) for r in passages(two, min_words=8).collect()) == [(0, 12, 0, 2), (0, 12, 12, 2)]


@pytest.mark.parametrize("n_batches", [1, 2, 3, 7])
def test_levels_of_any_number_of_batches(spark, n_batches):
    texts = corpus(4)
    same(levels.repeated_passages(documents(spark, texts), min_words=8, n_batches=n_batches, buckets=3), repeats(texts, 8))


def test_equal_levels_merge(spark):
    from lexigrove.llm import spans
    from lexigrove.llm.common import Shared

    family = levels.SuffixLevels(spark, Shared(spark), 2, 8, 3)
    rows = spans.known(documents(spark, corpus(5)))
    sizes = []
    for batch in levels.batches(rows, 6):
        family.add(batch)
        sizes.append([n for n, _, _ in family.levels])
    family.close()
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2]]


@pytest.mark.parametrize("passages", BOTH)
def test_nulls_empty_and_repeated_rows(spark, passages):
    t = " ".join(f"v{i}" for i in range(12))
    texts = [(1, t), (1, t), (None, t), (2, None), (3, ""), (4, "  \n\t"), (5, t + " tail"), (6, "v0 v1")]
    df = documents(spark, texts).selectExpr("*", "text as prefix", "n_chars as pos", "lang as at", "1 as before", "2 as n")
    same(passages(df, min_words=8), repeats(texts, 8))


@pytest.mark.parametrize("passages", BOTH)
def test_one_row_repeated_is_one_document(spark, passages):
    t = " ".join(f"v{i}" for i in range(12))
    same(passages(documents(spark, [(1, t), (1, t)]), min_words=8), [])


@pytest.mark.parametrize("passages", BOTH)
def test_empty_table(spark, passages):
    assert passages(documents(spark, []), min_words=8).collect() == []


@pytest.mark.parametrize("passages", BOTH)
def test_very_long_text(spark, passages):
    rng = random.Random(6)
    t = [f"u{rng.randrange(10**6)}" for _ in range(250_000)]
    t[200_000:200_060] = t[100:160]
    texts = [(1, " ".join(t)), (2, "o " + " ".join(t[5_000:5_100]) + " p")]
    same(passages(documents(spark, texts)), repeats(texts, 50))


def test_words_are_compared_byte_by_byte(spark):
    t = " ".join(f"ü{i}" for i in range(9))
    texts = [(1, t), (2, t.upper()), (3, t.replace(" ", " ")), (4, t)]
    same(suffixtree.repeated_passages(documents(spark, texts), min_words=8), repeats(texts, 8))


@pytest.mark.parametrize("name", ["op4_suffix_tree", "op7_suffix_levels"])
def test_query(spark, name):
    from lexigrove.llm.queries import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same(queries()[name](spark, SF), repeats(rows, 50))
