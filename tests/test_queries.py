"""Every search query against its SQL, or, without one, against plain Python."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexigrove.functions.edit import damerau
from lexigrove.queries import CONFIG, ORACLES, QUERIES, documents_postings
from tests.oracle import SF, compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


def test_states_against_a_loop(spark):
    for r in QUERIES["automaton_states"](spark, SF).collect():
        state, want = 0, []
        for c in r["term"][:14]:
            state = state * 4 + ord(c) % 4 + 1
            want.append(state)
        assert r["states"] == want


def test_stems_are_those_of_single_words(spark):
    from lexigrove.functions.stem import STEMMERS

    rows = QUERIES["stems"](spark, SF).collect()
    assert rows
    for r in rows:
        assert r["stem"] == (STEMMERS[r["lang"]](r["term"]) if r["lang"] in STEMMERS else r["term"]) or r["lang"] not in STEMMERS


def test_detected_languages(spark):
    """Of the texts in languages that there are profiles for, with ten words or more, most are recognised; a text without a verdict counts as missed."""
    from lexigrove.functions.language import LANGUAGES

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("size(split(text, ' ')) >= 10").select("doc_id")
    rows = QUERIES["language_detection"](spark, SF).join(docs, "doc_id").where(F.col("lang").isin(list(LANGUAGES))).collect()
    assert len(rows) > 100 and sum(r["lang"] == r["detected"] for r in rows) > 0.8 * len(rows)


def test_optional_typos_in_prefixes(spark):
    """Every term against every token, with the distance to each of its beginnings; what isn't near isn't there."""
    got = {(r["token"], r["term"]) for r in QUERIES["typo_prefix_optional"](spark, SF).collect()}
    terms = {r["term"] for r in documents_postings(spark, SF).select("term").distinct().collect()}
    want = {(0, "of")}
    for t in terms:
        near = any(damerau("thernd", t[:n], True) <= CONFIG.typo.allowed("thernd") for n in range(5, 8) if len(t) > n and len(t) > 6)
        whole = abs(len(t) - 6) <= 1 and damerau("thernd", t, True) <= CONFIG.typo.allowed("thernd")
        if t.startswith("thernd") or near or whole:
            want.add((1, t))
    assert got == want


def test_every_query_has_sql_or_a_reason():
    assert {n for n in QUERIES if n not in ORACLES} == {"stems", "language_detection", "automaton_states", "typo_prefix_optional"}
