"""From a query to the documents that match it.

The vocabulary is scanned once for all tokens; what matches there is joined with the postings, and one aggregation per
document decides on phrases, negation and strategy from arrays of positions.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lexigrove.config import IndexConfig
from lexigrove.operators.postings import ATTRIBUTE_STEP
from lexigrove.plans.query import Query, Token, accepts


#: Matching terms up to this number are looked at and joined as a list of the driver; more stay a table.
MOST_TERMS = 20_000
#: Values of an IN that a Parquet scan compares one by one with a row group's statistics.
IN_VALUES = 10


def _one_of(terms: Iterable[str], term: str = "term") -> str:
    """Whether the term is one of these, as SQL: one call, however many there are."""
    quoted = (t.replace("\\", "\\\\").replace("'", "\\'") for t in terms)
    return f"{term} IN (" + ", ".join(f"'{t}'" for t in quoted) + ")"


def _possible(token: Token, config: IndexConfig) -> Column:
    """What a matching term must look like: no matching term is left out, and few others get through.

    A swap of neighbours is two plain edits, so plain edits up to twice the allowed typos bound the distance.
    """
    out = F.expr(_one_of([token.term, *token.stems]))
    if token.phrase is not None:
        return out
    k, n, term = config.typo.allowed(token.term), len(token.term), F.lit(token.term)
    if k:
        out = out | (F.col("length").between(n - 1, n + 1) & (F.levenshtein("term", term, 2 * k) >= 0))
    if token.last and n >= config.min_prefix_length:
        out = out | F.col("term").startswith(token.term)
        if config.typo.for_prefixes and k:
            for m in range(max(config.min_prefix_length, n - 1), min(n + 1, config.typo.index_length) + 1):
                out = out | ((F.col("length") > max(n, m)) & (F.levenshtein(F.substring("term", 1, m), term, 2 * k) >= 0))
    return out


def _candidates(vocab: DataFrame, tokens: tuple[Token, ...], config: IndexConfig) -> DataFrame:
    wanted = F.lit(False)
    for t in tokens:
        wanted = wanted | _possible(t, config)
    return vocab.where(wanted)


def _accepted(tokens: tuple[Token, ...], term: str, config: IndexConfig, count: bool) -> list[tuple[int, int, bool]]:
    hits = ((t, accepts(t, term, config, count)) for t in tokens)
    return [(t.index, *h) for t, h in hits if h is not None]


MATCHES = "token int, term string, typos int, same boolean"


def term_matches(vocab: DataFrame, tokens: Iterable[Token], config: IndexConfig, count_typos: bool = True) -> DataFrame:
    """(token, term, typos, same): the terms of (term, length) that match each token, in one scan.

    Plain edits, lengths and beginnings, compared in the JVM, leave few terms for the distance, which runs in one pandas UDF
    for all tokens.
    """
    tokens = tuple(tokens)
    if not tokens:
        return vocab.sparkSession.createDataFrame([], MATCHES)

    @F.pandas_udf("array<struct<token: int, typos: int, same: boolean>>")
    def check(terms: pd.Series) -> pd.Series:
        return terms.map(lambda term: [dict(zip(("token", "typos", "same"), h)) for h in _accepted(tokens, term, config, count_typos)])

    exact_only = all(t.phrase is not None or not t.stems and not config.typo.allowed(t.term) and not (t.last and len(t.term) >= config.min_prefix_length) for t in tokens)
    if exact_only:  # no distance to compute: stay in the JVM
        each = F.filter(F.array(*(F.struct(F.lit(t.index).alias("token"), F.lit(0).alias("typos"), (F.col("term") == t.term).alias("same")) for t in tokens)), lambda x: x["same"])
    else:
        each = check(F.col("term"))
    found = _candidates(vocab, tokens, config).select("term", F.inline(each))
    return found.groupBy("token", "term").agg(F.min("typos").alias("typos"), F.max("same").alias("same"))


def known_matches(vocab: DataFrame, tokens: Iterable[Token], config: IndexConfig, count_typos: bool = True) -> tuple[DataFrame, list[str] | None]:
    """``term_matches``, and the terms if there are at most MOST_TERMS: these go to the driver, and the postings' scan can skip what has none of them."""
    tokens = tuple(tokens)
    found = [r["term"] for r in _candidates(vocab, tokens, config).select("term").distinct().limit(MOST_TERMS + 1).collect()]
    if len(found) > MOST_TERMS:
        return term_matches(vocab, tokens, config, count_typos), None
    rows = [(i, term, typos, same) for term in found for i, typos, same in _accepted(tokens, term, config, count_typos)]
    return F.broadcast(vocab.sparkSession.createDataFrame(rows, MATCHES)), sorted({r[1] for r in rows})


def having_terms(postings: DataFrame, terms: list[str]) -> DataFrame:
    """The postings of the terms, by filters that reach the scan in groups small enough to be compared with a row group's statistics."""
    if not terms:
        return postings.where("false")
    if not IN_VALUES < len(terms) <= 20 * IN_VALUES:
        return postings.where(_one_of(terms))
    groups = " OR ".join(_one_of(terms[i : i + IN_VALUES]) for i in range(0, len(terms), IN_VALUES))
    # one look into a set leaves few rows for the groups; by its form it isn't pushed to the scan beside them
    return postings.where(f"{_one_of(terms, "coalesce(term, '')")} AND ({groups})")


def hits(postings: DataFrame, matches: DataFrame, tokens: Iterable[Token], attributes: Iterable[int] | None = None) -> DataFrame:
    """(doc_id, token, key, typos, exact) of the postings of matching terms; only in the attributes with the given places, if any are."""
    rows = postings if attributes is None else postings.where(F.col("attribute").isin(list(attributes)))
    folded = F.lit(False)
    for t in tokens:
        folded = F.when(F.col("token") == t.index, F.lit(t.folded)).otherwise(folded)
    key = F.col("attribute") * F.lit(ATTRIBUTE_STEP) + F.col("position")
    rows = rows.select("term", "doc_id", key.alias("key"), F.col("folded"))
    key = F.col("key")
    return rows.join(matches, "term").select("doc_id", "token", key.alias("key"), "typos", (F.col("same") & (F.col("folded") == folded)).alias("exact"))


def per_document(found: DataFrame, query: Query) -> DataFrame:
    """One row per document with a hit: per token i its positions ``k{i}``, typos ``t{i}`` and exactness ``e{i}``, and ``matched``, one flag per group.

    A phrase's tokens keep the positions that follow one of the token before. One shuffle, by document.
    """
    aggregates = []
    for t in query.tokens:
        own = F.col("token") == t.index
        aggregates += [F.collect_set(F.when(own, F.col("key"))).alias(f"k{t.index}"), F.min(F.when(own, F.col("typos"))).alias(f"t{t.index}"), F.collect_set(F.when(own & F.col("exact"), F.col("key"))).alias(f"x{t.index}")]
    rows = found.groupBy("doc_id").agg(*aggregates)
    for group in query.groups():
        for before, t in zip(group, group[1:]):
            rows = rows.withColumn(f"k{t.index}", F.array_intersect(f"k{t.index}", F.transform(f"k{before.index}", lambda k: k + 1)))
    flags = [F.size(f"k{g[-1].index}") > 0 for g in query.groups()]
    rows = rows.withColumn("matched", F.array(*flags))
    return rows.select("doc_id", "matched", *(c for t in query.tokens for c in (F.col(f"k{t.index}"), F.coalesce(f"t{t.index}", F.lit(0)).alias(f"t{t.index}"), F.arrays_overlap(f"k{t.index}", f"x{t.index}").alias(f"e{t.index}"))))


def strategy(query: Query, matching: str = "any") -> Column:
    """Whether the flags in ``matched`` make a document match: any or all of the groups, and none of the negated ones."""
    positive, negative = [], []
    for i, g in enumerate(query.groups()):
        flag = F.coalesce(F.get("matched", F.lit(i)), F.lit(False))
        (negative if g[0].negated else positive).append(flag)
    out = F.lit(True)
    if positive:
        out = positive[0]
        for flag in positive[1:]:
            out = out & flag if matching == "all" else out | flag
    for flag in negative:
        out = out & ~flag
    return out


def needs_every_document(query: Query) -> bool:
    """Whether documents without a hit can match: nothing is asked for, or only that something is missing."""
    return all(g[0].negated for g in query.groups())


def matching_documents(docs: DataFrame, postings: DataFrame, vocab: DataFrame, query: Query, config: IndexConfig, matching: str = "any", attributes: Iterable[int] | None = None, count_typos: bool = True) -> DataFrame:
    """The documents (with doc_id) that match, with the columns of ``per_document`` for ranking. The vocabulary is looked up at once, the rest is lazy."""
    if not query.tokens:
        return docs
    matches, terms = known_matches(vocab, query.tokens, config, count_typos)
    some = postings if terms is None else having_terms(postings, terms)
    rows = per_document(hits(some, matches, query.tokens, attributes), query)
    joined = docs.join(rows, "doc_id", "left" if needs_every_document(query) else "inner")
    return joined.where(strategy(query, matching))
