"""Relevance: five rules as Column expressions over the positions of one document, weighted and summed."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from lexigrove.config import RULE_DECAY, IndexConfig
from lexigrove.operators.postings import ATTRIBUTE_STEP
from lexigrove.plans.query import Query

DECAY = 0.1
#: Scores by the number of tokens and what they depend on of the settings.
_SCORES: dict[tuple, Column] = {}
MOST_SCORES = 64


def _count(flags: list[Column]) -> Column:
    out = F.lit(0)
    for f in flags:
        out = out + F.coalesce(f, F.lit(False)).cast("int")
    return out


def _matched(query: Query) -> list[Column]:
    return [F.coalesce(F.size(f"k{t.index}") > 0, F.lit(False)) for t in query.tokens]


def words_rule(query: Query) -> Column:
    return _count(_matched(query)) / F.lit(float(len(query.tokens)))


def exactness_rule(query: Query) -> Column:
    return _count([F.col(f"e{t.index}") for t in query.tokens]) / F.lit(float(len(query.tokens)))


def typo_rule(query: Query) -> Column:
    total = F.lit(0)
    for t, matched in zip(query.tokens, _matched(query)):
        total = total + F.when(matched, F.coalesce(F.col(f"t{t.index}"), F.lit(0))).otherwise(0)
    return F.when(total <= 0, F.lit(1.0)).otherwise(F.exp(-DECAY * total))


def attribute_rule(query: Query, config: IndexConfig) -> Column:
    weights = list(config.attribute_weights().values())
    out = F.lit(1.0)
    if not weights:
        return out
    table = F.array(*(F.lit(w) for w in weights))
    for t, matched in zip(query.tokens, _matched(query)):
        best = F.array_max(F.transform(f"k{t.index}", lambda k: F.coalesce(F.get(table, F.floor(k / ATTRIBUTE_STEP).cast("int")), F.lit(1.0))))
        out = out * F.when(matched, best).otherwise(1.0)
    return out


def proximity_walk(positions: Column, attribute: Column) -> Column:
    """The walk through one attribute: positions is an array of each token's positions in query order; each token takes the next position after that of the token before."""
    state = F.struct(F.lit(-1).cast("bigint").alias("last"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(True).alias("adjacent"))

    def step(s: Column, keys: Column) -> Column:
        ahead = F.array_min(F.filter(keys, lambda k: (F.floor(k / ATTRIBUTE_STEP) == attribute) & (k > s["last"])))
        gap = ahead - s["last"]
        moved = F.struct(
            ahead.alias("last"),
            (s["n"] + 1).alias("n"),
            (s["sum"] + F.when(s["n"] > 0, F.exp(-DECAY * gap)).otherwise(0.0)).alias("sum"),
            (s["adjacent"] & ((s["n"] == 0) | (gap == 1))).alias("adjacent"),
        )
        return F.when(ahead.isNull(), s).otherwise(moved)

    return F.aggregate(positions, state, step)


def proximity_rule(query: Query) -> Column:
    """1 if the matched tokens follow one another in some attribute, else the best attribute's closeness."""
    if len(query.tokens) <= 1:
        return F.lit(1.0)
    matched = _count(_matched(query))
    positions = F.array(*(F.coalesce(F.col(f"k{t.index}"), F.array().cast("array<bigint>")) for t in query.tokens))
    attributes = F.array_distinct(F.transform(F.flatten(positions), lambda k: F.floor(k / ATTRIBUTE_STEP)))
    walks = F.transform(attributes, lambda a: proximity_walk(positions, a))

    def closeness(w: Column) -> Column:
        whole = (w["n"] == matched) & w["adjacent"]
        return F.when(whole, 1.0).when(w["n"] == 1, 1.0 / matched).otherwise(w["sum"] / (matched - 1))

    return F.when(matched <= 1, 1.0).otherwise(F.coalesce(F.array_max(F.transform(walks, closeness)), F.lit(1.0)))


def rule(name: str, query: Query, config: IndexConfig) -> Column:
    return {"words": words_rule, "typo": typo_rule, "proximity": proximity_rule, "exactness": exactness_rule}[name](query) if name != "attribute" else attribute_rule(query, config)


def score(query: Query, config: IndexConfig) -> Column:
    """The weighted mean of the configured rules, in their order; each weighs RULE_DECAY of the one before.

    It names the tokens by their places only, so that it is built once for all queries of as many tokens.
    """
    session = SparkSession.getActiveSession()
    key = id(session._jvm) if session else 0, len(query.tokens), config.ranking_rules, tuple(config.attribute_weights().values())
    if key not in _SCORES:
        if len(_SCORES) >= MOST_SCORES:
            _SCORES.clear()
        _SCORES[key] = _score(query, config)
    return _SCORES[key]


def _score(query: Query, config: IndexConfig) -> Column:
    total, weights = F.lit(0.0), 0.0
    for i, name in enumerate(config.ranking_rules):
        total, weights = total + rule(name, query, config) * (RULE_DECAY**i), weights + RULE_DECAY**i
    return total / weights
