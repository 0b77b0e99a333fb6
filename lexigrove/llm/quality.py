"""Quality rules: hashed word and character n-gram logistic regression with calibrated probabilities.

Two targets are fitted on the labelled rows, quality and toxicity. A text's features are its words and pairs of words, its
equal neighbouring words, and its runs of CHARACTERS bytes, all hashed to buckets. A linear score over them needs no feature
matrix: each n-gram's weight is looked up and summed per text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigrove.llm.common import FOLD, NOT_ALNUM, fresh, mix, released, text_slices, tokens

#: Buckets of the word features and of the character features.
WORD_BITS, CHAR_BITS = 40, 18
#: Word features are kept that as many of the sampled texts have, and that occur in the two classes of some target at rates which lie so many standard errors apart.
LEAST_TEXTS, LEAST_ERRORS = 4, 5.0
CHARACTERS = 4
#: Parts, a power of two, in which word features are counted.
PARTS = 16
#: Labelled texts that the model is fitted and calibrated on, at most; the first in the order of a hash of their ids.
SAMPLE_ROWS = 8_000
#: One in so many of these is kept for calibration.
HELD_OUT = 4
EPOCHS, STEP, RIDGE = 20, 0.2, 1e-5
#: Texts of a gradient step.
STEP_ROWS = 64
#: A text is kept if its probability of good quality is at least, and that of being toxic under, these.
MIN_QUALITY, MAX_TOXIC = 0.4, 0.3
TARGETS = ("quality", "toxic")
_LOW = np.uint64((1 << 16) - 1)


def word_features(buf: np.ndarray, offsets: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each distinct word, pair of words and repeated word of each text, in the order of rows; only those with a bucket among the chosen, in order, if these are given, as their places there."""
    h, _, _, first = tokens(buf, offsets, NOT_ALNUM, FOLD)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    pair = h[:-1] * np.uint64(3) + h[1:]
    pair[h[:-1] == h[1:]] = 7  # any word that follows itself
    follows = row[1:] == row[:-1]
    ids = np.concatenate([mix(h ^ np.uint64(11)), mix(pair[follows])]) >> np.uint64(64 - WORD_BITS)
    rows = np.concatenate([row, row[1:][follows]])
    if chosen is not None:
        known = np.zeros(1 << 16, bool)
        known[chosen & _LOW] = True
        maybe = np.flatnonzero(known[ids & _LOW])
        ids, rows = ids[maybe], rows[maybe]
        at = np.minimum(np.searchsorted(chosen, ids), max(len(chosen) - 1, 0))
        hit = chosen[at] == ids if len(chosen) else np.zeros(len(ids), bool)
        ids, rows = at[hit].astype(np.uint64), rows[hit]
    order = np.lexsort((ids, rows))
    ids, rows = ids[order], rows[order]
    once = np.ones(len(ids), bool)
    once[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])
    return rows[once], ids[once]


class Features:
    """The features of the texts of one slice: for each its number, and per text where its features begin and how many there are."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, chosen: np.ndarray):
        n = len(offsets) - 1
        rows, ids = word_features(buf, offsets, chosen)
        self.words = ids.astype(np.int64)
        self.word_first = np.searchsorted(rows, np.arange(n + 1))
        m = max(len(buf) - CHARACTERS + 1, 0)
        code = np.zeros(m, np.uint32)
        for i in range(CHARACTERS):
            code = (code << np.uint32(8)) | buf[i : i + m]
        self.chars = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHAR_BITS)).astype(np.int32)
        self.char_first = np.minimum(offsets[:-1], m)
        self.char_count = np.maximum(np.minimum(offsets[1:] - offsets[:-1] - CHARACTERS + 1, m), 0)
        self.char_scale = 4.0 / np.maximum(self.char_count, 1)

    def scores(self, weights: dict) -> np.ndarray:
        words = _sums(weights["words"][self.words], self.word_first[:-1], np.diff(self.word_first))
        return weights["bias"] + words + _sums(weights["chars"][self.chars], self.char_first, self.char_count) * self.char_scale


def _sums(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of count values from first on."""
    if not len(values):
        return np.zeros(len(first))
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first + count] - total[first]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def fit(texts: list[str], labels: dict[str, np.ndarray], held_out: np.ndarray, epochs: int = EPOCHS) -> dict:
    """The chosen word features and, by target, weights from the texts that aren't held out (Adagrad) and Platt's slope and intercept from those that are."""
    fitted = np.flatnonzero(~held_out)
    slices = [list(_slices([texts[i] for i in part])) for part in (fitted, np.flatnonzero(held_out))]
    each = [(word_features(buf, offsets), a) for a, _, buf, offsets in slices[0]]
    ids = np.concatenate([x[0][1] for x in each] or [np.zeros(0, np.uint64)])
    rows = np.concatenate([(x[0][0] + x[1]).astype(np.int32) for x in each] or [np.zeros(0, np.int32)])
    del each
    chosen = np.concatenate([_telling(ids, rows, np.uint64(part), labels, fitted) for part in range(PARTS)])
    del ids, rows
    parts = [[(Features(buf, offsets, chosen), part[a:b]) for a, b, buf, offsets in own] for own, part in zip(slices, (fitted, np.flatnonzero(held_out)))]
    size = {"words": len(chosen), "chars": 1 << CHAR_BITS}
    model: dict = {"chosen": chosen, "targets": {}}
    for target, y in labels.items():
        w = {"bias": 0.0, **{k: np.zeros(n, np.float32) for k, n in size.items()}, "slope": 1.0, "intercept": 0.0}
        squares = {"bias": 1e-6, **{k: np.full(n, 1e-6) for k, n in size.items()}}
        rng = np.random.default_rng(5)
        for _ in range(epochs):
            for i in rng.permutation(len(parts[0])):
                f, rows = parts[0][i]
                error = (sigmoid(f.scores(w)) - y[rows]) / len(rows)
                spread = np.zeros(len(f.chars))
                for r in range(len(rows)):
                    spread[f.char_first[r] : f.char_first[r] + f.char_count[r]] = error[r] * f.char_scale[r]
                steps = {
                    "bias": error.sum(),
                    "words": np.bincount(f.words, weights=np.repeat(error, np.diff(f.word_first)), minlength=size["words"]) + RIDGE * w["words"],
                    "chars": np.bincount(f.chars, weights=spread, minlength=size["chars"]) + RIDGE * w["chars"],
                }
                for name, g in steps.items():
                    squares[name] = squares[name] + g * g
                    w[name] = w[name] - STEP * g / np.sqrt(squares[name])
        if parts[1]:
            z = np.concatenate([f.scores(w) for f, _ in parts[1]])
            w["slope"], w["intercept"] = platt(z, np.concatenate([y[rows] for _, rows in parts[1]]))
        model["targets"][target] = w | {k: np.asarray(w[k], np.float32) for k in size}
    return model


def _telling(ids: np.ndarray, rows: np.ndarray, part: np.uint64, labels: dict[str, np.ndarray], fitted: np.ndarray) -> np.ndarray:
    """The chosen word features among those with the given first bits, in order; a part of the features at a time keeps the arrays small."""
    own = np.flatnonzero(ids >> np.uint64(WORD_BITS - PARTS.bit_length() + 1) == part)
    found, inverse, with_it = np.unique(ids[own], return_inverse=True, return_counts=True)
    telling = np.zeros(len(found), bool)
    for y in labels.values():
        y = y[fitted]
        ones, n = y.sum(), len(y)
        if 0 < ones < n:
            hits = np.bincount(inverse, weights=y[rows[own]], minlength=len(found))
            rate = with_it / n
            error = np.sqrt(rate * (1 - rate) * (1 / ones + 1 / (n - ones)))
            telling |= np.abs(hits / ones - (with_it - hits) / (n - ones)) > LEAST_ERRORS * error
    return found[telling & (with_it >= LEAST_TEXTS)]


def _slices(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    column = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    for s in range(0, len(texts), STEP_ROWS):
        for a, b, buf, offsets in text_slices(column.slice(s, STEP_ROWS)):
            yield s + a, s + b, buf, offsets


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through the scores, fitted by Newton's method to Platt's smoothed targets; a falling curve is not accepted."""
    pos, neg = float(y.sum()), float((1 - y).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        g = np.array([((p - target) * z).sum(), (p - target).sum()])
        v = p * (1 - p) + 1e-9
        hessian = np.array([[(v * z * z).sum() + 1e-6, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(hessian, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-8:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, targets: tuple[str, ...] = TARGETS) -> bytes:
    """The fitted model, from at most sample_rows labelled texts; a target that has no labels, or one class only, gives that class's share as every text's probability.

    Ids of both tables have one type, whichever. Of several labels of an id the least counts, of several texts the first in order.
    """
    chosen = labels.select(F.col(f"`{key}`").alias("doc_id"), *(F.col(t).cast("double").alias(t) for t in targets)).where("doc_id is not null").where(" and ".join(f"{t} is not null" for t in targets))
    sample = chosen.groupBy("doc_id").agg(*(F.min(t).alias(t) for t in targets)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    joined = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), *(F.first(t).alias(t) for t in targets)).withColumn("mixed", F.xxhash64("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by("doc_id")
        del held
        ids = rows["mixed"].to_numpy().astype(np.uint64)
        y = {t: (rows[t].to_numpy() > 0).astype(np.float64) for t in targets}
        mixed = {t: v for t, v in y.items() if 0 < v.mean() < 1}
        model = fit(rows["text"].to_pylist(), mixed, mix(ids) % np.uint64(HELD_OUT) == 0) if mixed else {"chosen": np.zeros(0, np.uint64), "targets": {}}
        model["targets"] |= {t: {"share": float(v.mean())} for t, v in y.items() if t not in mixed}
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    found = joined.repartition(1).mapInArrow(released(run), "model binary").collect()
    return bytes(found[0]["model"]) if found else pickle.dumps({"chosen": np.zeros(0, np.uint64), "targets": {t: {"share": None} for t in targets}})


def probabilities(f: Features, model: dict, target: str) -> np.ndarray:
    w = model["targets"][target]
    if "share" in w:
        return np.full(len(f.char_first), np.nan if w["share"] is None else w["share"])
    return sigmoid(w["slope"] * f.scores(w) + w["intercept"])


def score(docs: DataFrame, model: bytes, text: str = "text", targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """docs with ``p_quality`` and ``p_toxic`` (``p_`` and the target), scored in Arrow batches.

    A null text has null probabilities; an empty one, or one without n-grams, those of the model's bias. Without any labelled
    text all probabilities are null. All rows and columns are kept; the new names get underscores appended while a column
    has them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [fresh(docs, f"p_{t}") for t in targets]
    at = docs.columns.index(text)
    schema = docs.schema
    for name in names:
        schema = type(schema)([*schema.fields]).add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = pickle.loads(shared.value)
        for batch in batches:
            null = batch.column(at).is_null().to_numpy(zero_copy_only=False)
            only = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            for a, b, buf, offsets in text_slices(only, "text", 3 << 20):
                f = Features(buf, offsets, weights["chosen"])
                part = batch.slice(a, b - a)
                columns = list(part.columns)
                for t in targets:
                    p = probabilities(f, weights, t)
                    columns.append(pa.array(p, mask=null[a:b] | np.isnan(p)))
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, *names])

    return docs.mapInArrow(released(run), schema)


def keep(docs: DataFrame, model: bytes, text: str = "text", min_quality: float = MIN_QUALITY, max_toxic: float = MAX_TOXIC) -> DataFrame:
    """The scored docs that pass: good quality likely enough, and toxicity not. A null probability of quality rejects a null text and passes where nothing is labelled; one of toxicity passes."""
    scored = score(docs, model, text, TARGETS)
    quality, toxic = (F.col(c) for c in scored.columns[-2:])
    good = F.coalesce(quality >= min_quality, F.col(f"`{text}`").isNotNull())
    return scored.where(good & F.coalesce(toxic < max_toxic, F.lit(True)))
