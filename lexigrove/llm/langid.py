"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds its letters' vectors, each permuted by its place, by
elementwise product; a text's vector bundles the vectors of all its n-grams, as often as they occur; a language's prototype
bundles the texts of a labelled sample. A text gets the language whose prototype has the greatest cosine with its vector.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigrove.llm.common import released, text_slices

DIMENSIONS = 1024
GRAM = 3
#: Letter classes: white space, punctuation and digits are class 0, Latin letters and the others share the rest.
LETTERS = 32
SEED = 20_011
#: Labelled texts of each language that its prototype is made of, at most; the first in the order of a hash of their ids.
SAMPLE_PER_LANGUAGE = 1_000


def _classes() -> np.ndarray:
    """Class of each code point up to 0x250; the letters beyond are hashed to the classes."""
    out = np.zeros(0x250, np.uint8)
    extra = "ßäöüéèêçàñíóáúôîâûœæøå"
    for i in range(len(out)):
        c = chr(i).lower()
        if not c.isalpha():
            continue
        if "a" <= c <= "z":
            out[i] = ord(c) - 96
        elif c in extra and extra.index(c) < LETTERS - 27:
            out[i] = 27 + extra.index(c)
        else:
            base = unicodedata.normalize("NFD", c)[0]
            out[i] = ord(base) - 96 if "a" <= base <= "z" else 1 + i % (LETTERS - 1)
    return out


_CLASS = _classes()


def letters(text: str) -> np.ndarray:
    """Letter classes of a text, other characters as single zeros, with a zero at either end."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < len(_CLASS), _CLASS[np.minimum(points, len(_CLASS) - 1)], 1 + points % (LETTERS - 1)).astype(np.uint8)
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint8)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep].astype(np.int32)


def counts(text: str) -> np.ndarray:
    """How often each n-gram occurs."""
    c = letters(text)
    if len(c) < GRAM:
        return np.zeros(LETTERS**GRAM, np.int64)
    code = c[: len(c) - GRAM + 1].copy()
    for i in range(1, GRAM):
        code *= LETTERS
        code += c[i : len(c) - GRAM + 1 + i]
    return np.bincount(code, minlength=LETTERS**GRAM)


def gram_vectors(dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """The vector of every n-gram, bound from its letters' permuted vectors."""
    rng = np.random.default_rng(seed)
    base = rng.choice(np.array([-1, 1], np.int8), (LETTERS, dimensions))
    permutation = rng.permutation(dimensions)
    out, placed = np.ones((1, dimensions), np.int8), [base]
    for _ in range(GRAM - 1):
        placed.append(placed[-1][:, permutation])
    for i in range(GRAM):  # the first letter is permuted most
        out = (out[:, None, :] * placed[GRAM - 1 - i][None, :, :]).reshape(-1, dimensions)
    return out.astype(np.float32)


_VECTORS: dict[tuple[int, int], np.ndarray] = {}


def _vectors(dimensions: int, seed: int) -> np.ndarray:
    if (dimensions, seed) not in _VECTORS:
        _VECTORS[dimensions, seed] = gram_vectors(dimensions, seed)
    return _VECTORS[dimensions, seed]


def bundle(text: str, vectors: np.ndarray) -> np.ndarray:
    n = counts(text)
    at = np.flatnonzero(n)
    return n[at].astype(np.float32) @ vectors[at]


def prototypes(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED, per_language: int = SAMPLE_PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Unit vectors by language, from at most per_language labelled texts each; a text counts as a unit vector, so long ones don't outweigh the others."""
    from pyspark.sql import Window

    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    ids = rows.where("doc_id is not null and lang is not null").select("doc_id", "lang").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    sample = ids.withColumn("nth", nth).where(F.col("nth") <= per_language).select("doc_id", "lang")
    texts = rows.where("text is not null").join(F.broadcast(sample), ["doc_id", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        vectors = _vectors(dimensions, seed)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b, buf, offsets in text_slices(batch):
                data = buf.tobytes()
                for i in range(b - a):
                    v = bundle(data[offsets[i] : offsets[i + 1]].decode("utf-8", "replace"), vectors)
                    if (norm := np.linalg.norm(v)) > 0:
                        sums[langs[a + i]] = sums.get(langs[a + i], 0) + v / norm
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype(np.float64).tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    out: dict[str, np.ndarray] = {}
    partial = texts.select("lang", "text").mapInArrow(released(run), "lang string, v array<double>")
    summed = partial.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    for row in summed.orderBy("lang").collect():
        v = np.array([x["x"] for x in row["v"]])
        out[row["lang"]] = (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)
    return out


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], key: str = "doc_id", text: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """(key, language, cosine, margin) of every row; margin is the cosine's lead over the next language's.

    A text without letters (null, empty, only digits or signs) has a null language, cosine and margin, as has any text if there
    are no profiles; with one profile the margin is the cosine. Of languages with equal cosines the first by name is given.
    Repeated rows and null keys are kept; other columns are not read.
    """
    names = sorted(profiles)
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((names, np.stack([profiles[n] for n in names], 1) if names else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        vectors = _vectors(dimensions, seed)
        for batch in batches:
            for a, b, buf, offsets in text_slices(batch):
                data = buf.tobytes()
                best, cosine, margin = [None] * (b - a), [None] * (b - a), [None] * (b - a)
                for i in range(b - a) if names else ():
                    v = bundle(data[offsets[i] : offsets[i + 1]].decode("utf-8", "replace"), vectors)
                    norm = float(np.linalg.norm(v))
                    if not norm:
                        continue
                    c = (v @ matrix) / norm
                    j = int(c.argmax())
                    best[i], cosine[i] = names[j], float(c[j])
                    margin[i] = float(c[j] - max((c[k] for k in range(len(names)) if k != j), default=0.0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(best, pa.string()), pa.array(cosine, pa.float64()), pa.array(margin, pa.float64())], [key, "language", "cosine", "margin"])

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("text")).mapInArrow(released(run), f"`{key}` {kind}, language string, cosine double, margin double")
