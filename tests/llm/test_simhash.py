"""Operator 6: near duplicates, against the distances of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lexigrove.llm import simhash
from lexigrove.llm.common import Shared, text_slices
from tests.llm.util import SF, documents


def prints(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    parts = [simhash.simhash(buf, offsets) for _, _, buf, offsets in text_slices(batch)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def plain_simhash(text):
    """One text's fingerprint from the hashes of its distinct words, a bit at a time."""
    from lexigrove.llm.common import FOLD, NOT_ALNUM, mix, tokens

    data = np.frombuffer(text.encode(), np.uint8)
    h = sorted({int(x) for x in tokens(data, np.array([0, len(data)]), NOT_ALNUM, FOLD)[0]})
    other = [int(x) for x in mix(np.array(h, np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))]
    out = []
    for values in (h, other):
        bits = [2 * sum(v >> b & 1 for v in values) > len(values) for b in range(64)]
        out.append(sum(1 << b for b in range(64) if bits[b]))
    return out


def by_all_pairs(ids, hi, lo, size, radius):
    """{doc_id: least id of its group} of those in a group."""
    own = np.flatnonzero(size)
    ids, hi, lo = np.asarray(ids)[own], hi[own], lo[own]
    label = {int(i): int(i) for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k in range(len(ids)):
        d = simhash.distance(hi[k], lo[k], hi[k + 1 :], lo[k + 1 :])
        for j in np.flatnonzero(d <= radius):
            a, b = root(int(ids[k])), root(int(ids[k + 1 + j]))
            label[max(a, b)] = min(a, b)
    groups = {}
    for i in label:
        groups.setdefault(root(i), []).append(i)
    return {i: r for r, g in groups.items() if len(g) > 1 for i in g}


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3_000)}"
    out = []
    for i in range(n):
        t = [word() for _ in range(rng.choice([1, 4, 60, 200]))]
        out.append(t)
        for _ in range(rng.choice([0, 0, 1, 3])):
            u = list(t)
            for _ in range(rng.randrange(1 + len(t) // 20)):
                u[rng.randrange(len(u))] = word()
            out.append(u)
    rng.shuffle(out)
    return [(i * 2 + 5, " ".join(t)) for i, t in enumerate(out)]


def test_fingerprint_bits():
    texts = ["the cat sat on the mat", "One, two; THREE one", "x", "", "...", "héllo wörld"]
    hi, lo, size = prints(texts)
    for t, h, l, n in zip(texts, hi, lo, size):
        own = [sum(1 << k for k in range(64) if int.from_bytes(int(x).to_bytes(8, "little"), "little") >> (k ^ 0) & 1) for x in (h, l)]
        want = plain_simhash(t) if n else [0, 0]
        # unpacked and packed in the order of bytes, high bit first: the words come back as they were
        assert own == want


@pytest.mark.parametrize("few,bucket", [(64, 4_096), (0, 4_096), (0, 7), (3, 50)])
def test_every_tree_finds_all_within_the_radius(monkeypatch, few, bucket):
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "PAIRS", 1_000)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (20, 2), dtype=np.uint64)
    words = base[rng.integers(0, 20, 500)]
    for _ in range(9):
        words = words ^ (np.uint64(1) << rng.integers(0, 63, words.shape).astype(np.uint64))
    shard = np.sort(rng.integers(0, 4, 500))
    for radius in (0, 3, 16, 40, 128):
        found = {(int(a), int(b)) for q, node in simhash.Trees(shard, words[:, 0], words[:, 1]).search(radius) for a, b in zip(q, node)}
        want = {(a, b) for a in range(500) for b in range(a) if shard[a] == shard[b] and int(simhash.distance(words[a, 0], words[a, 1], words[b, 0], words[b, 1])) <= radius}
        assert found == want


@pytest.mark.parametrize("radius", [0, 2, 7, 11, 20, 31])
def test_shards_hold_every_pair_within_the_radius(radius):
    """Pairs as far apart as the radius, with the differing bits anywhere and evenly over the blocks, share a shard."""
    rng = np.random.default_rng(radius)
    words = rng.integers(0, 1 << 63, (600, 2), dtype=np.uint64)
    other = words.copy()
    for k in range(600):
        at = rng.choice(simhash.BITS, radius, replace=False)
        if k % 2:  # spread: as many in each block as can be
            parts = [list(rng.permutation(b)) for b in simhash.blocks(radius)]
            at = [parts[i % len(parts)].pop() for i in range(radius)]
        for b in at:
            other[k, b >> 6] ^= np.uint64(1 << (int(b) & 63))
    a = list(simhash.shard_keys(words[:, 0], words[:, 1], radius))
    b = list(simhash.shard_keys(other[:, 0], other[:, 1], radius))
    assert all(len({int(x[k]) for x in a} & {int(x[k]) for x in b}) for k in range(600))
    assert sum(len(x) for x in simhash.blocks(radius)) == simhash.BITS and all(simhash.distance(*(w[:, i] for w in (words, other) for i in (0, 1))) == radius)


@pytest.mark.parametrize("radius", [3, 20])
def test_groups_are_those_of_all_pairs(spark, radius):
    texts = corpus(radius, 300)
    want = by_all_pairs([i for i, _ in texts], *prints([t for _, t in texts]), radius)
    got = {r["doc_id"]: r["group_id"] for r in simhash.groups(documents(spark, texts), radius=radius).collect()}
    assert got == want and got


def test_no_pair_at_the_radius_is_missed(spark):
    """4,000 pairs, each as far apart as the radius."""
    rng, rows = np.random.default_rng(11), []
    for k in range(4_000):
        bits = rng.integers(0, 2, simhash.BITS, dtype=np.uint8)
        other = bits.copy()
        other[rng.choice(simhash.BITS, simhash.RADIUS, replace=False)] ^= 1
        rows += [(2 * k + i, *(int(x) for x in np.packbits(b).view(np.int64))) for i, b in enumerate((bits, other))]
    nodes = spark.createDataFrame(rows, "node bigint, hi bigint, lo bigint")
    assert {(r["node"], r["other"]) for r in simhash.near_edges(nodes).collect()} == {(2 * k + 1, 2 * k) for k in range(4_000)}


def test_ids_of_other_types_and_texts_of_one_id(spark):
    rows = [("b", "some words here"), ("a", "Some words, here"), ("c", "quite another thing altogether, long enough to differ"), ("c", "some WORDS here"), ("c", "some WORDS here")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(tuple(r) for r in simhash.groups(df).collect()) == [("a", "a", True), ("b", "a", False), ("c", "a", False)]
    assert sorted(tuple(r) for r in simhash.dedup(df).collect()) == [rows[1], rows[2]]
    assert simhash.groups(df.selectExpr("cast(doc_id as binary) as doc_id", "text")).count() == 3


def test_thousands_of_copies_and_ties(spark):
    texts = [(i, "one and the same text, over and over") for i in range(3_000, 0, -1)]
    out = simhash.groups(documents(spark, texts)).collect()
    assert len(out) == 3_000 and {r["group_id"] for r in out} == {1} and [r["doc_id"] for r in out if r["kept"]] == [1]
    assert [r["doc_id"] for r in simhash.dedup(documents(spark, texts)).collect()] == [1]


def test_nulls_empty_repeated_rows_and_clashing_names(spark):
    texts = [(1, "some words here"), (1, "some words here"), (2, None), (3, ""), (4, "?!"), (5, "?!"), (None, "some words here"), (6, "Some WORDS, here!"), (7, "quite another thing altogether, long enough to differ")]
    df = documents(spark, texts).selectExpr("*", "1 as gone", "2 as node", "3 as hi", "true as kept")
    assert sorted(tuple(r) for r in simhash.groups(df).collect()) == [(1, 1, True), (6, 1, False)]
    out = simhash.dedup(df)
    assert out.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "1", "2", "3", "4", "5", "7", "None"]


def test_repeated_rows_alone_make_no_group(spark):
    assert simhash.groups(documents(spark, [(1, "a b c"), (1, "a b c")])).collect() == []


def test_empty_table(spark):
    assert simhash.groups(documents(spark, [])).collect() == []
    assert simhash.dedup(documents(spark, [])).collect() == []


def test_very_long_text(spark):
    rng = random.Random(4)
    t = [f"u{rng.randrange(10**6)}" for _ in range(200_000)]
    texts = [(1, " ".join(t)), (2, " ".join([*t[:-500], "end"])), (3, " ".join(f"v{i}" for i in range(100_000)))]
    assert sorted(tuple(r) for r in simhash.groups(documents(spark, texts)).collect()) == [(1, 1, True), (2, 1, False)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(301, 300)], "node bigint, other bigint")
    got = {tuple(r) for r in simhash.components(edges, Shared(spark)).collect()}
    assert got == {(i, 0) for i in range(1, 201)} | {(301, 300)}


def test_query(spark):
    from lexigrove.llm.queries import op6_simhash

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = by_all_pairs([r[0] for r in rows], *prints([r[1] for r in rows]), simhash.RADIUS)
    out = op6_simhash(spark, SF).collect()
    got = {r["doc_id"]: r["group_id"] for r in out}
    assert got == want and want
    assert {r["doc_id"] for r in out if r["kept"]} == {r["group_id"] for r in out}
