"""SimHash near-dedup with BK-trees.

A document's fingerprint has 128 bits, each the majority of that bit over the hashes of its distinct words. The bits are cut
into blocks, so many that two fingerprints within the radius differ by no more than two bits in some block. Each fingerprint
goes to the shards named by its blocks as they are and with each single bit flipped, so that two such meet in a shard: no pair
is missed. Each shard's fingerprints form a BK-tree, searched for every one of them along the edges within the radius only.
Shards stay where they are instead of being broadcast, since all of them together are larger than the corpus's fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigrove.llm.common import FOLD, NOT_ALNUM, Shared, expand, known, mix, portions, released, same_document, text_slices, tokens, type_of
from lexigrove.llm.spans import grouped

RADIUS = 20
BITS = 128
#: Fingerprints whose shards' trees are built and searched at a time, at least, and pairs of them.
BATCH_ROWS, PAIRS = 100_000, 1 << 20
#: Fingerprints of a node without children, at most; of shards that are compared pair by pair, many at a time.
BUCKET, FEW = 4_096, 64


def simhash(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High and low word of each row's fingerprint, and the number of its distinct words."""
    h, _, _, first = tokens(buf, offsets, NOT_ALNUM, FOLD)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    order = np.argsort(mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    once = order[np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])])] if len(h) else order
    once.sort()
    h, row = h[once], row[once]
    size = np.bincount(row, minlength=n)
    both = np.stack([h, mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))], 1)
    out = np.zeros((n, BITS), bool)
    filled = np.flatnonzero(size)
    starts = np.searchsorted(row, filled)
    for i in range(0, len(filled), 256):
        a, b = starts[i], starts[i + 256] if i + 256 < len(filled) else len(h)
        at = filled[i : i + 256]
        for j in range(0, 2):  # a half at a time
            ones = np.add.reduceat(np.unpackbits(np.ascontiguousarray(both[a:b, j]).view(np.uint8).reshape(b - a, 8), axis=1), starts[i : i + 256] - a, axis=0, dtype=np.int32)
            out[at, 64 * j : 64 * j + 64] = 2 * ones > size[at, None]
    words = np.packbits(out, axis=1).reshape(n, 2, 8).view(np.uint64).reshape(n, 2)
    return words[:, 0], words[:, 1], size


def fingerprints(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, hi, lo) of every document of ``common.known`` that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in text_slices(batch, "text", 2 << 20):
                hi, lo, size = simhash(buf, offsets)
                own = np.flatnonzero(size)
                named = [batch.column(i).take(pa.array(a + own)) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*named, pa.array(hi[own].view(np.int64)), pa.array(lo[own].view(np.int64))], ["doc_id", "text_hash", "hi", "lo"])

    return rows.mapInArrow(released(run), f"doc_id {type_of(rows)}, text_hash bigint, hi bigint, lo bigint")


def distance(ah: np.ndarray, al: np.ndarray, bh: np.ndarray, bl: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(ah ^ bh) + np.bitwise_count(al ^ bl)).astype(np.int64)


class Trees:
    """BK-trees of several shards; fingerprints of a shard are adjacent.

    A node's children are keyed by their distance to its first fingerprint. Nodes of up to BUCKET fingerprints have no children:
    they are compared with what comes to them as a whole, which costs a small part of following an edge to each.
    """

    def __init__(self, shard: np.ndarray, hi: np.ndarray, lo: np.ndarray):
        self.hi, self.lo = hi, lo
        self.first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.first, len(shard)))

    def search(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (fingerprint, earlier one of its shard) within the radius."""
        small = self.size <= FEW
        rows = np.repeat(self.first[small], self.size[small])
        nth = expand(self.size[small])
        for a, b in portions(nth, PAIRS):  # each with all before it
            q = np.repeat(rows[a:b] + nth[a:b], nth[a:b])
            node = np.repeat(rows[a:b], nth[a:b]) + expand(nth[a:b])
            near = distance(self.hi[q], self.lo[q], self.hi[node], self.lo[node]) <= radius
            yield q[near], node[near]
        for a, n in zip(self.first[~small].tolist(), self.size[~small].tolist()):
            own = np.arange(a, a + n)
            yield from self._visit(own, own, radius)

    def _visit(self, queries: np.ndarray, members: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        queries = queries[queries > members[0]]  # both are in order
        if not len(queries):
            return
        if len(members) <= BUCKET:
            step = max(1, PAIRS // (2 * len(members)))
            for i in range(0, len(queries), step):
                q = queries[i : i + step]
                m = members[: np.searchsorted(members, q[-1])]
                d = np.bitwise_count(self.hi[q, None] ^ self.hi[m]) + np.bitwise_count(self.lo[q, None] ^ self.lo[m])
                x, y = np.nonzero(d <= radius)
                earlier = m[y] < q[x]
                yield q[x[earlier]], m[y[earlier]]
            return
        pivot = members[:1]
        edges, far = (distance(self.hi[x], self.lo[x], self.hi[pivot], self.lo[pivot]) for x in (members, queries))
        for edge in np.unique(edges):
            yield from self._visit(queries[np.abs(far - edge) <= radius], members[edges == edge], radius)


def least_labels(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For 0 .. n - 1 the least number of its connected component."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                break
            x, y = x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
    return label


def blocks(radius: int) -> list[list[int]]:
    """The bits of each block: with more than a third of the radius as many blocks, some block has at most two of the differing bits."""
    n = radius // 3 + 1
    return [list(part) for part in np.array_split(np.arange(BITS), n)]


def shard_keys(hi: np.ndarray, lo: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """For each block, and for it as it is and with each bit flipped, every fingerprint's shard. Two fingerprints that differ by two bits in a block have a shard in common, as each may flip one. Blocks whose keys collide only make a shard larger."""
    for i, bits in enumerate(blocks(radius)):
        masks = [sum(1 << (b & 63) for b in bits if b >> 6 == word) for word in (0, 1)]
        h, l = hi & np.uint64(masks[0]), lo & np.uint64(masks[1])
        for flip in (None, *bits):
            fh, fl = ((1 << (flip & 63)) * (flip >> 6 == word) if flip is not None else 0 for word in (0, 1))
            yield mix(mix((h ^ np.uint64(fh)) + np.uint64(i + 1)) ^ l ^ np.uint64(fl))


def near_edges(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, other): edges with other < node that connect the nodes (node, hi, lo) as the pairs within the radius would, all of them."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, hi, lo = (batch.column(i) for i in range(3))
            for key in shard_keys(hi.to_numpy().view(np.uint64), lo.to_numpy().view(np.uint64), radius):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), node, hi, lo], ["shard", "node", "hi", "lo"])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 0, BATCH_ROWS):
            shard, node, hi, lo = (t[c].to_numpy() for c in ("shard", "node", "hi", "lo"))
            order = np.lexsort((node, shard))
            shard, node, hi, lo = (x[order] for x in (shard, node, hi, lo))
            first = np.concatenate([[True], shard[1:] != shard[:-1]])
            crowd = np.flatnonzero(~(first & np.concatenate([first[1:], [True]])))
            shard, node, hi, lo = (x[crowd] for x in (shard, node, hi.view(np.uint64), lo.view(np.uint64)))
            label = least_labels(len(node), Trees(shard, hi, lo).search(radius)) if len(node) else np.zeros(0, np.int64)
            other = node[label]
            own = other != node
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(other[own])], ["node", "other"])

    sharded = nodes.select("node", "hi", "lo").mapInArrow(released(keys), "shard bigint, node bigint, hi bigint, lo bigint")
    return sharded.repartition("shard").sortWithinPartitions("shard").mapInArrow(released(trees), "node bigint, other bigint").distinct()


def components(edges: DataFrame, shared: Shared) -> DataFrame:
    """(node, other): for each node that isn't the least of its connected component, that least node. edges: (node, other), other < node.

    Alternates large-star and small-star steps until nothing changes; each step is two aggregations and a join.
    """
    edges, path = shared.write(edges.distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low"))
        large = both.where("other > node").join(least, "node").select(F.col("other").alias("node"), F.col("low").alias("other")).distinct()
        lowest = large.groupBy("node").agg(F.min("other").alias("low"))
        small = large.join(lowest, "node").where("other > low").select(F.col("other").alias("node"), F.col("low").alias("other"))
        new, new_path = shared.write(small.unionByName(lowest.select("node", F.col("low").alias("other"))).distinct())
        sums = [d.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "other"))).first() for d in (edges, new)]
        shared.drop(path)
        edges, path = new, new_path
        if sums[0] == sums[1]:
            return edges


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shared: Shared | None = None) -> DataFrame:
    """(doc_id, text_hash, group_id, kept) as ``groups`` has it, with the hash that tells apart the texts of one id."""
    shared = shared or Shared(docs.sparkSession)
    prints, _ = shared.write(fingerprints(known(docs, key, text)).distinct())
    # numbers hold once they are written
    nodes, _ = shared.write(prints.groupBy("hi", "lo").agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("node"), "hi", "lo", "n"))
    least = components(near_edges(nodes, radius), shared).withColumnRenamed("other", "label")
    labelled, _ = shared.write(nodes.join(least, "node", "left").select("hi", "lo", "n", F.coalesce("label", "node").alias("label")))
    several = labelled.groupBy("label").agg(F.sum("n").alias("members")).where("members > 1").select("label")
    members, path = shared.write(prints.join(labelled.join(several, "label", "left_semi"), ["hi", "lo"]).select("doc_id", "text_hash", "label"))
    shared.only(path)
    heads = members.groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"))
    return members.join(heads, "label").select("doc_id", "text_hash", F.col("head.doc_id").alias("group_id"), (F.struct("doc_id", "text_hash") == F.col("head")).alias("kept"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, group_id, kept) of every document that is near another: group_id is the least id of those that are near, directly or through others, and that document is kept.

    Near are all fingerprints within the radius; none is missed. Words are runs of ASCII letters and digits, ASCII case folded,
    and of all other characters. Texts without a word (null, empty, only signs) and rows without id are in no group. Documents
    with equal words have equal fingerprints and are in one group whatever their number. Rows of one id with one text are one
    document, so repeated rows alone make no group; different texts under one id are documents of their own, in the order of
    a hash of their texts. Ids keep their type, which can be any that has an order. Only the two columns are read.
    """
    return classes(docs, key, text, radius).drop("text_hash")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs without those that ``groups`` doesn't keep; all other rows and all columns stay. Repeated rows of a kept document stay too."""
    shared = Shared(docs.sparkSession)
    gone = shared.small(classes(docs, key, text, radius, shared).where("not kept").select("doc_id", "text_hash"))
    return docs.join(gone, same_document(docs, key, text, gone), "left_anti")
