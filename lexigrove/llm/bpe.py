"""BPE encoding and decoding.

Short texts are encoded batch by batch. A long text is cut into leaves that are encoded in parallel; its leaves are then
concatenated pairwise up a tree. At each join a window of tokens around it is encoded anew and grows until its outermost
tokens are those that both sides had there. Two token sequences that agree at a token can be spliced at it, since a sequence
is the encoding of its text if and only if each neighbouring pair in it is the encoding of the pair's text.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigrove.llm.common import released, text_slices

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: The split of the vocabularies that come as ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of more characters than this are encoded as a tree.
LONG_CHARS = 65_536
LEAF_BYTES = 16_384
#: Tokens on either side of a join that the first window has, and that must agree.
WINDOW, AGREE = 16, 2


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """A byte-level BPE vocabulary, given as a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        table = [b""] * size
        for token, rank in ranks.items():
            table[rank] = token
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.bytes = pa.array(table, pa.large_binary())

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32) if text else np.zeros(0, np.int32)

    def decode(self, ids: np.ndarray) -> memoryview | bytes:
        """The bytes of all tokens in turn."""
        if not len(ids):
            return b""
        taken = self.bytes.take(pa.array(ids))
        return memoryview(taken.buffers()[2]).cast("B")[: int(self.lengths[ids].sum())]

    def join(self, data: bytes, left: tuple[np.ndarray, int], right: tuple[np.ndarray, int], end: int) -> tuple[np.ndarray, int]:
        """The encoding of data[a:end], from those of data[a:b] and data[b:end], each given with its start."""
        (lt, a), (rt, b) = left, right
        if not len(lt) or not len(rt):
            return (lt if len(lt) else rt), a
        k = WINDOW
        while True:
            i, j = max(0, len(lt) - k), min(len(rt), k)
            s, e = b - int(self.lengths[lt[i:]].sum()), b + int(self.lengths[rt[:j]].sum())
            while i > 0 and data[s] & 0xC0 == 0x80:  # not inside a character
                i -= 1
                s -= int(self.lengths[lt[i]])
            while j < len(rt) and data[e] & 0xC0 == 0x80:
                e += int(self.lengths[rt[j]])
                j += 1
            w = self.encode(data[s:e].decode("utf-8"))
            m, n = min(AGREE, len(lt) - i), min(AGREE, j)
            if (i == 0 or np.array_equal(w[:m], lt[i : i + m])) and (j == len(rt) or np.array_equal(w[-n:], rt[j - n : j])):
                return np.concatenate([lt[:i], w, rt[j:]]), a
            k *= 2

    def concatenate(self, data: bytes, leaves: list[tuple[np.ndarray, int]]) -> np.ndarray:
        """The encoding of data from those of its leaves, (tokens, start) in order."""
        if not leaves:
            return np.zeros(0, np.int32)
        while len(leaves) > 1:
            ends = [start for _, start in leaves[2::2]] + [len(data)]
            pairs = [self.join(data, leaves[i], leaves[i + 1], ends[i // 2]) for i in range(0, len(leaves) - 1, 2)]
            leaves = pairs + leaves[len(pairs) * 2 :]
        return leaves[0][0]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def cuts(data: bytes, size: int) -> list[int]:
    """Starts of leaves of about size bytes, none inside a character."""
    out, n = [0], len(data)
    while out[-1] + size < n:
        at = out[-1] + size
        while at < n and data[at] & 0xC0 == 0x80:
            at += 1
        if at >= n:
            break
        out.append(at)
    return out


def _result(ids: list[np.ndarray | None], keys: pa.Array, name: str, ok: list[bool | None] | None) -> pa.RecordBatch:
    counts = np.array([0 if x is None else len(x) for x in ids], np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.array([*(x is None for x in ids), False]))
    values = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
    columns = {name: keys, "n_tokens": pa.array(counts, mask=np.array([x is None for x in ids], bool)), "tokens": pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))}
    if ok is not None:
        columns["round_trip"] = pa.array(ok, pa.bool_())
    return pa.RecordBatch.from_pydict(columns)


def encode(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", verify: bool = False, long_chars: int = LONG_CHARS, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """(key, n_tokens, tokens[, round_trip]) of every row, as many rows as df has.

    A null text has null tokens, a null count and a null round_trip, and an empty one no tokens. Null and repeated keys are
    kept as they are; other columns, whatever their names, are not read. A new column gets underscores appended while the key
    has its name. ``round_trip`` says whether the decoded tokens are the text byte by byte.
    """
    path = path or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, tokens array<int>" + ", round_trip boolean" * verify
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    is_long = F.coalesce(F.length("text") > long_chars, F.lit(False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            valid = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for a, b, buf, offsets in text_slices(batch, "text", 2 << 20):
                data = buf.tobytes()
                ids = [c.encode(data[offsets[i] : offsets[i + 1]].decode("utf-8")) if valid[a + i] else None for i in range(b - a)]
                ok = None
                if verify:
                    same = c.decode(np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])) == data
                    ok = [None if x is None else same or bytes(c.decode(x)) == data[offsets[i] : offsets[i + 1]] for i, x in enumerate(ids)]
                yield _result(ids, batch.column(0).slice(a, b - a), "key", ok)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, buf, _ in text_slices(batch, "text", 1):
                data = buf.tobytes()
                starts = cuts(data, leaf_bytes)
                parts = [data[s:e].decode("utf-8") for s, e in zip(starts, [*starts[1:], len(data)])]
                n = len(parts)
                own = [batch.column(i).slice(a, 1).take(pa.array(np.zeros(n, np.int64))) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(starts, pa.int64()), pa.array(parts, pa.string())], ["key", "text_hash", "leaf", "text"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [c.encode(t) for t in batch.column(3).to_pylist()]
            yield batch.append_column("tokens", _result(ids, batch.column(2), "k", None).column(2))

    def concatenate(group: pa.Table) -> pa.Table:
        c = codec(path)
        group = group.sort_by("leaf")
        starts = group["leaf"].to_numpy()
        kept = np.flatnonzero(np.concatenate([[True], np.diff(starts) > 0]))
        copies = int((starts == 0).sum())
        one = group.take(pa.array(kept))
        data = "".join(one["text"].to_pylist()).encode()
        ids = c.concatenate(data, [(np.asarray(t, np.int32), int(s)) for t, s in zip(one["tokens"].to_pylist(), one["leaf"].to_pylist())])
        ok = [bytes(c.decode(ids)) == data] * copies if verify else None
        return pa.Table.from_batches([_result([ids] * copies, group["key"].combine_chunks().slice(0, copies), "key", ok)])

    parts = (
        rows.where(is_long)
        .withColumn("text_hash", F.sha2("text", 256))
        .mapInArrow(released(split), f"key {kind}, text_hash string, leaf bigint, text string")
        .repartition(F.xxhash64("text_hash", "leaf"))
        .mapInArrow(released(leaves), f"key {kind}, text_hash string, leaf bigint, text string, tokens array<int>")
    )
    out = rows.where(~is_long).mapInArrow(released(short), schema).unionByName(parts.groupBy("key", "text_hash").applyInArrow(concatenate, schema))
    return out.toDF(key, *(_beside(key, c) for c in out.columns[1:]))


def _beside(key: str, name: str) -> str:
    """The name, with underscores appended while the key has it."""
    while name.lower() == key.lower():
        name += "_"
    return name


def decode(df: DataFrame, path: str | None = None, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(key, text) of every row with tokens. Null tokens give a null text, none an empty one; bytes that are not UTF-8 become U+FFFD. Ids outside of the vocabulary raise an error. ``text`` gets underscores appended while the key has that name."""
    path = path or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            lists = batch.column(1)
            texts = [None if not x.is_valid else bytes(c.decode(x.values.to_numpy(zero_copy_only=False))).decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{tokens}`").cast("array<int>").alias("tokens"))
    return rows.mapInArrow(released(run), f"key {kind}, text string").toDF(key, _beside(key, "text"))
