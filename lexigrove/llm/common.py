"""Shared pieces of the corpus operators: vectorised tokenising, rolling hashes, materialising.

Texts are handled as the UTF-8 buffer of a whole Arrow batch. Tokens are runs of bytes that are not
separators, and get a 64-bit polynomial hash from prefix sums, so that no Python loop runs per token
and memory stays a small multiple of ``CHUNK`` whatever the length of a text.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes tokenised at a time.
CHUNK = 1 << 20
#: Bytes of text that a step holds as arrays at a time; a single longer text is held alone.
SLICE = 6 << 20
MASK = (1 << 64) - 1
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE, WBASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser on a copy of an uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base & MASK
    while done < n:
        take = min(done, n - done)
        np.multiply(out[:take], np.uint64(step), out=out[done : done + take])
        done += take
        step = step * step & MASK
    return out[:n]


class Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n), _powers(pow(self.base, -1, 1 << 64), n)
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = Powers(BASE), Powers(WBASE)
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

#: Separators: ASCII white space as in RE2's \s.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 12, 13, 32]] = True
#: Separators: line feed.
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
#: Separators: every ASCII byte but letters and digits.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
#: ASCII upper case folded to lower case.
FOLD = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows in the bytes) of slices of at most ``size`` bytes, or of one row. A null is an empty text."""
    text = batch.column(batch.schema.get_field_index(column))
    if text.null_count:
        text = text.fill_null("")
    text = text.cast(pa.large_string())
    n = len(text)
    if not n:
        return
    _, offs, data = text.buffers()
    offsets = np.frombuffer(offs, np.int64)[text.offset : text.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1))
        yield a, b, whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _cut(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray, a: int) -> int:
    """End of the chunk at a: behind a separator or where a row starts; beyond CHUNK only within a single token."""
    b = a + CHUNK
    if b >= len(buf):
        return len(buf)
    back = np.flatnonzero(separators[buf[a:b]])
    cut = max(a + int(back[-1]) + 1 if len(back) else a, int(offsets[np.searchsorted(offsets, b, "right") - 1]))
    if cut > a:
        return cut
    row = int(offsets[np.searchsorted(offsets, b, "right")])
    while b < row:
        c = min(row, b + CHUNK)
        ahead = np.flatnonzero(separators[buf[b:c]])
        if len(ahead):
            return b + int(ahead[0]) + 1
        b = c
    return row


def tokens(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every token, and for each row the index of its first token (one more entry than rows)."""
    hashes, starts, ends = [], [], []
    n, a = len(buf), 0
    table = _VALUES if fold is None else _VALUES[fold]
    while a < n:
        b = _cut(buf, offsets, separators, a)
        part = buf[a:b]
        inside = ~separators[part]
        lo, hi = np.searchsorted(offsets, a, "left"), np.searchsorted(offsets, b, "left")
        edges = offsets[lo:hi] - a
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        before = edges[edges > 0] - 1
        last[before] = inside[before]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        up, down = _BYTES.get(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[part] * up[:-1], out=sums[1:])
        h = (sums[e + 1] - sums[s]) * down[s]
        hashes.append(mix(h + (e - s + 1).astype(np.uint64)))
        starts.append(s + a)
        ends.append(e + a + 1)
        a = b
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    h, s, e = np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)
    return h, s, e, np.searchsorted(s, offsets, "left")


class Windows:
    """Hashes of windows of tokens, from prefix sums over one slice."""

    def __init__(self, h: np.ndarray):
        self.n = len(h)
        up, self.down = _WORDS.get(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(h * up[: self.n], out=self.sums[1:])

    def of(self, k: int) -> np.ndarray:
        """Hashes of the windows that start at each token and have k tokens; 0 windows if there are fewer than k tokens."""
        m = self.n - k + 1
        return mix((self.sums[k:] - self.sums[:m]) * self.down[:m] + np.uint64(k)) if m > 0 else np.zeros(0, np.uint64)

    def at(self, start: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Hashes of the windows of k tokens from start on."""
        return mix((self.sums[start + k] - self.sums[start]) * self.down[start] + k.astype(np.uint64))


def sliding(a: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over a[i : i + w] for each i that has w elements, by doubling."""
    out, done = a, 1
    while done < w:
        step = min(done, w - done)
        out = op(out[:-step], out[step:])
        done += step
    return out


def winnow(h: np.ndarray, first: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the minima (all of equal ones) of the windows of w successive k-grams that lie in one row.

    Rows are given by the index of their first token. Any k + w - 1 successive tokens of a row hold a minimum.
    """
    n, length = len(h), k + w - 1
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < length:
        return none
    grams = Windows(h).of(k)
    least = sliding(grams, w, np.minimum)
    ends = np.repeat(first[1:], np.diff(first))
    valid = np.arange(len(least)) + length <= ends[: len(least)]
    if not valid.any():
        return none
    least = np.where(valid, least, np.uint64(0))
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    most = sliding(padded, w, np.maximum)
    at = np.flatnonzero(grams == most)
    return at, grams[at]


def portions(sizes: np.ndarray, total: int) -> Iterator[tuple[int, int]]:
    """Ranges of successive sizes that come to about the total."""
    sums, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + total, "right")))
        yield a, b
        a = b


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task, which at its end gives freed memory back to the system: a worker waits for its next task with what it has."""

    @functools.wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # there is none but in glibc
                ctypes.CDLL(None).malloc_trim(0)

    return own


def expand(lengths: np.ndarray) -> np.ndarray:
    """0 .. length - 1 for each length, one after another."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where it is unset, as in tests, a temporary one of this session."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lexigrove-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: A table is broadcast if it has no more rows and, as Parquet, no more bytes than this; else the other side is shuffled too.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 8 << 20


class Shared:
    """Tables written to the shared folder; ``drop`` deletes one when nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.count = 0

    def only(self, *paths: str) -> None:
        """Deletes all tables but these."""
        for path in (f"{self.root}/{i}" for i in range(1, self.count + 1)):
            if path not in paths:
                self.drop(path)

    def small(self, df: DataFrame) -> DataFrame:
        """The rows as a written table, to be broadcast in joins if its measured size allows that. Of the tables written before, none is needed any more."""
        out, path = self.write(df)
        self.only(path)
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        size = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
        return F.broadcast(out) if size <= BROADCAST_BYTES and out.count() <= BROADCAST_ROWS else out

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def known(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, text_hash) of the rows that have id and text, the id in its own type; other columns are not read.

    A document is an id with a text: equal rows are one, and different texts under one id are several.
    """
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return rows.withColumn("text_hash", F.xxhash64("text"))


def type_of(df: DataFrame, column: str = "doc_id") -> str:
    """The column's type as in a schema string."""
    return df.schema[column].dataType.simpleString()


def same_document(docs: DataFrame, key: str, text: str, found: DataFrame) -> Column:
    """Whether a row of docs is the document (doc_id, text_hash) that a row of found tells of."""
    return (docs[f"`{key}`"] == found["doc_id"]) & (F.xxhash64(docs[f"`{text}`"].cast("string")) == found["text_hash"])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added while the input has a column of this name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
