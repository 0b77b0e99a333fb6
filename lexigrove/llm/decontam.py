"""Benchmark decontamination by suffix arrays of the training documents.

The documents of a shard, some megabytes of them, that have a run of words in common with a test by its hash get the array of
their word suffixes. The test suffixes that begin with such a run are looked up in it by binary search, which gives all places
where at least MIN_WORDS words agree; the longest agreement is measured there. Documents without such a run cost no more than
the hashes of their words. Only the tests, whose size is checked, are sent to the shards; no document is shuffled. A benchmark
larger than TEST_BYTES is looked up in parts, one at a time, in the documents that a bitmap of all its runs leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from lexigrove.llm.common import Shared, Windows, expand, known, portions, released, text_slices, tokens, type_of

#: Words in a row that make a document a copy of a test; an item of fewer words must be there as a whole.
MIN_WORDS = 13
#: Items of fewer words than this are too short to tell.
LEAST_WORDS = 5
#: Bytes of test items that are looked up at a time.
TEST_BYTES = 32 << 20
#: Bytes of documents in a shard.
SHARD_BYTES = 4 << 20
#: Bits of the bitmap that all tests' runs are entered in.
FILTER_BITS = 27
#: Pairs of a test suffix and a place that are looked at together.
PAIRS = 1 << 20
BITS, AT_ONCE = np.uint64(21), 3
_START, _OTHER = np.uint64(0), np.uint64(1)


def _keys(h: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Codes of the AT_ONCE words from each position on, packed so that their order is that of the words' codes; ``left`` words of the text are left there."""
    code = (h >> np.uint64(43)) | np.uint64(1)
    out = code << (BITS * np.uint64(2))
    for i in range(1, AT_ONCE):
        shifted = np.zeros(len(h), np.uint64)
        shifted[:-i] = code[i:]
        shifted[left <= i] = 0
        out |= shifted << (BITS * np.uint64(AT_ONCE - 1 - i))
    return out


def _runs(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs of k words that lie in one row."""
    grams = Windows(h).of(k)
    ends = np.repeat(first[1:], np.diff(first))[: len(grams)]
    at = np.flatnonzero(np.arange(len(grams)) + k <= ends)
    return at, grams[at]


class SuffixArray:
    """The suffixes of the rows of one shard in the order of their words' codes, up to ``depth`` words: as many as a lookup can ask for."""

    def __init__(self, h: np.ndarray, first: np.ndarray, depth: int):
        self.h, self.n = h, len(h)
        self.end = np.repeat(first[1:], np.diff(first))
        self.start = np.repeat(first[:-1], np.diff(first))
        self.keys = _keys(h, self.end - np.arange(self.n))
        self.order = np.argsort(self.keys, kind="stable")
        known_words = AT_ONCE
        ordered = self.keys[self.order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if self.n else np.zeros(0, bool)
        rank = np.empty(self.n, np.int64)
        rank[self.order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        while known_words < depth:
            alone = new & np.concatenate([new[1:], [True]]) if self.n else new
            tied = np.flatnonzero(~alone)
            if not len(tied):
                break
            at = self.order[tied]
            ahead = at + known_words
            inside = ahead < self.end[at]
            then = np.where(inside, rank[np.minimum(ahead, self.n - 1)] + 1, 0)
            group = rank[at]
            o = np.lexsort((then, group))
            self.order[tied] = at[o]
            g, t = group[o], then[o]
            fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (t[1:] != t[:-1])])
            new[tied] = fresh
            rank[self.order[tied]] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
            known_words *= 2

    def bounds(self, wanted: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end index of the suffixes that begin with the wanted keys under the masks, one row of successive keys per query."""
        out = []
        for upper in (False, True):
            lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), self.n, np.int64)
            active = np.flatnonzero(lo < hi)
            while len(active):
                mid = (lo[active] + hi[active]) >> 1
                at, below, equal = self.order[mid], np.zeros(len(active), bool), np.ones(len(active), bool)
                for i in range(wanted.shape[1]):
                    pos = at + AT_ONCE * i
                    have = np.where(pos < self.end[at], self.keys[np.minimum(pos, self.n - 1)], np.uint64(0)) & masks[active, i]
                    below |= equal & (have < wanted[active, i])
                    equal &= have == wanted[active, i]
                right = below | equal if upper else below
                lo[active] = np.where(right, mid + 1, lo[active])
                hi[active] = np.where(right, hi[active], mid)
                active = active[lo[active] < hi[active]]
            out.append(lo)
        return out[0], out[1]


class Tests:
    """The words of the test items and what each of their suffixes needs to agree in. ids: a number per text; texts of one number are one item."""

    def __init__(self, ids: np.ndarray, texts: list[str], min_words: int = MIN_WORDS):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
        parts = list(text_slices(batch, "text", 1 << 62))
        self.h, _, _, first = tokens(parts[0][2], parts[0][3]) if parts else (np.zeros(0, np.uint64), None, None, np.zeros(1, np.int64))
        sizes = np.diff(first)
        self.item = np.repeat(ids, sizes)
        self.start, self.end = np.repeat(first[:-1], sizes), np.repeat(first[1:], sizes)
        size, left = self.end - self.start, self.end - np.arange(len(self.h))
        need = np.minimum(min_words, size)
        self.suffix = np.flatnonzero((left >= need) & (size >= min(LEAST_WORDS, min_words)))
        self.need = need[self.suffix]
        self.windows = Windows(self.h)
        self.before = np.where(self.suffix == self.start[self.suffix], _OTHER, self.h[self.suffix - 1]) if len(self.suffix) else np.zeros(0, np.uint64)
        width = -(-min_words // AT_ONCE)
        keys = _keys(self.h, left)
        self.keys, self.masks = np.zeros((len(self.suffix), width), np.uint64), np.zeros((len(self.suffix), width), np.uint64)
        for i in range(width):
            words = np.clip(self.need - AT_ONCE * i, 0, AT_ONCE)
            self.masks[:, i] = np.array([0, *((1 << 63) - (1 << 21 * (AT_ONCE - n)) for n in range(1, AT_ONCE + 1))], np.uint64)[words]
            at = np.minimum(self.suffix + AT_ONCE * i, len(self.h) - 1)
            self.keys[:, i] = keys[at] & self.masks[:, i]
        #: By length: the hashes of what suffixes need, in order, the suffixes, and a bitmap of the hashes' high bits.
        self.grams = {}
        for k in np.unique(self.need):
            which = np.flatnonzero(self.need == k)
            grams = self.windows.of(int(k))[self.suffix[which]]
            order = np.argsort(grams, kind="stable")
            bits = max(10, min(24, int(len(grams) * 16).bit_length()))
            maybe = np.zeros(1 << bits, bool)
            maybe[grams >> np.uint64(64 - bits)] = True
            self.grams[int(k)] = grams[order], which[order], maybe, np.uint64(64 - bits)

    def _met(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have a run that some test suffix needs, and those test suffixes, by hashes."""
        rows, suffixes = [], []
        for k, (grams, which, maybe, shift) in self.grams.items():
            at, own = _runs(h, first, k)
            some = np.flatnonzero(maybe[own >> shift])
            at, own = at[some], own[some]
            place = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            hit = grams[place] == own
            rows.append(np.searchsorted(first, at[hit], "right") - 1)
            found = np.unique(own[hit])
            a, b = np.searchsorted(grams, found, "left"), np.searchsorted(grams, found, "right")
            suffixes.append(which[np.repeat(a, b - a) + expand(b - a)])
        return np.unique(np.concatenate(rows)), np.sort(np.concatenate(suffixes))

    def find(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, item, words, word of the row, word of the item) of the longest match of each row and item, the first of equal ones."""
        none = tuple(np.zeros(0, np.int64) for _ in range(5))
        if not len(self.suffix):
            return none
        h, _, _, first = tokens(buf, offsets)
        if not len(h):
            return none
        rows, which = self._met(h, first)
        if not len(rows):
            return none
        sizes = np.diff(first)[rows]
        h = h[np.repeat(first[rows], sizes) + expand(sizes)]
        first = np.concatenate([[0], np.cumsum(sizes)])
        array, windows = SuffixArray(h, first, int(self.need.max())), Windows(h)
        lo, hi = array.bounds(self.keys[which], self.masks[which])
        best: list[tuple[np.ndarray, ...]] = []
        for t, at in self._pairs(array, which, lo, hi):
            length = self._agree(windows, array, self.suffix[t], at)
            real = length >= self.need[t]
            t, at, length = self.suffix[t[real]], at[real], length[real]
            row = np.searchsorted(first, at, "right") - 1
            best = [_longest(*(np.concatenate(x) for x in zip(*best, (row, self.item[t], length, at - first[row], t - self.start[t]))))]
        if not best:
            return none
        row, *rest = best[0]
        return rows[row], *rest

    def _pairs(self, array: SuffixArray, which: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(test suffix's number, place) of what the bounds hold, without pairs that match one word earlier too, as these are part of that match.

        In the array's order the words before the suffixes make runs of equal ones. Whole runs of the word before the test
        suffix are left out, so the work is in proportion to the pairs that come out, however often a text repeats itself.
        """
        before = np.where(array.order == array.start[array.order], _START, array.h[array.order - 1])
        new = np.concatenate([[True], before[1:] != before[:-1]])
        run, begins = np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(before))
        some = np.flatnonzero(lo < hi)
        which, lo, hi = which[some], lo[some], hi[some]
        count = -(-(hi - lo) // PAIRS)  # long ranges in pieces
        piece, which = expand(count), np.repeat(which, count)
        lo, hi = np.repeat(lo, count) + piece * PAIRS, np.minimum(np.repeat(hi, count), np.repeat(lo, count) + (piece + 1) * PAIRS)
        for a, b in portions(run[hi - 1] - run[lo] + 1, PAIRS):
            many = run[hi[a:b] - 1] - run[lo[a:b]] + 1
            own = np.repeat(np.arange(a, b), many)
            runs = np.repeat(run[lo[a:b]], many) + expand(many)
            differ = before[begins[runs]] != self.before[which[own]]
            own, runs = own[differ], runs[differ]
            start, end = np.maximum(begins[runs], lo[own]), np.minimum(begins[runs + 1], hi[own])
            for c, d in portions(end - start, PAIRS):
                many = (end - start)[c:d]
                yield which[np.repeat(own[c:d], many)], array.order[np.repeat(start[c:d], many) + expand(many)]

    def _agree(self, windows: Windows, array: SuffixArray, t: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Words in which the test from t on agrees with the text from at on, by halving over hashes of runs."""
        low, high = np.zeros(len(t), np.int64), np.minimum(self.end[t] - t, array.end[at] - at)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) >> 1
            equal = self.windows.at(t[open_], mid) == windows.at(at[open_], mid)
            low[open_[equal]] = mid[equal]
            high[open_[~equal]] = mid[~equal] - 1


def _longest(row: np.ndarray, item: np.ndarray, length: np.ndarray, dpos: np.ndarray, ipos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per row and item the longest, of these the first in the row and then in the item."""
    o = np.lexsort((ipos, dpos, -length, item, row))
    row, item = row[o], item[o]
    best = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])]) if len(o) else np.zeros(0, bool)
    return row[best], item[best], length[o][best], dpos[o][best], ipos[o][best]


def _items(benchmark: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """The tests, and in how many parts they are looked up."""
    items = known(benchmark, key, text).distinct()
    return items, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // TEST_BYTES)


def _tests(items: DataFrame, part: int, parts: int, min_words: int) -> tuple[Broadcast, pa.Array]:
    """The broadcast tests of a part, TEST_BYTES of them or so, and their distinct ids."""
    rows = items.where(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(parts)) == part).orderBy("doc_id", "text_hash").select("doc_id", "text").toArrow()
    ids = rows["doc_id"].combine_chunks().dictionary_encode()
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    return items.sparkSession.sparkContext.broadcast((ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows["text"].to_pylist(), min_words)), ids.dictionary


def _searched(rows: DataFrame, tests: Broadcast, ids: pa.Array, schema: str) -> DataFrame:
    """(doc_id, text_hash, item_id, n_words, doc_word, item_word) of the rows (doc_id, text, text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = Tests(*tests.value)
        for batch in batches:
            for a, _, buf, offsets in text_slices(batch, "text", SHARD_BYTES):
                row, item, *rest = built.find(buf, offsets)
                named = [batch.column(i).take(pa.array(a + row)) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*named, ids.take(pa.array(item)), *(pa.array(x.astype(np.int32)) for x in rest)], ["doc_id", "text_hash", "item_id", "n_words", "doc_word", "item_word"])

    return rows.mapInArrow(released(run), schema)


def _candidates(rows: DataFrame, items: DataFrame, min_words: int) -> DataFrame:
    """The rows that have a run of words whose hash is marked in a bitmap of all tests' runs; its size doesn't depend on theirs."""
    least = min(LEAST_WORDS, min_words)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in text_slices(batch):
                h, _, _, first = tokens(buf, offsets)
                size = np.diff(first)
                for k in range(least, min_words + 1):
                    own = (size == k) if k < min_words else (size >= k)
                    at, grams = _runs(h, first, k)
                    grams = grams[own[np.searchsorted(first, at, "right") - 1]]
                    if len(grams):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), k, np.int32)), pa.array((grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64) + 1)], ["k", "slot"])

    found = items.mapInArrow(released(runs), "k int, slot bigint")
    marked = found.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    lengths = sorted(r["k"] for r in found.select("k").distinct().collect())
    table = np.zeros(1 << FILTER_BITS, bool)
    for r in marked:
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        table[(r["bucket"] - 1) * len(bits) : r["bucket"] * len(bits)] = bits
    shared = items.sparkSession.sparkContext.broadcast((np.packbits(table), lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, lengths = shared.value
        marked = np.unpackbits(packed).view(bool)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for a, _, buf, offsets in text_slices(batch):
                h, _, _, first = tokens(buf, offsets)
                for k in lengths:
                    at, grams = _runs(h, first, k)
                    hit = at[marked[grams >> np.uint64(64 - FILTER_BITS)]]
                    keep[a + np.searchsorted(first, hit, "right") - 1] = True
            yield batch.filter(pa.array(keep))

    return rows.mapInArrow(released(run), rows.schema)


def _found(rows: DataFrame, benchmark: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(doc_id, text_hash, item_id, n_words, doc_word, item_word) per row and item; equal rows repeat."""
    items, parts = _items(benchmark, key, text)
    schema = f"doc_id {type_of(rows)}, text_hash bigint, item_id {type_of(items)}, n_words int, doc_word int, item_word int"
    if not parts:
        return rows.sparkSession.createDataFrame([], schema)
    if parts == 1:
        return _searched(rows, *_tests(items, 0, 1, min_words), schema)
    shared, out = Shared(rows.sparkSession), None
    left, path = shared.write(_candidates(rows, items, min_words))
    for part in range(parts):
        tests, ids = _tests(items, part, parts, min_words)
        if len(ids):
            found, _ = shared.write(_searched(left, tests, ids, schema))
            out = found if out is None else out.unionByName(found)
        tests.destroy()
    shared.drop(path)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words, doc_word, item_word): per document and test item the longest verbatim match and where it begins in both.

    Words are runs of bytes between white space, compared byte by byte; of equally long matches the first in the document,
    then in the item, is given. A match has min_words words, or the whole item if that has fewer but at least LEAST_WORDS.
    Rows without id or text, empty texts and empty tables give nothing; equal rows give one result, and different texts under
    one id one each; texts under one item id are one item. Ids keep their types; only the columns named are read.
    """
    found = _found(known(docs, key, text), benchmark, item_key, text, min_words)
    best = F.max_by(F.struct("n_words", "doc_word", "item_word"), F.struct("n_words", -F.col("doc_word"), -F.col("item_word")))
    return found.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", min_words: int = MIN_WORDS) -> DataFrame:
    """docs without those that have a match, as ``matches`` defines it. All columns and repeated rows stay; a null text has no match.

    Tests of up to TEST_BYTES take one pass without a shuffle. With more, the texts that have a match are found first and
    taken out by two 64-bit hashes.
    """
    items, parts = _items(benchmark, item_key, "text")
    if not parts:
        return docs
    if parts > 1:
        own = docs[f"`{text}`"].cast("string")
        hashes = [F.xxhash64(own, *more) for more in ([], [F.lit(7)])]
        rows = docs.where(own.isNotNull()).select(hashes[0].alias("doc_id"), own.alias("text"), hashes[1].alias("text_hash"))
        gone = Shared(docs.sparkSession).small(_found(rows, benchmark, item_key, "text", min_words).select("doc_id", "text_hash").distinct())
        return docs.join(gone, (hashes[0] == gone["doc_id"]) & (hashes[1] == gone["text_hash"]) & own.isNotNull(), "left_anti")
    at, (tests, _) = docs.columns.index(text), _tests(items, 0, 1, min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = Tests(*tests.value)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            only = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            for a, _, buf, offsets in text_slices(only, "text", SHARD_BYTES):
                keep[a + built.find(buf, offsets)[0]] = False
            yield batch if keep.all() else batch.filter(pa.array(keep))

    return docs.mapInArrow(released(run), docs.schema)
