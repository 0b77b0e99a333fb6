"""Repeated passages of words, found from sampled suffixes.

A word is a run of bytes between ASCII white space, compared byte by byte. Of a document's suffixes those are indexed that
start at a minimum of WINDOW successive PREFIX-word hashes: any MIN_WORDS words in a row hold one, at the same place in each
copy, so no repeat of MIN_WORDS words is missed. Suffixes whose first PREFIX words occur once in the corpus are dropped;
the others get their surroundings, as many words as a passage of MIN_WORDS around them can reach, and passages longer than
that are put together from those that overlap.

Suffixes are split into groups by a prefix, as long as it takes for a group to fit in memory. A passage around a sampled
suffix begins 0 to MIN_WORDS - PREFIX words before it. Where PREFIX words have too many suffixes, those with equal surroundings
become one context with their number and the first of them. Where the contexts are too many too, passages that begin 0 to 15
words before are looked for apart from those that begin 16 to 30 words before: of the surroundings only the words that these
can reach count, so that more contexts are equal, and they are grouped by the 35 words that all such passages share. Where that
is too large still, both are halved again, with prefixes of 43, 47, 49 and at last 50 words, which are a single context.
What is found of a context holds for all of its suffixes, but that only the first can be the first copy of a passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lexigrove.llm.common import Shared, Windows, known, mix, released, text_slices, tokens, type_of, winnow

MIN_WORDS = 50
PREFIX = 20
#: Suffixes of one prefix beyond this number are counted by their surroundings, which beyond this number are split by longer prefixes.
GROUP_ROWS = 100_000
#: Rows that a subtree is built over at a time, at least.
BATCH_ROWS = 60_000
_C = np.uint64(0xD6E8FEB86659FD93)


def prefix_words(min_words: int) -> int:
    """Words that suffixes are grouped by, PREFIX of MIN_WORDS words; passages need two words at least."""
    if min_words < 2:
        raise ValueError("a passage needs two words at least")
    return max(1, min(PREFIX, min_words * PREFIX // MIN_WORDS))


def anchors(docs: DataFrame, min_words: int = MIN_WORDS, prefix: int = PREFIX) -> DataFrame:
    """(prefix, doc_id, text_hash, pos): the hash of the first words, the document and the first word of each sampled suffix. docs: those of ``common.known``."""
    w = min_words - prefix + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in text_slices(batch):
                h, _, _, first = tokens(buf, offsets)
                at, fp = winnow(h, first, prefix, w)
                row = np.searchsorted(first, at, "right") - 1
                named = [batch.column(i).take(pa.array(a + row)) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), *named, pa.array((at - first[row]).astype(np.int32))], ["prefix", "doc_id", "text_hash", "pos"])

    return docs.mapInArrow(released(run), f"prefix bigint, doc_id {type_of(docs)}, text_hash bigint, pos int")


def surroundings(marked: DataFrame, docs: DataFrame, min_words: int = MIN_WORDS, prefix: int = PREFIX) -> DataFrame:
    """(prefix, doc_id, text_hash, pos, before, after) of the marked (doc_id, text_hash, pos): hashes of the words before, the nearest first, and of those after the prefix."""
    side = min_words - prefix
    lists = marked.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(3)
            for a, b, buf, offsets in text_slices(batch):
                h, _, _, first = tokens(buf, offsets)
                if len(h) < prefix:
                    continue
                own = at.slice(a, b - a)
                row = np.repeat(np.arange(b - a), own.value_lengths().to_numpy(zero_copy_only=False))
                pos = own.flatten().to_numpy().astype(np.int64)
                grams = Windows(h).of(prefix)
                short = np.maximum((h >> np.uint64(32)).astype(">u4"), 1).astype(">u4")
                for i in range(0, len(row), 50_000):
                    r, p = row[i : i + 50_000], pos[i : i + 50_000]
                    where = first[r] + p
                    back = where[:, None] - 1 - np.arange(side)
                    ahead = where[:, None] + prefix + np.arange(side)
                    before = np.where(back >= first[r][:, None], short[np.maximum(back, 0)], 0).astype(">u4")
                    after = np.where(ahead < first[r + 1][:, None], short[np.minimum(ahead, len(h) - 1)], 0).astype(">u4")
                    named = [batch.column(k).take(pa.array(a + r)) for k in (0, 2)]
                    yield pa.RecordBatch.from_arrays([pa.array(grams[where].view(np.int64)), *named, pa.array(p.astype(np.int32)), _fixed(before), _fixed(after)], ["prefix", "doc_id", "text_hash", "pos", "before", "after"])

    found = docs.join(lists, ["doc_id", "text_hash"]).select("doc_id", "text", "text_hash", "at")
    return found.mapInArrow(released(run), f"prefix bigint, doc_id {type_of(docs)}, text_hash bigint, pos int, before binary, after binary")


def _fixed(a: np.ndarray) -> pa.Array:
    n, width = a.shape[0], a.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(a))])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    start = np.frombuffer(offsets, np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(data, np.uint8, count=len(column) * width, offset=int(start)).view(">u4").reshape(len(column), width // 4)


def _ranks(t: pa.Table) -> np.ndarray:
    """The documents' places in the order of (doc_id, text_hash), equal ones for equal documents."""
    ids, hashes = t["doc_id"], t["text_hash"].to_numpy()
    ids = ids.to_numpy() if pa.types.is_integer(ids.type) else np.unique(np.array([*ids.to_pylist(), None], object)[:-1], return_inverse=True)[1]
    order = np.lexsort((hashes, ids))
    new = np.concatenate([[False], (ids[order][1:] != ids[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])])[: len(order)]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def subtree(prefix: np.ndarray, doc: np.ndarray, pos: np.ndarray, before: np.ndarray, after: np.ndarray, min_words: int = MIN_WORDS, head: int = PREFIX, least: int = 0, most: int | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(row, start, end, later start, later end, copies) of each suffix that lies in a repeat.

    The suffixes are sorted; the longest common prefixes of neighbours are the depths of the suffix tree's internal nodes.
    The leaves below a node of depth d whose d words are preceded by the same min_words - d words are copies of one passage;
    only passages that begin ``least`` to ``most`` words before the suffix are looked at. The passage of all but the first
    copy, in the order of (doc, pos), is later. A suffix of a ``weight`` stands for as many, of which it is the first.
    """
    side = min_words - head
    most = side if most is None else most
    rank = np.lexsort((pos, doc, prefix))
    same = np.concatenate([[False], (prefix[rank][1:] == prefix[rank][:-1]) & (doc[rank][1:] == doc[rank][:-1]) & (pos[rank][1:] == pos[rank][:-1])])
    keep = rank[~same]
    prefix, pos, before, after = prefix[keep], pos[keep], before[keep], after[keep]
    n = len(keep)
    wide = np.empty((n, 2 + side), ">u4")
    wide[:, :2] = prefix.view(np.uint64).astype(">u8").view(">u4").reshape(n, 2)
    wide[:, 2:] = after
    order = np.argsort(wide.view(f"S{4 * (2 + side)}").ravel(), kind="stable")
    sorted_prefix, words = prefix[order], np.ascontiguousarray(after[order].astype(np.uint32))
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = (words[1:] != words[:-1]) | (words[1:] == 0)
        lcp[1:] = np.where(sorted_prefix[1:] == sorted_prefix[:-1], head + np.where(differ.any(1), differ.argmax(1), side), 0)
    weight = None if weight is None else weight[keep][order]
    left = before[order].astype(np.uint64)
    n_before, n_after = (left != 0).sum(1), (words != 0).sum(1)
    start, end = np.full(n, 1 << 30), np.zeros(n, np.int64)
    later_start, later_end, copies = start.copy(), end.copy(), end.copy()
    at = pos[order].astype(np.int64)
    h = np.zeros(n, np.uint64)
    for o in range(most + 1):
        d = min_words - o
        if o:
            h = mix(h * _C + left[:, o - 1])
        if o < least:
            continue
        node = np.cumsum(lcp < d)
        leaves = np.flatnonzero((np.bincount(node, weight)[node] > 1) & (n_before >= o) & (n_after >= d - head))
        if not len(leaves):
            continue
        leaves = leaves[np.lexsort((order[leaves], h[leaves], node[leaves]))]
        new = np.concatenate([[True], (node[leaves][1:] != node[leaves][:-1]) | (h[leaves][1:] != h[leaves][:-1])])
        group = np.cumsum(new) - 1
        size = np.bincount(group, None if weight is None else weight[leaves])[group]
        hit = leaves[size > 1]
        start[hit], end[hit] = np.minimum(start[hit], at[hit] - o), np.maximum(end[hit], at[hit] + d)
        copies[hit] = np.maximum(copies[hit], size[size > 1])
        hit = leaves[(size > 1) & ~new]
        later_start[hit], later_end[hit] = np.minimum(later_start[hit], at[hit] - o), np.maximum(later_end[hit], at[hit] + d)
    hit = np.flatnonzero(end)
    none = later_end[hit] == 0
    return keep[order][hit], start[hit], end[hit], np.where(none, end[hit], later_start[hit]), np.where(none, end[hit], later_end[hit]), copies[hit]


NUMBERS = ("start_word", "end_word", "later_start", "later_end", "copies")


def _span_schema(docs: DataFrame) -> str:
    return f"doc_id {type_of(docs)}, text_hash bigint, " + ", ".join(f"{c} int" for c in NUMBERS)


def _trees(t: pa.Table, side: int, min_words: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """The spans of the suffixes of a table, grouped by the prefix, as batches."""
    row, *numbers = subtree(t["prefix"].to_numpy(), _ranks(t), t["pos"].to_numpy(), _matrix(t["before"], 4 * side), _matrix(t["after"], 4 * side), min_words, prefix)
    own = t.select(["doc_id", "text_hash"]).take(pa.array(row))
    for name, x in zip(NUMBERS, numbers):
        own = own.append_column(name, pa.array(x.astype(np.int32)))
    yield from own.to_batches()


def grouped(batches: Iterator[pa.RecordBatch], key: int, rows: int, more: int | None = None) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows (but the last) that no run of equal values in the sorted key column, or key columns, crosses."""

    def equal_to_last(batch: pa.RecordBatch) -> np.ndarray:
        out = np.ones(batch.num_rows, bool)
        for k in (key, more) if more is not None else (key,):
            column = batch.column(k)
            out &= pc.equal(column, column[-1]).to_numpy(zero_copy_only=False)
        return out

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            others = np.flatnonzero(~equal_to_last(batch))
            cut = int(others[-1]) + 1 if len(others) else 0
            if cut == 0:
                continue
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


#: What is known of a context: its number of suffixes, the first one, and the surroundings that count.
CONTEXT = ("n", "doc_id", "text_hash", "pos", "prefix", "before", "after")
FIRST = ("doc_id", "text_hash", "pos")


def _contexts(rows: DataFrame, *by: str) -> DataFrame:
    """One row per context of rows with ``by`` and CONTEXT."""
    found = rows.groupBy(*by).agg(F.sum("n").alias("n"), F.min(F.struct(*CONTEXT[1:])).alias("c"))
    return found.select(*by, "n", "c.*")


def halved(contexts: DataFrame, min_words: int, prefix: int) -> DataFrame:
    """The contexts of least to most twice, for either half of these numbers: (parent, code, key, least, most) and CONTEXT.

    ``key`` is the hash of the words that all passages share which begin least to most words before the suffix, ``code`` that of
    all words that one of them has; words out of their reach become 0. Contexts without the words to share are left out.
    """
    side = min_words - prefix
    schema = f"parent bigint, code bigint, key bigint, least int, most int, n bigint, doc_id {type_of(contexts)}, text_hash bigint, pos int, prefix bigint, before binary, after binary"

    def half(batch: pa.RecordBatch, least: int, most: int) -> pa.RecordBatch:
        before, after = (_matrix(batch.column(c), 4 * side).copy() for c in ("before", "after"))
        before[:, most:], after[:, side - least :] = 0, 0
        fits = (before[:, :least] != 0).all(1) & (after[:, : side - most] != 0).all(1)
        key = mix(batch.column("prefix").to_numpy().view(np.uint64) + np.uint64(1 + least * (side + 1) + most))
        for x in (before[:, :least], after[:, : side - most]):
            for i in range(x.shape[1]):
                key = mix(key * _C + x[:, i].astype(np.uint64))
        code = key
        for x in (before[:, least:most], after[:, side - most : side - least]):
            for i in range(x.shape[1]):
                code = mix(code * _C + x[:, i].astype(np.uint64))
        bounds = [pa.array(np.full(batch.num_rows, x, np.int32)) for x in (least, most)]
        kept = [batch.column(c) for c in CONTEXT[:-2]]
        columns = [batch.column("code"), pa.array(code.view(np.int64)), pa.array(key.view(np.int64)), *bounds, *kept, _fixed(before), _fixed(after)]
        return pa.RecordBatch.from_arrays(columns, ["parent", "code", "key", "least", "most", *CONTEXT]).filter(pa.array(fits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, most = (batch.column(c).to_numpy() for c in ("least", "most"))
            for a, b in np.unique(np.stack([least, most], 1), axis=0).tolist():
                own = batch.filter(pa.array((least == a) & (most == b)))
                yield half(own, a, (a + b) // 2)
                yield half(own, (a + b) // 2 + 1, b)

    return contexts.mapInArrow(released(run), schema)


def _passed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """What is found of contexts, for the rows that they stand for by ``code``; all but the first are later copies."""
    own = rows.join(found.select("code", *(F.col(c).alias(f"first_{c}") for c in FIRST), *NUMBERS), "code")
    first = F.struct(*FIRST) == F.struct(*(F.col(f"first_{c}").alias(c) for c in FIRST))
    for c, other in (("later_start", "start_word"), ("later_end", "end_word")):
        own = own.withColumn(c, F.when(first, F.col(c)).otherwise(F.col(other)))
    return own


def hot_spans(rows: DataFrame, shared: Shared, min_words: int, prefix: int, group_rows: int) -> DataFrame:
    """The spans of the suffixes in groups too large for memory, the rows of ``surroundings``, each once."""
    side = min_words - prefix
    schema = f"code bigint, doc_id {type_of(rows)}, text_hash bigint, pos int, " + ", ".join(f"{c} int" for c in NUMBERS)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 0, BATCH_ROWS):
            least, most = (t[c].to_numpy() for c in ("least", "most"))
            for a, b in np.unique(np.stack([least, most], 1), axis=0).tolist():
                own = t.filter(pa.array((least == a) & (most == b))).combine_chunks()
                before, after = (_matrix(own[c], 4 * side) for c in ("before", "after"))
                row, *numbers = subtree(own["key"].to_numpy(), _ranks(own), own["pos"].to_numpy(), before, after, min_words, prefix, a, b, own["n"].to_numpy())
                none = numbers[2] == numbers[3]
                out = own.select(["code", *FIRST]).take(pa.array(row))
                at = out["pos"].to_numpy()
                for name, x in zip(NUMBERS[:-1], numbers):
                    out = out.append_column(name, pa.array((x - at).astype(np.int32), mask=none if name.startswith("later") else None))
                yield from out.append_column("copies", pa.array(numbers[-1].astype(np.int32))).to_batches()

    rows, _ = shared.write(rows.withColumn("code", F.xxhash64("prefix", "before", "after")))
    level = _contexts(rows.withColumn("n", F.lit(1).cast("bigint")), "code").selectExpr("*", "prefix as key", "0 as least", f"{side} as most")
    levels: list[tuple[DataFrame, DataFrame | None]] = []
    while True:
        level, path = shared.write(level)
        groups = level.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("total")).where("total > 1")
        own, _ = shared.write(level.join(groups.drop("total"), "key"))
        shared.drop(path)
        fits = (F.col("rows") <= group_rows) | (F.col("least") == F.col("most"))
        found = own.where(fits).select("key", "code", "least", "most", *CONTEXT).repartition("key").sortWithinPartitions("key").mapInArrow(released(trees), schema)
        large = own.where(~fits)
        if large.isEmpty():
            levels.append((found, None))
            break
        links, _ = shared.write(halved(large, min_words, prefix))
        levels.append((found, links))
        level = _contexts(links, "code", "key", "least", "most")
    found, _ = levels.pop()
    while levels:
        own, links = levels.pop()
        # NULL is no later copy, which least and greatest leave out
        each = [f(c).alias(c) for f, c in zip((F.min, F.max, F.min, F.max, F.max), NUMBERS)]
        above = _passed(links, found).drop("code").withColumnRenamed("parent", "code")
        found = own.unionByName(above.groupBy("code", *FIRST).agg(*each))
    own, end = _passed(rows.select("code", *FIRST), found), F.col("pos") + F.col("end_word")
    start, later_start, later_end = (F.col("pos") + F.col(c) for c in ("start_word", "later_start", "later_end"))
    numbers = (start, end, F.coalesce(later_start, end), F.coalesce(later_end, end), F.col("copies"))
    return own.select("doc_id", "text_hash", *(x.alias(c) for x, c in zip(numbers, NUMBERS)))


def repeats(marked: DataFrame, docs: DataFrame, min_words: int = MIN_WORDS, prefix: int = PREFIX, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Merged repeats of the documents, from their marked suffixes (doc_id, text_hash, pos, n), n being the number of suffixes with this prefix."""
    side, schema = min_words - prefix, _span_schema(docs)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 0, BATCH_ROWS):
            yield from _trees(t.combine_chunks(), side, min_words, prefix)

    cold, hot = marked.where(F.col("n") <= group_rows), marked.where(F.col("n") > group_rows)
    found = surroundings(cold, docs, min_words, prefix).repartition("prefix").sortWithinPartitions("prefix").mapInArrow(released(trees), schema)
    if not hot.isEmpty():
        rows = surroundings(hot, docs, min_words, prefix).distinct()
        found = found.unionByName(hot_spans(rows, Shared(docs.sparkSession), min_words, prefix, group_rows))
    return merged(found)


def merged(found: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, later_words, copies): spans that overlap or touch as one, how many of its words lie in later copies, and the most copies of a passage in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 0, BATCH_ROWS, 1):
            s, e, ls, le, copies = (t[c].to_numpy().astype(np.int64) for c in NUMBERS)
            which = _ranks(t) << 34
            s, e, ls, le = s + which, e + which, ls + which, le + which
            o = np.argsort(s, kind="stable")
            reach = np.maximum.accumulate(e[o])
            new = np.concatenate([[True], s[o][1:] > reach[:-1]])
            at = np.flatnonzero(new)
            start, end = s[o][at], np.maximum.reduceat(e[o], at)
            most = np.maximum.reduceat(copies[o], at)
            p = np.argsort(ls, kind="stable")
            seen = np.concatenate([[0], np.maximum.accumulate(le[p])[:-1]])
            extra = np.maximum(0, le[p] - np.maximum(ls[p], seen))
            later = np.bincount(np.searchsorted(start, ls[p], "right") - 1, weights=extra, minlength=len(at))
            ids = t["doc_id"].combine_chunks().take(pa.array(o[at]))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int32)) for x in (start & ((1 << 34) - 1), end & ((1 << 34) - 1), end - start, later, most))], ["doc_id", "start_word", "end_word", "n_words", "later_words", "copies"])

    out = f"doc_id {type_of(found)}, start_word int, end_word int, n_words int, later_words int, copies int"
    return found.repartition("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash").mapInArrow(released(run), out)


def marks(suffixes: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pos, n) of the suffixes whose prefix has more than one, n being their number.

    Counted with partial sums and joined back, so that a prefix of very many suffixes is no task of its own: a skewed join is
    split at run time. The suffixes are read twice and should be a written table.
    """
    counts = suffixes.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1")
    return suffixes.join(counts, "prefix").select("doc_id", "text_hash", "pos", "n")
