"""Line dedup by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lexigrove.llm.common import NEWLINE, Shared, Windows, fresh, known, released, same_document, text_slices, tokens, type_of, winnow

#: Lines that a fingerprint covers, and successive fingerprints of which one is selected: every run of MIN_LINES is found.
GRAM, WINDOW = 2, 2
MIN_LINES = GRAM + WINDOW - 1
LINE = r"[^\n]+\n*"


def fingerprints(rows: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(fingerprint, doc_id, text_hash, runs): of each selected fingerprint, the runs of gram + window - 1 lines around it as (run hash, first line), extended backwards by 0 to window - 1 lines. rows: those of ``common.known``."""
    length = gram + window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in text_slices(batch):
                h, _, _, first = tokens(buf, offsets, NEWLINE)
                at, fp = winnow(h, first, gram, window)
                row = np.searchsorted(first, at, "right") - 1
                whole = Windows(h).of(length)
                start = at[:, None] - np.arange(window)
                fits = (start >= first[row][:, None]) & (start + length <= first[row + 1][:, None])
                start_in = start[fits]
                runs = pa.StructArray.from_arrays([pa.array(whole[start_in].view(np.int64)), pa.array((start_in - np.repeat(first[row], fits.sum(1))).astype(np.int32))], ["run", "line"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(fits.sum(1))]).astype(np.int32)), runs)
                named = [batch.column(i).take(pa.array(a + row)) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), *named, lists], ["fingerprint", "doc_id", "text_hash", "runs"])

    return rows.mapInArrow(released(run), f"fingerprint bigint, doc_id {type_of(rows)}, text_hash bigint, runs array<struct<run: bigint, line: int>>")


def later_runs(rows: DataFrame, shared: Shared, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, ranges): per document the ranges (start, end) of its lines that lie in a run of lines which occurs earlier in the order of (doc_id, text_hash, line).

    The first place of a run is a partial minimum that is joined back, so that a run which very many documents share is no
    task of its own: a skewed join is split at run time.
    """
    length = gram + window - 1
    prints, _ = shared.write(fingerprints(rows, gram, window))
    several = prints.groupBy("fingerprint").count().where("count > 1").select("fingerprint")
    runs = prints.join(several, "fingerprint", "left_semi").select("doc_id", "text_hash", F.inline("runs"))
    place = F.struct("doc_id", "text_hash", "line")
    first = runs.groupBy("run").agg(F.min(place).alias("first"))
    later = runs.join(first, "run").where(place != F.col("first")).select("doc_id", "text_hash", "line")
    per_doc = Window.partitionBy("doc_id", "text_hash").orderBy("line")
    starts = (F.col("line") > F.coalesce(F.lag("line").over(per_doc) + length, F.lit(-1))).cast("int")
    islands = later.withColumn("starts", starts).withColumn("island", F.sum("starts").over(per_doc))
    ranges = islands.groupBy("doc_id", "text_hash", "island").agg(F.min("line").alias("start"), (F.max("line") + length).alias("end"))
    return ranges.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW, drop_emptied: bool = True) -> DataFrame:
    """docs without the lines of later repeated runs, and with ``deleted_lines``.

    A line is what stands between line feeds; empty lines don't count and stay with the line before them. A run of
    gram + window - 1 lines or more that occurs earlier, in an earlier document or higher up in the same, is deleted;
    overlapping runs are deleted as one. A document all of whose lines are deleted goes (stays with an empty text if not
    ``drop_emptied``). Rows without id or text, and empty texts, stay as they are. Equal rows are one document and come out
    equal; different texts under one id are documents of their own, in the order of a hash of their texts, and each loses only
    its own lines. Ids keep their type, which can be any that has an order. Columns keep their names; ``deleted_lines`` gets
    underscores appended while a column has that name.

    The texts themselves are shuffled only if the ranges to delete are too large a table to be broadcast.
    """
    count = fresh(docs, "deleted_lines")
    shared = Shared(docs.sparkSession)
    found = shared.small(later_runs(known(docs, key, text), shared, gram, window))
    joined, own, ranges = docs.join(found, same_document(docs, key, text, found), "left"), docs[f"`{text}`"], found["ranges"]
    lines = F.regexp_extract_all(own, F.lit(LINE), F.lit(0))
    kept = F.filter(lines, lambda _, i: ~F.exists(ranges, lambda r: (i >= r["start"]) & (i < r["end"])))
    new = F.concat(F.regexp_extract(own, r"^\n*", 0), F.array_join(kept, ""))
    deleted = F.coalesce(F.aggregate(ranges, F.lit(0), lambda s, r: s + r["end"] - r["start"]), F.lit(0))
    out = joined.select(*(F.when(ranges.isNull(), own).otherwise(new).alias(c) if c == text else docs[f"`{c}`"] for c in docs.columns), deleted.alias(count))
    return out.where((F.col(count) == 0) | (F.ltrim(F.col(f"`{text}`"), F.lit("\n")) != "")) if drop_emptied else out
