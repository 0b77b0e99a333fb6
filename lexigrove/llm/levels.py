"""Suffix-array dedup with a logarithmic family of indexes.

Documents come in batches. A batch's suffix array, its sampled suffixes in the order of their first words' hashes, is scanned
side by side with the array of every level for suffixes that begin alike, then becomes a level itself; while two levels are of
equal size they are merged into one of twice the size, so after n batches there are at most log2(n) + 1 and each suffix has
been rewritten as often. All arrays are bucketed by the same hash into the same number of sorted files, so a scan reads
matching buckets side by side and shuffles nothing. A merge shuffles the two arrays: Spark 4.1 takes the union of two tables
with equal buckets for bucketed, but doesn't read it so, and would leave equal beginnings apart.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrove.llm import spans
from lexigrove.llm.common import Shared

#: Batches that a table is taken in as, where it doesn't come in batches of its own.
BATCHES = 4
_AUTO = "spark.sql.sources.bucketing.autoBucketedScan.enabled"


class SuffixLevels:
    """Levels of suffix arrays, and the beginnings of the suffixes that met one of another place."""

    def __init__(self, spark: SparkSession, shared: Shared, buckets: int | None = None, min_words: int = spans.MIN_WORDS, prefix: int = spans.PREFIX):
        self.spark, self.shared, self.min_words, self.prefix = spark, shared, min_words, prefix
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: (number of batches in it, table, path), the largest first.
        self.levels: list[tuple[int, str, str]] = []
        self.met: list[DataFrame] = []

    @contextlib.contextmanager
    def _bucketed(self) -> Iterator[None]:
        """Scans keep to buckets also where Spark would read files as they come."""
        before = self.spark.conf.get(_AUTO)
        self.spark.conf.set(_AUTO, "false")
        try:
            yield
        finally:
            self.spark.conf.set(_AUTO, before)

    def _write(self, df: DataFrame) -> tuple[str, str]:
        name = f"suffixes_{uuid.uuid4().hex}"
        path = f"{self.shared.root}/{name}"
        df.sortWithinPartitions("prefix", "doc_id", "text_hash", "pos").write.bucketBy(self.buckets, "prefix").sortBy("prefix", "doc_id", "text_hash", "pos").option("path", path).format("parquet").saveAsTable(name)
        return name, path

    def _drop(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.shared.drop(path)

    def add(self, docs: DataFrame) -> None:
        """Takes in a batch of (doc_id, text, text_hash)."""
        found = spans.anchors(docs, self.min_words, self.prefix).distinct()
        name, path = self._write(found.repartition(self.buckets, "prefix"))
        with self._bucketed():
            new = self.spark.table(name)
            beginnings = new.select("prefix").groupBy("prefix").count()
            met = beginnings.where("count > 1").select("prefix")
            for _, level, _ in self.levels:
                met = met.unionByName(beginnings.select("prefix").join(self.spark.table(level), "prefix", "left_semi"))
            self.met.append(self.shared.write(met)[0])  # no grouping after the union
        self.levels.append((1, name, path))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a, a_path), (_, b, b_path) = self.levels.pop(), self.levels.pop()
            merged = self._write(self.spark.table(b).unionByName(self.spark.table(a)).repartition(self.buckets, "prefix"))
            self._drop(a, a_path)
            self._drop(b, b_path)
            self.levels.append((2 * size, *merged))

    def marks(self) -> DataFrame:
        """(doc_id, pos, n) of the suffixes that begin as one of another place does, n being the number of such."""
        if not self.levels:
            return self.spark.createDataFrame([], "doc_id bigint, text_hash bigint, pos int, n bigint")
        met = self.met[0]
        for other in self.met[1:]:
            met = met.unionByName(other)
        met, _ = self.shared.write(met.distinct())
        everything = None
        for _, level, _ in self.levels:
            own = self.spark.table(level).join(met, "prefix", "left_semi")
            everything = own if everything is None else everything.unionByName(own)
        return spans.marks(self.shared.write(everything)[0])

    def close(self) -> None:
        for _, name, path in self.levels:
            self._drop(name, path)
        self.levels = []


def batches(rows: DataFrame, n: int) -> list[DataFrame]:
    """The rows in n parts of about as many rows, by a hash of the id, which can be of any type."""
    return [rows.where(F.pmod(F.xxhash64("doc_id", F.lit("batch")), F.lit(n)) == i) for i in range(n)]


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = spans.MIN_WORDS, n_batches: int = BATCHES, buckets: int | None = None) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, later_words, copies) of every maximal span all of whose runs of min_words words occur elsewhere, found batch by batch.

    What suffixes have met an equal beginning in their own batch or an older level is looked at word by word at the end.
    The result doesn't depend on the batches: it is that of ``suffixtree.repeated_passages``, with the same results for rows
    without id or text, short texts, repeated rows and empty tables. Only the two columns are read.
    """
    spark = docs.sparkSession
    prefix = spans.prefix_words(min_words)
    shared = Shared(spark)
    family = SuffixLevels(spark, shared, buckets, min_words, prefix)
    rows = spans.known(docs, key, text)
    for batch in batches(rows, n_batches):
        family.add(batch)
    marked, _ = shared.write(family.marks())
    family.close()
    return spans.repeats(marked, rows, min_words, prefix)
