"""Substring dedup by prefix-partitioned suffix trees."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexigrove.llm import spans
from lexigrove.llm.common import Shared


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = spans.MIN_WORDS, group_rows: int = spans.GROUP_ROWS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, later_words, copies) of every maximal span all of whose runs of min_words words occur elsewhere.

    Suffixes are split by the words they begin with: by PREFIX words, and where a group has more than group_rows suffixes
    those with equal surroundings count as one, split by longer and longer prefixes, up to min_words. In each group's suffix tree the internal nodes that are deep enough,
    counting the words that all copies have before them, are the maximal repeats. Overlapping repeats of a document come out
    as one span; ``later_words`` counts its words that some copy earlier in the order of (doc_id, text_hash, word) has too,
    those to remove.

    Rows without id or text and texts of fewer than min_words words have no spans, nor has an empty table. Equal rows count
    once; different texts under one id are documents of their own, whose spans all have this id. Ids keep their type, which
    can be any that has an order. Columns other than the two are not read, so their names don't matter.
    """
    shared = Shared(docs.sparkSession)
    rows, prefix = spans.known(docs, key, text), spans.prefix_words(min_words)
    suffixes, path = shared.write(spans.anchors(rows, min_words, prefix))
    marked, _ = shared.write(spans.marks(suffixes))
    shared.drop(path)
    return spans.repeats(marked, rows, min_words, prefix, group_rows)
