"""One query per operator over its whole table, with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrove.llm import bpe, decontam, hilbert, langid, levels, linededup, quality, simhash, suffixtree, urlgraph
from lexigrove.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), verify=True)


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.repeated_passages(table(spark, sf_dir, "documents"))


#: Seeds of the link-graph filter: hosts, with all below them.
TRUSTED_HOSTS, BLOCKED_HOSTS = ["example.org"], ["ththth.example.org", "tiontion.example.com"]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlgraph.filter_urls(pages, TRUSTED_HOSTS, BLOCKED_HOSTS).select("page_id", "url", "host", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"), "rejected")


def op2_host_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of the pages as they are: (src, dst, n)."""
    return urlgraph.host_edges(table(spark, sf_dir, "pages"))


def linked_pages(pages: DataFrame) -> DataFrame:
    """(src, dst, n): the hosts of all pages, linked by a rule, since the pages' own links stay within their hosts: each page links to those with the ids 2 * id + 1 and 7 * id + 3."""
    named = pages.select("page_id", urlgraph.host(F.col("url")).alias("host")).where("host is not null")
    links = named.select(F.col("host").alias("src"), F.explode(F.array(2 * F.col("page_id") + 1, 7 * F.col("page_id") + 3)).alias("page_id"))
    return links.join(named.withColumnRenamed("host", "dst"), "page_id").groupBy("src", "dst").agg(F.count("*").alias("n"))


def op2_linked_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust and distrust over links between hosts. Trusted is the host of the least page id, blocked that of the greatest, where it is another."""
    pages = table(spark, sf_dir, "pages")
    named = pages.select("page_id", urlgraph.host(F.col("url")).alias("host")).where("host is not null")
    trusted = named.agg(F.min_by("host", "page_id").alias("name"))
    blocked = named.agg(F.max_by("host", "page_id").alias("name"))
    scores = urlgraph.filter_hosts(urlgraph.propagate(linked_pages(pages), named, trusted, blocked))
    return scores.select("host", F.round("trust", 7).alias("trust"), F.round("distrust", 7).alias("distrust"), "rejected")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.prototypes(docs))


def op5_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(table(spark, sf_dir, "documents"), ["n_chars", "source", "lang"], F.octet_length("text"))


def op5_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document stands in each dimension of the curve."""
    docs = table(spark, sf_dir, "documents")
    return hilbert.cells(docs.select("doc_id", "n_chars", "source", "lang"), ["n_chars", "source", "lang"]).select("doc_id", "n_chars_cell", "source_cell", "lang_cell")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op7_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.repeated_passages(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op8_single_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every later copy of a line goes, whatever stands around it."""
    return linededup.dedup_lines(table(spark, sf_dir, "documents"), gram=1, window=1)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return kept.select("doc_id", "p_quality", "p_toxic")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_bpe, op2_url_filter, op2_host_edges, op2_linked_hosts, op3_language_id, op4_suffix_tree, op5_hilbert, op5_cells, op6_simhash, op7_suffix_levels, op8_line_dedup, op8_single_lines, op9_quality, op10_decontamination)}


#: Spans all of whose runs of 50 words occur elsewhere.
REPEATS_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\t\n\f\r ]+'), lambda x: x <> '') AS ws
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), g AS (
  SELECT doc_id, unnest(range(0, len(ws) - 49)) AS s, ws FROM w WHERE len(ws) >= 50
), p AS (
  SELECT doc_id, s, array_to_string(ws[s + 1 : s + 50], ' ') AS passage FROM g
), c AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY passage) AS n, row_number() OVER (PARTITION BY passage ORDER BY doc_id, s) AS k FROM p
), b AS (
  SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS starts FROM c WHERE n > 1
), i AS (
  SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM b
), l AS (
  SELECT doc_id, island, sum(least(50, coalesce(following - s, 50))) AS later_words
  FROM (SELECT doc_id, island, s, lead(s) OVER (PARTITION BY doc_id, island ORDER BY s) AS following FROM i WHERE k > 1) x
  GROUP BY doc_id, island
)
SELECT i.doc_id, CAST(min(s) AS INTEGER) AS start_word, CAST(max(s) + 50 AS INTEGER) AS end_word, CAST(max(s) + 50 - min(s) AS INTEGER) AS n_words,
  CAST(coalesce(max(later_words), 0) AS INTEGER) AS later_words, CAST(max(n) AS INTEGER) AS copies
FROM i LEFT JOIN l ON i.doc_id = l.doc_id AND i.island = l.island
GROUP BY i.doc_id, i.island
"""


#: Runs of three lines or more that occur earlier are deleted; a document with no line left goes.
LINES_SQL = r"""
WITH t AS (
  SELECT *, regexp_extract_all(text, '[^\n]+\n*') AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(range(0, len(lines) - 2)) AS i, lines FROM t WHERE doc_id IS NOT NULL AND len(lines) >= 3
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY rtrim(lines[i + 1], chr(10)), rtrim(lines[i + 2], chr(10)), rtrim(lines[i + 3], chr(10)) ORDER BY doc_id, i) AS k FROM l
), gone AS (
  SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM r WHERE k > 1
), d AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
), o AS (
  SELECT t.doc_id, t.text AS old, t.lang, t.source, t.n_chars, gone,
    regexp_extract(t.text, '^\n*') || array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i - 1)), '') AS text
  FROM t LEFT JOIN d ON t.doc_id = d.doc_id
)
SELECT doc_id, CASE WHEN gone IS NULL THEN old ELSE text END AS text, lang, source, n_chars, CAST(coalesce(len(gone), 0) AS INTEGER) AS deleted_lines
FROM o WHERE gone IS NULL OR ltrim(text, chr(10)) <> ''
"""

#: Lines that occur earlier are deleted; a document with no line left goes.
SINGLE_LINES_SQL = r"""
WITH t AS (
  SELECT *, regexp_extract_all(text, '[^\n]+\n*') AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(range(0, len(lines))) AS i, lines FROM t WHERE doc_id IS NOT NULL
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY rtrim(lines[i + 1], chr(10)) ORDER BY doc_id, i) AS k FROM l
), d AS (
  SELECT doc_id, list(i) AS gone FROM r WHERE k > 1 GROUP BY doc_id
), o AS (
  SELECT t.doc_id, t.text AS old, t.lang, t.source, t.n_chars, gone,
    regexp_extract(t.text, '^\n*') || array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i - 1)), '') AS text
  FROM t LEFT JOIN d ON t.doc_id = d.doc_id
)
SELECT doc_id, CASE WHEN gone IS NULL THEN old ELSE text END AS text, lang, source, n_chars, CAST(coalesce(len(gone), 0) AS INTEGER) AS deleted_lines
FROM o WHERE gone IS NULL OR ltrim(text, chr(10)) <> ''
"""

#: Longest runs of words that a document shares with a test item, from the 13-word runs on each diagonal.
LEAKS_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\t\n\f\r ]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(text, '[\t\n\f\r ]+'), lambda x: x <> '') AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), bg AS (
  SELECT item_id, p, least(13, len(ws)) AS n, array_to_string(ws[p + 1 : p + least(13, len(ws))], ' ') AS gram
  FROM (SELECT item_id, ws, unnest(range(0, len(ws) - least(13, len(ws)) + 1)) AS p FROM b WHERE len(ws) >= 5) x
), sizes AS (
  SELECT DISTINCT n FROM bg
), dg AS (
  SELECT doc_id, q, n, array_to_string(ws[q + 1 : q + n], ' ') AS gram
  FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS q FROM d, sizes WHERE len(ws) >= n) x
), m AS (
  SELECT DISTINCT doc_id, item_id, q, p, n FROM dg JOIN bg USING (n, gram)
), i AS (
  SELECT *, q - row_number() OVER (PARTITION BY doc_id, item_id, q - p ORDER BY q) AS island FROM m
), runs AS (
  SELECT doc_id, item_id, count(*) + min(n) - 1 AS n_words, min(q) AS doc_word, min(p) AS item_word FROM i GROUP BY doc_id, item_id, q - p, island
)
SELECT doc_id, item_id, CAST(n_words AS INTEGER) AS n_words, CAST(doc_word AS INTEGER) AS doc_word, CAST(item_word AS INTEGER) AS item_word
FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_words DESC, doc_word, item_word) = 1
"""


#: A value's cell is the share of documents with a lesser one, in 64 steps.
CELLS_SQL = "WITH " + ", ".join(
    f"{c} AS (SELECT {c} AS v, CAST(coalesce(sum(count(*)) OVER (ORDER BY {c} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 64 // sum(count(*)) OVER () AS INTEGER) AS cell FROM documents WHERE {c} IS NOT NULL GROUP BY {c})" for c in ("n_chars", "source", "lang")
) + """
SELECT doc_id, coalesce(n_chars.cell, 0) AS n_chars_cell, coalesce(source.cell, 0) AS source_cell, coalesce(lang.cell, 0) AS lang_cell
FROM documents LEFT JOIN n_chars ON documents.n_chars = n_chars.v LEFT JOIN source ON documents.source = source.v LEFT JOIN lang ON documents.lang = lang.v
"""


_HOST = r"nullif(rtrim(lower(regexp_extract(trim({}), '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '')"
#: Links counted by the hosts that they lead from and to.
EDGES_SQL = rf"""
WITH l AS (
  SELECT {_HOST.format("url")} AS src, unnest(regexp_extract_all(html, '<a\s[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'i')) AS href FROM pages
), k AS (
  SELECT src, replace(href, '&amp;', '&') AS href FROM l WHERE src IS NOT NULL
), e AS (
  SELECT src, CASE WHEN regexp_matches(href, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//') THEN {_HOST.format("href")} WHEN NOT regexp_matches(href, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:|#)') THEN src END AS dst FROM k
)
SELECT src, dst, count(*) AS n FROM e WHERE dst IS NOT NULL GROUP BY src, dst
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_host_edges": EDGES_SQL, "op5_cells": CELLS_SQL, "op4_suffix_tree": REPEATS_SQL, "op7_suffix_levels": REPEATS_SQL, "op8_line_dedup": LINES_SQL, "op8_single_lines": SINGLE_LINES_SQL, "op10_decontamination": LEAKS_SQL}
