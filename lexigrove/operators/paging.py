"""Distinct attributes, order and pages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def distinct_best(matches: DataFrame, attribute: str, order: list[Column], doc_id: str = "doc_id") -> DataFrame:
    """The first document, in the order given and then by id, of each value of the attribute; those without a value are one group."""
    w = Window.partitionBy(F.col(f"`{attribute}`")).orderBy(*order, F.col(doc_id).asc())
    return matches.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, doc_id: str = "doc_id") -> DataFrame:
    """The rows from offset on in the order given and then by id. Spark takes the first offset + limit of each partition instead of sorting all."""
    return rows.orderBy(*order, F.col(doc_id).asc()).offset(offset).limit(limit)


def numbered(rows: DataFrame, order: list[Column], doc_id: str = "doc_id") -> DataFrame:
    """The rows with their ``place`` in the order given and then by id, from 1 on. Rows are ranged and sorted range by range; only the ranges' sizes go to the driver."""
    ranged = rows.orderBy(*order, F.col(doc_id).asc()).withColumn("__at", F.monotonically_increasing_id()).persist()
    part = F.shiftright("__at", 33)
    sizes = {r["part"]: r["count"] for r in ranged.groupBy(part.alias("part")).count().collect()}
    begins, total = [], 0
    for p in sorted(sizes):
        begins.append((p, total))
        total += sizes[p]
    begin = rows.sparkSession.createDataFrame(begins, "__part bigint, __begin bigint")
    nth = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(begin), part == F.col("__part")).withColumn("place", F.col("__begin") + nth + 1).drop("__at", "__part", "__begin")


def page_numbers(total: int, limit: int, offset: int) -> tuple[int, int]:
    """(page, number of pages)."""
    if limit <= 0:
        return 1, 0
    return offset // limit + 1, math.ceil(total / limit)
