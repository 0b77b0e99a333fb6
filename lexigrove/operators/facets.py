"""Facets of the matching documents: how many have each value, and the least and greatest number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lexigrove import schema as S

DISTRIBUTION = "attribute string, value string, count bigint"
STATS = "attribute string, min double, max double"


def _values(matches: DataFrame, attribute: str, kind: str, doc_id: str) -> DataFrame:
    """(value) once per document that has it; nulls and empty strings have none."""
    column = F.col(f"`{attribute}`")
    if kind in S.MULTI:
        return matches.select(F.explode(F.array_distinct(column)).alias("value")).where("value is not null")
    rows = matches.select(column.alias("value")).where("value is not null")
    return rows.where("value <> ''") if kind in (S.STRING, S.NULL) else rows


def _named(attribute: str, number: bool):
    return lambda v: F.struct(F.lit(attribute).alias("attribute"), v.alias("value"), (v if number else F.lit(None)).cast("double").alias("number"))


def distribution(matches: DataFrame, attributes: dict[str, str], limit: int = 100, doc_id: str = "doc_id") -> DataFrame:
    """(attribute, value, count), per attribute the first ``limit`` values in order.

    All facets come from one pass over the matches: a row is expanded to its values once, counted before the shuffle, and the
    limit is a rank over the counted values. Numbers are shown as decimals (18.0), booleans as true and false.
    """
    if not attributes:
        return matches.sparkSession.createDataFrame([], DISTRIBUTION)
    pairs = []
    for name, kind in attributes.items():
        column = F.col(f"`{name}`")
        if kind == S.NUMBER:
            values = F.array(column.cast("double").cast("string"))
        elif kind == S.NUMBERS:
            values = F.transform(F.array_distinct(column), lambda x: x.cast("double").cast("string"))
        elif kind in S.MULTI:
            values = F.array_distinct(column.cast("array<string>"))
        else:
            values = F.array(F.when(column.cast("string") != "", column.cast("string")))
        pairs.append(F.transform(values, _named(name, kind in (S.NUMBER, S.NUMBERS))))
    rows = matches.select(F.inline(F.concat(*(F.coalesce(p, F.array().cast("array<struct<attribute:string,value:string,number:double>>")) for p in pairs)))).where("value is not null")
    counted = rows.groupBy("attribute", "value", "number").agg(F.count("*").alias("count"))
    nth = F.row_number().over(Window.partitionBy("attribute").orderBy("number", "value"))
    return counted.withColumn("nth", nth).where(F.col("nth") <= limit).select("attribute", "value", "count")


def stats(matches: DataFrame, attributes: dict[str, str]) -> DataFrame:
    """(attribute, min, max) of the numeric attributes, in one aggregation; none for attributes without a number."""
    numeric = {n: k for n, k in attributes.items() if k in (S.NUMBER, S.NUMBERS)}
    if not numeric:
        return matches.sparkSession.createDataFrame([], STATS)
    columns = []
    for i, (name, kind) in enumerate(numeric.items()):
        low, high = (F.array_min(f"`{name}`"), F.array_max(f"`{name}`")) if kind == S.NUMBERS else (F.col(f"`{name}`"), F.col(f"`{name}`"))
        columns += [F.min(low).cast("double").alias(f"l{i}"), F.max(high).cast("double").alias(f"h{i}")]
    row = matches.agg(*columns)
    each = F.array(*(F.struct(F.lit(name).alias("attribute"), F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max")) for i, name in enumerate(numeric)))
    return row.select(F.inline(each)).where("min is not null")
