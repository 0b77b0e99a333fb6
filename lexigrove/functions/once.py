"""Columns that are computed once a row, however often later steps name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """The rows with the column, as what a generator yields: a filter on it isn't pushed below it, where each mention would compute it again."""
    return rows.select("*", value.alias("__once")).select(*rows.columns, F.explode(F.array("__once")).alias(name))
