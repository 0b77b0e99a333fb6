"""Damerau-Levenshtein distance: insertions, deletions, replacements and swaps of neighbours, with edits allowed in between."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def damerau(a: str, b: str, first_letter_double: bool = False) -> int:
    """The distance; with first_letter_double one more if the first letters differ."""
    extra = int(first_letter_double and a[:1] != b[:1])
    if a == b:
        return 0
    last: dict[str, int] = {}
    limit = len(a) + len(b)
    rows = [[limit] * (len(b) + 2), [limit, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, swap_at = [limit, i], 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), swap_at
            cost = 0 if x == y else 1
            if not cost:
                swap_at = j
            row.append(min(rows[i][j] + cost, rows[i][j + 1] + 1, row[j] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        last[x] = i
        rows.append(row)
    return rows[-1][-1] + extra


def damerau_column(column: Column, term: str, first_letter_double: bool = False) -> Column:
    """Distance of each value from the term, as a pandas UDF; meant for the distinct words that a length filter leaves."""

    @F.pandas_udf("int")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else damerau(v, term, first_letter_double)).astype("Int32")

    return run(column)
