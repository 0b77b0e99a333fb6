"""The sort language: attribute, min(attribute), max(attribute), _geoPoint(attribute, lat, lng) or _relevance, with :asc or :desc."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from lexigrove import schema as S
from lexigrove.config import IndexConfig
from lexigrove.errors import SortFormatError
from lexigrove.functions import geo
from lexigrove.plans.filters import Node, element_filter

_NUMBER = r"\s*(-?\d+(?:\.\d+)?)\s*"
_GEO = re.compile(rf"_geoPoint\(\s*(\w+)\s*,{_NUMBER},{_NUMBER}\)")
_AGGREGATE = re.compile(r"(min|max)\((\w+)\)")


@dataclass(frozen=True)
class SortKey:
    kind: str
    attribute: str
    descending: bool
    point: tuple[float, float] | None = None


def parse_sort(entries: tuple[str, ...], config: IndexConfig) -> list[SortKey]:
    out = []
    for entry in entries:
        name, _, direction = entry.rpartition(":")
        if direction not in ("asc", "desc") or not name:
            raise SortFormatError(f"Sort parameters must be in the format attribute:asc or attribute:desc, not {entry!r}.")
        down = direction == "desc"
        if name == "_relevance":
            out.append(SortKey("relevance", name, down))
            continue
        if m := _GEO.fullmatch(name):
            key = SortKey("geo", m[1], down, (float(m[2]), float(m[3])))
        elif m := _AGGREGATE.fullmatch(name):
            key = SortKey(m[1], m[2], down)
        else:
            key = SortKey("value", name, down)
        if key.attribute not in (*config.sortable, config.primary_key):
            raise SortFormatError(f"Cannot sort on {key.attribute!r}; it must be sortable.")
        out.append(key)
    return out


def order_columns(keys: list[SortKey], schema: dict[str, str], config: IndexConfig, tree: Node, score: Column | None) -> list[Column]:
    """What to order by. Nulls come last, and empty strings next to last, in both directions; attributes that no document has and, without a score, relevance order nothing.

    The least or greatest element of an array is that of the elements which pass what the filter asks of this array.
    """
    out: list[Column] = []
    for key in keys:
        kind = schema.get(key.attribute)
        if key.kind == "relevance":
            if score is None:
                continue
            value = score
        elif key.attribute == config.primary_key:
            value = F.col(f"`{key.attribute}`").cast("string")
        elif kind is None:
            continue
        elif key.kind == "geo":
            value = geo.distance(F.col(f"`{key.attribute}`.lat"), F.col(f"`{key.attribute}`.lng"), *key.point)
        elif key.kind in ("min", "max") and kind in S.MULTI:
            array, wanted = F.col(f"`{key.attribute}`"), element_filter(tree, key.attribute, kind)
            array = F.filter(array, wanted) if wanted else array
            value = F.array_min(array) if key.kind == "min" else F.array_max(array)
        else:
            value = F.col(f"`{key.attribute}`")
            if kind == S.STRING:
                out += [value.isNull().asc(), (value == "").asc()]
            elif kind in S.MULTI:
                raise SortFormatError(f"{key.attribute} is an array; sort by its min() or max().")
        out.append(value.desc_nulls_last() if key.descending else value.asc_nulls_last())
    return out
