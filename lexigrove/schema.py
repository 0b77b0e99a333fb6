"""Types of attributes: inferred from documents, narrowed by later ones, checked against each."""

from __future__ import annotations

from pyspark.sql import types as T

from lexigrove.config import IndexConfig
from lexigrove.errors import InvalidConfiguration, InvalidDocument, PrimaryKeyNotFound

NULL, NUMBER, BOOLEAN, STRING, GEO = "null", "number", "boolean", "string", "geo"
ARRAY, NUMBERS, STRINGS = "array", "array<number>", "array<string>"
MULTI = (ARRAY, NUMBERS, STRINGS)


def type_of_value(value) -> str:
    """Type of a Python value of a document."""
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, (int, float)):
        return NUMBER
    if isinstance(value, dict):
        return GEO if set(value) == {"lat", "lng"} else STRINGS if value else ARRAY
    if isinstance(value, (list, tuple)):
        if not value:
            return ARRAY
        return NUMBERS if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in value) else STRINGS
    return STRING


def type_of_field(kind: T.DataType) -> str:
    """Type of a DataFrame's column."""
    if isinstance(kind, T.NullType):
        return NULL
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, T.NumericType):
        return NUMBER
    if isinstance(kind, T.ArrayType):
        return ARRAY if isinstance(kind.elementType, T.NullType) else NUMBERS if isinstance(kind.elementType, T.NumericType) else STRINGS
    if isinstance(kind, T.StructType):
        return GEO if {f.name for f in kind.fields} == {"lat", "lng"} else STRINGS
    if isinstance(kind, T.MapType):
        return STRINGS
    return STRING


def compatible(known: str, new: str) -> bool:
    """Whether a value of the new type fits a column of the known one."""
    return NULL in (known, new) or known == new or (known in MULTI and new in MULTI and ARRAY in (known, new))


def narrower(known: str, new: str) -> str:
    """The more telling of two compatible types."""
    if known == NULL or known == ARRAY and new in (NUMBERS, STRINGS):
        return new
    return known


def merge(known: dict[str, str], new: dict[str, str], config: IndexConfig) -> dict[str, str]:
    """The schema after documents with the new types; only relevant attributes count."""
    relevant = config.schema_attributes
    if not known and config.primary_key not in new:
        raise PrimaryKeyNotFound(f"The primary key {config.primary_key!r} is missing.")
    out = dict(known)
    for name, kind in new.items():
        if name not in relevant:
            continue
        if name not in out:
            out[name] = kind
        elif not compatible(out[name], kind):
            raise InvalidDocument(f"Attribute {name!r} is {out[name]}; a document has {kind} there.")
        else:
            out[name] = narrower(out[name], kind)
    return out


def schema_of(documents: list[dict], config: IndexConfig, known: dict[str, str] | None = None) -> dict[str, str]:
    """The schema after the documents, taken one by one."""
    out = dict(known or {})
    for document in documents:
        out = merge(out, {k: type_of_value(v) for k, v in document.items()}, config)
    return out


def spark_type(kind: str) -> T.DataType:
    geo = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())])
    return {NULL: T.StringType(), NUMBER: T.DoubleType(), BOOLEAN: T.BooleanType(), STRING: T.StringType(), GEO: geo, ARRAY: T.ArrayType(T.StringType()), NUMBERS: T.ArrayType(T.DoubleType()), STRINGS: T.ArrayType(T.StringType())}[kind]


def require(schema: dict[str, str], name: str) -> str:
    if name not in schema:
        raise InvalidConfiguration(f"Attribute {name!r} is not in the documents' schema.")
    return schema[name]


def flat_text(value) -> str:
    """A value as text for searching; lists are sorted and maps ordered by key, with keys or places between dots."""
    if value is None or isinstance(value, bool):
        return "" if value is None else str(value).lower()
    if isinstance(value, dict):
        return ".".join(f"{k}.{flat_text(v)}" for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return ".".join(f"{i}.{v}" for i, v in enumerate(sorted(flat_text(v) for v in value)))
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)
