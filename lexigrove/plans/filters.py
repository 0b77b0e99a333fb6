"""The filter language: text to tree, tree to a Column.

AND and OR bind alike and from the left; only parentheses group. Comparisons are two-valued: what is negative (!=, NOT IN,
NOT BETWEEN) holds for nulls, what is positive doesn't. On an array a positive predicate holds if it does for an element,
and a negative one if its opposite holds for none.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import regex
from pyspark.sql import Column, functions as F

from lexigrove import schema as S
from lexigrove.errors import FilterFormatError, InvalidSearchParameters
from lexigrove.functions import geo

_TOKEN = regex.compile(
    r"(?P<string>'(?:[^']|'')*')|(?P<number>\d+(?:\.\d+)?(?:e[+-]?\d+)?)|(?P<name>[a-zA-Z_\u007f-\U0010ffff][a-zA-Z0-9_\u007f-\U0010ffff]*)|(?P<sign>&&|\|\||[<>!=(),-])|(?P<space>\s+)|(?P<other>.)", regex.DOTALL
)
_WORDS = {"AND", "OR", "IN", "NOT", "EMPTY", "IS", "NULL", "BETWEEN", "true", "false", "_geoRadius", "_geoBoundingBox"}
OPPOSITE = {"=": "!=", "!=": "=", ">": "<=", "<=": ">", "<": ">=", ">=": "<", "IN": "NOT IN", "NOT IN": "IN", "BETWEEN": "NOT BETWEEN", "NOT BETWEEN": "BETWEEN", "IS NULL": "IS NOT NULL", "IS NOT NULL": "IS NULL", "IS EMPTY": "IS NOT EMPTY", "IS NOT EMPTY": "IS EMPTY"}
NEGATIVE = {"!=", "NOT IN", "NOT BETWEEN", "IS NOT NULL", "IS NOT EMPTY"}


@dataclass(frozen=True)
class Lexeme:
    kind: str
    text: str
    at: int
    value: object = None


@dataclass(frozen=True)
class Comparison:
    attribute: str
    operator: str
    value: object = None


@dataclass(frozen=True)
class Radius:
    attribute: str
    lat: float
    lng: float
    metres: float


@dataclass(frozen=True)
class Box:
    attribute: str
    north: float
    east: float
    south: float
    west: float


@dataclass(frozen=True)
class Group:
    """Parts with the words between them, from the left."""

    parts: tuple[Node, ...]
    joins: tuple[str, ...]


Node = Comparison | Radius | Box | Group


def lex(text: str) -> list[Lexeme]:
    out = []
    for m in _TOKEN.finditer(text):
        kind, raw = m.lastgroup, m.group()
        if kind == "space":
            continue
        if kind == "string":
            out.append(Lexeme("string", raw[1:-1].replace("''", "'"), m.start(), raw[1:-1].replace("''", "'")))
        elif kind == "number":
            out.append(Lexeme("number", raw, m.start(), float(raw)))
        elif kind == "name":
            out.append(Lexeme(raw if raw in _WORDS else "name", raw, m.start()))
        elif raw in ("&&", "||"):
            out.append(Lexeme("AND" if raw == "&&" else "OR", raw, m.start()))
        else:
            out.append(Lexeme(raw if kind == "sign" else "other", raw, m.start()))
    return out


def _plain(x: float) -> str:
    return str(int(x)) if x == int(x) else str(x)


class Parser:
    def __init__(self, text: str, filterable: Iterable[str]):
        self.lexemes, self.i, self.filterable = lex(text), 0, set(filterable)

    @property
    def next(self) -> Lexeme | None:
        return self.lexemes[self.i] if self.i < len(self.lexemes) else None

    def fail(self, wanted: str, at: Lexeme | None = None) -> FilterFormatError:
        if at is None:
            last = self.lexemes[-1] if self.lexemes else Lexeme("", "", 0)
            return FilterFormatError(f"Col {last.at}: Error: Expected {wanted}, got end of string.")
        return FilterFormatError(f"Col {at.at}: Error: Expected {wanted}, got '{at.text}'")

    def take(self, kind: str, wanted: str) -> Lexeme:
        lexeme = self.next
        if lexeme is None or lexeme.kind != kind:
            raise self.fail(wanted, lexeme)
        self.i += 1
        return lexeme

    def parse(self) -> Group:
        stack: list[tuple[list, list]] = [([], [])]
        while (lexeme := self.next) is not None:
            parts, joins = stack[-1]
            if lexeme.kind in ("AND", "OR"):
                self.i += 1
                if len(joins) < len(parts):
                    joins.append(lexeme.kind)
            elif lexeme.kind == "(":
                self.i += 1
                stack.append(([], []))
            elif lexeme.kind == ")":
                if len(stack) == 1:
                    raise self.fail("an opened group statement", lexeme)
                self.i += 1
                group = stack.pop()
                if group[0]:
                    stack[-1][0].append(Group(tuple(group[0]), tuple(group[1][: len(group[0]) - 1])))
            elif lexeme.kind == "_geoRadius":
                self.i += 1
                parts.append(self.radius())
            elif lexeme.kind == "_geoBoundingBox":
                self.i += 1
                parts.append(self.box())
            elif lexeme.kind == "name":
                self.i += 1
                parts.append(self.comparison(lexeme))
            else:
                raise self.fail("an attribute name, _geoRadius() or '('", lexeme)
            if len(stack[-1][0]) > len(stack[-1][1]) + 1:  # no word between: AND
                stack[-1][1].append("AND")
        if len(stack) > 1:
            raise self.fail("a closing parenthesis")
        parts, joins = stack[0]
        return Group(tuple(parts), tuple(joins[: max(len(parts) - 1, 0)]))

    def attribute(self, lexeme: Lexeme | None) -> str:
        if lexeme is None or lexeme.text not in self.filterable:
            raise self.fail("filterable attribute", lexeme)
        return lexeme.text

    def literal(self) -> object:
        lexeme = self.next
        if lexeme is None or lexeme.kind not in ("string", "number", "true", "false"):
            raise self.fail("valid string, float or boolean value", lexeme)
        self.i += 1
        return lexeme.value if lexeme.kind in ("string", "number") else lexeme.kind == "true"

    def comparison(self, name: Lexeme) -> Comparison:
        attribute = self.attribute(name)
        lexeme = self.next
        if lexeme is None or lexeme.kind not in ("=", "!", "<", ">", "IN", "NOT", "IS", "BETWEEN"):
            raise self.fail("valid operator", lexeme)
        self.i += 1
        if lexeme.kind == "IS":
            return Comparison(attribute, self.state())
        operator = lexeme.text
        if operator in ("<", ">", "!") and self.next is not None and self.next.kind == "=":
            operator += "="
            self.i += 1
        if operator == "!":
            raise self.fail("valid operator", lexeme)
        if lexeme.kind == "NOT":
            if self.next is None or self.next.kind not in ("IN", "BETWEEN"):
                raise self.fail("NOT must be followed by IN () or BETWEEN", self.next)
            operator = f"NOT {self.next.kind}"
            self.i += 1
        if operator.endswith("BETWEEN"):
            low = self.take("number", "valid float value").value
            self.take("AND", "'AND'")
            high = self.take("number", "valid float value").value
            return Comparison(attribute, operator, tuple(sorted((low, high))))
        if operator.endswith("IN"):
            self.take("(", "'('")
            values = [self.literal()]
            while self.next is not None and self.next.kind == ",":
                self.i += 1
                values.append(self.literal())
            self.take(")", "')'")
            return Comparison(attribute, operator, tuple(values))
        return Comparison(attribute, operator, self.literal())

    def state(self) -> str:
        wanted = '"NULL", "NOT NULL", "EMPTY" or "NOT EMPTY" after is'
        lexeme = self.next
        negated = lexeme is not None and lexeme.kind == "NOT"
        if negated:
            self.i += 1
        if self.next is None or self.next.kind not in ("NULL", "EMPTY"):
            raise self.fail(wanted, lexeme)
        self.i += 1
        return f"IS {'NOT ' * negated}{self.lexemes[self.i - 1].kind}"

    def signed(self) -> float:
        sign = 1.0
        if self.next is not None and self.next.kind == "-":
            self.i += 1
            sign = -1.0
        return sign * self.take("number", "valid float value").value

    def numbers(self, n: int) -> tuple[Lexeme, str, list[float]]:
        self.take("(", "'('")
        first = self.next
        attribute, out = self.attribute(first), []
        self.i += 1
        for _ in range(n):
            self.take(",", "','")
            out.append(self.signed())
        self.take(")", "')'")
        return first, attribute, out

    def radius(self) -> Radius:
        _, attribute, (lat, lng, metres) = self.numbers(3)
        return Radius(attribute, lat, lng, metres)

    def box(self) -> Box:
        first, attribute, (north, east, south, west) = self.numbers(4)
        for what, limit, values in (("Latitude", 90, (north, south)), ("Longitude", 180, (east, west))):
            for v in values:
                if not -limit <= v <= limit:
                    shown = ", ".join([attribute, *(_plain(x) for x in (north, east, south, west))])
                    raise self.fail(f"{what} value must be numeric -{limit}.0 .. +{limit}.0 (given: {_plain(v)})", Lexeme("number", shown, first.at))
        return Box(attribute, north, east, south, west)


def parse(text: str, filterable: Iterable[str]) -> Group:
    return Parser(text, filterable).parse()


def to_dict(node: Node) -> dict:
    """The tree as plain data."""
    if isinstance(node, Group):
        out: list = []
        for i, part in enumerate(node.parts):
            if i:
                out.append(node.joins[i - 1])
            out.append(to_dict(part))
        return {"group": out}
    if isinstance(node, Comparison):
        return {"attribute": node.attribute, "operator": node.operator, "value": list(node.value) if isinstance(node.value, tuple) else node.value}
    return {k: v for k, v in vars(node).items()} | {"operator": "_geoRadius" if isinstance(node, Radius) else "_geoBoundingBox"}


def _literal(value: object, kind: str) -> Column | None:
    """The value in a column of the kind, or none if it can equal nothing there."""
    if kind in (S.NUMBER, S.NUMBERS):
        if isinstance(value, bool):
            return F.lit(float(value))
        return F.lit(float(value)) if isinstance(value, float) else None
    if kind == S.BOOLEAN:
        return F.lit(bool(value)) if isinstance(value, bool) or value in (0.0, 1.0) else None
    if isinstance(value, bool):
        return F.lit(str(value).lower())
    return F.lit(_plain(value) if isinstance(value, float) else value)


def predicate(column: Column, kind: str, operator: str, value: object) -> Column:
    """A two-valued predicate on one scalar; for a null it holds exactly if the operator is negative."""
    if operator == "IS NULL":
        return column.isNull()
    if operator == "IS NOT NULL":
        return column.isNotNull()
    if operator in ("IS EMPTY", "IS NOT EMPTY"):
        empty = F.coalesce(column == "", F.lit(False)) if kind == S.STRING else F.lit(False)
        return empty if operator == "IS EMPTY" else ~empty
    if operator in NEGATIVE:
        return ~predicate(column, kind, OPPOSITE[operator], value)
    if operator == "BETWEEN":
        low, high = (_literal(v, kind) for v in value)
        return F.lit(False) if low is None or kind == S.BOOLEAN else F.coalesce(column.between(low, high), F.lit(False))
    if operator == "IN":
        wanted = [x for x in (_literal(v, kind) for v in value) if x is not None]
        return F.coalesce(column.isin(wanted), F.lit(False)) if wanted else F.lit(False)
    wanted = _literal(value, kind)
    if wanted is None:
        return F.lit(False)
    test = {"=": lambda: column == wanted, ">": lambda: column > wanted, ">=": lambda: column >= wanted, "<": lambda: column < wanted, "<=": lambda: column <= wanted}[operator]()
    return F.coalesce(test, F.lit(False))


def compile_comparison(node: Comparison, schema: dict[str, str], primary_key: str | None = None) -> Column:
    """The comparison on the attribute's column; on a configured attribute that no document has, a negative one holds always and a positive one never."""
    operator, value = node.operator, node.value
    if node.attribute == primary_key:
        return predicate(F.col(f"`{node.attribute}`").cast("string"), S.STRING, operator, value)
    kind = schema.get(node.attribute)
    if kind is None:
        return F.lit(operator in NEGATIVE)
    column = F.col(f"`{node.attribute}`")
    if kind == S.GEO and operator not in ("IS NULL", "IS NOT NULL"):
        raise InvalidSearchParameters(f"{node.attribute} is a location; only IS NULL, IS NOT NULL, _geoRadius and _geoBoundingBox apply to it.")
    if kind not in S.MULTI or operator in ("IS NULL", "IS NOT NULL"):
        return predicate(column, S.STRING if kind == S.NULL else kind, operator, value)
    if operator in ("IS EMPTY", "IS NOT EMPTY"):
        empty = F.coalesce(F.size(column) == 0, F.lit(False)) & column.isNotNull()
        return empty if operator == "IS EMPTY" else ~empty
    element = S.NUMBERS if kind == S.NUMBERS else S.STRING
    positive = OPPOSITE[operator] if operator in NEGATIVE else operator
    found = F.coalesce(F.exists(column, lambda x: predicate(x, element, positive, value)), F.lit(False))
    return ~found if operator in NEGATIVE else found


def compile_filter(node: Node, schema: dict[str, str], primary_key: str | None = None) -> Column:
    """The tree as one boolean expression over a row, never null."""
    if isinstance(node, Group):
        if not node.parts:
            return F.lit(True)
        out = compile_filter(node.parts[0], schema, primary_key)
        for word, part in zip(node.joins, node.parts[1:]):
            other = compile_filter(part, schema, primary_key)
            out = out & other if word == "AND" else out | other
        return out
    if isinstance(node, Comparison):
        return compile_comparison(node, schema, primary_key)
    if schema.get(node.attribute) != S.GEO:
        return F.lit(False)
    lat, lng = F.col(f"`{node.attribute}`.lat"), F.col(f"`{node.attribute}`.lng")
    if isinstance(node, Radius):
        return geo.within_radius(lat, lng, node.lat, node.lng, node.metres)
    return geo.within_box(lat, lng, node.north, node.east, node.south, node.west)


def element_filter(node: Node, attribute: str, kind: str):
    """What the filter asks of the elements of one array: a function of an element, or none if it doesn't name the attribute."""
    if isinstance(node, Group):
        out = None
        for word, part in zip(("AND", *node.joins), node.parts):
            own = element_filter(part, attribute, kind)
            if own is not None:
                out = own if out is None else (lambda x, a=out, b=own, w=word: a(x) & b(x) if w == "AND" else a(x) | b(x))
        return out
    if isinstance(node, Comparison) and node.attribute == attribute and not node.operator.startswith("IS"):
        element = S.NUMBERS if kind == S.NUMBERS else S.STRING
        return lambda x: predicate(x, element, node.operator, node.value)
    return None


def radii(node: Node) -> list[Radius]:
    if isinstance(node, Group):
        return [r for part in node.parts for r in radii(part)]
    return [node] if isinstance(node, Radius) else []
