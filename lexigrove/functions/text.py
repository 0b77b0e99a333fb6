"""Words of texts: the same rules as Spark columns, for documents, and in Python, for queries and for the page shown."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import regex
from pyspark.sql import Column, functions as F

#: Letters, marks and digits, with apostrophes inside.
WORD = r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}\p{N}]+)*"
_WORD = regex.compile(WORD)


def _folds() -> tuple[str, str]:
    """Accented lower-case Latin letters and what they fold to, one for one."""
    source, target = [], []
    for point in range(0xC0, 0x250):
        c = chr(point)
        base = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(base) > 1 and base[0].isascii() and all(unicodedata.combining(x) for x in base[1:]):
            source.append(c)
            target.append(base[0])
    return "".join(source) + "øłđħ", "".join(target) + "oldh"


FOLD_FROM, FOLD_TO = _folds()
#: Letters that fold to two.
FOLD_PAIRS = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"))
_TABLE = str.maketrans(FOLD_FROM, FOLD_TO) | {ord(a): b for a, b in FOLD_PAIRS}


def fold(word: str) -> str:
    return word.lower().translate(_TABLE)


def fold_column(word: Column) -> Column:
    """Words of ASCII letters, which have as many bytes as letters, are only put into lower case."""
    out = F.translate(F.lower(word), FOLD_FROM, FOLD_TO)
    for a, b in FOLD_PAIRS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(out)


def fold_sql(expression: str) -> str:
    """``fold_column`` as ANSI SQL."""
    out = f"translate(lower({expression}), '{FOLD_FROM}', '{FOLD_TO}')"
    for a, b in FOLD_PAIRS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def words_column(text: Column) -> Column:
    """The words of a text as they stand there."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


@dataclass(frozen=True)
class Word:
    """A word of a text: its folded term, where it stands, and whether folding changed more than its case."""

    term: str
    start: int
    end: int
    folded: bool


def words(text: str) -> list[Word]:
    out = []
    for m in _WORD.finditer(text):
        term = fold(m.group())
        out.append(Word(term, m.start(), m.end(), term != m.group().lower()))
    return out
