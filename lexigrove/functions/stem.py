"""Light stemmers for the distinct words of a vocabulary, and splitting of compounds.

English follows Porter's steps, German, French and Spanish strip inflections from what follows the first syllable.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lexigrove.functions.once import once

_VOWEL = re.compile(r"[aeiouy]")


def _measure(stem: str) -> int:
    kinds = "".join("v" if c in "aeiou" or c == "y" and i and stem[i - 1] not in "aeiou" else "c" for i, c in enumerate(stem))
    return len(re.findall(r"v+c+", kinds))


def _has_vowel(stem: str) -> bool:
    return bool(_VOWEL.search(stem[1:])) or stem[:1] in tuple("aeiou")


def _short(stem: str) -> bool:
    return bool(re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", stem))


_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def english(word: str) -> str:
    w = word
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss") and not w.endswith("us"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for ending in ("ed", "ing"):
            if w.endswith(ending) and _has_vowel(w[: -len(ending)]):
                w = w[: -len(ending)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]) and len(w) > 2:
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        ending = max((e for e in table if w.endswith(e)), key=len, default=None)
        if ending and _measure(w[: -len(ending)]) > 0:
            w = w[: -len(ending)] + table[ending]
    ending = next((e for e in sorted(_STEP4, key=len, reverse=True) if w.endswith(e)), None)
    if ending and _measure(w[: -len(ending)]) > 1 and (ending != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(ending)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _region(word: str, vowels: str, least: int) -> int:
    """Where what follows the first consonant after a vowel begins, after ``least`` letters at least."""
    m = re.search(rf"[{vowels}][^{vowels}]", word)
    return max(m.end() if m else len(word), least)


def german(word: str) -> str:
    w = word
    r1 = _region(w, "aeiouyäöü", 3)
    for ending in ("ern", "em", "er", "en", "es", "e", "s"):
        if w.endswith(ending) and len(w) - len(ending) >= r1 and (ending != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
            w = w[: -len(ending)]
            break
    for ending in ("est", "en", "er", "st"):
        if w.endswith(ending) and len(w) - len(ending) >= r1 and (ending != "st" or len(w) > 5 and w[-3:-2] in tuple("bdfghklmnt")):
            w = w[: -len(ending)]
            break
    return w


def _strip(word: str, endings: tuple[str, ...], vowels: str) -> str:
    r1 = _region(word, vowels, 3)
    for ending in sorted(endings, key=len, reverse=True):
        if word.endswith(ending) and len(word) - len(ending) >= r1:
            return word[: -len(ending)]
    return word


_FRENCH = ("issements", "issement", "issantes", "issante", "issants", "issant", "ements", "ement", "ations", "ation", "euses", "euse", "eux", "ives", "ive", "ifs", "if", "erait", "eront", "aient", "ances", "ance", "ences", "ence", "antes", "ante", "ants", "ant", "ait", "ees", "ee", "es", "er", "ez", "e", "s")
_SPANISH = ("amientos", "amiento", "imientos", "imiento", "aciones", "acion", "mente", "adoras", "adora", "adores", "ador", "ancias", "ancia", "idades", "idad", "ando", "iendo", "aban", "aba", "adas", "ados", "ada", "ado", "idas", "idos", "ida", "ido", "ar", "er", "ir", "as", "os", "es", "a", "o", "e", "s")


def french(word: str) -> str:
    return _strip(word, _FRENCH, "aeiouy")


def spanish(word: str) -> str:
    return _strip(word, _SPANISH, "aeiou")


STEMMERS = {"en": english, "de": german, "fr": french, "es": spanish}


def stem(word: str, language: str | None) -> str:
    return STEMMERS[language](word) if language in STEMMERS else word


def stem_column(term: Column, language: Column) -> Column:
    """Stems by language; meant for distinct (term, language) pairs."""

    @F.pandas_udf("string")
    def run(terms: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else stem(t, l) for t, l in zip(terms, languages)], dtype="object")

    return run(term, language)


#: Letters that German and English put between the parts of a compound.
FILLERS = ("", "s", "es", "n", "en", "er")
MIN_PART = 4


def compounds(vocabulary: DataFrame) -> DataFrame:
    """(term, part): both parts of each word of the vocabulary (term) that is two of its words with a filler between, of MIN_PART letters at least.

    Every split of every word is joined with the vocabulary twice, on the parts; a word has fewer splits than letters. The
    distinct words are found once, as no filter is pushed below them by which they would differ.
    """
    words = once(vocabulary.select("term").distinct(), F.col("term"), "word").select(F.col("word").alias("term"))
    cut = F.explode(F.sequence(F.lit(MIN_PART), F.length("term") - MIN_PART)).alias("i")
    halves = words.where(F.length("term") >= 2 * MIN_PART).select("term", cut)
    halves = halves.select("term", F.expr("substring(term, 1, i)").alias("head"), F.expr("substring(term, i + 1)").alias("rest"))
    heads = halves.join(words.select(F.col("term").alias("head")), "head")
    filled = heads.select("term", "head", "rest", F.explode(F.array(*(F.lit(x) for x in FILLERS))).alias("filler")).where(F.col("rest").startswith(F.col("filler")))
    tails = filled.select("term", "head", F.expr("substring(rest, length(filler) + 1)").alias("tail")).where(F.length("tail") >= MIN_PART)
    both = tails.join(words.select(F.col("term").alias("tail")), "tail")
    return both.select("term", F.explode(F.array("head", "tail")).alias("part")).distinct()
