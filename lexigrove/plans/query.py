"""The query language: words, "phrases", -words and -"phrases"."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from lexigrove.config import IndexConfig
from lexigrove.functions.edit import damerau
from lexigrove.functions.stem import stem
from lexigrove.functions.text import Word, fold, words


@dataclass(frozen=True)
class Token:
    """A word of the query. Tokens of one phrase share its number; ``last`` is the last token outside of phrases, if it ends the query."""

    index: int
    term: str
    folded: bool
    start: int
    end: int
    phrase: int | None = None
    negated: bool = False
    last: bool = False
    #: Its stem in the query's language, if that is another word.
    stems: tuple[str, ...] = ()


@dataclass(frozen=True)
class Query:
    text: str
    tokens: tuple[Token, ...]
    analysed: str

    def groups(self) -> list[list[Token]]:
        """Tokens that match together: each phrase, and each other token alone."""
        out: list[list[Token]] = []
        for t in self.tokens:
            if t.phrase is not None and out and out[-1][-1].phrase == t.phrase:
                out[-1].append(t)
            else:
                out.append([t])
        return out


def parse_query(text: str, config: IndexConfig) -> Query:
    """Tokens of a query, at most max_query_tokens; stop words go unless nothing else is left.

    A minus counts at the start of a word only and then holds for all that hangs together with it, or for the phrase that
    follows. A phrase that isn't closed ends with the query.
    """
    pieces: list[tuple[int, int, int | None, bool]] = []  # start, end, phrase, negated
    i, n, phrase = 0, len(text), 0
    while i < n:
        if text[i].isspace():
            i += 1
            continue
        negated = text[i] == "-" and i + 1 < n and not text[i + 1].isspace()
        i += negated
        if i < n and text[i] == '"':
            close = text.find('"', i + 1)
            close = n if close < 0 else close
            pieces.append((i + 1, close, phrase, negated))
            phrase, i = phrase + 1, close + 1
            continue
        end = i
        while end < n and not text[end].isspace() and text[end] != '"':
            end += 1
        pieces.append((i, end, None, negated))
        i = end
    found: list[Token] = []
    for start, end, number, negated in pieces:
        for w in words(text[start:end]):
            found.append(Token(len(found), w.term, w.folded, start + w.start, start + w.end, number, negated))
    found = found[: config.max_query_tokens]
    analysed = text
    if found and len(found) == config.max_query_tokens:
        analysed = text[: found[-1].end]
        if analysed.count('"') % 2:
            analysed += '"'
    stop = {fold(w) for w in config.stop_words}
    kept = [t for t in found if t.term not in stop] or found
    kept = [dataclasses.replace(t, index=i, last=i == len(kept) - 1 and t.phrase is None) for i, t in enumerate(kept)]
    return Query(text, tuple(kept), analysed)


def with_stems(query: Query, language: str | None) -> Query:
    """The query whose tokens outside of phrases match their stems too."""
    if language is None:
        return query
    tokens = tuple(t if t.phrase is not None or (s := stem(t.term, language)) == t.term else dataclasses.replace(t, stems=(s,)) for t in query.tokens)
    return dataclasses.replace(query, tokens=tokens)


def accepts(token: Token, term: str, config: IndexConfig, count: bool = True) -> tuple[int, bool] | None:
    """(typos, exact) if the term matches the token, else none; typos are 0 if they needn't be counted.

    Tokens of phrases match as they are. Others allow typos by their length, in terms at most one letter longer or shorter,
    and the last one matches terms that it begins, whose typos are counted against the whole term.
    """
    if term == token.term:
        return 0, True
    if token.phrase is not None:
        return None
    if term in token.stems:
        return 0, False
    typo, double = config.typo, config.typo.first_letter_counts_double
    k = typo.allowed(token.term)
    prefix = token.last and len(token.term) >= config.min_prefix_length
    hit = prefix and term.startswith(token.term)
    if not hit and k and abs(len(term) - len(token.term)) <= 1:
        hit = damerau(term, token.term, double) <= k
    if not hit and k and prefix and typo.for_prefixes and len(term) > len(token.term):
        lengths = range(max(config.min_prefix_length, len(token.term) - 1), min(len(term) - 1, len(token.term) + 1, typo.index_length) + 1)
        hit = any(damerau(term[:m], token.term, double) <= k for m in lengths)
    if not hit:
        return None
    return (damerau(term, token.term, double) if typo.enabled and count else 0), False


def matched_words(text: str, query: Query, config: IndexConfig, language: str | None = None) -> list[Word]:
    """The words of a text that tokens of the query match which aren't negated; those of a phrase only where the whole phrase stands."""
    found = words(text)
    hit = [False] * len(found)
    known: dict[str, bool] = {}
    for group in query.groups():
        if group[0].negated:
            continue
        if group[0].phrase is not None and len(group) > 1:
            terms = [t.term for t in group]
            for i in range(len(found) - len(terms) + 1):
                if [w.term for w in found[i : i + len(terms)]] == terms:
                    hit[i : i + len(terms)] = [True] * len(terms)
            continue
        for i, w in enumerate(found):
            key = (group[0].index, w.term)
            if key not in known:
                stemmed = stem(w.term, language) if language and config.typo.enabled else w.term
                known[key] = accepts(group[0], w.term, config) is not None or (stemmed != w.term and accepts(group[0], stemmed, config) is not None)
            hit[i] = hit[i] or known[key]
    return [w for w, h in zip(found, hit) if h]
