"""Small tables and plain-Python versions of what the operators compute."""

from __future__ import annotations

from collections import Counter, defaultdict

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def documents(spark, texts, langs=None, sources=None):
    """documents of (doc_id, text) pairs."""
    rows = [(i, t, langs[k] if langs else "en", sources[k] if sources else "a", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    out, word = [], ""
    for c in text:
        if c in "\t\n\f\r ":
            out.append(word)
            word = ""
        else:
            word += c
    return [w for w in [*out, word] if w]


def repeats(texts, m):
    """(doc_id, start, end, words in later copies, copies) by looking at every run of m words."""
    docs = {i: words(t) for i, t in set(texts) if i is not None and t is not None}
    where = defaultdict(list)
    for i in sorted(docs):
        for s in range(len(docs[i]) - m + 1):
            where[tuple(docs[i][s : s + m])].append((i, s))
    out = []
    hits = defaultdict(list)
    for at in where.values():
        for k, (i, s) in enumerate(at):
            if len(at) > 1:
                hits[i].append((s, k > 0, len(at)))
    for i, found in hits.items():
        islands = []
        for s, later, n in sorted(found):
            if not islands or s > islands[-1][1]:
                islands.append([s, s + m, set(), n])
            own = islands[-1]
            own[1], own[3] = max(own[1], s + m), max(own[3], n)
            if later:
                own[2] |= set(range(s, s + m))
        out += [(i, a, b, b - a, len(later), n) for a, b, later, n in islands]
    return sorted(out)


def lines(texts, m=3):
    """{doc_id: (text, deleted lines)} of distinct ids."""
    seen, out = set(), {}
    for i, t in sorted((x for x in texts if x[1] is not None), key=lambda x: x[0]):
        parts, head, k = [], "", 0
        while k < len(t) and t[k] == "\n":
            k += 1
        head, rest = t[:k], t[k:]
        while rest:
            e = rest.find("\n")
            e = len(rest) if e < 0 else e
            f = e
            while f < len(rest) and rest[f] == "\n":
                f += 1
            parts.append(rest[:f])
            rest = rest[f:]
        gone = set()
        for s in range(len(parts) - m + 1):
            run = tuple(p.rstrip("\n") for p in parts[s : s + m])
            if run in seen:
                gone |= set(range(s, s + m))
            seen.add(run)
        new = head + "".join(p for k, p in enumerate(parts) if k not in gone)
        out[i] = (t if not gone else new, len(gone))
    return {i: (t, n) for i, (t, n) in out.items() if not n or t.strip("\n")}


def leaks(texts, items, m=13, least=5):
    """(doc_id, item_id, n_words, doc_word, item_word) by extending every pair of equal words."""
    out = {}
    for i, t in texts:
        for j, b in items:
            if None in (i, t, j, b):
                continue
            x, y = words(t), words(b)
            if len(y) < least:
                continue
            for p in range(len(x)):
                for q in range(len(y)):
                    n = 0
                    while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
                        n += 1
                    if n >= min(m, len(y)):
                        best = out.get((i, j))
                        if best is None or (-n, p, q) < best:
                            out[i, j] = (-n, p, q)
    return sorted((i, j, -n, p, q) for (i, j), (n, p, q) in out.items())


def same(df, expected):
    got = Counter(tuple(r) for r in df.collect())
    want = Counter(tuple(x) for x in expected)
    assert got == want, f"missing {list((want - got))[:3]}, extra {list((got - want))[:3]}"
