"""Many terms in one pass over each text: an automaton of the whole dictionary (Aho and Corasick) in place of one search a term."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_AUTOMATA: dict[tuple, object] = {}


def plain_term(term: str) -> str:
    """A term as texts are compared: lower case without spaces."""
    return term.lower().replace(" ", "")


def automaton_of(words: tuple[str, ...]):
    """The automaton of different words, one a Python worker for as long as few are in use; a match gives the word's number."""
    import ahocorasick

    if words not in _AUTOMATA:
        if len(_AUTOMATA) >= 8:
            _AUTOMATA.clear()
        made = ahocorasick.Automaton()
        for i, w in enumerate(words):
            made.add_word(w, i)
        made.make_automaton()
        _AUTOMATA[words] = made
    return _AUTOMATA[words]


def occurrences_by_word(words: tuple[str, ...], text: str) -> dict[int, int]:
    """Non-overlapping occurrences of each word that the text holds, by its number."""
    counts: dict[int, int] = {}
    ends: dict[int, int] = {}
    if words and text:
        for end, i in automaton_of(words).iter(text):
            if end - len(words[i]) >= ends.get(i, -1):
                counts[i] = counts.get(i, 0) + 1
                ends[i] = end
    return counts


def scan_terms(plain: Column, counts: dict[str, list[str]] | None = None, found: dict[str, list[tuple[str, str]]] | None = None) -> Column:
    """A struct with, for each name of counts, the occurrences of all its terms, and for each name of found, given as
    (term, shown) in order, what is shown of the terms that the text holds, each once. plain is a column of lower-case
    texts without spaces; a null text holds nothing."""
    counts, found = counts or {}, found or {}
    words = tuple(sorted({w for terms in counts.values() for t in terms if (w := plain_term(t))} | {w for terms in found.values() for t, _ in terms if (w := plain_term(t))}))
    number = {w: i for i, w in enumerate(words)}
    sums = [[number[w] for t in terms if (w := plain_term(t))] for terms in counts.values()]
    lists = [{number[w]: (k, shown) for k, (t, shown) in reversed(list(enumerate(terms))) if (w := plain_term(t))} for terms in found.values()]
    several = [[(number[w], k, shown) for k, (t, shown) in enumerate(terms) if (w := plain_term(t)) and lists[j][number[w]][0] != k] for j, terms in enumerate(found.values())]

    def scanned(texts: pd.Series) -> pd.DataFrame:
        columns: list[list] = [[] for _ in range(len(sums) + len(lists))]
        for text in texts:
            held = occurrences_by_word(words, text or "")
            for out, own in zip(columns, sums, strict=False):
                out.append(sum(held.get(i, 0) for i in own) if held else 0)
            for out, own, more in zip(columns[len(sums) :], lists, several, strict=True):
                shown = sorted([own[i] for i in held if i in own] + [(k, s) for i, k, s in more if i in held])
                out.append(list(dict.fromkeys(s for _, s in shown)))
        return pd.DataFrame({f"c{i}": c for i, c in enumerate(columns)})

    names = [*counts, *found]
    schema = ", ".join(f"c{i} {'long' if i < len(sums) else 'array<string>'}" for i in range(len(names)))
    struct = F.pandas_udf(scanned, f"struct<{schema.replace(' ', ':').replace(',:', ',')}>")(plain)
    return struct
