"""Canonical names from a registry table of raw forms, of any length up to a checked size."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventpulse.functions.terms import automaton_of

MOST = 1_000_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Registry:
    """(raw, canonical) pairs in order. One automaton tells which raw forms a text holds, so a text costs its own length and its
    replacements, not the registry's length."""

    rows: tuple[tuple[str, str], ...]

    @cached_property
    def whole(self) -> dict[str, str]:
        return {raw.lower(): canonical for raw, canonical in self.rows}

    @cached_property
    def spaceless(self) -> dict[str, str]:
        return {raw.lower().replace(" ", ""): canonical for raw, canonical in self.rows}

    @cached_property
    def _places(self) -> dict[str, list[int]]:
        """Places in the registry of each form with Latin letters."""
        places: dict[str, list[int]] = {}
        for i, (raw, _) in enumerate(self.rows):
            if any("a" <= c <= "z" for c in raw.translate(_LOWER)):
                places.setdefault(raw.translate(_LOWER), []).append(i)
        return places

    @cached_property
    def _words(self) -> tuple[str, ...]:
        return tuple(self._places)

    def replaced(self, text: str) -> str:
        """All raw forms replaced inside the text, ignoring the case of A to Z, one form after the other in registry order; what
        a replacement brings in counts for the forms after it."""
        after = 0
        while self._words and text:
            held = {self._words[i] for _, i in automaton_of(self._words).iter(text.translate(_LOWER))}
            following = [(p[at], w) for w in held if (at := bisect_left(p := self._places[w], after)) < len(p)]
            if not following:
                break
            after, word = min(following)
            text = re.sub(re.escape(word), lambda _, new=self.rows[after][1]: new, text, flags=re.IGNORECASE | re.ASCII)
            after += 1
        return text

    def canonical(self, text: str) -> str:
        """A whole value that equals a raw form ignoring case wins; else raw forms are replaced inside; a two-part label is judged by
        its part before the bar; at last a match that ignores spaces."""
        if (found := self.whole.get(text.lower())) is not None:
            return found
        head = self.replaced(text).split("|")[0].strip(" ")
        return self.whole.get(head.lower()) or self.spaceless.get(head.lower().replace(" ", "")) or head

    def column(self, text: Column) -> Column:
        @F.pandas_udf("string")
        def of(texts: pd.Series) -> pd.Series:
            return texts.map({t: self.canonical(t) for t in texts.dropna().unique()})

        return of(text)


def registry_of(table: DataFrame, order: str) -> Registry:
    """The registry of a table (raw, canonical) in the order of a column, then of raw; blank and null raw forms are left out; more than
    MOST rows are refused, as the registry goes to every task."""
    rows = table.filter("trim(coalesce(raw, '')) <> ''").select("raw", F.coalesce("canonical", F.lit("")).alias("canonical"), order).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a registry has at most {MOST} raw forms")
    return Registry(tuple((r[0], r[1]) for r in sorted(rows, key=lambda r: (r[2], r[0]))))
