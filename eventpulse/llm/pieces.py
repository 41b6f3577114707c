"""Tokenising whole texts through a bounded cache of their parts.

A tokenizer's split pattern never joins certain neighbours: a letter and the punctuation after it, or a
character and the white space after it. Texts are cut at such places only, so the ids of the parts, one after
the other, are the ids of the text; a part is encoded once for as long as it stays in the cache.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: White space as the tokenizers' patterns have it (Unicode White_Space).
SPACE = "\t-\r \x85\xa0  -     　"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: For patterns that drop white space.
BARE_PARTS = re.compile(rf"[{LETTERS}]+(?=[{SPACE}.,;:!?]|\Z)|[^{SPACE}]+")
LONGEST_KEPT = 48


class PartCache:
    """Values of parts, computed in batches; two generations of at most `most` entries each bound its memory."""

    def __init__(self, compute: Callable[[list[str]], list], most: int = 300_000):
        self.compute, self.most = compute, most
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def values(self, texts: list[list[str]]) -> list[list]:
        """The values of each text's parts."""
        wanted = set().union(*texts) if texts else set()
        missing = wanted - self.young.keys()
        found = {p: self.old[p] for p in missing & self.old.keys()}
        missing = list(missing - found.keys())
        passing = {}
        for part, value in zip(missing, self.compute(missing), strict=True):
            (found if len(part) <= LONGEST_KEPT else passing)[part] = value
        self.young |= found
        table = self.young | passing if passing else self.young
        out = [[table[p] for p in parts] for parts in texts]
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        return out


_CACHES: dict[tuple, PartCache] = {}


def cache_for(key: tuple, make: Callable[[], Callable[[list[str]], list]], most: int = 300_000) -> PartCache:
    """One cache a Python worker for each key."""
    if key not in _CACHES:
        _CACHES[key] = PartCache(make(), most)
    return _CACHES[key]
