"""Licence scans with a generalised suffix automaton over the words of licence templates.

Words become template word numbers in arrays; stretches whose neighbouring words never stand together in a
template are passed over, as no long match can cross them. The rest is streamed through the automaton, which
gives the matching statistics: the longest template substring that ends at each word. Maximal long matches are
chained along each template by a dynamic program, in the order of text and template; a template of which enough words are
covered gives its label, unless another label's template covers more words of the same span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licence_texts import PHRASES, TEMPLATES
from .storage import refuse_clashes
from .wordblocks import released, word_blocks

SEPARATORS = np.ones(256, dtype=bool)
SEPARATORS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 256)]] = False
LONG_MATCH = 3
COVERED = 0.8


class SuffixAutomaton:
    """Of several token sequences; ends(state) lists the (sequence, end) places of a state's strings."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.own: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._extend(last, token)
                self.own[last].append((number, i + 1))
        below = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        self.ends = [list(x) for x in self.own]
        for state in below:
            self.ends[self.link[state]] += self.ends[state]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(dict(following))
        self.length.append(length)
        self.link.append(link)
        self.own.append([])
        return len(self.next) - 1

    def _split(self, state: int, token: int, target: int) -> int:
        """target's shorter strings, from state on, as a state of their own."""
        copy = self._state(self.length[state] + 1, self.link[target], self.next[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, token: int) -> int:
        target = self.next[last].get(token)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, token, target)
        new, state = self._state(self.length[last] + 1, 0, {}), last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][token]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, token, target)
        return new

    def matches(self, tokens: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the maximal matches in tokens."""
        state = length = 0
        for i, token in enumerate(tokens):
            before = (i, length, state)
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            else:
                state = length = 0
            if before[1] and length <= before[1]:
                yield before
        if length:
            yield len(tokens), length, state


def best_chain(matches: list[tuple[int, int, int]], size: int) -> tuple[int, int, int]:
    """(covered, begin, end) of the best chain of matches (end in text, end in template, length), given by end in text.
    Ends grow in both; where matches overlap, in text or template, words count once. From one match to the next the text
    may go on for `size` words, so the look back is bounded."""
    chained: list[tuple[int, int]] = []  # covered and begin of the best chain that ends with each match
    best = (0, 0, 0)
    for i, (end, at, length) in enumerate(matches):
        covered, begin = length, end - length
        for k in range(i - 1, -1, -1):
            before, before_at, _ = matches[k]
            if end - length - before > size:
                break
            if before < end and before_at < at:
                more = chained[k][0] + min(length, end - before, at - before_at)
                if more > covered or more == covered and chained[k][1] > begin:
                    covered, begin = more, chained[k][1]
        chained.append((covered, begin))
        if covered > best[0]:
            best = (covered, begin, end)
    return best


class LicenceScanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        texts = [(label, phrase) for phrase, label in phrases.items()] + list(templates)
        self.labels = [label for label, _ in texts]
        block = next(word_blocks(pa.array([t for _, t in texts]), lower=True, separators=SEPARATORS))
        hashes = block.word_hashes()
        self.known, numbers = np.unique(hashes, return_inverse=True)
        self.sequences = [numbers[a:b].tolist() for a, b in zip(block.word_bounds, block.word_bounds[1:], strict=False)]
        self.automaton = SuffixAutomaton(self.sequences)
        self.phrases = [(self.labels[i], self.sequences[i]) for i in range(len(phrases))]
        self.pairs = np.unique([a << 20 | b for s in self.sequences for a, b in zip(s, s[1:], strict=False)])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, -1)

    def chains(self, runs: list[tuple[int, list[int]]]) -> dict[int, tuple[int, int, int]]:
        """For each touched template its best chain of long matches: words covered, first word and end in the text. Of equal
        chains the first counts."""
        found: dict[int, list[tuple[int, int, int]]] = {}  # template: (end in text, end in template, length), by end in text
        for first, tokens in runs:
            for end, length, state in self.automaton.matches(tokens):
                if length >= LONG_MATCH:
                    for template, at in self.automaton.ends[state]:
                        found.setdefault(template, []).append((first + end, at, length))
        return {template: best_chain(matches, len(self.sequences[template])) for template, matches in found.items()}

    def labels_of(self, chains: dict[int, tuple[int, int, int]]) -> set[str]:
        """Labels of templates covered well enough; of two whose chains share more than half of the shorter span the one with
        fewer covered words gives way."""
        full = [(covered, begin, end, self.labels[t]) for t, (covered, begin, end) in chains.items() if covered >= COVERED * len(self.sequences[t])]
        return {
            label
            for covered, begin, end, label in full
            if not any(other != label and more > covered and 2 * (min(end, e) - max(begin, b)) > min(end - begin, e - b) for more, b, e, other in full)
        }

    def scan(self, block) -> Iterator[tuple]:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score) of each text."""
        numbers = self.numbers(block.word_hashes())
        doc = block.doc_of_words()
        together = np.zeros(len(numbers), dtype=bool)
        if len(numbers) > 1:
            key = (numbers[:-1] << 20) | np.maximum(numbers[1:], 0)
            together[:-1] = (numbers[:-1] >= 0) & (numbers[1:] >= 0) & (doc[:-1] == doc[1:]) & np.isin(key, self.pairs)
        opens = np.flatnonzero(together & ~np.concatenate([[False], together[:-1]]))
        closes = np.flatnonzero(together & ~np.concatenate([together[1:], [False]])) + 2
        long = closes - opens >= LONG_MATCH
        found: dict[int, list[tuple[int, list[int]]]] = {}
        for a, b in zip(opens[long], closes[long], strict=True):
            d = int(doc[a])
            found.setdefault(d, []).append((int(a - block.word_bounds[d]), numbers[a:b].tolist()))
        for d, n in enumerate(block.n_words.tolist()):
            if d not in found:
                yield n, 0, None, None, "", "", 0.0
                continue
            starts, base = [], set()
            for first, tokens in found[d]:
                for label, phrase in self.phrases:
                    own = [first + i for i in range(len(tokens) - len(phrase) + 1) if tokens[i : i + len(phrase)] == phrase]
                    starts += own
                    base |= {label} if own else set()
            chains = self.chains(found[d])
            score = max((covered / len(self.sequences[t]) for t, (covered, _, _) in chains.items()), default=0.0)
            yield n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | self.labels_of(chains))), score


_SCANNERS: list[LicenceScanner] = []


def licence_scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Per row of docs: keep's columns, n_words, n_base (places of base phrases), first_word and last_word (their smallest
    and largest first word, or null), base_labels and labels (sorted, comma-joined, empty if none) and score (largest
    covered share of a template, 0 to 1). Null and empty texts have no words; repeated rows give repeated results; a very
    long text is scanned whole in one task; an empty table gives an empty result. keep must not hold a result's name."""
    refuse_clashes(keep, ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "_text"])
    source = docs.select(*keep, F.col(text).alias("_text"))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNERS:
            _SCANNERS.append(LicenceScanner())
        for batch in batches:
            for block in word_blocks(batch.column("_text"), lower=True, separators=SEPARATORS):
                columns = zip(*_SCANNERS[0].scan(block), strict=True)
                part = batch.slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*keep, *names])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.select(*keep).schema)
    return source.mapInArrow(released(run), f"{kept}n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
