"""Secret scans: fixed shapes, and a battery of randomness tests with length-aware false-discovery control.

A pass over each whole text finds the fixed shapes and every long run of encoding characters. Runs are tested
whole and, where they hold separators, part by part. The encoding is inferred from the alphabet; symbols become
values, and three tests ask whether these are uniform and independent: chi-squared over equal bins,
Wald-Wolfowitz runs about the middle, and lag-one serial correlation, combined by Fisher's method. Runs for which this
battery rejects randomness are plain.

The others need not be random: short strings give the battery little power. So their null hypothesis is the plain
identifier: letters follow each other as in the corpus' own words (a table of letter pairs, counted over all texts
outside long runs, on top of a fixed word list), and letters and digits seldom alternate. The sum of log-likelihood
ratios against a uniform source has a known mean and spread under that null, which grow with the number of pairs, so
every length has its own p-value. Within each encoding and length band the Benjamini-Hochberg step over the whole corpus, from
counts of binned p-values (a table of bounded size), bounds the share of plain strings among the reported ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import refuse_clashes, saved
from .wordblocks import released, text_blocks

KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LONG_RUN = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
EQUALS = re.compile("=+")

ALPHABETS = {
    "hex": "0123456789abcdef",
    "alpha": "abcdefghijklmnopqrstuvwxyz",
    "base32": "abcdefghijklmnopqrstuvwxyz234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "alpha52": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
ENCODINGS = tuple(ALPHABETS)
VALUES = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ALPHABETS.items()}
SEPARATORS = re.compile(r"[-_+/]+")
LENGTH_BANDS = (16, 24, 32, 64)
P_BINS_PER_DECADE = 20
LEAST_P = 1e-12
URL_SAFE = {ord("-"): "+", ord("_"): "/"}
#: Words of identifiers, the least that the table of letter pairs knows.
PLAIN_WORDS = (
    "access account action address agent analysis answer archive argument article attribute author backup balance billing block branch browser "
    "buffer build button calendar campaign capacity category channel chapter charge check client cloud code collection color command company "
    "config connection content control country course create currency custom data default delete design device digital direct display document "
    "domain download driver edition element email engine error event example export external factory feature field file filter folder format "
    "frame function gallery general global group guide handler header health help history home image import index input instance interface "
    "invoice item journal keyboard language layout letter level library license limit list location login machine manager market master media "
    "member memory menu message method mobile model module monitor month music name network number object office online option order output owner "
    "package page parameter partner path payment people phone platform player policy power preview price print private process product profile "
    "program project property public quality query question range reader record region release remote report request resource response result "
    "review school screen script search season section security select"
).split()
PLAIN_WEIGHT = 20
SMOOTHING = 8.0
#: How often letters and digits alternate in plain identifiers, as a share of neighbours; and how much neighbours depend on each other.
PLAIN_SWITCHES = 0.15
DEPENDENCE = 2.0
#: Names and other languages than the corpus' reach this share of its mean ratio.
PLAIN_SHARE = 0.6
LETTER = np.full(256, 26, dtype=np.int64)
LETTER[ord("a") : ord("z") + 1] = LETTER[ord("A") : ord("Z") + 1] = np.arange(26)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed shapes."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out


def infer_encoding(run: str) -> str | None:
    """The narrowest encoding whose alphabet holds the run, in either case for one-case encodings; None for digits alone
    and for other characters."""
    low = run.lower()
    if run.isdigit():
        return None
    if run == low or run == run.upper():
        return next((name for name in ("hex", "alpha", "base32", "base36") if all(c in VALUES[name] for c in low)), None) or ("base64" if all(c in VALUES["base64"] for c in run.translate(URL_SAFE)) else None)
    return next((name for name in ("alpha52", "base64") if all(c in VALUES[name] for c in run.translate(URL_SAFE))), None)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_squared_tail(x: float, freedom: int) -> float:
    """Wilson and Hilferty's normal approximation."""
    part = 2 / (9 * freedom)
    return _normal_tail(((x / freedom) ** (1 / 3) - (1 - part)) / math.sqrt(part))


def randomness(values: list[int], size: int) -> float:
    """Fisher-combined p-value of the three tests, for values in range(size) of a uniform independent source."""
    n = len(values)
    bins = max(2, min(size, n // 5))
    counts = [0] * bins
    for v in values:
        counts[v * bins // size] += 1
    shares = [0] * bins
    for v in range(size):
        shares[v * bins // size] += 1
    uniform = _chi_squared_tail(sum((c - n * s / size) ** 2 / (n * s / size) for c, s in zip(counts, shares, strict=True)), bins - 1)
    high = [2 * v >= size for v in values]
    ups, downs = sum(high), n - sum(high)
    if ups and downs and n > 2:
        mean = 1 + 2 * ups * downs / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
        runs_p = 2 * _normal_tail(max(0.0, abs(runs - mean) - 0.5) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        runs_p = LEAST_P
    middle = sum(values) / n
    power = sum((v - middle) ** 2 for v in values)
    serial = sum((a - middle) * (b - middle) for a, b in zip(values, values[1:], strict=False)) / power if power else 1.0
    serial_p = 2 * _normal_tail(abs(serial + 1 / n) * math.sqrt(n))
    half = -sum(math.log(min(1.0, max(p, LEAST_P))) for p in (uniform, runs_p, serial_p))
    return min(1.0, math.exp(-half) * (1 + half + half * half / 2))


class PlainModel:
    """Log-likelihood ratios of letter pairs, plain against uniform, and their mean and variance in plain text."""

    def __init__(self, pairs: np.ndarray | None = None):
        counts = np.zeros((26, 26)) if pairs is None else pairs.reshape(27, 27)[:26, :26].astype(float)
        for word in PLAIN_WORDS:
            for a, b in zip(word, word[1:], strict=False):
                counts[ord(a) - 97, ord(b) - 97] += PLAIN_WEIGHT
        after = counts.sum(axis=0) + 1
        shares = (counts + SMOOTHING * after / after.sum()) / (counts.sum(axis=1, keepdims=True) + SMOOTHING)
        ratios = np.clip(np.log(shares * 26), -3, 3)
        weights = counts / counts.sum()
        self.mean = float((weights * ratios).sum())
        self.variance = float((weights * ratios**2).sum()) - self.mean**2
        self.ratios = ratios.tolist()

    def p_plain(self, body: str, encoding: str) -> float:
        """The chance that a plain identifier of as many pairs has as small a sum of ratios. Pairs across a change to upper
        case or beside signs tell nothing; letters beside digits count by PLAIN_SWITCHES."""
        digits = sum(map(str.isdigit, ALPHABETS[encoding])) / len(ALPHABETS[encoding])
        uniform = 2 * digits * (1 - digits)
        change, stay = (math.log(PLAIN_SWITCHES / uniform), math.log((1 - PLAIN_SWITCHES) / (1 - uniform))) if digits else (0.0, 0.0)
        total = mean = variance = 0.0
        switch_mean = PLAIN_SWITCHES * change + (1 - PLAIN_SWITCHES) * stay
        switch_variance = PLAIN_SWITCHES * change**2 + (1 - PLAIN_SWITCHES) * stay**2 - switch_mean**2
        for a, b in zip(body, body[1:], strict=False):
            if a.isalpha() and b.isalpha():
                if not (a.islower() and b.isupper()):
                    total += self.ratios[ord(a.lower()) - 97][ord(b.lower()) - 97]
                    mean, variance = mean + PLAIN_SHARE * self.mean, variance + self.variance
            if a.isalnum() and b.isalnum() and digits:
                total += change if a.isdigit() != b.isdigit() else stay
                mean, variance = mean + switch_mean, variance + switch_variance
        return _normal_tail((mean - total) / math.sqrt(DEPENDENCE * variance)) if variance else 1.0


def letter_pairs(texts: DataFrame) -> np.ndarray:
    """How often each pair of letters (and 26 for anything else) stands in all texts (the only column), outside long runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27 * 27, dtype=np.int64)

        def counted(data: np.ndarray) -> np.ndarray:
            codes = LETTER[data]
            return np.bincount(codes[:-1] * 27 + codes[1:], minlength=27 * 27) if len(codes) > 1 else 0

        for batch in batches:
            for data, _, _ in text_blocks(batch.column(0)):
                total += counted(data)
                for m in LONG_RUN.finditer(data.tobytes()):
                    total -= counted(np.frombuffer(m[0], np.uint8))
        found = np.flatnonzero(total > 0)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["pair", "n"])

    out = np.zeros(27 * 27, dtype=np.int64)
    for row in texts.mapInArrow(released(run), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 729 rows at most
        out[row["pair"]] = row["n"]
    return out


def tested_run(body: str, model: PlainModel) -> tuple[int, float, float] | None:
    """Stratum, p-value of randomness and p-value of plainness; a run of one case is taken without its separators."""
    joined = body
    if body == body.lower() or body == body.upper():
        body = SEPARATORS.sub("", body)
    if len(body) < LENGTH_BANDS[0] or not (encoding := infer_encoding(body)):
        return None
    stratum = ENCODINGS.index(encoding) * len(LENGTH_BANDS) + sum(len(body) >= b for b in LENGTH_BANDS) - 1
    plain = body.translate(URL_SAFE) if encoding in ("base64", "alpha52") else body.lower()
    return stratum, randomness([VALUES[encoding][c] for c in plain], len(ALPHABETS[encoding])), model.p_plain(joined if encoding == "alpha" else body, encoding)


def _pieces(run: str, separators: re.Pattern, least: int) -> Iterator[tuple[int, str]]:
    """(place, piece) of the pieces of at least that length between separators."""
    at = 0
    for m in [*separators.finditer(run), None]:
        piece = run[at : m.start() if m else len(run)]
        if len(piece) >= least:
            yield at, piece
        at = m.end() if m else at


def random_runs(text: str, model: PlainModel) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """(hex spans, (start, end, stratum, p_random, p_plain, and of a part the same five of its whole run) of each tested run and part)."""
    shapes, tested = [], []
    for m in RUN.finditer(text):
        shapes += [(m.start() + h.start(), 2, m.start() + h.end()) for h in HEX.finditer(m[0]) if len(h[0]) >= 24]
        for at, body in _pieces(m[0], EQUALS, LENGTH_BANDS[0]):  # names and values apart
            start, whole = m.start() + at, (None,) * 5
            if found := tested_run(body, model):
                whole = (start, start + len(body), *found)
                tested.append((*whole, *(None,) * 5))
            if SEPARATORS.search(body):
                for at, part in _pieces(body, SEPARATORS, LENGTH_BANDS[0]):
                    if found := tested_run(part, model):
                        tested.append((start + at, start + at + len(part), *found, *whole))
    return shapes, tested


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_FIELDS = {"start": "long", "end": "long", "stratum": "int", "p": "double", "p_plain": "double"}
_FIELDS = _FIELDS | {f"in_{name}": kind for name, kind in _FIELDS.items()}
TEST = pa.struct([(name, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[kind]) for name, kind in _FIELDS.items()])


def scan_texts(docs: DataFrame, keep: list[str], model: PlainModel, text: str = "text") -> DataFrame:
    """keep's columns, base (spans of the fixed shapes) and tested (runs with their p-values)."""
    source = docs.select(*dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, tested = [], []
            for value in batch.column(text):
                value = value.as_py() or ""
                shapes, runs = random_runs(value, model)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in sorted(base_spans(value) + shapes)])
                tested.append([dict(zip(_FIELDS, r, strict=True)) for r in runs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(base, pa.list_(SPAN)), pa.array(tested, pa.list_(TEST))], names=[*keep, "base", "tested"]
            )

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.select(*keep).schema)
    test = ",".join(f"{name}:{kind}" for name, kind in _FIELDS.items())
    return source.mapInArrow(released(run), f"{kept}base array<struct<start:long,kind:int,end:long>>, tested array<struct<{test}>>")


def discovery_limits(scanned: DataFrame, rate: float, least_random: float) -> dict[int, float]:
    """By stratum the largest p-value at which Benjamini and Hochberg's step rejects plainness, among the runs outside base
    spans for which the battery does not reject randomness.

    p-values are rounded up to bins, which keeps the step conservative; strata and bins are fixed in number.
    """
    level = F.greatest(F.ceil(F.log10(F.greatest("t.p_plain", F.lit(LEAST_P))) * P_BINS_PER_DECADE), F.lit(math.log10(LEAST_P) * P_BINS_PER_DECADE))
    runs = scanned.select(F.explode(F.filter("tested", lambda t: _apart(t, "") & (t["p"] >= least_random))).alias("t"))
    counts = runs.groupBy(F.col("t.stratum").alias("stratum"), level.cast("int").alias("level")).count()
    limits: dict[int, float] = {}
    by_stratum: dict[int, list[tuple[int, int]]] = {}
    for row in counts.collect():  # at most strata x bins rows, whatever the input
        by_stratum.setdefault(row["stratum"], []).append((row["level"], row["count"]))
    for stratum, found in by_stratum.items():
        total, before = sum(n for _, n in found), 0
        for level, n in sorted(found):
            before += n
            edge = 10 ** (level / P_BINS_PER_DECADE)
            if edge <= rate * before / total:
                limits[stratum] = edge
    return limits


def _apart(t: Column, of: str) -> Column:
    """Whether a run overlaps no base span."""
    return ~F.exists("base", lambda b: (b["start"] < t[f"{of}end"]) & (t[f"{of}start"] < b["end"]))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, keep: list[str], text: str = "text", rate: float = 0.01, least_random: float = 0.001, scan_twice: bool = False) -> DataFrame:
    """Per row of docs: keep's columns, base and spans (arrays of start, kind, end by start and kind, in code points,
    end exclusive), n_assign, n_access, n_hex, base_sha256 and spans_text.

    spans adds to base the runs that are not plain, look random and overlap no base span. `rate` bounds the share of
    plain strings among those (false discoveries); `least_random` is the p-value under which the battery takes a run for not
    random. With scan_twice, for keep columns that are large, only p-values are written between the two passes, and
    texts are scanned again. Null and empty texts have no spans; repeated rows are tested as often as they occur; a very
    long text is scanned whole in one task; an empty table gives an empty result. keep must not hold a result's name.
    """
    refuse_clashes(keep, ["base", "tested", "spans", "n_assign", "n_access", "n_hex", "base_sha256", "spans_text"])
    model = PlainModel(letter_pairs(docs.select(text)))
    scanned = saved(scan_texts(docs, [] if scan_twice else keep, model, text))
    limits = discovery_limits(scanned, rate, least_random)
    if scan_twice:
        scanned = scan_texts(docs, keep, model, text)

    def looks_random(t: Column, of: str) -> Column:
        found = F.lit(False)
        for stratum, edge in sorted(limits.items()):
            found = found | ((t[f"{of}stratum"] == stratum) & (t[f"{of}p_plain"] <= edge))
        return _apart(t, of) & found & (t[f"{of}p"] >= least_random)

    def stays(t: Column) -> Column:  # a part only where its whole run does not stay
        return looks_random(t, "") & (t["in_stratum"].isNull() | ~looks_random(t, "in_"))

    added = F.transform(F.filter("tested", stays), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    spans = F.array_sort(F.concat("base", added))

    def counted(kind: int) -> Column:
        return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return scanned.select(*keep, "base", spans.alias("spans"), *map(counted, range(3)), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(spans).alias("spans_text"))


def redacted(spanned: DataFrame, keep: list[str], text: str = "text", mask: str = "[secret]") -> DataFrame:
    """keep's columns and redacted: the text with each covered stretch of spans replaced by mask; rows without spans stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, spans in zip(batch.column(text), batch.column("spans"), strict=True):
                value, spans = value.as_py(), spans.as_py()
                if value is not None and spans:
                    parts, at = [], 0
                    for s in spans:
                        if s["start"] >= at:
                            parts += [value[at : s["start"]], mask]
                        at = max(at, s["end"])
                    value = "".join(parts) + value[at:]
                out.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(out, pa.string())], names=[*keep, "redacted"])

    source = spanned.select(*dict.fromkeys([*keep, text, "spans"]))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.select(*keep).schema)
    return source.mapInArrow(released(run), f"{kept}redacted string")
