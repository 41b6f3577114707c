"""Tables of rules as column expressions: the first that holds decides, scores are adjusted in order, or terms are added up."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_that_holds(rules: Sequence[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first rule whose condition holds."""
    return reduce(lambda rest, rule: F.when(rule[0], F.lit(rule[1])).otherwise(rest), reversed(rules), F.lit(otherwise))


def band_of(value: Column, bands: Sequence[tuple[float, object]], otherwise: object) -> Column:
    """The label of the first band (least value, label) that the value reaches."""
    return first_that_holds([(value >= least, label) for least, label in bands], otherwise)


def capped_sum(terms: Sequence[tuple[Column, float, float | None]], start: float = 0.0, low: float | None = None, high: float | None = None) -> Column:
    """start and all terms (value, weight, cap): each counts weight times its value, but no more than its cap; the sum stays
    between low and high."""
    total = F.lit(start)
    for value, weight, cap in terms:
        term = value * weight
        total = total + (term if cap is None else F.least(term, F.lit(cap)))
    total = total if low is None else F.greatest(total, F.lit(low))
    return total if high is None else F.least(total, F.lit(high))


@dataclass(frozen=True)
class Adjustment:
    """A change of a score where a condition holds: set, floor, cap or add; `text` is noted, alone if it replaces the notes so far."""

    condition: str
    effect: str
    value: float
    text: str
    replaces: bool = False


EFFECTS: dict[str, Callable[[Column, Column], Column]] = {"floor": F.greatest, "cap": F.least, "add": lambda score, value: score + value}


def adjusted(df: DataFrame, score: str, notes: str, table: Sequence[Adjustment], conditions: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """df with its column `score` changed by the table in order and its text column `notes` prolonged. A condition is a function
    of the score as it is by then; where a rule of effect set holds, the first of them decides alone."""
    fixed = [r for r in table if r.effect == "set"]
    for rule in (r for r in table if r.effect != "set"):
        df = df.withColumn("_holds", F.coalesce(conditions[rule.condition](F.col(score)), F.lit(False)))
        text = F.lit(rule.text) if rule.replaces else F.concat_ws("+", notes, F.lit(rule.text))
        df = df.withColumns({score: F.when(F.col("_holds"), EFFECTS[rule.effect](F.col(score), F.lit(rule.value))).otherwise(F.col(score)), notes: F.when(F.col("_holds"), text).otherwise(F.col(notes))})
    if fixed:
        holds = [F.coalesce(conditions[r.condition](F.col(score)), F.lit(False)) for r in fixed]
        df = df.withColumn("_set", F.coalesce(*[F.when(h, F.lit(i)) for i, h in enumerate(holds)]))
        values, texts = F.array(*[F.lit(r.value) for r in fixed]), F.array(*[F.lit(r.text) for r in fixed])
        df = df.withColumns({score: F.when(F.col("_set").isNull(), F.col(score)).otherwise(F.get(values, F.col("_set"))), notes: F.when(F.col("_set").isNull(), F.col(notes)).otherwise(F.get(texts, F.col("_set")))}).drop("_set")
    return df.drop("_holds")


#: A comparison: column, operator, value (a text is another column's name).
Comparison = tuple[str, str, object]
OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    ">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b, "=": lambda a, b: a == b, "starts": lambda a, b: F.startswith(a, b),
}


def all_hold(comparisons: Sequence[Comparison]) -> Column:
    """Whether all comparisons hold; one with a null doesn't."""
    other = lambda op, v: F.col(v) if isinstance(v, str) and op != "starts" else F.lit(v)
    return F.coalesce(reduce(lambda a, b: a & b, [OPERATORS[op](F.col(c), other(op, v)) for c, op, v in comparisons], F.lit(True)), F.lit(False))


def label_by(table: Sequence[tuple[str, Sequence[Comparison]]], otherwise: str) -> Column:
    """The first label of the table (label, comparisons) all of whose comparisons hold."""
    return first_that_holds([(all_hold(comparisons), label) for label, comparisons in table], otherwise)


@dataclass(frozen=True)
class Term:
    """A part of a score: weight times a column, or weight alone where all comparisons hold; no more than the cap."""

    weight: float
    column: str | None = None
    when: Sequence[Comparison] = ()
    cap: float | None = None


@dataclass(frozen=True)
class Score:
    """A capped linear score: terms, the points of the highest band that each banded column reaches, a ceiling where its
    comparisons hold, all between low and high."""

    terms: Sequence[Term]
    bands: Sequence[tuple[str, Sequence[tuple[float, float]]]] = ()
    ceiling: tuple[Sequence[Comparison], float] | None = None
    low: float = 0
    high: float = 100


def score_of(spec: Score) -> Column:
    """A score as a whole number."""
    parts = [(F.col(t.column) if t.column else F.when(all_hold(t.when), 1).otherwise(0), t.weight, t.cap) for t in spec.terms]
    parts += [(band_of(F.col(column), bands, 0), 1, None) for column, bands in spec.bands]
    total = capped_sum(parts, 0)
    if spec.ceiling:
        total = F.when(all_hold(spec.ceiling[0]), F.least(total, F.lit(spec.ceiling[1]))).otherwise(total)
    return F.greatest(F.lit(spec.low), F.least(F.lit(spec.high), total)).cast("long")
