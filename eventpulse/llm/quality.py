"""Quality rules with verdicts on whole hosts.

Each text is measured once, in Arrow batches. Several rules judge the measures; their failures are summed by host in a
grouped aggregation. For each rule, and for failing any of them, an empirical beta prior over all hosts, fitted by
moments, shrinks the hosts' rates to the common one; a host one of whose shrunken rates is surely over that rule's limit
is rejected, and the verdicts are joined back. The limits follow the fitted priors or are fixed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import refuse_clashes, saved
from .wordblocks import chain, hash_spans, mix, released, word_blocks

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = (*MEASURES, "n_lines")
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    codes, seen = pd.factorize(keys)
    return np.bincount(codes, minlength=len(seen))[codes] > 1 if len(keys) else np.zeros(0, dtype=bool)


def _block_measures(block) -> dict[str, np.ndarray]:
    data, n = block.data, block.n
    out = {
        "n_words": block.n_words,
        "word_chars": block.per_doc(block.inside & ((data & 0xC0) != 0x80)),
        "n_symbols": block.per_doc(SYMBOLS[data]),
    }
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(block.bounds[:-1][block.bounds[:-1] < len(data)], breaks + 1)
    starts = starts[starts < len(data)]
    stops = np.append(starts[1:], len(data))
    ends = stops - ((stops > starts) & (data[np.maximum(stops - 1, 0)] == 10))
    has_word = np.searchsorted(block.starts, ends) > np.searchsorted(block.starts, starts)
    starts, ends = starts[has_word], ends[has_word]
    doc = np.searchsorted(block.bounds, starts, side="right") - 1
    with np.errstate(over="ignore"):
        salt = mix(np.arange(1, n + 1, dtype=np.uint64))
        _, first = np.unique(hash_spans(data, starts, ends) + salt[doc], return_index=True)
    out["n_lines"] = np.bincount(doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(doc[first], minlength=n)
    doc = block.doc_of_words()
    covered = np.zeros(len(doc), dtype=bool)
    if len(doc) > 2:
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        with np.errstate(over="ignore"):
            again = inside[_repeats(chain(block.word_hashes(), 3)[inside] + salt[doc[inside]])]
        for i in range(3):
            covered[again + i] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    return out


def measure_texts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of keep, and per row n_words, word_chars (code points in words), n_symbols, n_dup_lines
    (lines with a word that equal an earlier line), n_repeat_words (words covered by three-word windows
    that occur twice or more) and n_lines (lines with a word). A null text counts as empty."""
    refuse_clashes(keep, [*MEASURED])
    source = docs.select(*dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in word_blocks(batch.column(text)):
                found, part = _block_measures(block), batch.slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(found[m].astype(np.int64)) for m in MEASURED], names=[*keep, *MEASURED]
                )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema] + [f"{m} long" for m in MEASURED])
    return source.mapInArrow(released(run), schema)


def base_failure(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def failures(min_words: int = 50, max_repeat_percent: int = 50, max_symbol_percent: int | None = 20, max_dup_line_percent: int | None = 30, min_word_chars: int | None = 2) -> dict[str, Column]:
    """Whether a text fails each rule: too few words; too many words in repeated three-word windows; more symbols than that
    share of the words; more repeated lines than that share of the lines; fewer code points a word. None leaves a rule
    out. Long words are no fault: scripts without spaces have them. `any` is the failure of at least one rule."""
    out = {"words": F.col("n_words") < min_words, "repeats": 100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")}
    if max_symbol_percent is not None:
        out["symbols"] = 100 * F.col("n_symbols") > max_symbol_percent * F.col("n_words")
    if max_dup_line_percent is not None:
        out["lines"] = 100 * F.col("n_dup_lines") > max_dup_line_percent * F.col("n_lines")
    if min_word_chars is not None:
        out["short"] = F.col("word_chars") < min_word_chars * F.col("n_words")
    return out | {"any": functools.reduce(lambda a, b: a | b, out.values())}


def host_verdicts(measured: DataFrame, host: str, failed: dict[str, Column], limit: float | None = None, certainty: float = 3.0, odds: float = 3.0, least_limit: float = 0.2) -> DataFrame:
    """One row per non-null host: host, n_docs, failure_rate (the shrunken rate of `any`) and host_kept.

    A rule's beta prior (a, b) matches mean and between-host variance of the hosts' rates. A host is rejected when for some
    rule its posterior mean lies more than `certainty` posterior standard deviations above the limit. Without a fixed limit
    that is the rate with `odds` times the odds of the prior's mean, or least_limit if that is more: average hosts stay.
    """
    hosts = measured.filter(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n_docs"), *[F.count_if(f).alias(f"k_{rule}") for rule, f in failed.items()])
    share = {rule: F.col(f"k_{rule}") / F.col("n_docs") for rule in failed}
    prior = hosts.agg(
        F.sum("n_docs").alias("n"), F.avg(1 / F.col("n_docs")).alias("per_doc"),
        *[F.sum(f"k_{rule}").alias(f"sum_{rule}") for rule in failed], *[F.var_pop(rate).alias(f"spread_{rule}") for rule, rate in share.items()],
    ).first()
    kept, rates = F.lit(True), {}
    for rule in failed:
        mean = min(max((prior[f"sum_{rule}"] or 0) / max(prior["n"] or 1, 1), 1e-6), 1 - 1e-6)
        noise = mean * (1 - mean)
        between = max((prior[f"spread_{rule}"] or 0) - noise * (prior["per_doc"] or 0), 1e-9)
        weight = min(max(noise / between - 1, 1.0), 1e4)
        most = max(odds * mean / (1 - mean + odds * mean), least_limit) if limit is None else limit
        total = F.col("n_docs") + F.lit(weight)
        rates[rule] = (F.col(f"k_{rule}") + F.lit(mean * weight)) / total
        deviation = F.sqrt(rates[rule] * (1 - rates[rule]) / (total + 1))
        kept = kept & (rates[rule] - certainty * deviation <= most)
    return hosts.select(host, "n_docs", rates["any"].alias("failure_rate"), kept.alias("host_kept"))


def quality_rules(docs: DataFrame, keep: list[str], host: str = "source", text: str = "text", host_limit: float | None = None, **limits: int | None) -> DataFrame:
    """Per row of docs: keep's columns, the measures, base_failed, failure_rate of its host and kept.

    kept is false where a rule of failures(**limits) fails, else the host's verdict; rows without a host have none and are
    kept. Null and empty texts fail (no words). Repeated rows count as often as they occur. A very long text is measured
    whole in one task. An empty table gives an empty result. keep must not hold a result's name.
    """
    refuse_clashes(keep, [*MEASURED, "base_failed", "failure_rate", "kept", "_host", "_judged", "_failed"])
    failed = failures(**limits)
    base = {k: v for k, v in limits.items() if k in ("min_words", "max_repeat_percent")}
    source = docs.select(*keep, F.col(host).alias("_host"), F.col(text).alias("_body"))
    measured = saved(measure_texts(source, [*keep, "_host"], "_body").withColumns({"base_failed": base_failure(**base), "_failed": failed["any"]}))
    verdicts = host_verdicts(measured, "_host", failed, host_limit).withColumnRenamed("_host", "_judged")
    joined = measured.join(verdicts, F.col("_host") == F.col("_judged"), "left")
    return joined.select(*keep, *MEASURES, "base_failed", "failure_rate", (~F.col("_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"))


def kept_by_quality(docs: DataFrame, host: str = "source", text: str = "text", host_limit: float | None = None, **limits: int | None) -> DataFrame:
    """The rows of docs that quality_rules keeps, with their columns, whatever these are named. Texts are measured twice, so
    that only hosts and failures, not texts, are written in between."""
    columns, failed = docs.columns, failures(**limits)
    light = measure_texts(docs.select(F.col(host).alias("_host"), F.col(text).alias("_body")), ["_host"], "_body")
    light = saved(light.select("_host", *[f.alias(rule) for rule, f in failed.items()]))
    verdicts = host_verdicts(light, "_host", {rule: F.col(rule) for rule in failed}, host_limit).filter(~F.col("host_kept")).select(F.col("_host").alias("_rejected"))
    others = F.struct(*[c for c in columns if c != text]).alias("_row")
    measured = measure_texts(docs.select(others, F.col(text).alias("_body")), ["_row", "_body"], "_body").filter(~failed["any"])
    kept = measured.join(verdicts, F.col("_row")[host] == F.col("_rejected"), "left_anti")
    return kept.select(*[F.col("_body").alias(c) if c == text else F.col("_row")[c].alias(c) for c in columns])
