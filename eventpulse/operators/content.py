"""Features of long texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventpulse.functions.numbers import rounded
from eventpulse.functions.terms import scan_terms
from eventpulse.functions.text import no_spaces, occurrences, shown_terms
from eventpulse.operators.rules import Comparison, Score, all_hold, first_that_holds, label_by, score_of


def theme_features(df: DataFrame, text: str, themes: dict[str, list[str]], event: str, terms: list[str], noise: list[str]) -> DataFrame:
    """Per theme count and flag, event keyword count and flag, matched terms, noise flag."""
    counted = count_keywords(df, text, {f"{t}_count": words for t, words in themes.items()} | {"event_count": [event], "_noise": noise}, {"terms": terms})
    out = counted.withColumns({f"{t}_flag": F.col(f"{t}_count") > 0 for t in themes})
    return out.withColumns({"noise_risk": F.col("_noise") > 2, "event_present": F.col("event_count") > 0}).drop("_noise")


def count_keywords(df: DataFrame, text: str, counts: dict[str, list[str]], found: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds counts of keywords and lists of found terms, in one pass over a text that is made plain once."""
    found = found or {}
    scanned = df.withColumn("_found", scan_terms(no_spaces(text), counts, {n: shown_terms(t) for n, t in found.items()}))
    new = {n: F.col(f"_found.c{i}") if n in counts else F.array_join(f"_found.c{i}", ";") for i, n in enumerate([*counts, *found])}
    return scanned.withColumns(new).drop("_found")


def match_terms_by(df: DataFrame, row: str, text: str, dictionary: DataFrame, out: str, most: int = 1_000_000) -> DataFrame:
    """Adds the aliases of the dictionary's terms (term, alias or null) that the text holds, ignoring case and spaces, by
    longest term, then name, each once. row is a key of df. A dictionary of at most `most` terms becomes one automaton in
    each task, run once over a text whatever its size; a larger one is joined by the first three characters of its terms (shorter ones by
    the automaton)."""
    terms = dictionary.select(no_spaces("term").alias("key"), F.coalesce("alias", "term").alias("alias")).filter("key <> ''").distinct()
    entry = F.struct((-F.length("key")).alias("n"), "key", "alias")
    small = dictionary.limit(most + 1).count() <= most
    near = terms.filter(F.lit(True) if small else F.length("key") < 3).limit(most + 1).collect()  # at most `most`, or the few short ones
    if len(near) > most:
        raise ValueError(f"over {most} different terms of fewer than three characters")
    listed = sorted({(-len(t.key), t.key, t.alias) for t in near})
    if small:
        return df.withColumn(out, F.array_join(scan_terms(no_spaces(text), found={out: [(k, a) for _, k, a in listed]})["c0"], ";"))
    shown = [(k, "\u0001".join((k, a))) for _, k, a in listed]
    held = df.withColumn("_plain", no_spaces(text)).withColumn("_held", scan_terms(F.col("_plain"), found={out: shown})["c0"])
    parts = F.transform("_held", lambda t: F.split(t, "\u0001"))
    found = held.withColumn("_found", F.transform(parts, lambda t: F.struct((-F.length(t[0])).alias("n"), t[0].alias("key"), t[1].alias("alias")))).drop("_held")
    if not small:
        gram = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(F.col(c), i, F.lit(3))))
        grams = found.filter(F.length("_plain") >= 3).select(F.col(row).alias("_row"), "_plain", F.explode(gram("_plain")).alias("_gram"))
        met = grams.join(terms.filter(F.length("key") >= 3).withColumn("_gram", F.substring("key", 1, 3)), "_gram").filter(F.contains("_plain", "key"))
        more = met.groupBy("_row").agg(F.collect_list(entry).alias("_more"))
        found = found.join(more, F.col(row) == F.col("_row"), "left").withColumn("_found", F.concat("_found", F.coalesce("_more", F.array().cast("array<struct<n:int,key:string,alias:string>>")))).drop("_row", "_more")
    named = F.array_distinct(F.transform(F.array_sort("_found"), lambda t: t["alias"]))
    return found.withColumn(out, F.array_join(named, ";")).drop("_plain", "_found")


def primary_theme(df: DataFrame, priority: list[str]) -> DataFrame:
    """Theme with most hits, ties by priority, none: unclear."""
    best = F.array_max(F.array(*[F.struct(F.col(f"{t}_count").alias("n"), F.lit(-i).alias("p"), F.lit(t).alias("t")) for i, t in enumerate(priority)]))
    return df.withColumn("primary_theme", F.when(best["n"] == 0, "unclear").otherwise(best["t"]))


def theme_summary(df: DataFrame, themes: list[str], length: str) -> DataFrame:
    """Per theme: texts, texts with the event keyword, mean length."""
    rows = df.withColumn("theme", F.explode(F.array_compact(F.array(*[F.when(F.col(f"{t}_flag"), F.lit(t)) for t in themes]))))
    return rows.groupBy("theme").agg(F.count("*").alias("mentions"), F.count_if("event_present").alias("with_event"), rounded(F.avg(length), 2).alias("mean_length"))


def term_theme_summary(df: DataFrame) -> DataFrame:
    term = F.explode(F.when(F.col("terms") == "", F.array(F.lit("UNMATCHED"))).otherwise(F.split("terms", ";")))
    return df.withColumn("term", term).groupBy("term").agg(F.count("*").alias("mentions"), F.count_if("event_present").alias("with_event"), F.count_distinct("primary_theme").alias("themes"))


def number_of_terms(terms: str) -> Column:
    return F.when(F.col(terms) == "", 0).otherwise(F.size(F.split(terms, ";")))


def scored_and_labelled(df: DataFrame, score: str, spec: Score, label: str, table: list[tuple[str, list[Comparison]]], otherwise: str) -> DataFrame:
    """Adds a score (relevance, depth, emotion) by its specification and a label by the first row of its table that holds;
    the table may name the score."""
    return df.withColumn(score, score_of(spec)).withColumn(label, label_by(table, otherwise))


def exclamation_marks(text: str) -> Column:
    return occurrences(F.coalesce(F.col(text), F.lit("")), "!")


def typed_posts(df: DataFrame, risks: list, no_risk: str, types: list, no_type: str, reviews: list[list[Comparison]]) -> DataFrame:
    """Adds topic_risk and post_type by tables, and manual_review, whether all comparisons of any of `reviews` hold."""
    review = reduce(lambda a, b: a | b, map(all_hold, reviews))
    return df.withColumns({"topic_risk": label_by(risks, no_risk), "post_type": label_by(types, no_type), "manual_review": review})


def post_type_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("post_type").agg(F.count("*").alias("mentions"), *[rounded(F.avg(c), 2).alias(f"mean_{c}") for c in ("relevance", "depth", "emotion")], F.count_if("manual_review").alias("manual_reviews"))


def quality_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("relevance_level", "depth_label", "tone").agg(F.count("*").alias("mentions"), F.count_if("manual_review").alias("manual_reviews"), rounded(F.avg("chars"), 2).alias("mean_chars"))


def block_theme_counts(blocks: DataFrame, page: str, text: str, themes: dict[str, list[str]]) -> DataFrame:
    """Blocks per page and first-hit theme, unmatched as other, with the page's blocks and number of themes."""
    scanned = blocks.withColumn("_found", scan_terms(no_spaces(text), themes))
    label = first_that_holds([(F.col(f"_found.c{i}") > 0, t) for i, t in enumerate(themes)], "other")
    counts = scanned.groupBy(page, label.alias("theme")).agg(F.count("*").alias("blocks"))
    pages = counts.groupBy(page).agg(F.sum("blocks").alias("page_blocks"), F.count_if(F.col("theme") != "other").alias("page_themes"))
    return counts.join(pages, page)
