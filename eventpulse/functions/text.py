"""Text, number and date functions. "" stands for a missing string; null counts as missing too."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventpulse.functions.registry import Registry
from eventpulse.functions.terms import scan_terms

ANY_SPACE = r"[\s\x0B\x85\p{Z}]"


#: The patterns of e-mail addresses, phones and signed numbers, and the characters that a normal form leaves out.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d{2,3}[-. ]\d{3,4}[-. ]\d{4}"
SIGNED_NUMBER = r"-?\d+(?:\.\d+)?"
NOT_KEPT = "[^0-9a-z가-힣]+"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Column | str) -> Column:
    """Neither null nor blank."""
    return F.trim(F.coalesce(as_column(c), F.lit(""))) != ""


def compact_spaces(c: Column | str) -> Column:
    """Null to "", each run of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(as_column(c), F.lit("")), f"{ANY_SPACE}+", " "))


def no_spaces(c: Column | str) -> Column:
    """Lower case without any white space, for keyword search. Texts whose only white space is ASCII are spared the
    regular expression."""
    low = F.lower(F.coalesce(as_column(c), F.lit("")))
    plain = reduce(lambda x, space: F.replace(x, F.lit(space), F.lit("")), " \n\t\r\v\f", low)
    wide = (F.octet_length(low) != F.length(low)) & low.rlike(r"[\x85\p{Z}&&[^ ]]")
    return F.when(wide, F.regexp_replace(low, f"{ANY_SPACE}+", "")).otherwise(plain)


def normalize_text(c: Column | str) -> Column:
    """Lower case, each run of other than letters and digits to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(as_column(c), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def join_key(c: Column | str) -> Column:
    return F.replace(normalize_text(c), F.lit(" "), F.lit(""))


def nfkc_key(c: Column | str) -> Column:
    """NFKC, lower case, without (...), only digits, Latin letters and Hangul."""
    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.fillna("").str.normalize("NFKC")

    return F.regexp_replace(F.regexp_replace(F.lower(nfkc(as_column(c))), r"\([^)]*\)", ""), NOT_KEPT, "")


def bare_key(c: Column | str, drop_brackets: bool = True) -> Column:
    """Lower case letters and digits only, without [...] and (...) if asked for."""
    out = F.lower(F.coalesce(as_column(c), F.lit("")))
    if drop_brackets:
        out = F.regexp_replace(F.regexp_replace(out, r"\[[^\]]*\]", ""), r"\([^)]*\)", "")
    return F.regexp_replace(out, r"[^\p{L}\p{N}]+", "")


def first_number(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(F.replace(F.coalesce(as_column(c), F.lit("")), F.lit(","), F.lit("")), SIGNED_NUMBER, 0), F.lit(""))


def safe_float(c: Column | str) -> Column:
    """First signed number of a text, commas dropped; null if none."""
    return first_number(c).try_cast("double")


def safe_int(c: Column | str, default: int | None = None) -> Column:
    """Whole part of the first signed number; default if none."""
    number = F.nullif(F.regexp_extract(F.replace(F.coalesce(as_column(c), F.lit("")), F.lit(","), F.lit("")), r"-?\d+", 0), F.lit("")).try_cast("long")
    return number if default is None else F.coalesce(number, F.lit(default).cast("long"))


def ticket_count(c: Column | str, allowed: list[int]) -> Column:
    """The first number of a text if it is an allowed count."""
    number = safe_int(c)
    return F.when(number.isin(allowed), number)


def ordered_label(c: Column | str, rules: list[tuple[str, list[str]]], default: str | None) -> Column:
    """Label of the first rule of which the text holds some keyword."""
    text, out = F.coalesce(as_column(c), F.lit("")), F.lit(default)
    for label, keywords in reversed(rules):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in keywords]), F.lit(label)).otherwise(out)
    return out


method_group = ordered_label
classify_by_keywords = ordered_label


def bracket_label(c: Column | str) -> Column:
    return F.trim(F.regexp_extract(F.coalesce(as_column(c), F.lit("")), r"\[([^\]]*)\]", 1))


def strip_bracket(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(as_column(c), F.lit("")), r"^\s*\[[^\]]*\]\s*", ""))


def escaped(term: str) -> str:
    """A literal as a regular expression."""
    return "".join("\\" + ch if not ch.isalnum() and not ch.isspace() else ch for ch in term)


def canonicalize(c: Column | str, registry: Registry) -> Column:
    """The registry's canonical form of a text (see Registry.canonical)."""
    return registry.column(compact_spaces(c))


def canonical_title(c: Column | str, registry: Registry) -> Column:
    """[canonical label] and the body."""
    label, body = bracket_label(c), strip_bracket(c)
    return F.when(label == "", body).otherwise(F.concat(F.lit("["), canonicalize(label, registry), F.lit("] "), body))


def canonical_key(c: Column | str, registry: Registry) -> Column:
    return join_key(canonical_title(c, registry))


def title_candidate(c: Column | str, longest: int = 40) -> Column:
    """The title without a trailing (...) of at most `longest` characters."""
    return F.trim(F.regexp_replace(as_column(c), r"\s*\([^()]{0,%d}\)\s*$" % longest, ""))


def known_titles(frames: list[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct titles over several tables."""
    parts = [df.select(compact_spaces(column).alias("title")) for df, column in frames]
    return reduce(DataFrame.unionByName, parts).filter("title <> ''").distinct()


def base_title(df: DataFrame, column: str, known: DataFrame | None, out: str = "base_title") -> DataFrame:
    """Adds the title without its trailing (...), if what is left is a known title; always, where known is None."""
    title = compact_spaces(column)
    if known is None:
        return df.withColumn(out, title_candidate(title))
    names = known.select(F.col("title").alias("_known"))
    return df.withColumn("_short", title_candidate(title)).join(names, F.col("_short") == F.col("_known"), "left").withColumn(out, F.when(F.col("_known").isNotNull(), F.col("_short")).otherwise(title)).drop("_short", "_known")


def rewrite_terms(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Ordered regular-expression rewrites, ignoring case."""
    return reduce(lambda text, rule: F.regexp_replace(text, f"(?i){rule[0]}", rule[1]), rules, as_column(c))


def parse_date_lenient(c: Column | str, year: int | None = None) -> Column:
    """ISO with a zone to the UTC day; else the first ten characters, eight digits, `yyyy. m. d`, or `m.d` of a given year."""
    text = F.trim(F.coalesce(as_column(c), F.lit("")))
    zoned = F.when(text.rlike(r"T.*(?:Z|[+-]\d\d:?\d\d)$"), F.to_date(F.try_to_timestamp(text)))
    dotted = F.regexp_replace(F.regexp_extract(text, r"^(\d{4})\. ?(\d{1,2})\. ?(\d{1,2})\.?$", 0), r"^(\d{4})\. ?(\d{1,2})\. ?(\d{1,2})\.?$", "$1-$2-$3")
    options = [zoned, text.substr(1, 10).try_cast("date"), F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")), F.nullif(dotted, F.lit("")).try_cast("date")]
    if year is not None:
        short = F.regexp_replace(F.regexp_extract(text, r"^(\d{1,2})\.(\d{1,2})$", 0), r"^(\d{1,2})\.(\d{1,2})$", f"{year}-$1-$2")
        options.append(F.nullif(short, F.lit("")).try_cast("date"))
    full = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), options[1])
    return F.coalesce(options[0], full, *options[2:])


def normalize_time(c: Column | str) -> Column:
    """h:mm to hh:mm, ; to :, blanks out; "" if there is no time."""
    text = F.regexp_replace(F.replace(F.coalesce(as_column(c), F.lit("")), F.lit(";"), F.lit(":")), r"\s+", "")
    hour, minute = F.regexp_extract(text, r"(\d{1,2}):(\d{2})", 1), F.regexp_extract(text, r"(\d{1,2}):(\d{2})", 2)
    return F.when(hour == "", F.lit("")).otherwise(F.concat(F.lpad(hour, 2, "0"), F.lit(":"), minute))


def parse_time_range(df: DataFrame, column: str, year: int) -> DataFrame:
    """Adds class_date, start_at, end_at, start_hour, duration_minutes, time_status and needs_review from
    `m.d (w) hh:mm-hh:mm`; an end not after the start lies on the next day."""
    pattern = r"(\d{1,2})\.\s*(\d{1,2})\s*\(([^)]*)\)\s*(\d{1,2}:\d{2})\s*[-~]\s*(\d{1,2}:\d{2})"
    text = F.coalesce(F.col(column), F.lit(""))
    part = [F.regexp_extract(text, pattern, i) for i in range(6)]
    day = F.concat(F.lit(f"{year}-"), F.lpad(part[1], 2, "0"), F.lit("-"), F.lpad(part[2], 2, "0"))
    start = F.try_to_timestamp(F.concat(day, F.lit(" "), F.lpad(part[4], 5, "0")), F.lit("yyyy-MM-dd HH:mm"))
    end = F.try_to_timestamp(F.concat(day, F.lit(" "), F.lpad(part[5], 5, "0")), F.lit("yyyy-MM-dd HH:mm"))
    good = start.isNotNull() & end.isNotNull()
    out = df.withColumn("start_at", F.when(good, start)).withColumn("_end", F.when(good, end))
    out = out.withColumn("end_at", F.when(F.col("_end") <= F.col("start_at"), F.col("_end") + F.expr("interval 1 day")).otherwise(F.col("_end"))).drop("_end")
    return (
        out.withColumn("class_date", F.to_date("start_at"))
        .withColumn("weekday_text", F.when(F.col("start_at").isNotNull(), part[3]).otherwise(F.lit("")))
        .withColumn("start_hour", F.hour("start_at").cast("long"))
        .withColumn("duration_minutes", ((F.unix_timestamp("end_at") - F.unix_timestamp("start_at")) / 60))
        .withColumn("time_status", F.when(F.col("start_at").isNull(), F.lit("unparsed")).otherwise(F.lit("parsed")))
        .withColumn("needs_review", F.col("start_at").isNull())
    )


def truthy(c: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(as_column(c).cast("string"), F.lit("")))).isin("true", "1", "yes", "y")


def ellipsize(c: Column | str, most: int = 160) -> Column:
    text = compact_spaces(c)
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def first_sentence(c: Column | str, most: int = 180) -> Column:
    """Up to the first sentence end, cut at `most` characters."""
    text = compact_spaces(c)
    found = F.regexp_extract(text, r"^(.*?[.!?。])(?:\s|$)", 1)
    return F.substring(F.when(found == "", text).otherwise(found), 1, most)


def tag_flags(df: DataFrame, column: str, tags: dict[str, str]) -> DataFrame:
    """Adds a boolean for each tag's pattern, and all as tags_json with sorted keys."""
    text = F.coalesce(F.col(column), F.lit(""))
    out = df.withColumns({f"tag_{t}": text.rlike(p) for t, p in tags.items()})
    return out.withColumn("tags_json", F.to_json(F.struct(*[F.col(f"tag_{t}").alias(t) for t in sorted(tags)])))



def mask_contacts(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(as_column(c), F.lit("")), EMAIL, "[email]"), PHONE, "[phone]")


def path_part(c: Column | str, i: int, fallback: str = "") -> Column:
    """The i-th (from 0) non-empty part of a path."""
    parts = F.filter(F.split(F.coalesce(as_column(c), F.lit("")), "/"), lambda p: F.trim(p) != "")
    return F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit(fallback))


def classify_path(c: Column | str, rules: list[tuple[str, str, str]], default: str) -> Column:
    """Label of the first of the rules (kind, needle, label) that holds; kind: prefix, contains or suffix."""
    text = F.lower(F.coalesce(as_column(c), F.lit("")))
    tests = {"prefix": F.startswith, "contains": F.contains, "suffix": F.endswith}
    out = F.lit(default)
    for kind, needle, label in reversed(rules):
        out = F.when(tests[kind](text, F.lit(needle)), F.lit(label)).otherwise(out)
    return out


def json_tag_counts(df: DataFrame, column: str, tags: list[str], by: list[str]) -> DataFrame:
    """Rows whose JSON holds a truthy tag, by group; bad JSON counts as none."""
    flags = F.from_json(F.col(column), "map<string,string>", {"mode": "PERMISSIVE"})
    return df.withColumn("_tags", flags).groupBy(*by).agg(F.count("*").alias("rows"), *[F.count_if(truthy(F.try_element_at("_tags", F.lit(t)))).alias(f"{t}_count") for t in tags])


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def keyword_count(c: Column | str, terms: list[str], plain: bool = False) -> Column:
    """Occurrences of all terms, ignoring case and spaces, those of one term not overlapping; plain tells that c is a no_spaces
    column already."""
    return scan_terms(as_column(c) if plain else no_spaces(c), {"n": terms})["c0"]


def shown_terms(terms: list[str], aliases: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(term, what is shown of it), longest first, then by name."""
    return [(t, (aliases or {}).get(t, t)) for t in sorted(set(terms), key=lambda t: (-len(t), t))]


def matched_terms(c: Column | str, terms: list[str], aliases: dict[str, str] | None = None, plain: bool = False) -> Column:
    """Array of the terms that the text holds, longest first, then by name; aliased, each once; plain as in keyword_count."""
    return scan_terms(as_column(c) if plain else no_spaces(c), found={"terms": shown_terms(terms, aliases)})["c0"]


def section_between(c: Column | str, starts: list[str], ends: list[str]) -> Column:
    """From behind the earliest start marker to the earliest end marker after it, trimmed; "" without a start."""
    text = F.coalesce(as_column(c), F.lit(""))

    def earliest(source: Column, markers: list[str]) -> Column:
        spots = F.array(*[F.struct(F.locate(m, source).alias("at"), F.lit(len(m)).alias("size")) for m in markers])
        return F.try_element_at(F.array_sort(F.filter(spots, lambda s: s["at"] > 0)), F.lit(1))

    opened = earliest(text, starts)
    rest = F.substring(text, opened["at"] + opened["size"], F.length(text))
    closed = earliest(rest, ends)
    return F.when(opened.isNull(), F.lit("")).otherwise(F.trim(F.when(closed.isNull(), rest).otherwise(F.substring(rest, F.lit(1), closed["at"] - 1))))


def clean_address(c: Column | str, prefix: str, drop: list[str]) -> Column:
    """Punctuation and blanks cleaned, tokens dropped, the city put before where absent; "" stays."""
    text = F.regexp_replace(F.coalesce(as_column(c), F.lit("")), r"[,;#]+", " ")
    for token in drop:
        text = F.replace(text, F.lit(token), F.lit(" "))
    text = compact_spaces(text)
    return F.when((text == "") | F.startswith(text, F.lit(prefix)), text).otherwise(F.concat(F.lit(prefix + " "), text))


def split_tail(c: Column | str, sep: str) -> list[Column]:
    """First part, second part, and the rest with its separators; absent parts are ""."""
    parts = F.split(F.coalesce(as_column(c), F.lit("")), escaped(sep), 3)
    return [F.trim(F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))) for i in (1, 2, 3)]


def split_trailing_paren(c: Column | str) -> tuple[Column, Column]:
    """`title (teacher)` to title and teacher."""
    text = F.trim(F.coalesce(as_column(c), F.lit("")))
    return F.trim(F.regexp_replace(text, r"\s*\(([^()]*)\)$", "")), F.trim(F.regexp_extract(text, r"\(([^()]*)\)$", 1))


def clean_markup_text(c: Column | str) -> Column:
    """Tags stripped, character references decoded, spaces collapsed."""
    @F.pandas_udf("string")
    def unescaped(s: pd.Series) -> pd.Series:
        return s.map(html.unescape)

    return compact_spaces(unescaped(F.regexp_replace(F.coalesce(as_column(c), F.lit("")), "<[^>]*>", "")))
