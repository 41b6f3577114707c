"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventpulse.functions import text as T
from eventpulse.functions.registry import registry_of
from eventpulse.operators import content as B

from .tables import table

ALIASES = [("widget", "Gadget"), ("red ring", "Crimson Ring"), ("small bolt", "Mini Bolt"), ("hotgear", "Hot Gear Co")]
TERMS = ["the", "and of", "ing", "tion", "de la", "und", "que", "hat"]
SPACE = r"[\s\x0B\p{Z}\x{85}]+"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def t1_compact_spaces(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.compact_spaces("text").alias("compact"))


def t2_normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalize_text("text").alias("normalized"), F.length(T.join_key("text")).cast("long").alias("key_length"))


def t3_nfkc_key(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.nfkc_key("text").alias("nfkc_key"))


def t4_bare_key(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    title = F.concat(F.lit("["), "p_brand", F.lit("] "), "p_name", F.lit(" ("), "p_type", F.lit(")"))
    return parts.select("p_partkey", T.bare_key(title).alias("without_brackets"), T.bare_key(title, drop_brackets=False).alias("whole"))


def t5_safe_numbers(spark, sf_dir):
    spaced = F.concat(F.lit("n: "), F.format_string("%,d", F.col("n_chars")), F.lit(" chars"))
    docs = _docs(spark, sf_dir)
    return docs.select("doc_id", T.safe_int(spaced).alias("chars"), T.safe_int("lang", 0).alias("none_int"), T.safe_float(F.concat("source", F.lit(".5"))).alias("source_number"))


def t6_method_group(spark, sf_dir):
    rules = [("one_time", ["URGENT", "HIGH"]), ("pass", ["MEDIUM"])]
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", T.ticket_count("o_orderpriority", [1, 3, 5]).alias("tickets"), T.method_group("o_orderpriority", rules, "unknown").alias("method_group"))


def t7_bracket_label(spark, sf_dir):
    title = F.concat(F.lit("["), "p_brand", F.lit("] "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.bracket_label(title).alias("label"), T.strip_bracket(title).alias("body"), T.bracket_label("p_name").alias("no_label"))


def _registry(spark):
    return registry_of(spark.createDataFrame([(*a, i) for i, a in enumerate(ALIASES)], "raw string, canonical string, place int"), "place")


def t8_canonicalize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.canonicalize("p_name", _registry(spark)).alias("canonical"))


def t9_canonical_key(spark, sf_dir):
    title = F.concat(F.lit("["), "p_name", F.lit("] "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", T.canonical_title(title, _registry(spark)).alias("canonical_title"), T.canonical_key(title, _registry(spark)).alias("canonical_key"))


def t10_base_title(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    titled = parts.withColumn("title", F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).otherwise(F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")"))))
    known = T.known_titles([(parts, "p_name"), (table(spark, sf_dir, "nation"), "n_name"), (table(spark, sf_dir, "customer"), "c_mktsegment")])
    return T.base_title(T.base_title(titled, "title", known), "title", None, out="always").select("p_partkey", "title", "base_title", "always")


def t11_rewrite_terms(spark, sf_dir):
    rules = [("th(e|is|at)([ .,])", "T$1$2"), ("tion", "TION"), (" und ", " and ")]
    return _docs(spark, sf_dir).select("doc_id", T.rewrite_terms("text", rules).alias("rewritten"))


def t12_parse_date(spark, sf_dir):
    day = F.col("o_orderdate")
    form = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T23:30:00-05:00")))
    form = form.when(F.col("o_orderkey") % 5 == 1, F.date_format(day, "yyyyMMdd")).when(F.col("o_orderkey") % 5 == 2, F.date_format(day, "yyyy. M. d")).when(F.col("o_orderkey") % 5 == 3, F.date_format(day, "M.d"))
    text = form.otherwise(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 10:00")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("date_text"), F.date_format(T.parse_date_lenient(text, 2026), "yyyy-MM-dd").alias("day"))


def t13_normalize_time(spark, sf_dir):
    text = F.concat(F.lit(" "), (F.col("event_id") % 24).cast("string"), F.lit("; "), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"))
    return table(spark, sf_dir, "events").select("event_id", T.normalize_time(text).alias("hhmm"), T.normalize_time("event_type").alias("no_time"))


def t14_parse_time_range(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("until", F.col("ts") + F.make_dt_interval(mins=F.floor(F.col("value") * 5).cast("int")))
    text = F.concat(F.date_format("ts", "M.d"), F.lit(" (x) "), F.date_format("ts", "H:mm"), F.lit(" - "), F.date_format("until", "H:mm"))
    events = events.withColumn("slot", F.when(F.col("event_id") % 50 == 0, F.lit("soon")).otherwise(text))
    out = T.parse_time_range(events, "slot", 2024)
    return out.select("event_id", "slot", F.date_format("class_date", "yyyy-MM-dd").alias("class_date"), "weekday_text", F.date_format("end_at", "yyyy-MM-dd HH:mm").alias("end_at"), "start_hour", "duration_minutes", "time_status", "needs_review")


def t15_truthy(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(x) for x in (" True ", "no", "YES", "0", "1", "")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "labels").select("doc_id", T.truthy(text).alias("from_text"), T.truthy("toxic").alias("from_number"))


def t16_first_sentence(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.first_sentence("text", 180).alias("sentence"), T.ellipsize("text", 160).alias("short"))


def t17_tag_flags(spark, sf_dir):
    return T.tag_flags(_docs(spark, sf_dir), "text", {"theme": "(?i)the|und", "contact": "@", "numbers": "[0-9]{3}"}).select("doc_id", "tag_theme", "tag_contact", "tag_numbers", "tags_json")


def t18_mask_contacts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.mask_contacts("text").alias("masked"))


def t19_classify_path(spark, sf_dir):
    rules = [("contains", "blog.", "blog"), ("prefix", "https://m.", "mobile"), ("suffix", "#top", "anchor"), ("contains", "/en/", "english")]
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", T.path_part(path, 0).alias("host"), T.path_part(path, 2, "none").alias("third"), T.classify_path("url", rules, "other").alias("area"))


def t20_json_tag_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("json", F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.format_string('{"a": %s, "b": "%s"}', F.when(F.col("user_id") % 2 == 0, "true").otherwise("false"), F.when(F.col("event_id") % 3 == 0, "yes").otherwise("no"))))
    return T.json_tag_counts(events, "json", ["a", "b"], ["event_type"])


def t21_keyword_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.keyword_count("text", TERMS).alias("hits"))


def t22_match_terms_by(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term")).distinct()
    dictionary = words.withColumn("alias", F.when(F.length("term") > 4, F.upper("term")))
    return B.match_terms_by(_docs(spark, sf_dir), "doc_id", "text", dictionary, "terms").select("doc_id", "terms")


def t22_match_terms(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.matched_terms("text", TERMS, {"hat": "the"}), ";").alias("terms"))


def t23_section_between(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.section_between("text", ["the ", "und "], [".", "\n"]).alias("section"))


def t24_classify_by_keywords(spark, sf_dir):
    rules = [("german", ["und ", " der "]), ("english", [" the ", " of "]), ("french", [" les ", " des "])]
    return _docs(spark, sf_dir).select("doc_id", T.classify_by_keywords("text", rules, "other").alias("label"))


def t25_clean_address(spark, sf_dir):
    address = F.concat(F.when(F.col("c_custkey") % 3 == 0, "Seoul ").otherwise(""), "c_name", F.lit(", ,"), "c_mktsegment", F.lit(" floor;"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.clean_address(address, "Seoul", ["floor"]).alias("address"))


_names = [n for n in list(globals()) if n[:1] == "t" and n[1:2].isdigit()]
QUERIES = {n: globals()[n] for n in _names}

_compact = rf"trim(regexp_replace(text, '{SPACE}', ' ', 'g'))"
_nosp = rf"regexp_replace(lower(text), '{SPACE}', '', 'g')"


def _hits(term: str) -> str:
    t = term.lower().replace(" ", "")
    return f"(length(s) - length(replace(s, '{t}', ''))) // {len(t)}"


_matched = ", ".join(f"CASE WHEN contains(s, '{t.replace(' ', '')}') THEN '{ {'hat': 'the'}.get(t, t) }' END" for t in sorted(TERMS, key=lambda t: (-len(t), t)))
_canon = r"""CASE lower({x}) WHEN 'widget' THEN 'Gadget' WHEN 'red ring' THEN 'Crimson Ring' WHEN 'small bolt' THEN 'Mini Bolt' WHEN 'hotgear' THEN 'Hot Gear Co'
  ELSE CASE replace(lower(i), ' ', '') WHEN 'widget' THEN 'Gadget' WHEN 'redring' THEN 'Crimson Ring' WHEN 'smallbolt' THEN 'Mini Bolt' WHEN 'hotgear' THEN 'Hot Gear Co' ELSE i END END"""
_inside = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)widget', 'Gadget', 'g'), '(?i)red ring', 'Crimson Ring', 'g'), '(?i)small bolt', 'Mini Bolt', 'g'), '(?i)hotgear', 'Hot Gear Co', 'g')"
SQL = {
    "t1_compact_spaces": f"SELECT doc_id, {_compact} AS compact FROM documents",
    "t2_normalize_text": r"SELECT doc_id, n AS normalized, CAST(length(replace(n, ' ', '')) AS BIGINT) AS key_length FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS n FROM documents)",
    "t4_bare_key": r"SELECT p_partkey, regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', '', 'g') AS without_brackets, regexp_replace(lower(p_brand || p_name || p_type), '[^\p{L}\p{N}]+', '', 'g') AS whole FROM part",
    "t5_safe_numbers": "SELECT doc_id, n_chars AS chars, CAST(0 AS BIGINT) AS none_int, CAST(substring(source, 4) || '.5' AS DOUBLE) AS source_number FROM documents",
    "t6_method_group": "SELECT o_orderkey, CASE WHEN left(o_orderpriority, 1) IN ('1', '3', '5') THEN CAST(left(o_orderpriority, 1) AS BIGINT) END AS tickets, CASE WHEN o_orderpriority SIMILAR TO '.*(URGENT|HIGH).*' THEN 'one_time' WHEN o_orderpriority LIKE '%MEDIUM%' THEN 'pass' ELSE 'unknown' END AS method_group FROM orders",
    "t7_bracket_label": "SELECT p_partkey, p_brand AS label, p_name AS body, '' AS no_label FROM part",
    "t8_canonicalize": f"SELECT p_partkey, {_canon.format(x='p_name')} AS canonical FROM (SELECT *, {_inside.format(x='p_name')} AS i FROM part)",
    "t9_canonical_key": rf"SELECT p_partkey, t AS canonical_title, regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', '', 'g') AS canonical_key FROM (SELECT p_partkey, '[' || {_canon.format(x='p_name')} || '] ' || p_type AS t FROM (SELECT *, {_inside.format(x='p_name')} AS i FROM part))",
    "t10_base_title": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' (' || p_type || ')' ELSE p_type || ' (' || p_brand || ')' END AS title, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE CASE WHEN p_type IN (SELECT c_mktsegment FROM customer) THEN p_type ELSE p_type || ' (' || p_brand || ')' END END AS base_title, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS always FROM part",
    "t11_rewrite_terms": r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)th(e|is|at)([ .,])', 'T\1\2', 'g'), '(?i)tion', 'TION', 'g'), '(?i) und ', ' and ', 'g') AS rewritten FROM documents",
    "t12_parse_date": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T23:30:00-05:00' WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') WHEN 2 THEN strftime(o_orderdate, '%Y. %-m. %-d') WHEN 3 THEN strftime(o_orderdate, '%-m.%-d') ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 10:00' END AS date_text, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') WHEN 3 THEN CASE WHEN strftime(o_orderdate, '%m-%d') = '02-29' THEN NULL ELSE '2026-' || strftime(o_orderdate, '%m-%d') END ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders",
    "t13_normalize_time": "SELECT event_id, lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS hhmm, '' AS no_time FROM events",
    "t14_parse_time_range": """SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'soon' ELSE strftime(s, '%-m.%-d') || ' (x) ' || strftime(s, '%-H:%M') || ' - ' || strftime(u, '%-H:%M') END AS slot,
  CASE WHEN event_id % 50 <> 0 THEN strftime(s, '%Y-%m-%d') END AS class_date, CASE WHEN event_id % 50 <> 0 THEN 'x' ELSE '' END AS weekday_text,
  CASE WHEN event_id % 50 <> 0 THEN strftime(e, '%Y-%m-%d %H:%M') END AS end_at, CASE WHEN event_id % 50 <> 0 THEN CAST(extract(hour FROM s) AS BIGINT) END AS start_hour,
  CASE WHEN event_id % 50 <> 0 THEN CAST(epoch(e) - epoch(s) AS DOUBLE) / 60 END AS duration_minutes, CASE WHEN event_id % 50 = 0 THEN 'unparsed' ELSE 'parsed' END AS time_status, event_id % 50 = 0 AS needs_review
  FROM (SELECT *, CASE WHEN d + (u - date_trunc('day', u)) <= s THEN d + (u - date_trunc('day', u)) + INTERVAL 1 DAY ELSE d + (u - date_trunc('day', u)) END AS e
    FROM (SELECT event_id, date_trunc('minute', ts) AS s, date_trunc('day', ts) AS d, date_trunc('minute', ts + to_minutes(CAST(floor(value * 5) AS BIGINT))) AS u FROM events))""",
    "t15_truthy": "SELECT doc_id, doc_id % 6 IN (0, 2, 4) AS from_text, toxic = 1 AS from_number FROM labels",
    "t16_first_sentence": rf"SELECT doc_id, substring(CASE WHEN f = '' THEN c ELSE f END, 1, 180) AS sentence, CASE WHEN length(c) > 160 THEN rtrim(substring(c, 1, 157)) || '...' ELSE c END AS short FROM (SELECT doc_id, c, regexp_extract(c, '^(.*?[.!?。])(?:\s|$)', 1) AS f FROM (SELECT doc_id, {_compact} AS c FROM documents))",
    "t17_tag_flags": """SELECT doc_id, a AS tag_theme, b AS tag_contact, n AS tag_numbers, '{"contact":' || CAST(b AS VARCHAR) || ',"numbers":' || CAST(n AS VARCHAR) || ',"theme":' || CAST(a AS VARCHAR) || '}' AS tags_json FROM (SELECT doc_id, regexp_matches(text, '(?i)the|und') AS a, contains(text, '@') AS b, regexp_matches(text, '[0-9]{3}') AS n FROM documents)""",
    "t18_mask_contacts": r"SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '\+?\d{2,3}[-. ]\d{3,4}[-. ]\d{4}', '[phone]', 'g') AS masked FROM documents",
    "t19_classify_path": "SELECT page_id, p[1] AS host, coalesce(p[3], 'none') AS third, CASE WHEN contains(url, 'blog.') THEN 'blog' WHEN starts_with(url, 'https://m.') THEN 'mobile' WHEN ends_with(url, '#top') THEN 'anchor' WHEN contains(url, '/en/') THEN 'english' ELSE 'other' END AS area FROM (SELECT page_id, lower(url) AS url, list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: trim(x) <> '') AS p FROM pages)",
    "t20_json_tag_counts": "SELECT event_type, count(*) AS rows, count(*) FILTER (WHERE event_id % 10 <> 0 AND user_id % 2 = 0) AS a_count, count(*) FILTER (WHERE event_id % 10 <> 0 AND event_id % 3 = 0) AS b_count FROM events GROUP BY event_type",
    "t21_keyword_count": f"SELECT doc_id, CAST({' + '.join(map(_hits, TERMS))} AS BIGINT) AS hits FROM (SELECT doc_id, {_nosp} AS s FROM documents)",
    "t22_match_terms_by": f"WITH d AS (SELECT term, CASE WHEN length(term) > 4 THEN upper(term) ELSE term END AS alias FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part)) SELECT doc_id, coalesce(string_agg(alias, ';' ORDER BY length(term) DESC, term) FILTER (WHERE contains(s, term)), '') AS terms FROM (SELECT doc_id, {_nosp} AS s FROM documents) CROSS JOIN d GROUP BY doc_id",
    "t22_match_terms": f"SELECT doc_id, coalesce(array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(list_filter([{_matched}], lambda x: x IS NOT NULL), lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END), ';'), '') AS terms FROM (SELECT doc_id, {_nosp} AS s FROM documents)",
    "t23_section_between": r"SELECT doc_id, CASE WHEN p IS NULL THEN '' ELSE trim(CASE WHEN q IS NULL THEN r ELSE substring(r, 1, q - 1) END) END AS section FROM (SELECT *, least(nullif(instr(r, '.'), 0), nullif(instr(r, chr(10)), 0)) AS q FROM (SELECT doc_id, p, substring(text, p + 4) AS r FROM (SELECT doc_id, text, least(nullif(instr(text, 'the '), 0), nullif(instr(text, 'und '), 0)) AS p FROM documents)))",
    "t24_classify_by_keywords": "SELECT doc_id, CASE WHEN contains(text, 'und ') OR contains(text, ' der ') THEN 'german' WHEN contains(text, ' the ') OR contains(text, ' of ') THEN 'english' WHEN contains(text, ' les ') OR contains(text, ' des ') THEN 'french' ELSE 'other' END AS label FROM documents",
    "t25_clean_address": "SELECT c_custkey, 'Seoul ' || c_name_clean || ' ' || c_mktsegment AS address FROM (SELECT c_custkey, c_mktsegment, replace(c_name, '#', ' ') AS c_name_clean FROM customer)",
}
