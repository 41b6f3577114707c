"""Queries of mentions, long texts, checking, inventory and the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventpulse.functions.text import keyword_count
from eventpulse.operators import checking as A
from eventpulse.operators import content as B
from eventpulse.operators import inventory as K
from eventpulse.operators import mentions as V
from eventpulse.operators import metrics as M
from eventpulse.operators import quality as Q

from . import fixed_values as fixed
from .tables import table, with_views

TERMS = ["that", "heit", "tion", "ment", "ción"]
ALIASES = [("tion", "ment"), ("heit", "Heit")]


def _aliases(spark):
    return spark.createDataFrame(ALIASES, "alias string, name string")

SCHEMA = ["platform", "url", "title", "description", "source", "published", "query", "rank", "views", "likes"]
THEMES = {"english": ["the", "and"], "german": ["ung", "heit"], "romance": ["que", "los"], "latin": ["tion"]}


def _blog(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    day = F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")), "yyyy-MM-dd"))
    return d.select("doc_id", F.concat(F.lit("doc:"), (F.col("doc_id") % 400).cast("string")).alias("link"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("head"), F.col("text").alias("body"), "source", day.alias("day"), "lang", "n_chars", F.when(F.col("doc_id") % 5 == 0, "n/a").otherwise((F.col("doc_id") % 50).cast("string")).alias("like_text"))


def _united(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"), "page_id")
    return V.unify_sources(
        [
            (_blog(spark, sf_dir), {"link": "url", "head": "title", "body": "description", "source": "source", "day": "published", "lang": "query", "doc_id": "rank", "n_chars": "views", "like_text": "likes"}, {"platform": "blog"}),
            (pages, {"url": "url", "t": "title", "page_id": "rank"}, {"platform": "video", "query": "all", "published": "2026-02-01"}),
        ],
        SCHEMA,
    )


def v1_unify_sources(spark, sf_dir):
    return _united(spark, sf_dir)


def _collapsed(spark, sf_dir):
    rows = _united(spark, sf_dir).withColumn("ord", F.concat_ws("|", F.lpad("rank", 12, "0"), "query", "title"))
    return V.collapse_by_url(rows, ["platform", "url"], ["title", "description", "source", "published", "views", "likes"], "query", "rank", "ord")


def v2_collapse_by_url(spark, sf_dir):
    return _collapsed(spark, sf_dir)


def _queue(spark, sf_dir):
    return V.review_queue(_collapsed(spark, sf_dir), "the", TERMS, ["title", "description"])


def v3_review_queue(spark, sf_dir):
    return _queue(spark, sf_dir).select("mention_id", "platform", "url", "keyword_present", "matched_terms", "needs_manual_review", "queue_no")


def _confirmed(spark, sf_dir):
    return V.confirm_mentions(_queue(spark, sf_dir), "the", "2026-02-01")


def v4_confirm_mentions(spark, sf_dir):
    return _confirmed(spark, sf_dir).select("mention_id", "date_status", "mention_class", "confidence", "evidence", "needs_review")


def v5_publish_mentions(spark, sf_dir):
    return V.publish_mentions(_confirmed(spark, sf_dir), "source")


def _kept(spark, sf_dir):
    return _confirmed(spark, sf_dir).filter("mention_class = 'confirmed'")


def v6_platform_summary(spark, sf_dir):
    return V.platform_summary(_kept(spark, sf_dir), ["views", "likes"], "source")


def v7_term_summary(spark, sf_dir):
    return V.term_summary(_kept(spark, sf_dir), "matched_terms", _aliases(spark), ["views", "likes"], "source")


def v8_viral_overall(spark, sf_dir):
    return V.viral_overall(_kept(spark, sf_dir), ["blog", "video"], ["views", "likes"])


def v9_platform_metrics(spark, sf_dir):
    return V.platform_metrics(_kept(spark, sf_dir), ["views", "likes"], "source")


def _terms(spark, sf_dir):
    return V.term_metrics(_kept(spark, sf_dir), "matched_terms", _aliases(spark), ["blog", "video"], ["views", "likes"], "source")


def v10_term_metrics(spark, sf_dir):
    return _terms(spark, sf_dir)


def v11_avgrank_score(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_custkey")).alias("v"))
    return M.avgrank_scores(orders, {"v": "score"}).select("o_orderkey", "score")


def v12_viral_score(spark, sf_dir):
    return V.viral_score(_terms(spark, sf_dir), "views", 2).select("term", "mention_score", "source_score", "reach_score", "viral_score")


def v13_unmatched_mentions(spark, sf_dir):
    return V.unmatched_mentions(_kept(spark, sf_dir), "matched_terms").select("mention_id", "platform", "url")


def _themed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return B.primary_theme(B.theme_features(docs, "text", THEMES, "and the", TERMS, ["||", "%%%"]), ["german", "english", "latin", "romance"])


def b1_theme_features(spark, sf_dir):
    return _themed(spark, sf_dir).select("doc_id", *[f"{t}_count" for t in THEMES], "event_count", "event_present", "terms", "noise_risk")


def b2_primary_theme(spark, sf_dir):
    return _themed(spark, sf_dir).select("doc_id", "primary_theme")


def b3_theme_summary(spark, sf_dir):
    return B.theme_summary(_themed(spark, sf_dir), list(THEMES), "n_chars")


def b4_term_theme_summary(spark, sf_dir):
    return B.term_theme_summary(_themed(spark, sf_dir))


COUNTED = {"experience": ["with", "mit"], "detail": ["tion", "ung"], "reflection": ["that", "que"], "positive": ["er", "en"], "negative": ["nicht", "pas"], "promo": ["for", "para"], "mixed": ["is", "des"]}


def _scored(spark, sf_dir):
    docs = _themed(spark, sf_dir)
    docs = B.count_keywords(docs, "text", COUNTED).withColumns({"title_event_count": keyword_count(F.split_part("text", F.lit("\n"), F.lit(1)), ["the"]), "chars": F.col("n_chars")})
    docs = docs.withColumns({"n_terms": B.number_of_terms("terms"), "marks": B.exclamation_marks("text")})
    docs = B.scored_and_labelled(docs, "relevance", fixed.RELEVANCE, "relevance_level", fixed.RELEVANCE_LEVELS, fixed.NO_RELEVANCE)
    docs = B.scored_and_labelled(docs, "depth", fixed.DEPTH, "depth_label", fixed.DEPTH_LABELS, fixed.NO_DEPTH)
    docs = B.scored_and_labelled(docs, "emotion", fixed.EMOTION, "tone", fixed.TONES, fixed.NO_TONE)
    return B.typed_posts(docs, fixed.RISKS, fixed.NO_RISK, fixed.POST_TYPES, fixed.NO_POST_TYPE, fixed.REVIEWS)


def b5_relevance_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "relevance", "relevance_level")


def b6_depth_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "depth", "depth_label")


def b7_emotion_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "emotion", "tone")


def b8_post_type(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "topic_risk", "post_type", "manual_review")


def b9_post_type_summary(spark, sf_dir):
    return B.post_type_summary(_scored(spark, sf_dir))


def b10_quality_summary(spark, sf_dir):
    return B.quality_summary(_scored(spark, sf_dir))


def b11_block_theme_counts(spark, sf_dir):
    blocks = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("block"))
    return B.block_theme_counts(blocks, "doc_id", "block", THEMES)


def _reviews(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l")
    joined = d.join(labels, d["doc_id"] == labels["l"], "left")
    rating = F.when(F.col("doc_id") % 31 == 0, 5.1).otherwise(F.col("quality") + 4.0)
    return joined.select("doc_id", "text", "lang", F.col("toxic"), F.col("quality"), rating.alias("rating"), F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.col("source")).alias("reviewer"))


def _penalties():
    return [(F.col("reviewer") == "", 20), (F.col("quality").isNull(), 30), (F.coalesce(F.col("toxic"), F.lit(0)) == 1, 10)]


def a1_rule_confidence(spark, sf_dir):
    return _reviews(spark, sf_dir).select("doc_id", A.rule_confidence(_penalties()).alias("confidence"))


def a2_rule_record(spark, sf_dir):
    out = A.rule_record(_reviews(spark, sf_dir), "text", _penalties(), {"calm": "the", "space": "und"})
    return out.select("doc_id", "confidence", "needs_review", "tags_json", "status", "mode")


def a3_validate_ranges(spark, sf_dir):
    return A.validate_ranges(_reviews(spark, sf_dir), "doc_id", ["reviewer", "quality"], {"rating": (0, 5)})


def a4_parse_json_payload(spark, sf_dir):
    body = F.format_string('{"rating": %s, "reviewer": "%s"}', F.coalesce(F.col("quality").cast("string"), F.lit("null")), F.col("reviewer"))
    payload = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Sure: "), body)).when(F.col("doc_id") % 4 == 2, F.lit("no json")).otherwise(F.lit("{broken"))
    df = _reviews(spark, sf_dir).withColumn("payload", payload).withColumnsRenamed({"rating": "old_rating", "reviewer": "old_reviewer"})
    return A.parse_json_payload(df, "payload", "rating double, reviewer string", {"rating": "old_rating", "reviewer": "old_reviewer"}).select("doc_id", "rating", "reviewer", "payload_ok")


def a5_preserve_success(spark, sf_dir):
    fresh = _reviews(spark, sf_dir).select("doc_id", F.lit("new").alias("summary"), F.col("lang").alias("match_key"), F.lit("success").alias("status"))
    existing = _reviews(spark, sf_dir).select((F.col("doc_id") * 2).alias("doc_id"), F.lit("old").alias("summary"), F.lit("?").alias("match_key"), F.when(F.col("doc_id") % 3 == 0, "success").otherwise("error").alias("status"))
    return A.preserve_success(existing, fresh, "doc_id", ["match_key"])


def a5_merge_counts(spark, sf_dir):
    return A.merge_counts(a5_preserve_success(spark, sf_dir))


def _manifest(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("folder", "image", "document", "video")]), (F.col("page_id") % 4 + 1).cast("int"))
    host = F.regexp_extract("url", "^[a-z]+://([^/]*)/", 1)
    return p.select(
        "page_id", F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("area"), host.alias("folder"), kinds.alias("asset_type"), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("url")).alias("local_path"),
        F.when(F.col("page_id") % 7 == 0, "skipped").when(F.col("page_id") % 11 == 0, "error").otherwise("archived").alias("status"), (F.col("page_id") % 5 == 0).alias("sensitive"),
    )


def k1_area_summary(spark, sf_dir):
    return K.area_summary(_manifest(spark, sf_dir), ["area", "folder"])


def k2_asset_type_summary(spark, sf_dir):
    return K.asset_type_summary(_manifest(spark, sf_dir))


def k3_opportunity_matrix(spark, sf_dir):
    axes = spark.createDataFrame([("north", ["en", "de"]), ("south", ["fr", "es"]), ("none", ["xx"])], "axis string, areas array<string>")
    return K.opportunity_matrix(axes, K.area_summary(_manifest(spark, sf_dir), ["area"]))


def k4_sponsor_inventory(spark, sf_dir):
    numbered = _manifest(spark, sf_dir).withColumn("numbered", F.concat((F.col("page_id") % 30).cast("string"), F.lit(". "), "folder"))
    return K.sponsor_inventory(numbered, "numbered", ["folder", "image", "document"])


def q1_row_counts(spark, sf_dir):
    return Q.check_row_counts({n: table(spark, sf_dir, n) for n in ("nation", "region", "customer")}, {"nation": 25, "region": 5, "customer": 1500})


def q2_canonical(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return Q.check_canonical(parts, "part", "p_brand", ["Brand#0", "Brand#99"]).unionByName(Q.check_canonical(parts, "part", "p_type", ["LARGE"])).unionByName(Q.check_canonical(parts, "part", "p_missing", ["x"]))


def q3_unique(spark, sf_dir):
    return Q.check_unique(table(spark, sf_dir, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"]).unionByName(Q.check_unique(table(spark, sf_dir, "orders"), "orders", ["o_orderkey"]))


def q4_absent_columns(spark, sf_dir):
    return Q.check_absent_columns(table(spark, sf_dir, "customer"), "customer", ["c_phone", "c_address"]).unionByName(Q.check_absent_columns(table(spark, sf_dir, "customer"), "customer2", ["c_name", "c_phone"]))


def q5_expectation(spark, sf_dir):
    return Q.check_expectation(table(spark, sf_dir, "events"), "has purchases", F.col("event_type") == "purchase", 1, None).unionByName(Q.check_expectation(table(spark, sf_dir, "labels"), "no toxic", F.col("toxic") == 1, 0, 0))


def q6_suspicious_matches(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumns({"query": F.concat_ws(" ", "p_name", "p_type"), "found": F.when(F.col("p_partkey") % 2 == 0, F.split_part("p_name", F.lit(" "), F.lit(2))).otherwise(F.col("p_name")), "score": (F.col("p_partkey") % 20 + 80).cast("double")})
    return Q.suspicious_matches(parts, "query", "found", "score", ["bolt", "ring"]).select("p_partkey", "query", "found", "score")


def q7_scan_forbidden(spark, sf_dir):
    return Q.scan_forbidden(table(spark, sf_dir, "documents"), "doc_id", "text", {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "assignment": "password=", "digits": "[0-9]{5,}"})


def q8_gate_report(spark, sf_dir):
    return Q.gate_report([q1_row_counts(spark, sf_dir), q2_canonical(spark, sf_dir), q3_unique(spark, sf_dir), q4_absent_columns(spark, sf_dir), q5_expectation(spark, sf_dir)])


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] in "vbakq" and n[1:2].isdigit()}


def _kw(terms, s="s"):
    return " + ".join(f"(length({s}) - length(replace({s}, '{t.replace(' ', '')}', ''))) // {len(t.replace(' ', ''))}" for t in terms)


def _ns(x):
    return rf"regexp_replace(lower({x}), '[\s\x0B\p{{Z}}\x{{85}}]+', '', 'g')"


def _mt(s):
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains({s}, '{t}') THEN '{t}' END" for t in sorted(TERMS, key=lambda t: (-len(t), t))) + "], lambda x: x IS NOT NULL), ';')"


_U = """united AS (SELECT 'blog' AS platform, 'doc:' || CAST(doc_id % 400 AS VARCHAR) AS url, split_part(text, chr(10), 1) AS title, text AS description, source, CASE WHEN doc_id % 13 = 0 THEN '' ELSE strftime(DATE '2026-01-01' + CAST(doc_id % 90 AS INTEGER), '%Y-%m-%d') END AS published,
  lang AS query, CAST(doc_id AS VARCHAR) AS rank, CAST(n_chars AS VARCHAR) AS views, CASE WHEN doc_id % 5 = 0 THEN 'n/a' ELSE CAST(doc_id % 50 AS VARCHAR) END AS likes FROM documents
  UNION ALL SELECT 'video', url, regexp_extract(html, '<title>([^<]*)</title>', 1), '', '', '2026-02-01', 'all', CAST(page_id AS VARCHAR), '', '' FROM pages)"""
_C = "collapsed AS (SELECT platform, url, " + ", ".join(f"coalesce(arg_min({c}, o) FILTER (WHERE trim({c}) <> ''), '') AS {c}" for c in ("title", "description", "source", "published", "views", "likes")) + """,
  (SELECT string_agg(q, ';' ORDER BY o) FROM (SELECT query AS q, min(lpad(rank, 12, '0') || '|' || query || '|' || title) AS o FROM united u WHERE u.platform = x.platform AND u.url = x.url GROUP BY query)) AS query,
  count(DISTINCT query) AS query_count, min(CAST(rank AS BIGINT)) AS best_rank, count(*) AS raw_rows FROM (SELECT *, lpad(rank, 12, '0') || '|' || query || '|' || title AS o FROM united) x GROUP BY platform, url)"""
_QU = f"""queue AS (SELECT *, 'M_' || lpad(CAST(row_number() OVER (ORDER BY platform || chr(1) || url) AS VARCHAR), 5, '0') AS mention_id, NOT keyword_present OR matched_terms = '' AS needs_manual_review FROM (SELECT *, contains(s, 'the') AS keyword_present, {_mt('s')} AS matched_terms FROM (SELECT *, {_ns("title || ' ' || description")} AS s FROM collapsed)))"""
_CF = f"""conf AS (SELECT *, CASE WHEN d IS NULL THEN 'missing_date' WHEN late THEN 'in_period' ELSE 'before_period' END AS date_status, CASE WHEN (t OR b) AND late THEN 'confirmed' WHEN (t OR b) AND d IS NULL THEN 'confirmed_without_date' WHEN t OR b THEN 'keyword_before_period' ELSE 'not_confirmed' END AS mention_class,
  CAST(CASE WHEN t AND late THEN 100 WHEN b AND late THEN 95 WHEN (t OR b) AND d IS NULL THEN 90 ELSE 0 END AS BIGINT) AS confidence, concat_ws(';', CASE WHEN t THEN 'title' END, CASE WHEN b THEN 'description' END) AS evidence, (t OR b) AND NOT late AS needs_review
  FROM (SELECT *, try_cast(published AS DATE) AS d, coalesce(try_cast(published AS DATE) >= DATE '2026-02-01', false) AS late, contains({_ns('title')}, 'the') AS t, contains({_ns('description')}, 'the') AS b FROM queue))"""
_KP = "kept AS (SELECT *, coalesce(try_cast(views AS BIGINT), 0) AS vw, coalesce(try_cast(likes AS BIGINT), 0) AS lk FROM conf WHERE mention_class = 'confirmed')"
_V4 = (_U, _C, _QU, _CF)
_V = (*_V4, _KP)
_X = "ex AS (SELECT * EXCLUDE (term), CASE term WHEN 'tion' THEN 'ment' WHEN 'heit' THEN 'Heit' ELSE term END AS term FROM (SELECT *, unnest(CASE WHEN matched_terms = '' THEN ['UNMATCHED'] ELSE string_split(matched_terms, ';') END) AS term FROM kept))"
_TM = "tm AS (SELECT term, count(*) AS mentions, count(*) FILTER (WHERE platform = 'blog') AS blog_mentions, count(*) FILTER (WHERE platform = 'video') AS video_mentions, count(DISTINCT source) AS sources, count(DISTINCT platform) AS platforms, CAST(sum(vw) AS BIGINT) AS views, CAST(sum(lk) AS BIGINT) AS likes, min(nullif(published, '')) AS first_date, max(published) AS last_date FROM (SELECT DISTINCT term, mention_id, platform, source, vw, lk, published FROM ex WHERE term <> 'UNMATCHED') GROUP BY term)"


def _ar(x):
    return f"round((rank() OVER (ORDER BY {x}) - 1 + (count(*) OVER (PARTITION BY {x}) + 1)::DOUBLE / 2) / count(*) OVER () * 100, 2)"


_TH = "themed AS (SELECT *, CASE WHEN greatest(" + ", ".join(f"{t}_count" for t in THEMES) + ") = 0 THEN 'unclear' ELSE " + "CASE greatest(" + ", ".join(f"{t}_count" for t in THEMES) + ") WHEN german_count THEN 'german' WHEN english_count THEN 'english' WHEN latin_count THEN 'latin' ELSE 'romance' END END AS primary_theme, event_count > 0 AS event_present FROM (SELECT *, " + ", ".join(f"CAST({_kw(w)} AS BIGINT) AS {t}_count" for t, w in THEMES.items()) + f", CAST({_kw(['and the'])} AS BIGINT) AS event_count, {_mt('s')} AS terms, {_kw(['||', '%%%'])} > 2 AS noise_risk FROM (SELECT *, {_ns('text')} AS s FROM documents)))"
_SC = "counted AS (SELECT *, " + ", ".join(f"CAST({_kw(w)} AS BIGINT) AS {n}" for n, w in COUNTED.items()) + f", CAST({_kw(['the'], _ns('split_part(text, chr(10), 1)'))} AS BIGINT) AS title_event_count, n_chars AS chars, CASE WHEN terms = '' THEN 0 ELSE len(string_split(terms, ';')) END AS nt FROM themed)" + """,
s1 AS (SELECT *, CAST(greatest(0, least(100, CASE WHEN event_count > 0 THEN r ELSE least(r, 45) END)) AS BIGINT) AS relevance, CAST(greatest(0, least(100, CASE WHEN chars >= 1800 THEN 35 WHEN chars >= 1000 THEN 28 WHEN chars >= 600 THEN 20 WHEN chars >= 300 THEN 12 WHEN chars > 0 THEN 5 ELSE 0 END + least(experience * 4, 25) + least(detail * 2, 20) + least(reflection * 3, 15) + least(nt * 3, 10))) AS BIGINT) AS depth,
  CAST(greatest(0, least(100, least(positive * 4, 45) + least(negative * 3, 20) + least(reflection * 2, 20) + least((length(text) - length(replace(text, '!', ''))) * 3, 15))) AS BIGINT) AS emotion FROM (SELECT *, CASE WHEN event_count > 0 THEN 45 ELSE 0 END + least(event_count, 6) * 5 + CASE WHEN title_event_count > 0 THEN 15 ELSE 0 END + least(nt, 4) * 4 + CASE WHEN chars >= 600 THEN 10 ELSE 0 END + least(experience, 5) * 2 - CASE WHEN mixed >= 5 AND event_count <= 1 THEN 15 ELSE 0 END AS r FROM counted)),
s2 AS (SELECT *, CASE WHEN event_count >= 2 AND relevance >= 70 THEN 'confirmed_body_strong' WHEN event_count > 0 AND relevance >= 55 THEN 'confirmed_body_basic' WHEN event_count > 0 THEN 'confirmed_body_weak' WHEN title_event_count >= 1 THEN 'needs_review_title_only' ELSE 'needs_review_no_body_event_keyword' END AS relevance_level,
  CASE WHEN depth >= 70 THEN 'high_depth' WHEN depth >= 45 THEN 'medium_depth' WHEN depth >= 25 THEN 'low_depth' ELSE 'thin_reference' END AS depth_label, CASE WHEN negative >= 3 AND negative >= positive THEN 'negative_or_disappointed' WHEN positive >= 10 OR emotion >= 65 THEN 'very_positive' WHEN positive >= 3 THEN 'positive' WHEN positive > 0 AND negative > 0 THEN 'mixed' ELSE 'neutral_or_unclear' END AS tone,
  CASE WHEN mixed >= 5 AND event_count <= 2 THEN 'high' WHEN mixed >= 3 AND event_count <= 1 THEN 'medium' WHEN mixed >= 2 AND event_count = 0 AND chars >= 600 THEN 'medium' ELSE 'low' END AS topic_risk FROM s1),
scored AS (SELECT *, starts_with(relevance_level, 'needs_review') OR topic_risk = 'high' OR post_type = 'mixed_context_event_mention' AS manual_review FROM (SELECT *, CASE WHEN event_count = 0 THEN 'title_only_or_extraction_gap' WHEN topic_risk = 'high' AND event_count <= 2 THEN 'mixed_context_event_mention' WHEN promo >= 4 AND experience <= 2 THEN 'official_or_promotional_notice'
  WHEN depth >= 70 AND emotion >= 55 THEN 'immersive_participant_review' WHEN depth >= 45 AND experience >= 3 THEN 'participant_experience_review' WHEN detail >= 8 THEN 'space_or_program_overview' ELSE 'event_reference_or_light_review' END AS post_type FROM s2))"""
_RV = "rv AS (SELECT d.doc_id, text, lang, toxic, quality, CASE WHEN d.doc_id % 31 = 0 THEN 5.1::DOUBLE ELSE quality + 4.0::DOUBLE END AS rating, CASE WHEN d.doc_id % 17 = 0 THEN '' ELSE source END AS reviewer FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
_CONF = "CAST(greatest(0, 100 - CASE WHEN reviewer = '' THEN 20 ELSE 0 END - CASE WHEN quality IS NULL THEN 30 ELSE 0 END - CASE WHEN coalesce(toxic, 0) = 1 THEN 10 ELSE 0 END) AS DOUBLE) / 100"
_MG = """merged AS (SELECT coalesce(d.doc_id, o.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL OR o.ok THEN 'old' ELSE 'new' END AS summary, coalesce(d.lang, '?') AS match_key, CASE WHEN d.doc_id IS NULL AND NOT o.ok THEN 'error' ELSE 'success' END AS status,
  CASE WHEN d.doc_id IS NULL THEN 'existing_only' WHEN o.ok THEN 'preserved' ELSE 'fresh' END AS merge_mode FROM documents d FULL JOIN (SELECT doc_id * 2 AS doc_id, doc_id % 3 = 0 AS ok FROM documents) o ON d.doc_id = o.doc_id)"""
_MF = "mf AS (SELECT page_id, regexp_extract(url, '/(en|de|fr|es)/', 1) AS area, regexp_extract(url, '^[a-z]+://([^/]*)/', 1) AS folder, CASE page_id % 4 WHEN 0 THEN 'folder' WHEN 1 THEN 'image' WHEN 2 THEN 'document' ELSE 'video' END AS asset_type, CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS local_path, CASE WHEN page_id % 7 = 0 THEN 'skipped' WHEN page_id % 11 = 0 THEN 'error' ELSE 'archived' END AS status, page_id % 5 = 0 AS sensitive FROM pages)"
_AGG = "count(*) AS rows, count(*) FILTER (WHERE local_path <> '') AS local_copies, count(*) FILTER (WHERE asset_type = 'folder') AS folders, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE sensitive) AS sensitive, count(*) FILTER (WHERE NOT sensitive AND status = 'archived') AS publishable"


def _chk(check, target, n, expected, passed):
    return f"SELECT '{check}' AS check_id, '{target}' AS target, {passed} AS passed, CAST({n} AS VARCHAR) AS observed, '{expected}' AS expected"


_Q1 = " UNION ALL ".join(_chk("row_count", t, f"(SELECT count(*) FROM {t})", e, f"(SELECT count(*) FROM {t}) = {e}") for t, e in (("nation", 25), ("region", 5), ("customer", 1500)))
_N2 = [f"(SELECT count(*) FROM part WHERE {w})" for w in ("p_brand IN ('Brand#0', 'Brand#99')", "p_type = 'LARGE'")]
_Q2 = f"{_chk('canonical', 'part.p_brand', _N2[0], '0', _N2[0] + ' = 0')} UNION ALL {_chk('canonical', 'part.p_type', _N2[1], '0', _N2[1] + ' = 0')} UNION ALL {_chk('canonical', 'part.p_missing', chr(39) + 'column missing' + chr(39), '0', 'false')}"
_N3 = ["(SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem)", "(SELECT count(*) - count(DISTINCT o_orderkey) FROM orders)"]
_Q3 = f"{_chk('unique', 'lineitem(l_orderkey,l_linenumber)', _N3[0], '0', _N3[0] + ' = 0')} UNION ALL {_chk('unique', 'orders(o_orderkey)', _N3[1], '0', _N3[1] + ' = 0')}"
_Q4 = f"{_chk('absent_columns', 'customer', chr(39) * 2, '', 'true')} UNION ALL {_chk('absent_columns', 'customer2', chr(39) + 'c_name' + chr(39), '', 'false')}"
_N5 = ["(SELECT count(*) FROM events WHERE event_type = 'purchase')", "(SELECT count(*) FROM labels WHERE toxic = 1)"]
_Q5 = f"{_chk('expectation', 'has purchases', _N5[0], '1..', _N5[0] + ' >= 1')} UNION ALL {_chk('expectation', 'no toxic', _N5[1], '0..0', _N5[1] + ' = 0')}"
_ALL = f"SELECT * FROM ({_Q1}) UNION ALL SELECT * FROM ({_Q2}) UNION ALL SELECT * FROM ({_Q3}) UNION ALL SELECT * FROM ({_Q4}) UNION ALL SELECT * FROM ({_Q5})"
_SUM = "count(*) AS mentions, count(DISTINCT source) AS sources, CAST(sum(vw) AS BIGINT) AS views, CAST(sum(lk) AS BIGINT) AS likes"
SQL = {
    "v1_unify_sources": with_views(_U) + "SELECT * FROM united",
    "v2_collapse_by_url": with_views(_U, _C) + "SELECT * FROM collapsed",
    "v3_review_queue": with_views(_U, _C, _QU) + "SELECT mention_id, platform, url, keyword_present, matched_terms, needs_manual_review, row_number() OVER (PARTITION BY platform ORDER BY nullif(published, '') DESC NULLS LAST, url) AS queue_no FROM queue",
    "v4_confirm_mentions": with_views(*_V4) + "SELECT mention_id, date_status, mention_class, confidence, evidence, needs_review FROM conf",
    "v5_publish_mentions": with_views(*_V) + "SELECT 'PUB_' || lpad(CAST(dense_rank() OVER (ORDER BY platform || chr(1) || published || chr(1) || url) AS VARCHAR), 4, '0') AS mention_public_id, platform, published, title, 'SRC_' || lpad(CAST(dense_rank() OVER (ORDER BY platform || chr(1) || source) AS VARCHAR), 4, '0') AS source_id, confidence, evidence FROM kept",
    "v6_platform_summary": with_views(*_V) + f"SELECT platform, {_SUM} FROM kept GROUP BY platform",
    "v7_term_summary": with_views(*_V, _X) + "SELECT term, count(DISTINCT mention_id) AS mentions, count(DISTINCT platform) AS platforms, count(DISTINCT source) AS sources, CAST(sum(vw) AS BIGINT) AS views, CAST(sum(lk) AS BIGINT) AS likes FROM ex GROUP BY term",
    "v8_viral_overall": with_views(*_V) + "SELECT count(*) AS mentions, count(*) FILTER (WHERE platform = 'blog') AS blog_mentions, count(*) FILTER (WHERE platform = 'video') AS video_mentions, CAST(sum(vw) AS BIGINT) AS views, CAST(sum(lk) AS BIGINT) AS likes, min(nullif(published, '')) AS first_date, max(published) AS last_date FROM kept",
    "v9_platform_metrics": with_views(*_V) + f"SELECT platform, {_SUM}, min(nullif(published, '')) AS first_date, max(published) AS last_date, round(count(*)::DOUBLE / (SELECT count(*) FROM kept), 4) AS share FROM kept GROUP BY platform",
    "v10_term_metrics": with_views(*_V, _X, _TM) + "SELECT * FROM tm",
    "v11_avgrank_score": f"SELECT o_orderkey, {_ar('o_custkey')} AS score FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 11 = 0",
    "v12_viral_score": with_views(*_V, _X, _TM) + f"SELECT term, mention_score, source_score, reach_score, round(mention_score * 0.45::DOUBLE + source_score * 0.25::DOUBLE + reach_score * 0.2::DOUBLE + least(100.0::DOUBLE, platforms * 100.0::DOUBLE / 2) * 0.1::DOUBLE, 2) AS viral_score FROM (SELECT *, {_ar('mentions')} AS mention_score, {_ar('sources')} AS source_score, {_ar('views')} AS reach_score FROM tm)",
    "v13_unmatched_mentions": with_views(*_V) + "SELECT mention_id, platform, url FROM kept WHERE matched_terms = ''",
    "b1_theme_features": with_views(_TH) + "SELECT doc_id, " + ", ".join(f"{t}_count" for t in THEMES) + ", event_count, event_present, terms, noise_risk FROM themed",
    "b2_primary_theme": with_views(_TH) + "SELECT doc_id, primary_theme FROM themed",
    "b3_theme_summary": with_views(_TH) + "SELECT theme, count(*) AS mentions, count(*) FILTER (WHERE event_present) AS with_event, round(avg(n_chars), 2) AS mean_length FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS theme, event_present, n_chars FROM themed WHERE {t}_count > 0" for t in THEMES) + ") GROUP BY theme",
    "b4_term_theme_summary": with_views(_TH) + "SELECT term, count(*) AS mentions, count(*) FILTER (WHERE event_present) AS with_event, count(DISTINCT primary_theme) AS themes FROM (SELECT unnest(CASE WHEN terms = '' THEN ['UNMATCHED'] ELSE string_split(terms, ';') END) AS term, event_present, primary_theme FROM themed) GROUP BY term",
    "b5_relevance_score": with_views(_TH, _SC) + "SELECT doc_id, relevance, relevance_level FROM scored",
    "b6_depth_score": with_views(_TH, _SC) + "SELECT doc_id, depth, depth_label FROM scored",
    "b7_emotion_score": with_views(_TH, _SC) + "SELECT doc_id, emotion, tone FROM scored",
    "b8_post_type": with_views(_TH, _SC) + "SELECT doc_id, topic_risk, post_type, manual_review FROM scored",
    "b9_post_type_summary": with_views(_TH, _SC) + "SELECT post_type, count(*) AS mentions, round(avg(relevance), 2) AS mean_relevance, round(avg(depth), 2) AS mean_depth, round(avg(emotion), 2) AS mean_emotion, count(*) FILTER (WHERE manual_review) AS manual_reviews FROM scored GROUP BY post_type",
    "b10_quality_summary": with_views(_TH, _SC) + "SELECT relevance_level, depth_label, tone, count(*) AS mentions, count(*) FILTER (WHERE manual_review) AS manual_reviews, round(avg(chars), 2) AS mean_chars FROM scored GROUP BY ALL",
    "b11_block_theme_counts": "WITH b AS (SELECT doc_id, CASE " + " ".join(f"WHEN {_kw(w)} > 0 THEN '{t}'" for t, w in THEMES.items()) + f" ELSE 'other' END AS theme FROM (SELECT doc_id, {_ns('block')} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS block FROM documents))), c AS (SELECT doc_id, theme, count(*) AS blocks FROM b GROUP BY ALL) SELECT doc_id, theme, blocks, CAST(sum(blocks) OVER (PARTITION BY doc_id) AS BIGINT) AS page_blocks, count(*) FILTER (WHERE theme <> 'other') OVER (PARTITION BY doc_id) AS page_themes FROM c",
    "a1_rule_confidence": with_views(_RV) + f"SELECT doc_id, {_CONF} AS confidence FROM rv",
    "a2_rule_record": with_views(_RV) + f"""SELECT doc_id, {_CONF} AS confidence, reviewer = '' OR quality IS NULL OR coalesce(toxic, 0) = 1 AS needs_review, '{{"calm":' || CAST(contains(text, 'the') AS VARCHAR) || ',"space":' || CAST(contains(text, 'und') AS VARCHAR) || '}}' AS tags_json, 'success' AS status, 'rules' AS mode FROM rv""",
    "a3_validate_ranges": with_views(_RV) + "SELECT doc_id, concat_ws(';', CASE WHEN reviewer = '' THEN 'reviewer:missing' END, CASE WHEN quality IS NULL THEN 'quality:missing' END, CASE WHEN rating < 0 OR rating > 5 THEN 'rating:range' END) AS failures FROM rv WHERE reviewer = '' OR quality IS NULL OR rating > 5",
    "a4_parse_json_payload": with_views(_RV) + "SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) AND quality IS NOT NULL THEN CAST(quality AS DOUBLE) ELSE rating END AS rating, reviewer, doc_id % 4 IN (0, 1) AS payload_ok FROM rv",
    "a5_preserve_success": with_views(_MG) + "SELECT * FROM merged",
    "a5_merge_counts": with_views(_MG) + "SELECT merge_mode, count(*) AS rows FROM merged GROUP BY merge_mode",
    "k1_area_summary": with_views(_MF) + f"SELECT area, folder, {_AGG} FROM mf GROUP BY ALL",
    "k2_asset_type_summary": with_views(_MF) + f"SELECT area, asset_type, {_AGG} FROM mf GROUP BY ALL",
    "k3_opportunity_matrix": with_views(_MF) + "SELECT 'north' AS axis, 'en;de' AS areas, (SELECT count(*) FROM mf WHERE area IN ('en', 'de')) AS records UNION ALL SELECT 'south', 'fr;es', (SELECT count(*) FROM mf WHERE area IN ('fr', 'es')) UNION ALL SELECT 'none', 'xx', 0",
    "k4_sponsor_inventory": with_views(_MF) + "SELECT folder AS sponsor, count(*) AS files, count(*) FILTER (WHERE asset_type = 'folder') AS folder_files, count(*) FILTER (WHERE asset_type = 'image') AS image_files, count(*) FILTER (WHERE asset_type = 'document') AS document_files FROM mf WHERE local_path <> '' GROUP BY folder",
    "q1_row_counts": _Q1, "q2_canonical": _Q2, "q3_unique": _Q3, "q4_absent_columns": _Q4, "q5_expectation": _Q5,
    "q6_suspicious_matches": r"SELECT * FROM (SELECT p_partkey, p_name || ' ' || p_type AS query, CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 2) ELSE p_name END AS found, CAST(p_partkey % 20 + 80 AS DOUBLE) AS score FROM part) WHERE length(regexp_replace(query, '[^A-Za-z]+', '', 'g')) >= 8 AND score < 95 AND (found IN ('bolt', 'ring') OR length(replace(found, ' ', '')) < 0.45 * length(regexp_replace(query, '[^A-Za-z]+', '', 'g')))",
    "q7_scan_forbidden": r"SELECT doc_id, pattern, hits FROM (SELECT doc_id, 'email' AS pattern, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS hits FROM documents UNION ALL SELECT doc_id, 'assignment', len(regexp_extract_all(text, 'password=')) FROM documents UNION ALL SELECT doc_id, 'digits', len(regexp_extract_all(text, '[0-9]{5,}')) FROM documents) WHERE hits > 0",
    "q8_gate_report": f"WITH g AS ({_ALL}) SELECT *, count(*) FILTER (WHERE NOT passed) OVER () AS blockers, count(*) FILTER (WHERE passed) OVER () AS passes, bool_and(passed) OVER () AS gate_passed FROM g",
}
