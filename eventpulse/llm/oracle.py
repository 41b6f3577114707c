"""DuckDB SQL for the operators that SQL can express on whole tables."""

WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JACCARD_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOWER)} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
linked AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a)
SELECT a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON a = n.doc_id GROUP BY a
"""

#: Failures of the quality rules by name.
FAILURES = {
    "words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
    "short": "word_chars < 2 * n_words",
}
FAILURES["any"] = " OR ".join(FAILURES.values())


def _prior(rule: str) -> str:
    """Mean, weight and limit of a rule's beta prior."""
    return f"""p_{rule} AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(spread - mean * (1 - mean) * per, 1e-9) - 1, 1), 1e4) AS weight, greatest(3 * mean / (1 - mean + 3 * mean), 0.2) AS most
  FROM (SELECT least(greatest(sum(k_{rule}) / sum(n), 1e-6), 1 - 1e-6) AS mean, var_pop(k_{rule} / n) AS spread, avg(1 / n) AS per FROM h)),
v_{rule} AS (SELECT source AS s_{rule}, post - 3 * sqrt(post * (1 - post) / (total + 1)) <= most AS kept_{rule} FROM (SELECT source, n + weight AS total, (k_{rule} + mean * weight) / (n + weight) AS post, most FROM h, p_{rule}))"""


QUALITY_RULES = f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
tri AS (SELECT doc_id, i, a, count(*) OVER (PARTITION BY doc_id, a) AS c FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS a FROM w WHERE len(w) > 2)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM tri, range(3) AS r(k) WHERE c > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(ln.lines, 0) AS n_lines, coalesce(ln.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN ln ON w.doc_id = ln.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, {", ".join(f"{f} AS f_{rule}" for rule, f in FAILURES.items())} FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, {", ".join(f"count(*) FILTER (WHERE f_{rule})::DOUBLE AS k_{rule}" for rule in FAILURES)} FROM b WHERE source IS NOT NULL GROUP BY source),
{",".join(map(_prior, FAILURES))}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_words OR f_repeats AS base_failed, NOT f_any AND {" AND ".join(f"coalesce(kept_{rule}, true)" for rule in FAILURES)} AS kept
FROM b {" ".join(f"LEFT JOIN v_{rule} ON source = s_{rule}" for rule in FAILURES)}
"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: array_to_string(w[i:i + 34], ' '))) AS h FROM w WHERE len(w) >= 35),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM g) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM d, range(35) AS r(k)),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS t, count(*) AS n FROM x ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column})::VARCHAR || ':' || {column}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', text))})"


#: CRC-32 of a short text: a byte is combined, then eight single steps follow, written as -1.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, strlen(({text})) + 1), lambda i: [ascii(({text})[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""

#: Trees of all languages grow level by level; over their roots the tree '/' does the same.
MERKLE_MANIFEST = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {_leaf("text")} AS leaf,
    CASE WHEN {CRC32.format(text="doc_id::VARCHAR")} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos FROM d),
up AS (SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM p
  UNION ALL SELECT tree, level, pos, h, count(*) OVER (PARTITION BY tree) AS n FROM (SELECT tree, level + 1 AS level, pos // 8 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM up WHERE n > 1 GROUP BY tree, level, pos // 8)),
sub AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
over_up AS (SELECT 0 AS level, place AS pos, subroot AS h, n FROM sub
  UNION ALL SELECT level, pos, h, count(*) OVER () AS n FROM (SELECT level + 1 AS level, pos // 8 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM over_up WHERE n > 1 GROUP BY level, pos // 8)),
nodes AS (SELECT tree, level, pos, h, n FROM up UNION ALL SELECT '/', level, pos, h, n FROM over_up),
sides AS (SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos),
walk AS (SELECT p.doc_id, p.leaf, sub.subroot, p.tree, place, 0 AS level, pos, '' AS proof, coalesce(other, leaf) AS h, false AS done FROM p JOIN sub ON p.tree = sub.tree
  UNION ALL SELECT w.doc_id, w.leaf, w.subroot, CASE WHEN s.l IS NULL THEN '/' ELSE w.tree END, place, CASE WHEN s.l IS NULL THEN 0 ELSE w.level + 1 END, CASE WHEN s.l IS NULL THEN place ELSE w.pos // 8 END,
    proof || coalesce(s.l || s.r, ''), CASE WHEN s.l IS NULL THEN w.h ELSE sha256(s.l || w.h || s.r) END, s.l IS NULL AND w.tree = '/'
  FROM walk w LEFT JOIN sides s ON w.tree = s.tree AND w.level = s.level AND w.pos = s.pos WHERE NOT done)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, walk.h AS folded_root, walk.h = r.h AS verified FROM walk, (SELECT h FROM over_up WHERE n = 1) AS r WHERE done
"""

#: The cheapest edits run over the turns; v0 to v3 are the least (cost, initials) after nothing, a system, a user's and an assistant's turn.
CONVERSATION_REPAIR = f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (SELECT *, {CRC32.format(text="k")} % 20 AS h FROM raw),
rows AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(2) AS c(copy) WHERE h <> 0 AND (copy = 0 OR h = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, left(role, 1) AS r FROM rows),
faults AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, lag(r) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' END AS fault FROM placed),
walk AS (SELECT conv_id, 0::BIGINT AS pos, {{'c': 0, 's': ''}} AS v0, NULL::STRUCT(c INTEGER, s VARCHAR) AS v1, {{'c': 2, 's': 'I'}} AS v2, {{'c': 4, 's': 'II'}} AS v3 FROM (SELECT DISTINCT conv_id FROM placed)
  UNION ALL SELECT conv_id, pos, w0, w1, x2, least(w3, CASE WHEN x2 IS NOT NULL THEN {{'c': x2.c + 2, 's': x2.s || 'I'}} END) FROM (
    SELECT *, least(w2, CASE WHEN least(w0, w1, w3) IS NOT NULL THEN {{'c': least(w0, w1, w3).c + 2, 's': least(w0, w1, w3).s || 'I'}} END) AS x2 FROM (
      SELECT conv_id, pos, {{'c': v0.c + 3, 's': v0.s || 'D'}} AS w0,
        least(CASE WHEN v1 IS NOT NULL THEN {{'c': v1.c + 3, 's': v1.s || 'D'}} END, CASE WHEN stays AND r = 's' THEN {{'c': v0.c + cut, 's': v0.s || 'K'}} END) AS w1,
        least({{'c': v2.c + 3, 's': v2.s || 'D'}}, CASE WHEN stays AND r = 'u' THEN {{'c': o.c + cut, 's': o.s || 'K'}} END, CASE WHEN stays THEN {{'c': o.c + cut + 2, 's': o.s || 'R'}} END) AS w2,
        least({{'c': v3.c + 3, 's': v3.s || 'D'}}, CASE WHEN stays AND r = 'a' THEN {{'c': v2.c + cut, 's': v2.s || 'K'}} END, CASE WHEN stays THEN {{'c': v2.c + cut + 2, 's': v2.s || 'R'}} END) AS w3
      FROM (SELECT f.conv_id, f.pos, r, v0, v1, v2, v3, least(v0, v1, v3) AS o, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS stays, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS cut
        FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1)))),
best AS (SELECT w.conv_id, least(v0, v3).c AS cost, least(v0, v3).s AS audit FROM walk w JOIN (SELECT DISTINCT conv_id, n FROM faults) f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = f.n),
steps AS (SELECT conv_id, i, audit[i] AS e, length(replace(left(audit, i), 'I', '')) AS pos, length(replace(audit, 'D', '')) AS many, length(replace(left(audit, i), 'D', '')) - 1 AS place FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM best)),
lines AS (SELECT s.conv_id, s.i, CASE WHEN e = 'K' THEN f.role WHEN (place - many % 2) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE f.text END AS line
  FROM steps s LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.pos = s.pos AND e <> 'I' WHERE e <> 'D'),
texts AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY i)) AS h FROM lines GROUP BY conv_id),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pos > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT c.conv_id, {", ".join(f"coalesce({x}, 0)::BIGINT AS {x}" for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))}, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""
