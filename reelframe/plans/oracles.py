"""DuckDB SQL for the driver queries that SQL can express, over the same tables."""
from __future__ import annotations

from .assembly_oracles import assembly_oracles
from .flow_oracles import flow_oracles
from .input_oracles import input_oracles
from .script_oracles import script_oracles

WORDS = r"len(list_filter(string_split_regex({}, '\s+'), lambda x: x <> ''))"

ELEMENTS = """SELECT conv_id // 10 AS script_id, CAST(conv_id % 10 + 1 AS INTEGER) AS scene_number, CAST(turn AS INTEGER) AS element_index,
  CASE WHEN role = 'system' THEN 'action' ELSE 'dialogue' END AS type, text, CASE WHEN role <> 'system' THEN upper(role) END AS character, conv_id, turn FROM conversations"""
E = f"e AS ({ELEMENTS}), w AS (SELECT *, {WORDS.format('text')} AS n FROM e)"

HEADINGS = """h0 AS (SELECT c_nationkey AS script_id, c_custkey AS scene_number, CASE WHEN c_custkey % 2 = 0 THEN 'INT' ELSE 'EXT' END AS int_ext, upper(c_mktsegment) AS location,
  CASE c_custkey % 5 WHEN 0 THEN 'DAY' WHEN 1 THEN 'NIGHT' WHEN 2 THEN 'MORNING' WHEN 3 THEN 'CONTINUOUS' END AS time_of_day FROM customer),
h AS (SELECT *, int_ext || '. ' || location || coalesce(' - ' || time_of_day, '') AS heading_raw FROM h0)"""

PAGES = f"""{E}, l AS (SELECT script_id, scene_number, CAST(sum(CASE WHEN type = 'action' THEN greatest(1, ceil(n / 10.0)) ELSE greatest(1, ceil(n / 14.0)) END) AS BIGINT) AS lines FROM w GROUP BY ALL),
p AS (SELECT script_id, scene_number, CAST(sum(lines) OVER (PARTITION BY script_id ORDER BY scene_number) AS DOUBLE) / 54::DOUBLE AS page FROM l),
a AS (SELECT *, CASE WHEN page <= 0.25::DOUBLE * max(page) OVER (PARTITION BY script_id) THEN 1 WHEN page <= 0.75::DOUBLE * max(page) OVER (PARTITION BY script_id) THEN 2 ELSE 3 END AS act FROM p)"""

PAIRS = """o AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
pairs AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS together FROM o x JOIN o y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY ALL)"""

PACE = f"""{E}, s AS (SELECT script_id, scene_number, CAST(sum(n) AS BIGINT) AS words, count(*) FILTER (n > 0) AS beats, CAST(sum(CASE WHEN type = 'dialogue' THEN n ELSE 0 END) AS BIGINT) AS dialogue_words FROM w GROUP BY ALL),
r AS (SELECT *, words::DOUBLE / greatest(beats, 1)::DOUBLE AS density, (words - dialogue_words)::DOUBLE / greatest(words, 1)::DOUBLE AS action_share FROM s),
m AS (SELECT *, min(density) OVER k AS d0, max(density) OVER k AS d1, min(action_share) OVER k AS a0, max(action_share) OVER k AS a1 FROM r WINDOW k AS (PARTITION BY script_id)),
pace AS (SELECT script_id, scene_number, words, beats, dialogue_words, density, action_share,
  100::DOUBLE * (0.6::DOUBLE * ((density - d0) / greatest(1e-9::DOUBLE, d1 - d0)) + 0.4::DOUBLE * ((a1 - action_share) / greatest(1e-9::DOUBLE, a1 - a0))) AS pace_score FROM m)"""


def injected(*options: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{t.replace(chr(39), chr(39) * 2)}'" for i, t in enumerate(options))
    return f"(CASE turn % 4 {cases} ELSE '' END || ' ' || text)"


ORACLES = {
    "character_stats": f"""WITH {E}, c AS (SELECT script_id, character, count(*) AS lines, CAST(sum(n) AS BIGINT) AS words, count(DISTINCT scene_number) AS scenes FROM w WHERE type = 'dialogue' GROUP BY ALL)
SELECT *, 100::DOUBLE * words / greatest(sum(words) OVER (PARTITION BY script_id), 1)::DOUBLE AS share_pct FROM c""",
    "scene_estimates": f"""WITH {E} SELECT script_id, scene_number, CAST(sum(n) AS BIGINT) AS words, count(*) FILTER (type = 'dialogue') AS dialogue_lines, greatest(CAST(sum(n) AS DOUBLE) / 160::DOUBLE, 0.1::DOUBLE) AS minutes FROM w GROUP BY ALL""",
    "dialogue_share": f"""WITH {E}, s AS (SELECT script_id, CAST(coalesce(sum(n) FILTER (type = 'dialogue'), 0) AS BIGINT) AS dialogue_words, CAST(coalesce(sum(n) FILTER (type = 'action'), 0) AS BIGINT) AS action_words FROM w GROUP BY ALL)
SELECT *, 100::DOUBLE * dialogue_words / nullif(dialogue_words + action_words, 0)::DOUBLE AS dialogue_pct, 100::DOUBLE * action_words / nullif(dialogue_words + action_words, 0)::DOUBLE AS action_pct FROM s""",
    "location_usage": """WITH u AS (SELECT o_custkey % 100 AS script_id, o_orderpriority, count(*) AS uses, min(o_orderkey) AS first_seen FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY uses DESC, first_seen, o_orderpriority) AS usage_rank FROM u""",
    "scene_length_stats": f"""WITH {E}, s AS (SELECT script_id, scene_number, CAST(sum(n) AS BIGINT) AS words FROM w GROUP BY ALL)
SELECT script_id, count(*) AS scene_count, sum(words)::DOUBLE / count(*)::DOUBLE AS mean_words, median(words)::DOUBLE AS median_words,
  arg_min(scene_number, words * 1000 + scene_number) AS shortest_scene, arg_min(scene_number, -words * 1000 + scene_number) AS longest_scene FROM s GROUP BY script_id""",
    "time_breakdown": f"""WITH {HEADINGS}, m AS (SELECT script_id, 'int_ext' AS dimension, coalesce(int_ext, 'UNKNOWN') AS value, 1 AS one FROM h
  UNION ALL SELECT script_id, 'time', coalesce(time_of_day, 'UNSPECIFIED'), 1 FROM h UNION ALL SELECT script_id, 'night', 'NIGHT', CASE WHEN time_of_day LIKE '%NIGHT%' THEN 1 ELSE 0 END FROM h),
g AS (SELECT script_id, dimension, value, CAST(sum(one) AS BIGINT) AS scenes, count(*) AS n FROM m GROUP BY ALL)
SELECT script_id, dimension, value, scenes, 100::DOUBLE * scenes / sum(n) OVER (PARTITION BY script_id, dimension)::DOUBLE AS pct FROM g""",
    "script_report": f"""WITH {E} SELECT script_id, CAST(sum(n) AS BIGINT) AS words, count(*) FILTER (type = 'dialogue') AS dialogue_lines, count(DISTINCT scene_number) AS scene_count,
  CAST(coalesce(sum(n) FILTER (type = 'dialogue'), 0) AS BIGINT) AS dialogue_words, CAST(coalesce(sum(n) FILTER (type = 'action'), 0) AS BIGINT) AS action_words,
  100::DOUBLE * coalesce(sum(n) FILTER (type = 'dialogue'), 0)::DOUBLE / nullif(sum(n), 0)::DOUBLE AS dialogue_pct, 100::DOUBLE * coalesce(sum(n) FILTER (type = 'action'), 0)::DOUBLE / nullif(sum(n), 0)::DOUBLE AS action_pct FROM w GROUP BY script_id""",
    "cooccurrence_pairs": f"WITH {PAIRS} SELECT * FROM pairs",
    "interactions_topk": f"""WITH {PAIRS}, d AS (SELECT a AS member, b AS partner, together FROM pairs UNION ALL SELECT b, a, together FROM pairs)
SELECT *, row_number() OVER (PARTITION BY member ORDER BY together DESC, partner) AS partner_rank FROM d QUALIFY partner_rank <= 8""",
    "scene_cooccurrence": f"""WITH {E}, p AS (SELECT DISTINCT script_id, scene_number, character FROM e WHERE character IS NOT NULL)
SELECT x.script_id, x.character AS a, y.character AS b, count(*) AS together, string_agg(CAST(x.scene_number AS VARCHAR), ',' ORDER BY x.scene_number) AS scenes
FROM p x JOIN p y ON x.script_id = y.script_id AND x.scene_number = y.scene_number AND x.character < y.character GROUP BY ALL""",
    "quiet_gaps": """WITH d AS (SELECT DISTINCT user_id, event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events),
l AS (SELECT *, lag(day) OVER (PARTITION BY user_id, event_type ORDER BY day) AS after FROM d)
SELECT user_id, event_type, CAST(after AS INTEGER) AS after, CAST(day - after - 1 AS INTEGER) AS absent FROM l WHERE day - after - 1 >= 2""",
    "page_positions": f"WITH {PAGES} SELECT script_id, scene_number, page FROM p",
    "act_assignment": f"WITH {PAGES} SELECT * FROM a",
    "acts": f"""WITH {PAGES}, g AS (SELECT script_id, act, string_agg(CAST(scene_number AS VARCHAR), ',' ORDER BY scene_number) AS scene_numbers, min(page) AS low, arg_max(page, scene_number) AS page_end, count(*) AS scene_count FROM a GROUP BY ALL),
k AS (SELECT script_id, act FROM (SELECT DISTINCT script_id FROM a), (VALUES (1), (2), (3)) v(act))
SELECT k.script_id, k.act, coalesce(scene_numbers, '') AS scene_numbers, CASE WHEN low IS NULL THEN NULL WHEN k.act = 1 THEN least(low, 1::DOUBLE) ELSE low END AS page_start, page_end, coalesce(scene_count, 0) AS scene_count FROM k LEFT JOIN g USING (script_id, act)""",
    "pacing_curve": f"""WITH {PAGES}, v AS (SELECT script_id, scene_number, CAST(sum(CASE WHEN type = 'dialogue' THEN n ELSE 0 END) AS BIGINT) AS d, CAST(sum(CASE WHEN type = 'action' THEN n ELSE 0 END) AS BIGINT) AS x FROM w GROUP BY ALL),
t AS (SELECT script_id, max(page) AS total, CAST(greatest(1, ceil(max(page))) AS BIGINT) AS segments FROM p GROUP BY ALL),
g AS (SELECT p.script_id, least(CAST(floor(page) AS BIGINT), segments - 1) AS segment, CAST(sum(d) AS BIGINT) AS d, CAST(sum(x) AS BIGINT) AS x, count(*) AS c FROM p JOIN t USING (script_id) JOIN v USING (script_id, scene_number) GROUP BY ALL),
k AS (SELECT script_id, total, unnest(generate_series(0, segments - 1)) AS segment FROM t)
SELECT script_id, CAST(segment AS BIGINT) AS segment, CAST(segment + 1 AS BIGINT) AS page_start, CAST(least(segment + 1, ceil(total)) AS BIGINT) AS page_end, coalesce(d, 0) AS dialogue_words, coalesce(x, 0) AS action_words, coalesce(c, 0) AS scene_count FROM k LEFT JOIN g USING (script_id, segment)""",
    "character_arc": f"""WITH {E}, p AS (SELECT DISTINCT script_id, scene_number, character FROM e WHERE character IS NOT NULL), t AS (SELECT script_id, count(DISTINCT scene_number) AS total FROM e GROUP BY ALL),
g AS (SELECT script_id, character, count(*) FILTER (scene_number - before - 1 >= 2) AS n_gaps FROM (SELECT *, lag(scene_number) OVER (PARTITION BY script_id, character ORDER BY scene_number) AS before FROM p) GROUP BY ALL),
s AS (SELECT script_id, character, count(*) AS dialogue_lines FROM e WHERE type = 'dialogue' GROUP BY ALL),
c AS (SELECT script_id, character, min(scene_number) AS first_scene, max(scene_number) AS last_scene, count(*) AS scene_count FROM p GROUP BY ALL)
SELECT script_id, character, first_scene, last_scene, scene_count, 100::DOUBLE * scene_count / total::DOUBLE AS presence_pct, dialogue_lines, n_gaps, scene_count * 10 >= total * 6 AS appears_throughout,
  row_number() OVER (PARTITION BY script_id ORDER BY scene_count DESC, first_scene, character) AS arc_rank FROM c JOIN t USING (script_id) JOIN s USING (script_id, character) JOIN g USING (script_id, character)""",
    "pace_index": f"WITH {PACE} SELECT * FROM pace",
    "drag_topk": f"""WITH {PACE} SELECT script_id, scene_number, pace_score, row_number() OVER (PARTITION BY script_id ORDER BY pace_score DESC, scene_number) AS slow_rank FROM pace QUALIFY slow_rank <= 4 AND pace_score >= 68 AND words >= 20""",
    "time_flip": f"""WITH {HEADINGS}, l AS (SELECT script_id, scene_number, time_of_day AS now, lag(time_of_day) OVER k AS before, scene_number % 7 = 0 AS marked, coalesce(lag(scene_number) OVER k % 7 = 0, false) AS marked_before FROM h WINDOW k AS (PARTITION BY script_id ORDER BY scene_number))
SELECT script_id, scene_number, before, now FROM l WHERE NOT marked AND NOT marked_before AND ((before = 'NIGHT' AND now IN ('DAY', 'MORNING')) OR (now = 'NIGHT' AND before IN ('DAY', 'MORNING')))""",
    "heading_parse": f"WITH {HEADINGS} SELECT scene_number, heading_raw, int_ext, location, time_of_day FROM h",
    "line_flags": r"""WITH l AS (SELECT i - 1 AS line_no, parts[i] AS line FROM (SELECT string_split(text, chr(10)) AS parts, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)
  UNION ALL SELECT -1, CASE WHEN c_custkey % 2 = 0 THEN 'INT. ' ELSE 'EXT. ' END || upper(c_mktsegment) || CASE c_custkey % 5 WHEN 0 THEN ' - DAY' WHEN 1 THEN ' - NIGHT' WHEN 2 THEN ' - MORNING' WHEN 3 THEN ' - CONTINUOUS' ELSE '' END FROM customer
  UNION ALL SELECT -2, upper(replace(s_name, '#', ' ')) || CASE s_suppkey % 3 WHEN 0 THEN ' (V.O.)' WHEN 1 THEN ' CUT TO:' ELSE '' END FROM supplier),
f AS (SELECT line_no, trim(line, ' ') AS s FROM l),
g AS (SELECT line_no, s, regexp_matches(s, '(?i)^\s*(\d+[A-Z]?\s+)?(INT\.?/EXT\.?|EXT\.?/INT\.?|I/E|EST|INT\.?|EXT\.?)[\s.-].*') AS heading,
  regexp_matches(s, '(?i)^\s*(CUT TO:|SMASH CUT TO:|MATCH CUT TO:|DISSOLVE TO:|FADE TO:|FADE OUT\.?|FADE IN:|FADE TO BLACK\.?|JUMP CUT TO:|TIME CUT TO:|CONTINUOUS:|INTERCUT WITH:?|WHITE FLASH CUT:?|FLASH CUT:?|FLASHE? CUTS?:|PRESENT:|MONTAGE:)\s*$') OR regexp_matches(s, '^[A-Z0-9 ''\-]{3,30}TO:\s*$') AS transition,
  regexp_matches(s, '(?i)^\s*(\d+|ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN|A\s+COUPLE\s+OF|A\s+FEW)\s+(MINUTES?|HOURS?|DAYS?|WEEKS?|MONTHS?|YEARS?)\s+(LATER|EARLIER|AFTER|BEFORE|AGO)\b') AS marker,
  regexp_matches(s, '^\s*(ANGLE ON|CLOSE ON|CLOSE-UP|WIDE SHOT|POV|INSERT|AERIAL SHOT|TRACKING SHOT|TIGHT ON|ON [A-Z]+)\b') AS shot, regexp_matches(s, '^\s*\(.*\)\s*$') AS paren,
  trim(regexp_replace(s, '(?i)\([A-Z0-9 ._''’\-/]{1,15}\)', '', 'g'), ' ') AS core FROM f)
SELECT CAST(line_no AS INTEGER) AS line_no, count(*) AS n, count(*) FILTER (heading) AS headings, count(*) FILTER (transition) AS transitions, count(*) FILTER (marker) AS time_markers, count(*) FILTER (shot) AS shots, count(*) FILTER (paren) AS parentheticals,
  count(*) FILTER (length(s) BETWEEN 1 AND 45 AND NOT heading AND NOT transition AND NOT marker AND upper(s) <> 'THE END' AND regexp_matches(core, '^[\p{Lu}\p{Nd} .''\-#_]+$') AND regexp_matches(core, '\p{Lu}')) AS cues FROM g GROUP BY ALL""",
    "screenplay_parse": f"""WITH {E}, s AS (SELECT *, CAST(row_number() OVER (PARTITION BY script_id, conv_id ORDER BY turn) AS INTEGER) AS k, CAST(dense_rank() OVER (PARTITION BY script_id ORDER BY conv_id) AS INTEGER) AS scene FROM e)
SELECT script_id, scene AS scene_number, CAST(0 AS INTEGER) AS element_index, 'scene_heading' AS type, 'INT. ROOM ' || conv_id || ' - DAY' AS text, NULL::VARCHAR AS character FROM (SELECT DISTINCT script_id, scene, conv_id FROM s)
UNION ALL SELECT script_id, scene, 2 * k - 1, 'character', upper(r), upper(r) FROM (SELECT s.*, c.role AS r FROM s JOIN conversations c USING (conv_id, turn))
UNION ALL SELECT script_id, scene, 2 * k, 'dialogue', 'so ' || trim(regexp_replace(text, '\\s+', ' ', 'g')), upper(r) FROM (SELECT s.*, c.role AS r FROM s JOIN conversations c USING (conv_id, turn))""",
    "export_roundtrip": r"""WITH s AS (SELECT conv_id // 10 AS script_id, conv_id, role, 'so ' || trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations),
r AS (SELECT script_id, 'scene_heading' AS type, length('INT. ROOM ' || conv_id || ' - DAY') AS n FROM (SELECT DISTINCT script_id, conv_id FROM s) UNION ALL SELECT script_id, 'character', length(role) FROM s UNION ALL SELECT script_id, 'dialogue', length(t) FROM s)
SELECT script_id, type, count(*) AS n, CAST(sum(n) AS BIGINT) AS characters FROM r GROUP BY script_id, type""",
    "prop_candidates": r"""WITH l AS (SELECT source, doc_id, unnest(string_split(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), chr(10))) AS line FROM documents),
f AS (SELECT source, doc_id, unnest(list_distinct(regexp_extract_all(line, '\b([A-Z]{3,}(?:\s[A-Z]{3,}){0,2})\b', 1))) AS phrase FROM l)
SELECT source, phrase, count(DISTINCT doc_id) AS containers, count(*) AS mentions FROM f
WHERE len(list_filter(string_split_regex(phrase, '\s'), lambda x: x NOT IN ('THE', 'AND', 'BUT', 'FOR', 'WITH', 'FROM', 'INT', 'EXT', 'DAY', 'NIGHT', 'CONTINUOUS', 'LATER', 'MOMENTS', 'CUT', 'FADE', 'SAME'))) > 0
GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2""",
    "timeline_markers": rf"""WITH e AS (SELECT *, {injected('LATER', 'THE NEXT DAY, EARLIER', 'two years ago in 1999')} AS t FROM conversations),
m AS (SELECT conv_id, turn, u.i, found[u.i] AS marker FROM (SELECT conv_id, turn, regexp_extract_all(t, '(?i)\b(LATER|MOMENTS LATER|THE NEXT (?:DAY|MORNING|NIGHT)|EARLIER|\d+\s+(?:YEARS?|MONTHS?|WEEKS?|DAYS?|HOURS?)\s+(?:LATER|AGO)|(?:19|20)\d{{2}})\b', 0) AS found FROM e), LATERAL (SELECT unnest(generate_series(1, len(found))) AS i) u),
f AS (SELECT conv_id, marker, min(turn * 1000 + i) AS pos FROM m GROUP BY ALL), g AS (SELECT conv_id, string_agg(marker, '|' ORDER BY pos) AS markers FROM f GROUP BY ALL)
SELECT c.conv_id // 10 AS script_id, CAST(c.conv_id % 10 + 1 AS INTEGER) AS scene_number, coalesce(markers, '') AS markers FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g USING (conv_id)""",
    "promise_phrases": f"""SELECT conv_id // 10 AS script_id, CAST(conv_id % 10 + 1 AS INTEGER) AS scene_number, CAST(turn AS INTEGER) AS element_index, upper(role) AS character, CASE turn % 4 WHEN 0 THEN 'I''ll show' WHEN 1 THEN 'I swear' WHEN 2 THEN 'nammuko' END AS matched
FROM conversations WHERE role <> 'system' AND turn % 4 < 3""",
    "voice_similarity": rf"""WITH {E}, l AS (SELECT script_id, character AS speaker, scene_number, element_index, text, n, list_filter(regexp_extract_all(lower(text), '[a-z'']+', 0), lambda x: x NOT IN ({{stop}})) AS tok FROM w WHERE character IS NOT NULL),
st AS (SELECT script_id, speaker, count(*) AS k, CAST(sum(n) AS BIGINT) AS lw, CAST(sum(length(text) - length(replace(text, '?', ''))) AS BIGINT) AS q, CAST(sum(length(text) - length(replace(text, '!', ''))) AS BIGINT) AS b, CAST(sum(len(tok)) AS BIGINT) AS t, CAST(sum(coalesce(list_sum(list_transform(tok, lambda x: length(x))), 0)) AS BIGINT) AS c FROM l GROUP BY ALL HAVING count(*) >= 3),
tk AS (SELECT script_id, speaker, scene_number * 10000000 + element_index * 100000 + i AS pos, tok[i] AS word FROM (SELECT *, unnest(generate_series(1, len(tok))) AS i FROM l)),
fr AS (SELECT script_id, speaker, word, count(*) AS u, row_number() OVER (PARTITION BY script_id, speaker ORDER BY count(*) DESC, min(pos)) AS r FROM tk GROUP BY script_id, speaker, word QUALIFY r <= 40),
nm AS (SELECT script_id, speaker, sqrt(sum(u * u)::DOUBLE) AS norm FROM fr GROUP BY ALL),
sh AS (SELECT x.script_id, x.character AS a, y.character AS b, count(*) AS together FROM (SELECT DISTINCT script_id, scene_number, character FROM e WHERE character IS NOT NULL) x JOIN (SELECT DISTINCT script_id, scene_number, character FROM e WHERE character IS NOT NULL) y ON x.script_id = y.script_id AND x.scene_number = y.scene_number AND x.character < y.character GROUP BY ALL),
dt AS (SELECT x.script_id, x.speaker AS a, y.speaker AS b, sum(x.u * y.u)::DOUBLE AS dot FROM fr x JOIN fr y ON x.script_id = y.script_id AND x.word = y.word AND x.speaker < y.speaker GROUP BY ALL),
z AS (SELECT sh.script_id, sh.a, sh.b, together, coalesce(coalesce(dot, 0::DOUBLE) / nullif(na.norm * nb.norm, 0::DOUBLE), 0::DOUBLE) AS cos,
  p.lw::DOUBLE / p.k::DOUBLE AS l1, s.lw::DOUBLE / s.k::DOUBLE AS l2, p.c::DOUBLE / greatest(p.t, 1)::DOUBLE AS w1, s.c::DOUBLE / greatest(s.t, 1)::DOUBLE AS w2, p.q::DOUBLE / p.k::DOUBLE AS q1, s.q::DOUBLE / s.k::DOUBLE AS q2, p.b::DOUBLE / p.k::DOUBLE AS b1, s.b::DOUBLE / s.k::DOUBLE AS b2
  FROM sh JOIN st p ON p.script_id = sh.script_id AND p.speaker = sh.a JOIN st s ON s.script_id = sh.script_id AND s.speaker = sh.b LEFT JOIN dt ON dt.script_id = sh.script_id AND dt.a = sh.a AND dt.b = sh.b
  LEFT JOIN nm na ON na.script_id = sh.script_id AND na.speaker = sh.a LEFT JOIN nm nb ON nb.script_id = sh.script_id AND nb.speaker = sh.b),
f AS (SELECT script_id, a, b, together, 0.7::DOUBLE * cos + 0.3::DOUBLE * greatest(0::DOUBLE, 1::DOUBLE - (abs(l1 - l2) / greatest(1::DOUBLE, l1 + l2 + 0::DOUBLE) + abs(w1 - w2) / greatest(0.5::DOUBLE, w1 + w2 + 0::DOUBLE) + abs(q1 - q2) / greatest(0.05::DOUBLE, q1 + q2 + 0.001::DOUBLE) + abs(b1 - b2) / greatest(0.05::DOUBLE, b1 + b2 + 0.001::DOUBLE)) / 4::DOUBLE) AS similarity FROM z)
SELECT script_id, a, b, similarity, together FROM f QUALIFY row_number() OVER (PARTITION BY script_id ORDER BY similarity DESC, a, b) <= 6""",
    "idiolect_shift": f"""WITH {E}, l AS (SELECT script_id, character AS speaker, n, row_number() OVER (PARTITION BY script_id, character ORDER BY scene_number, element_index) AS k, count(*) OVER (PARTITION BY script_id, character) AS c FROM w WHERE character IS NOT NULL),
g AS (SELECT script_id, speaker, count(*) AS n_lines, sum(n) FILTER (k <= c // 2)::DOUBLE / count(*) FILTER (k <= c // 2)::DOUBLE AS early_len, sum(n) FILTER (k > c // 2)::DOUBLE / count(*) FILTER (k > c // 2)::DOUBLE AS late_len FROM l GROUP BY ALL HAVING count(*) >= 6)
SELECT *, abs(early_len - late_len) / greatest(early_len, late_len) AS shift FROM g WHERE abs(early_len - late_len) / greatest(early_len, late_len) >= 0.2::DOUBLE""",
    "on_the_nose": """SELECT conv_id // 10 AS script_id, CAST(conv_id % 10 + 1 AS INTEGER) AS scene_number, CAST(turn AS INTEGER) AS element_index, upper(role) AS speaker FROM conversations WHERE role <> 'system' AND turn % 4 IN (0, 1)""",
    "name_variants": """WITH n AS (SELECT DISTINCT p_type, p_name AS n, upper(p_name) AS u FROM part)
SELECT DISTINCT x.p_type, least(x.n, y.n) AS a, greatest(x.n, y.n) AS b FROM n x JOIN n y ON x.p_type = y.p_type AND x.u < y.u
WHERE levenshtein(x.u, y.u) <= 2 OR (length(x.u) BETWEEN 4 AND length(y.u) AND starts_with(y.u, x.u) AND length(y.u) - length(x.u) <= 3) OR (length(y.u) BETWEEN 4 AND length(x.u) AND starts_with(x.u, y.u) AND length(x.u) - length(y.u) <= 3)""",
    "long_blocks": r"""WITH l AS (SELECT doc_id, i - 1 AS line_no, parts[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents))
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(len(regexp_extract_all(line, '[^ \t\n\r\f\v]+', 0)) AS BIGINT) AS words FROM l WHERE len(regexp_extract_all(line, '[^ \t\n\r\f\v]+', 0)) > 60""",
    "paren_ratio": """SELECT user_id, count(*) FILTER (event_type = 'click') AS parens, count(*) FILTER (event_type = 'view') AS lines FROM events GROUP BY ALL HAVING lines >= 5 AND parens > 0.4 * lines""",
    "first_intro": """SELECT user_id, min(event_id) FILTER (event_type = 'signup') AS first_shown, min(event_id) FILTER (event_type = 'purchase') AS first_spoken FROM events GROUP BY ALL HAVING first_spoken IS NOT NULL AND (first_shown IS NULL OR first_shown > first_spoken)""",
    "quote_verify_exact": r"""WITH q AS (SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s]', '', 'g'), '\s+', ' ', 'g')) AS q FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s]', '', 'g'), '\s+', ' ', 'g')) AS body FROM documents)
SELECT item_id, min(doc_id) AS found_at FROM q JOIN d ON contains(body, q) WHERE len(string_split(q, ' ')) >= 3 GROUP BY item_id""",
    "language_remarks": """SELECT conv_id, count(*) AS kept FROM conversations WHERE turn % 4 > 1 GROUP BY conv_id""",
    "overlay_merge": """WITH r AS (SELECT doc_id % 10 AS script_id, doc_id % 7 AS pass, doc_id, quality FROM labels), f AS (SELECT * FROM r WHERE doc_id % 2 = 1)
SELECT script_id, pass, doc_id, quality, false AS is_fresh FROM r WHERE doc_id % 2 = 0 AND (script_id, pass) NOT IN (SELECT (script_id, pass) FROM f WHERE pass < 3) UNION ALL SELECT script_id, pass, doc_id, quality, true FROM f""",
    "ledger_antijoin": r"""WITH b AS (SELECT item_id, substr(lower(text), 1, 40) AS h FROM benchmark) SELECT item_id FROM b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), h))""",
    "draft_diff": """WITH o AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p FROM orders), a AS (SELECT * FROM o WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 2 THEN 'X' ELSE s END AS s, p FROM o WHERE o_orderkey % 7 <> 1)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.s IS DISTINCT FROM b.s OR a.p IS DISTINCT FROM b.p THEN 'changed' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""",
    "presence_diff": """WITH o AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT l_orderkey, coalesce(string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) FILTER (l_suppkey % 5 = 0 AND l_suppkey % 7 <> 0), '') AS added, coalesce(string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) FILTER (l_suppkey % 5 <> 0 AND l_suppkey % 7 = 0), '') AS removed
FROM o GROUP BY l_orderkey HAVING added <> '' OR removed <> ''""",
    "finding_states": f"""WITH {E} SELECT script_id, CAST(scene_number * 100 + element_index AS BIGINT) AS finding_index, CASE WHEN EXISTS (SELECT 1 FROM e y WHERE y.script_id = e.script_id AND y.element_index % 2 = 0 AND contains(y.text, e.text)) THEN 'still_present' ELSE 'addressed' END AS status FROM e""",
    "fix_queue": """WITH r AS (SELECT o_custkey % 100 AS script_id, o_orderkey AS finding_index, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'major' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity, CASE WHEN o_orderkey % 20 < 5 THEN 1 WHEN o_orderkey % 20 < 15 THEN 2 ELSE 3 END AS act FROM orders)
SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'major' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, act, finding_index) AS queue_rank FROM r""",
    "character_tracks": """WITH l AS (SELECT l_orderkey, l_suppkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), o AS (SELECT s_nationkey, l_suppkey, count(DISTINCT l_orderkey) AS scenes, count(*) AS lines FROM l GROUP BY ALL), t AS (SELECT s_nationkey, count(DISTINCT l_orderkey) AS total FROM l GROUP BY ALL),
a AS (SELECT s_nationkey, l_suppkey, scenes, lines, total, CAST(sum(lines) OVER (PARTITION BY s_nationkey) AS BIGINT) AS all_lines FROM o JOIN t USING (s_nationkey))
SELECT *, CASE WHEN scenes::DOUBLE / total >= 0.25::DOUBLE OR lines::DOUBLE / all_lines >= 0.15::DOUBLE THEN 'main' WHEN scenes::DOUBLE / total >= 0.08::DOUBLE THEN 'supporting' ELSE 'bit' END AS importance FROM a""",
    "rule_stats": """SELECT 'total' AS dimension, 'all' AS value, count(*) AS rules FROM part UNION ALL SELECT 'tier', p_brand, count(*) FROM part GROUP BY p_brand UNION ALL SELECT 'level', p_type, count(*) FROM part GROUP BY p_type""",
    "rule_lookup": """WITH m(category, level) AS (VALUES ('building', 'ECONOMY'), ('machinery', 'SMALL'), ('furniture', 'LARGE'), ('furniture', 'PROMO')), r AS (SELECT category, CAST(p_partkey AS VARCHAR) AS applicable_rule FROM m JOIN part ON p_type = level)
SELECT lower(c_mktsegment) AS category, applicable_rule, count(*) AS customers, CAST(min(c_custkey) AS BIGINT) AS first_customer, CAST(max(c_custkey) AS BIGINT) AS last_customer FROM customer LEFT JOIN r ON r.category = lower(c_mktsegment) GROUP BY ALL""",
    "rule_lookup_whole": """WITH m(category, level) AS (VALUES ('building', 'ECONOMY'), ('machinery', 'SMALL'), ('furniture', 'LARGE'), ('furniture', 'PROMO')), r AS (SELECT category, p_partkey FROM m JOIN part ON p_type = level)
SELECT c_custkey, lower(c_mktsegment) AS category, count(p_partkey) AS rules, CAST(min(p_partkey) AS BIGINT) AS first_rule, CAST(max(p_partkey) AS BIGINT) AS last_rule FROM customer LEFT JOIN r ON r.category = lower(c_mktsegment) GROUP BY ALL""",
    "beat_board": f"""WITH {E}, s AS (SELECT script_id, scene_number, CAST(sum(n) AS BIGINT) AS words, count(*) FILTER (type = 'action') AS note_count FROM w GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY scene_number) AS up, row_number() OVER (PARTITION BY script_id ORDER BY scene_number DESC) AS down, count(*) OVER (PARTITION BY script_id) AS c FROM s)
SELECT script_id, scene_number, CASE WHEN script_id % 2 = 0 OR c <= 2 THEN down ELSE up END - 1 AS position, 'SCENE ' || scene_number AS heading_raw, words, greatest(words::DOUBLE / 160::DOUBLE, 0.1::DOUBLE) AS minutes, note_count FROM p""",
    "rolling_metrics": """SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER k AS BIGINT) AS rolling_cents, count(value) OVER k AS rolling_n FROM events WINDOW k AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)""",
    "stall_sessions": """WITH l AS (SELECT user_id, epoch_us(ts) AS u, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), s AS (SELECT user_id, u, CAST(sum(CASE WHEN before IS NULL OR u - before >= 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY u) AS BIGINT) AS session_no FROM l)
SELECT user_id, session_no, min(u) AS started, max(u) AS ended, count(*) AS n FROM s GROUP BY ALL""",
    "profile_signals": f"""WITH t AS (SELECT CAST(conv_id % 50 AS VARCHAR) AS writer, turn % 4 AS k, {injected('keep it short', 'go deeper', 'okay then')} AS t FROM conversations),
s AS (SELECT writer, 'detail_level' AS dimension, CASE k WHEN 0 THEN 'short' WHEN 1 THEN 'deep' END AS pole FROM t UNION ALL SELECT writer, 'pushback_appetite', CASE WHEN regexp_matches(t, '(?i)\\b(i disagree\\b|no,|but |that won''?t work\\b|that doesn''?t work\\b|that loses\\b|keep it anyway\\b|actually no\\b)') THEN 'high' WHEN regexp_matches(t, '(?i)\\b(ok(?:ay)?|sure|fine|good point|makes sense|agree(?:d)?|sounds good|go with it)\\b') THEN 'low' END FROM t)
SELECT writer, dimension, pole, count(*) AS n FROM s WHERE pole IS NOT NULL GROUP BY ALL""",
    "turn_kinds": rf"""WITH t AS (SELECT conv_id, trim({injected('what if', 'rewrite it:', 'because')}, ' ') AS t FROM conversations), l AS (SELECT conv_id, t, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM t),
k AS (SELECT conv_id, CASE WHEN t = '' THEN 'idea' WHEN ends_with(t, '?') OR regexp_matches(low, '^(who|what|why|how|does|can|should|is|are|would|could|do|did)([^\p{{L}}\p{{Mn}}\p{{Nd}}_]|$)') THEN 'question' WHEN regexp_matches(low, '^(rewrite|fix|change|try|add|cut|move|remove|make|let''?s|write|imagine|explain)([^\p{{L}}\p{{Mn}}\p{{Nd}}_]|$)') THEN 'directive' ELSE 'idea' END AS k FROM l)
SELECT conv_id, count(*) FILTER (k = 'question') AS question, count(*) FILTER (k = 'directive') AS directive, count(*) FILTER (k = 'idea') AS idea FROM k GROUP BY conv_id""",
    "trigram_repetition": r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')), '[a-z'']+', 0) AS w FROM documents), g AS (SELECT doc_id, len(w) AS n, list_transform(generate_series(1, greatest(len(w) - 2, 0)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS t FROM w)
SELECT doc_id, CASE WHEN n >= 40 THEN (len(t) - len(list_distinct(t)))::DOUBLE / len(t)::DOUBLE ELSE 0::DOUBLE END AS ratio FROM g""",
    "history_window": """SELECT conv_id // 10 AS session, conv_id * 100 + turn AS seq, row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id * 100 + turn DESC) AS from_end FROM conversations QUALIFY from_end <= 16""",
    "library_digest": r"""WITH r AS (SELECT source, doc_id, substr(regexp_replace(text, '\s+', ' ', 'g'), 1, 120) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, n, string_agg(t, ' | ' ORDER BY k) AS digest FROM r WHERE k <= 4 GROUP BY source, n""",
    "token_surplus": r"""WITH t AS (SELECT conv_id, role, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS word FROM conversations WHERE role IN ('user', 'assistant')), c AS (SELECT conv_id, word, count(*) FILTER (role = 'user') AS a, count(*) FILTER (role = 'assistant') AS b FROM t GROUP BY ALL)
SELECT conv_id, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS only_user, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS only_assistant FROM c WHERE a <> b GROUP BY conv_id""",
    "token_chunks": """WITH RECURSIVE t AS (SELECT conv_id, turn, CAST(greatest(1, length(text) // 4) + 55 AS BIGINT) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT conv_id, turn, k, 0::BIGINT AS chunk, 1::BIGINT AS n, t AS used FROM t WHERE k = 1
  UNION ALL SELECT t.conv_id, t.turn, t.k, CASE WHEN f.n >= 3 OR f.used + t.t > 400 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.n >= 3 OR f.used + t.t > 400 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 3 OR f.used + t.t > 400 THEN t.t ELSE f.used + t.t END FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1)
SELECT conv_id // 10 AS script_id, CAST(conv_id % 10 + 1 AS INTEGER) AS scene_number, CAST(turn AS INTEGER) AS element_index, chunk FROM f""",
    "scene_references": """WITH r AS (SELECT conv_id, turn, CAST(turn + 3 AS INTEGER) AS x, CAST(conv_id % 4 AS INTEGER) AS y FROM conversations) SELECT conv_id, turn, CASE WHEN x = y THEN CAST(x AS VARCHAR) ELSE least(x, y) || ',' || greatest(x, y) END AS refs FROM r""",
}


def oracles() -> dict[str, str]:
    from ..functions.text import STOP_WORDS

    stop = ", ".join("'" + w + "'" for w in STOP_WORDS)
    return {k: v.replace("{stop}", stop) for k, v in ORACLES.items()} | script_oracles() | assembly_oracles() | flow_oracles() | input_oracles()
