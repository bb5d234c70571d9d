"""DuckDB SQL for the queries of scripts.py and state.py."""
from __future__ import annotations

from ..operators.memory import TOPICS

CONV = r"c AS (SELECT *, conv_id // 10 AS script_id, CAST(conv_id % 10 + 1 AS INTEGER) AS scene, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line, upper(role) AS name FROM conversations)"
SCENE = "s AS (SELECT script_id, conv_id, CAST(row_number() OVER (PARTITION BY script_id ORDER BY conv_id) AS INTEGER) AS scene_number FROM (SELECT DISTINCT script_id, conv_id FROM c))"

#: The parts of the written-out Fountain scripts, in order.
RICH = rf"""{CONV}, {SCENE},
cue AS (SELECT *, CASE WHEN role = 'assistant' THEN 'ASSISTANT' WHEN turn % 5 = 0 THEN 'ராமன்' ELSE 'User ' || turn END AS who FROM c WHERE role <> 'system'),
p AS (SELECT script_id, conv_id, -1 AS a, 0 AS b, 'scene_heading' AS type, CASE conv_id % 3 WHEN 0 THEN 'THE ROOF ' || conv_id WHEN 1 THEN 'INT. ROOM ' || conv_id || ' - NIGHT' ELSE 'इंट. घर ' || conv_id || ' - रात' END AS text, NULL::VARCHAR AS character FROM s
UNION ALL SELECT script_id, conv_id, turn, 0, 'action', 'so ' || line, NULL FROM c WHERE role = 'system'
UNION ALL SELECT script_id, conv_id, turn, 0, 'character', CASE WHEN role = 'assistant' THEN 'ASSISTANT (V.O.)' ELSE who END, who FROM cue
UNION ALL SELECT script_id, conv_id, turn, 1, 'parenthetical', '(softly)', who FROM cue WHERE role <> 'assistant'
UNION ALL SELECT script_id, conv_id, turn, 2, 'dialogue', 'so ' || line, who FROM cue
UNION ALL SELECT script_id, conv_id, 1000000, x.b, x.type, x.text, NULL FROM s, (VALUES (0, 'action', 'la la'), (1, 'shot', 'ANGLE ON the door'), (2, 'transition', 'TWO DAYS LATER')) x(b, type, text)
UNION ALL SELECT script_id, conv_id, 1000000, 3, 'transition', CASE WHEN conv_id % 2 = 0 THEN 'FADE OUT.' ELSE 'CUT TO:' END, NULL FROM s),
r AS (SELECT p.script_id, scene_number, CAST(row_number() OVER (PARTITION BY p.script_id, p.conv_id ORDER BY a, b) - 1 AS INTEGER) AS element_index, type, text, character, conv_id FROM p JOIN s USING (script_id, conv_id))"""
ELEMENTS = f"WITH {RICH} SELECT script_id, scene_number, element_index, type, text, character FROM r"

FILES = f"""WITH {RICH}, k AS (SELECT *, CASE WHEN script_id % 2 = 0 THEN 'fountain' ELSE 'fdx' END AS source_format, script_id % 2 = 1 AND script_id % 5 = 0 AS broken FROM r)
SELECT source_format, type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS characters FROM k WHERE NOT broken GROUP BY ALL
UNION ALL SELECT source_format, 'error', count(DISTINCT script_id), CAST(0 AS BIGINT) FROM k WHERE broken GROUP BY source_format"""

#: The lines of the PDF boxes, in order.
PDF = rf"""{CONV}, {SCENE}, l AS (SELECT script_id, conv_id, -1 AS t, 0 AS k, 'scene_heading' AS type, 'INT. ROOM ' || conv_id || ' - DAY' AS text, NULL::VARCHAR AS character FROM s
UNION ALL SELECT script_id, conv_id, turn, 0, 'character', name, name FROM c UNION ALL SELECT script_id, conv_id, turn, 1, 'dialogue', 'so ' || line, name FROM c
UNION ALL SELECT script_id, conv_id, m, k, type, text, NULL FROM (SELECT script_id, conv_id, max(turn) AS m FROM c GROUP BY ALL), (VALUES (2, 'action', '1999'), (3, 'transition', 'CUT TO:')) x(k, type, text)),
q AS (SELECT l.*, scene_number, row_number() OVER (PARTITION BY l.script_id ORDER BY conv_id, t, k) - 1 AS n FROM l JOIN s USING (script_id, conv_id))"""

PLAIN = r"""l AS (SELECT script_id, conv_id, -1 AS turn, 0 AS k, 'scene_heading' AS type, 'INT. ROOM ' || conv_id || ' - DAY' AS text FROM s
UNION ALL SELECT script_id, conv_id, turn, 0, 'character', name FROM c UNION ALL SELECT script_id, conv_id, turn, 1, 'dialogue', 'so ' || line FROM c)"""

E = "e AS (SELECT *, CASE WHEN role <> 'system' THEN name END AS character FROM c)"
WORDS = r"len(list_filter(string_split_regex({}, '\s+'), lambda x: x <> ''))"


def phrase(*options: str) -> str:
    return "CASE turn % 4 " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options)) + " ELSE '' END || ' ' || text"


def topic_sql() -> str:
    each = " UNION ALL ".join(f"SELECT writer, '{t}' AS topic FROM t WHERE " + " OR ".join(f"contains(x, '{k}')" for k in kws) for t, kws in TOPICS.items())
    return f"""WITH t AS (SELECT conv_id // 10 AS writer, lower({phrase('the protagonist', 'a slow midpoint', 'more banter')}) AS x FROM conversations), h AS ({each}),
n AS (SELECT writer, topic, count(*) AS n FROM h GROUP BY ALL)
SELECT writer, topic, n, row_number() OVER (PARTITION BY writer ORDER BY n DESC, topic) = 1 AND sum(n) OVER (PARTITION BY writer) >= 6 AND n >= 0.35::DOUBLE * sum(n) OVER (PARTITION BY writer) AS leading FROM n"""


def script_oracles() -> dict[str, str]:
    return {
        "fountain_elements": ELEMENTS,
        "fdx_elements": ELEMENTS,
        "fountain_scenes": f"""WITH {CONV}, {SCENE} SELECT script_id, scene_number, CASE conv_id % 3 WHEN 0 THEN 'THE ROOF ' || conv_id WHEN 1 THEN 'INT. ROOM ' || conv_id || ' - NIGHT' ELSE 'इंट. घर ' || conv_id || ' - रात' END AS heading_raw,
CASE WHEN conv_id % 3 > 0 THEN 'INT' END AS int_ext, CASE conv_id % 3 WHEN 0 THEN 'THE ROOF ' WHEN 1 THEN 'ROOM ' ELSE 'घर ' END || conv_id AS location, CASE conv_id % 3 WHEN 1 THEN 'NIGHT' WHEN 2 THEN 'रात' END AS time_of_day FROM s""",
        "fountain_titles": f"WITH {CONV} SELECT DISTINCT script_id, 'Script ' || script_id AS title, 'Writer ' || script_id AS author, 'medium' AS parse_confidence, 'fountain' AS source_format FROM c",
        "fdx_titles": f"WITH {CONV} SELECT DISTINCT script_id, 'Script ' || script_id AS title, 'Writer ' || script_id AS author, 'high' AS parse_confidence FROM c",
        "plain_elements": f"WITH {CONV}, {SCENE}, {PLAIN} SELECT script_id, scene_number, type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS characters FROM l JOIN s USING (script_id, conv_id) GROUP BY ALL",
        "pdf_elements": f"WITH {PDF} SELECT script_id, scene_number, CAST(row_number() OVER (PARTITION BY script_id, conv_id ORDER BY t, k) - 1 AS INTEGER) AS element_index, type, text, character FROM q",
        "page_spans": f"WITH {PDF} SELECT script_id, scene_number, CAST(min(n) // 40 + 1 AS DOUBLE) AS page_start, CAST(max(n) // 40 + 1 AS DOUBLE) AS page_end FROM q GROUP BY ALL",
        "unreadable_scripts": f"WITH {CONV} SELECT DISTINCT script_id FROM c WHERE script_id % 3 = 0 OR script_id % 7 = 0",
        "export_text": f"""WITH {CONV}, {SCENE}, {PLAIN} SELECT script_id, sha256(rtrim(string_agg(CASE WHEN type = 'character' THEN text ELSE text || chr(10) END, chr(10) ORDER BY conv_id, turn, k), chr(10)) || chr(10)) AS sha256 FROM l GROUP BY ALL""",
        "json_roundtrip": f"""WITH {CONV}, {SCENE}, {PLAIN} SELECT script_id, count(*) FILTER (type = 'scene_heading') AS scenes, count(*) AS elements, (SELECT count(*) FROM (SELECT DISTINCT script_id, conv_id, role FROM c) x WHERE x.script_id = l.script_id) AS characters FROM l GROUP BY ALL""",
        "session_files": "SELECT CAST(conv_id // 10 AS VARCHAR) AS session_id, 'Talk ' || (conv_id // 10) AS title, CAST(conv_id // 10 AS DOUBLE) AS updated_at, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY ALL",
        "watch_folder": f"WITH {CONV}, {SCENE}, {PLAIN} SELECT type, count(*) AS n FROM l GROUP BY ALL",
        "script_file_source": FILES,
        "script_file_stream": FILES,
        "formatting_checks": f"""WITH {RICH}, h AS (SELECT * FROM r WHERE type = 'scene_heading' AND conv_id % 3 = 0),
n AS (SELECT script_id, character, count(*) FILTER (type = 'parenthetical') AS parens, count(*) FILTER (type = 'dialogue') AS lines, min(scene_number) FILTER (type = 'character') AS first FROM r WHERE character IS NOT NULL GROUP BY ALL),
f AS (SELECT script_id, 'scene_heading_missing_int_ext' AS rule, 'medium' AS severity, scene_number AS ref FROM h UNION ALL SELECT script_id, 'scene_heading_missing_time_of_day', 'low', scene_number FROM h
UNION ALL SELECT script_id, 'long_action_block', 'low', scene_number FROM r WHERE type = 'action' AND {WORDS.format('text')} > 60
UNION ALL SELECT script_id, 'heavy_parenthetical_usage', 'low', 0 FROM n WHERE lines >= 5 AND parens > 0.4 * lines
UNION ALL SELECT script_id, 'character_not_capitalized_on_first_appearance', 'low', first FROM n)
SELECT script_id, rule, severity, count(*) AS n, CAST(sum(ref) AS BIGINT) AS first_refs FROM f GROUP BY ALL""",
        "cue_presence": f"WITH {RICH} SELECT script_id, name, string_agg(scene_number, ',' ORDER BY scene_number) AS scenes FROM (SELECT DISTINCT script_id, upper(character) AS name, scene_number FROM r WHERE type = 'character') GROUP BY ALL",
        "character_index": f"""WITH {CONV}, {E} SELECT script_id, character, string_agg(scene, ',' ORDER BY scene) AS scenes, min(scene) AS first_scene, max(scene) AS last_scene, CAST(sum(n) AS BIGINT) AS lines
FROM (SELECT script_id, character, scene, count(*) AS n FROM e WHERE character IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
        "character_profiles": f"""WITH {CONV}, {E}, k AS (SELECT script_id, character, count(DISTINCT scene) AS scene_count, count(*) AS lines FROM e WHERE character IS NOT NULL GROUP BY ALL),
t AS (SELECT script_id, count(DISTINCT scene) AS total FROM c GROUP BY ALL), pr AS (SELECT DISTINCT script_id, scene, character FROM e WHERE character IS NOT NULL),
m AS (SELECT a.script_id, a.character, b.character AS partner, count(*) AS n FROM pr a JOIN pr b ON a.script_id = b.script_id AND a.scene = b.scene AND a.character <> b.character GROUP BY ALL),
g AS (SELECT script_id, character, string_agg(partner, ',' ORDER BY n DESC, partner) AS partners FROM m GROUP BY ALL),
i AS (SELECT k.*, CASE WHEN scene_count / total::DOUBLE >= 0.25 OR lines / sum(lines) OVER (PARTITION BY script_id)::DOUBLE >= 0.15 THEN 'main' WHEN scene_count / total::DOUBLE >= 0.08 THEN 'supporting' ELSE 'bit' END AS importance, partners FROM k JOIN t USING (script_id) LEFT JOIN g USING (script_id, character))
SELECT script_id, character, importance, scene_count, lines, partners, row_number() OVER (PARTITION BY script_id ORDER BY CASE importance WHEN 'main' THEN 0 WHEN 'supporting' THEN 1 ELSE 2 END, scene_count DESC, lines DESC, character) AS track_rank FROM i""",
        "trait_mentions": f"""WITH {CONV}, {E}, pr AS (SELECT DISTINCT script_id, scene, character FROM e WHERE character IS NOT NULL), a AS (SELECT *, CASE WHEN turn % 2 = 0 THEN 'ASSISTANT' ELSE 'USER' END AS shown FROM c WHERE role = 'system')
SELECT a.script_id, pr.character, a.scene AS scene_number, CAST(turn AS INTEGER) AS element_index, CASE WHEN turn % 2 = 0 THEN '30s, tired' ELSE 'calm' END AS descriptor, CASE WHEN turn % 2 = 0 THEN 'age' ELSE 'descriptor' END AS kind FROM a JOIN pr ON a.script_id = pr.script_id AND a.scene = pr.scene AND pr.character = shown""",
        "scene_timeline": rf"""WITH {CONV}, f AS (SELECT conv_id, turn, regexp_extract_all({phrase('LATER', 'two years ago in 1999', 'EARLIER')}, '(?i)\b(LATER|MOMENTS LATER|THE NEXT (?:DAY|MORNING|NIGHT)|EARLIER|\d+\s+(?:YEARS?|MONTHS?|WEEKS?|DAYS?|HOURS?)\s+(?:LATER|AGO)|(?:19|20)\d{{2}})\b', 0) AS found FROM c),
m AS (SELECT conv_id, turn, i, found[i] AS marker FROM (SELECT *, unnest(generate_series(1, len(found))) AS i FROM f)), g AS (SELECT conv_id, marker, min(turn * 1000 + i) AS pos FROM m GROUP BY ALL), j AS (SELECT conv_id, string_agg(marker, '|' ORDER BY pos) AS markers FROM g GROUP BY ALL)
SELECT script_id, scene AS scene_number, 'INT' AS int_ext, CASE WHEN scene % 2 = 0 THEN 'NIGHT' END AS time_of_day, coalesce(markers, '') AS markers FROM (SELECT DISTINCT script_id, conv_id, scene FROM c) LEFT JOIN j USING (conv_id)""",
        "prop_mentions": f"""WITH {CONV}, a AS (SELECT script_id, scene, CASE WHEN turn % 3 = 0 THEN 'GOLD WATCH' ELSE 'RED LAMP' END AS phrase, CASE WHEN turn % 3 = 0 THEN 'the GOLD WATCH ' ELSE 'a RED LAMP ' END || regexp_replace(text, '[A-Z]', 'x', 'g') AS t FROM c)
SELECT script_id, phrase, count(*) AS mentions, CAST(sum(length(substr(t, 1, 160))) AS BIGINT) AS characters FROM a GROUP BY ALL HAVING count(DISTINCT scene) >= 2""",
        "script_summary": f"""WITH {CONV}, w AS (SELECT *, {WORDS.format('text')} AS n FROM c), z AS (SELECT script_id, scene, CAST(sum(n) AS BIGINT) AS words, greatest(round_even(sum(n) / 160::DOUBLE, 1), 0.1::DOUBLE) AS minutes FROM w GROUP BY ALL),
q AS (SELECT script_id, CAST(sum(CASE WHEN role <> 'system' THEN n ELSE 0 END) AS BIGINT) AS dialogue_words, CAST(sum(CASE WHEN role = 'system' THEN n ELSE 0 END) AS BIGINT) AS action_words FROM w GROUP BY ALL)
SELECT script_id, CAST(round(sum(minutes) * 10) AS BIGINT) AS tenths, count(*) AS scene_count, any_value(dialogue_words) AS dialogue_words, any_value(action_words) AS action_words, arg_min(scene, words * 100 + scene) AS shortest_scene, arg_max(scene, words * 100 - scene) AS longest_scene FROM z JOIN q USING (script_id) GROUP BY script_id""",
        "quote_verification": f"WITH {CONV} SELECT script_id, count(*) FILTER (turn % 4 = 0) AS verified, count(*) FILTER (turn % 4 = 1) AS not_found, count(*) FILTER (turn % 4 = 2) AS no_quote, count(*) FILTER (turn % 4 = 3) AS scene_not_found FROM c GROUP BY ALL",
        "library_lines": f"""WITH {CONV}, {E}, u AS (SELECT script_id, substr(line, 1, 120) AS t, row_number() OVER (PARTITION BY script_id ORDER BY scene, turn) AS r FROM e WHERE character = 'USER'),
th AS (SELECT script_id, string_agg(t, '; ' ORDER BY r) AS themes FROM u WHERE r <= 4 GROUP BY ALL), k AS (SELECT script_id, character, count(DISTINCT scene) AS n FROM e WHERE character IS NOT NULL GROUP BY ALL),
ch AS (SELECT script_id, string_agg(character, ', ' ORDER BY n DESC, character) AS people FROM k GROUP BY ALL)
SELECT DISTINCT c.script_id, 'S' || c.script_id || ': ' || coalesce(themes, '') || ' (' || coalesce(people, '') || ')' AS digest FROM c LEFT JOIN th USING (script_id) LEFT JOIN ch USING (script_id) WHERE c.script_id <> 0""",
        "script_cast": "SELECT * FROM (SELECT l_orderkey % 40 AS script_id, l_suppkey AS character, count(DISTINCT l_orderkey) AS scenes, row_number() OVER (PARTITION BY l_orderkey % 40 ORDER BY count(DISTINCT l_orderkey) DESC, l_suppkey) AS cast_rank FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1, 2) WHERE cast_rank <= 24",
        "scene_texts_for": f"""WITH {CONV}, b AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body FROM c GROUP BY ALL)
SELECT script_id, CAST(scene * 1000 + turn AS INTEGER) AS text_id, sha256('Scene ' || scene || chr(10) || body) AS sha256, '99' AS missing FROM c JOIN b USING (conv_id)""",
        "ungrounded_replies": f"WITH {CONV} SELECT script_id, CAST(scene * 1000 + turn AS INTEGER) AS text_id, CAST(CASE WHEN EXISTS (SELECT 1 FROM c x WHERE x.script_id = c.script_id AND x.scene = c.turn + 7) THEN 77 ELSE turn + 7 END AS INTEGER) AS unknown_scene FROM c",
        "act_lengths": f"""WITH {CONV}, w AS (SELECT *, {WORDS.format('text')} AS n FROM c), l AS (SELECT script_id, scene, CAST(sum(CASE WHEN role = 'system' THEN greatest(1, ceil(n / 10.0)) ELSE greatest(1, ceil(n / 14.0)) END) AS BIGINT) AS lines FROM w GROUP BY ALL),
p AS (SELECT script_id, CAST(sum(lines) OVER (PARTITION BY script_id ORDER BY scene) AS DOUBLE) / 54::DOUBLE AS page FROM l), a AS (SELECT script_id, CAST(CASE WHEN page <= 0.25::DOUBLE * max(page) OVER (PARTITION BY script_id) THEN 1 WHEN page <= 0.75::DOUBLE * max(page) OVER (PARTITION BY script_id) THEN 2 ELSE 3 END AS INTEGER) AS act FROM p)
SELECT script_id, act, count(*) AS scenes FROM a GROUP BY ALL""",
        "applied_edits": f"""WITH {CONV}, n AS (SELECT *, count(*) OVER (PARTITION BY conv_id, trim(text)) AS alike FROM c), x AS (SELECT *, turn % 3 = 0 AND alike = 1 AND trim(text) <> '' AND NOT contains(trim(text), chr(10)) AS edited FROM n)
SELECT script_id, scene AS scene_number, CAST(turn AS INTEGER) AS element_index, CASE WHEN edited THEN 'line ' || turn ELSE text END AS text, edited FROM x""",
        "edits_in_force": """WITH RECURSIVE o AS (SELECT user_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE WHEN event_id % 5 < 3 THEN 'edit' WHEN event_id % 5 = 3 THEN 'undo' ELSE 'redo' END AS op, CAST(event_id % 1000000 AS INTEGER) AS x FROM events),
f AS (SELECT DISTINCT s, CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS done, CAST([] AS INTEGER[]) AS undone FROM o
UNION ALL SELECT f.s, o.k, CASE op WHEN 'edit' THEN list_append(done, x) WHEN 'undo' THEN done[1:len(done) - 1] ELSE CASE WHEN len(undone) > 0 THEN list_append(done, undone[len(undone)]) ELSE done END END,
CASE op WHEN 'edit' THEN CAST([] AS INTEGER[]) WHEN 'undo' THEN CASE WHEN len(done) > 0 THEN list_append(undone, done[len(done)]) ELSE undone END ELSE undone[1:len(undone) - 1] END FROM f JOIN o ON f.s = o.s AND o.k = f.k + 1),
z AS (SELECT s, done FROM f QUALIFY row_number() OVER (PARTITION BY s ORDER BY k DESC) = 1) SELECT s AS script_id, unnest(done) AS edit_seq FROM z""",
        "previous_drafts": "SELECT o_custkey AS script_id, CAST(o_orderkey AS VARCHAR) AS draft_name, lag(CAST(o_orderkey AS VARCHAR)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders",
        "project_names": """WITH u AS (SELECT p_partkey AS arrived, replace(p_brand, '#', '_') AS stem, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part),
free AS (SELECT stem, k, row_number() OVER (PARTITION BY stem ORDER BY k) AS r FROM (SELECT stem, unnest(generate_series(1, count(*) + 1)) AS k FROM u GROUP BY stem) WHERE NOT (k = CASE WHEN stem < 'Brand_3' THEN 1 ELSE 3 END))
SELECT arrived, CASE WHEN k = 1 THEN stem ELSE stem || '_' || k END AS project FROM u JOIN free USING (stem, r)""",
        "open_stages": "SELECT o_custkey AS script_id, o_orderpriority AS stage FROM orders GROUP BY ALL HAVING arg_max(o_orderstatus, o_orderkey) <> 'F'",
        "chat_branches": """WITH m AS (SELECT conv_id // 10 AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'main' ELSE 'side' END AS branch FROM conversations), a AS (SELECT * FROM m UNION ALL SELECT session_id, 'fork' FROM m WHERE session_id = 1 AND branch = 'main')
SELECT session_id, branch, count(*) AS messages FROM a WHERE NOT (session_id = 2 AND branch = 'side') GROUP BY ALL""",
        "note_upserts": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN quality + 10 ELSE quality END AS quality FROM labels WHERE doc_id % 5 <> 0",
        "chat_titles": r"SELECT conv_id, turn, substr(trim(regexp_replace('# ' || split_part(text, chr(10), 1), '^[#*\- ]+', '')), 1, 48) AS title FROM conversations",
        "rebuilds": """WITH w AS (SELECT o_custkey AS k, max(o_orderkey) AS ts, count(*) FILTER (o_orderstatus = 'F') AS edits FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL), p AS (SELECT o_custkey AS k, max(o_orderkey) AS parsed FROM orders GROUP BY ALL)
SELECT k AS script_id FROM p LEFT JOIN w USING (k) WHERE ts IS NULL OR (parsed > ts AND coalesce(edits, 0) = 0)""",
        "stalled_scripts": "SELECT user_id AS script_id, arg_max(event_type, event_id) AS stage, CAST(max(event_id) AS DOUBLE) AS ts FROM events GROUP BY ALL HAVING max(event_id) % 3 = 0",
        "stage_progress": """WITH p AS (SELECT l_orderkey AS script_id, CAST(l_linenumber AS BIGINT) AS stage_order, 100::DOUBLE * sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) / sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey) AS done_pct FROM lineitem)
SELECT script_id, stage_order, done_pct, CASE WHEN done_pct > 0 THEN stage_order * 60 * (100 - done_pct) / done_pct END AS eta FROM p""",
        "writer_topics": topic_sql(),
        "refreshes_due": "SELECT conv_id // 10 AS writer, count(*) AS turns FROM conversations GROUP BY ALL HAVING count(*) - count(*) FILTER (conv_id % 10 = 0) >= 10",
        "novel_observations": """WITH k AS (SELECT DISTINCT o_custkey, lower(trim(substr(o_orderpriority, 3, 20))) AS t FROM orders WHERE o_orderkey % 7 = 0), n AS (SELECT o_custkey AS writer, o_orderkey AS seq, o_orderpriority AS text, lower(trim(o_orderpriority)) AS x FROM orders)
SELECT writer, seq, text FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.o_custkey = n.writer AND (contains(x, k.t) OR contains(k.t, x))) QUALIFY row_number() OVER (PARTITION BY writer ORDER BY seq) <= 3""",
        "scoped_observations": r"""WITH t AS (SELECT conv_id * 100 + turn AS id, regexp_replace(text, '[A-Z]', 'x', 'g') || ' ' || coalesce(lower(n_name), 'nowhere') || '.' AS x FROM conversations LEFT JOIN nation ON n_nationkey = (conv_id * 7 + turn) % 40),
h AS (SELECT id, arg_min(r_name, n_nationkey) AS scope FROM t JOIN nation ON regexp_matches(x, '(?i)\b' || n_name || '\b') JOIN region ON n_regionkey = r_regionkey GROUP BY id)
SELECT id, coalesce(scope, 'global') AS scope FROM t LEFT JOIN h USING (id)""",
        "visible_observations": "SELECT o_custkey AS writer, o_orderkey AS seq FROM orders WHERE (o_orderkey % 3 = 0 OR o_orderpriority = '1-URGENT') AND o_orderkey % 4 <> 0 AND (o_orderkey % 10) / 10::DOUBLE >= 0.6::DOUBLE AND o_orderkey % 2 <> 0",
        "open_ledger": """WITH e AS (SELECT o_custkey % 100 AS script_id, o_orderkey AS entry_index, CASE o_orderstatus WHEN 'F' THEN 'dangling' WHEN 'O' THEN 'paid' ELSE 'other' END AS status FROM orders)
SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY CASE status WHEN 'dangling' THEN 0 WHEN 'paid' THEN 3 ELSE 4 END, entry_index) AS queue_rank FROM e QUALIFY queue_rank <= 12""",
        "judgment_candidates": """WITH p AS (SELECT user_id AS script_id, 0 AS source, -count(*) AS a, 0 AS b, event_type AS label FROM events GROUP BY user_id, event_type), q AS (SELECT user_id, 1, event_id % 50, event_id, CAST(event_id AS VARCHAR) FROM events)
SELECT script_id, label, row_number() OVER (PARTITION BY script_id ORDER BY source, a, b, label) AS queue_rank FROM (SELECT * FROM p UNION ALL SELECT * FROM q) QUALIFY queue_rank <= 15""",
        "categories": "SELECT o_custkey % 100 AS script_id, o_orderpriority AS category, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS findings FROM orders GROUP BY ALL",
        "nudged_replies": r"""WITH t AS (SELECT conv_id // 10 AS session_id, conv_id * 100 + turn AS seq, CASE WHEN turn % 2 = 0 THEN 'Fine. ' ELSE text END AS x FROM conversations),
s AS (SELECT *, trim(x) <> '' AND NOT (ends_with(rtrim(x), '?') OR regexp_matches(lower(regexp_extract(rtrim(x), '(\S+)$', 1)), 'want|let''s|lets|should|shall|right')) AND length(trim(x)) < 120 AS lost FROM t),
n AS (SELECT *, count(*) FILTER (lost) OVER (PARTITION BY session_id ORDER BY seq) AS k FROM s)
SELECT session_id, seq, CASE WHEN lost THEN trim(x) || chr(10) || chr(10) || CASE WHEN k % 2 = 1 THEN 'What then?' ELSE 'And now?' END ELSE x END AS text FROM n""",
        "bullets": f"""WITH {CONV}, w AS (SELECT conv_id, turn, list_transform(string_split(line, ' '), lambda x: '- ' || x) AS b FROM c)
SELECT conv_id, turn, CASE WHEN len(b) > 3 THEN array_to_string(b[1:3], chr(10)) || ' (more)' ELSE array_to_string(b, chr(10)) END AS text FROM w""",
        "model_passes": f"WITH {CONV} SELECT script_id, pass, count(*) AS findings, CAST(0 AS BIGINT) AS errors, CAST(sum(length(line)) AS BIGINT) AS characters FROM c, (VALUES ('dialogue'), ('theme'), ('genre')) v(pass) GROUP BY ALL",
        "shown_items": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0",
        "trait_dials": "SELECT l_suppkey AS script_id, l_linestatus AS character, l_returnflag AS trait, CAST(greatest(1, least(10, CAST(l_quantity AS INTEGER) - 10)) AS INTEGER) AS score, count(*) AS n FROM lineitem WHERE l_linenumber <> 1 GROUP BY ALL",
        "principle_findings": "SELECT o_custkey AS script_id, 'plot_thread' AS category, 'medium' AS severity, o_orderpriority AS issue, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'F' GROUP BY ALL",
    }
