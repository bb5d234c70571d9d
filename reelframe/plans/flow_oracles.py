"""DuckDB SQL for the queries of flow.py, for streams and for the profile fold."""
from __future__ import annotations

from .script_oracles import CONV

#: The log of edited turns: what each entry is about, by the two stacks of a script.
LOG = f"""{CONV}, o AS (SELECT script_id AS k, conv_id * 100 + turn AS seq, CASE WHEN conv_id % 7 = 6 AND turn = 4 THEN 'reset' WHEN turn % 3 = 0 THEN 'edit' WHEN turn % 3 = 1 AND conv_id % 2 = 0 THEN 'undo' WHEN turn % 3 = 2 AND conv_id % 4 = 0 THEN 'redo' END AS op FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS i FROM o WHERE op IS NOT NULL),
f AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS BIGINT) AS target, CAST([] AS BIGINT[]) AS done, CAST([] AS BIGINT[]) AS undone FROM n
UNION ALL SELECT n.k, n.i, n.seq, n.op, CASE n.op WHEN 'edit' THEN n.seq WHEN 'undo' THEN done[len(done)] WHEN 'redo' THEN undone[len(undone)] END,
CASE n.op WHEN 'edit' THEN list_append(done, n.seq) WHEN 'undo' THEN done[1 : len(done) - 1] WHEN 'redo' THEN CASE WHEN len(undone) > 0 THEN list_append(done, undone[len(undone)]) ELSE done END ELSE CAST([] AS BIGINT[]) END,
CASE n.op WHEN 'undo' THEN CASE WHEN len(done) > 0 THEN list_append(undone, done[len(done)]) ELSE undone END WHEN 'redo' THEN undone[1 : len(undone) - 1] ELSE CAST([] AS BIGINT[]) END FROM f JOIN n ON n.k = f.k AND n.i = f.i + 1),
ev AS (SELECT k, target, seq, op IN ('edit', 'redo') AS fresh FROM f WHERE target IS NOT NULL UNION ALL SELECT r.k, e.seq, r.seq, false FROM f r JOIN f e ON e.k = r.k AND e.op = 'edit' AND e.seq < r.seq WHERE r.op = 'reset'),
ch AS (SELECT * FROM (SELECT *, lag(fresh, 1, false) OVER (PARTITION BY k, target ORDER BY seq) AS was FROM ev) WHERE fresh <> was),
v AS (SELECT k, target, fresh, seq AS from_seq, lead(seq) OVER (PARTITION BY k, target ORDER BY seq) AS to_seq FROM ch UNION ALL SELECT script_id, conv_id * 100 + turn, false, NULL, min(ch.seq) FROM c LEFT JOIN ch ON ch.k = script_id AND ch.target = conv_id * 100 + turn GROUP BY ALL),
w AS (SELECT script_id, scene AS scene_number, CAST(turn AS INTEGER) AS element_index, CASE WHEN fresh THEN 'line ' || target ELSE turn || ': ' || line END AS text, from_seq, to_seq FROM v JOIN c ON c.script_id = v.k AND c.conv_id * 100 + turn = v.target)"""

PRIORITIES = "o AS (SELECT o_custkey AS k, o_orderpriority AS c, bool_or(o_orderstatus = 'F') AS f FROM orders GROUP BY ALL)"


def reach(pairs: str) -> str:
    return f"needs(c, r) AS (VALUES {pairs}), reach AS (SELECT c, r FROM needs UNION SELECT reach.c, needs.r FROM reach JOIN needs ON needs.c = reach.r)"


DIMENSIONS = "['detail_level', 'directness', 'probe_appetite', 'pushback_appetite', 'support_style', 'mood']"
REFRESH = f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS writer, {DIMENSIONS}[event_id % 6 + 1] AS dimension, event_id // 6 % 4 AS q, event_id % 6 AS i, event_id * 37 % 140 / 100 AS sure, event_id AS seq FROM events),
p AS (SELECT *, CASE q WHEN 0 THEN ['short', 'gentle', 'low', 'low', 'generate', 'high'][i + 1] WHEN 1 THEN ['deep', 'direct', 'high', 'high', 'discuss', 'high'][i + 1] WHEN 2 THEN ['balanced', 'balanced', 'medium', 'medium', 'balanced', 'medium'][i + 1] ELSE 'no_evidence' END AS value FROM e),
h AS (SELECT writer, dimension, value, sure, seq FROM p WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY writer, dimension ORDER BY seq DESC) = 1),
b AS (SELECT writer, dimension, value AS v, least(sure, 1) AS s FROM p WHERE seq % 2 = 1 AND q < 3 AND i < 5 QUALIFY row_number() OVER (PARTITION BY writer, dimension ORDER BY least(sure, 1) DESC, seq) = 1),
j AS (SELECT *, s IS NOT NULL AND (sure IS NULL OR s > sure) AS refreshed FROM h FULL JOIN b USING (writer, dimension))
SELECT writer, dimension, CASE WHEN refreshed THEN v ELSE value END AS value, CAST(CASE WHEN refreshed THEN round(s, 2) ELSE sure END AS DOUBLE) AS confidence, CAST(CASE WHEN refreshed THEN round(s * 20) ELSE seq END AS BIGINT) AS pos, CAST(CASE WHEN refreshed THEN round((1 - s) * 20) ELSE 1 END AS BIGINT) AS neg, refreshed FROM j"""

PROFILES = r"""WITH RECURSIVE t AS (SELECT CAST(conv_id // 10 AS VARCHAR) AS writer, conv_id * 100 + turn AS seq, turn % 4 AS k, turn % 2 = 1 AS probed, CASE turn % 4 WHEN 0 THEN 'keep it short' WHEN 1 THEN 'go deeper' WHEN 2 THEN 'no, I disagree' ELSE '' END || ' ' || text AS t FROM conversations),
n AS (SELECT *, len(list_filter(string_split_regex(trim(t), '\s+'), lambda x: x <> '')) AS words FROM t),
s AS (SELECT writer, seq, 'detail_level' AS dimension, CASE k WHEN 0 THEN 'short' ELSE 'deep' END AS pole, true AS explicit, 'short' AS a, 'deep' AS b FROM n WHERE k < 2
UNION ALL SELECT writer, seq, 'probe_appetite', CASE WHEN words > 3 AND (regexp_matches(t, '(?i)\b(because|since|the reason|my instinct|i feel|i think|the thing is)\b') OR (words >= 6 AND NOT ends_with(rtrim(t, ' '), '?'))) THEN 'high' ELSE 'low' END, false, 'low', 'high' FROM n WHERE probed AND trim(t, ' ') <> ''
UNION ALL SELECT writer, seq, 'pushback_appetite', CASE WHEN regexp_matches(t, '(?i)\b(i disagree\b|no,|but |that won''?t work\b|that doesn''?t work\b|that loses\b|keep it anyway\b|actually no\b)') THEN 'high' WHEN regexp_matches(t, '(?i)\b(ok(?:ay)?|sure|fine|good point|makes sense|agree(?:d)?|sounds good|go with it)\b') THEN 'low' END, false, 'low', 'high' FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY writer, dimension ORDER BY seq) AS i FROM s WHERE pole IS NOT NULL),
f AS (SELECT writer, dimension, i, pole AS value, CAST(1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS neg, CAST(1 AS BIGINT) AS led, CAST(0 AS BIGINT) AS against FROM o WHERE i = 1
UNION ALL SELECT writer, dimension, i, CASE WHEN n > p THEN CASE value WHEN a THEN b ELSE a END ELSE value END, greatest(p, n), least(p, n), p, CASE WHEN n > p THEN 0 WHEN explicit AND pole <> value AND 200 * (p + 2) > 119 * (p + n + 4) THEN against + 1 ELSE against END
FROM (SELECT o.*, f.value, f.against, f.pos + CASE WHEN o.pole = f.value THEN 1 ELSE 0 END AS p, f.neg + CASE WHEN o.pole <> f.value THEN 1 ELSE 0 END AS n FROM f JOIN o ON o.writer = f.writer AND o.dimension = f.dimension AND o.i = f.i + 1))
SELECT writer, dimension, value, CAST(pos AS INTEGER) AS pos, CAST(neg AS INTEGER) AS neg, CAST(printf('%.2f', (led + 2) / (pos + neg + 4)) AS DOUBLE) AS confidence, against >= 2 AS suppressed, 200 * (led + 2) > 119 * (pos + neg + 4) AND pos + neg >= 3 AND against < 2 AS gated
FROM f QUALIFY row_number() OVER (PARTITION BY writer, dimension ORDER BY i DESC) = 1"""


def flow_oracles() -> dict[str, str]:
    return {
        "element_versions": f"WITH RECURSIVE {LOG} SELECT script_id, scene_number, element_index, sha256(text) AS sha256, from_seq, to_seq FROM w",
        "lines_as_of": f"WITH RECURSIVE {LOG}, h AS (SELECT k AS script_id, (min(seq) + max(seq)) // 2 AS half FROM n GROUP BY k) SELECT script_id, scene_number, element_index, text FROM w JOIN h USING (script_id) WHERE coalesce(from_seq <= half, true) AND coalesce(to_seq > half, true) AND text LIKE 'line %'",
        "edit_outcomes": f"WITH RECURSIVE {LOG} SELECT k AS script_id, op, count(*) AS n, count(*) AS restored, CAST(0 AS BIGINT) AS failed FROM f WHERE target IS NOT NULL GROUP BY k, op",
        "stage_retries": f"""WITH RECURSIVE {PRIORITIES}, {reach("('2-HIGH', '1-URGENT'), ('3-MEDIUM', '2-HIGH'), ('5-LOW', '3-MEDIUM')")}
SELECT k AS script_id, c AS category, CASE WHEN max(f) THEN 'failed' ELSE 'needed' END AS reason FROM (SELECT k, c, true AS f FROM o WHERE f UNION ALL SELECT o.k, reach.r, false FROM o JOIN reach USING (c) WHERE f) GROUP BY ALL""",
        "gated_outcomes": f"""WITH RECURSIVE {PRIORITIES}, {reach("('2-HIGH', '1-URGENT'), ('3-MEDIUM', '2-HIGH')")},
g AS (SELECT k, c, f OR EXISTS (SELECT 1 FROM reach JOIN o x ON x.c = reach.r WHERE reach.c = o.c AND x.k = o.k AND x.f) AS failed FROM o)
SELECT k AS script_id, count(*) AS n, count(*) FILTER (failed) AS failed, CASE WHEN count(*) FILTER (failed) = 0 THEN 'complete' WHEN count(*) FILTER (failed) < count(*) THEN 'partial' ELSE 'failed' END AS result FROM g GROUP BY k""",
        "draft_uploads": """WITH r AS (SELECT o_custkey AS k, o_orderkey AS x, o_orderstatus <> 'F' AS up, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderkey) AS i FROM orders)
SELECT k AS script_id, 'draft-' || i AS draft_name, CAST(x AS VARCHAR) AS source_filename, i = max(i) OVER (PARTITION BY k) AS active FROM r""",
        "refresh_merges": REFRESH,
        "durable_progress": "SELECT user_id AS script_id, event_type AS stage, CAST(max(event_id) AS VARCHAR) AS detail, max(event_id) AS ts FROM events GROUP BY ALL",
        "graduated_ideas": "SELECT max(o_custkey) AS idea_id, o_orderkey % 20 AS session_id, o_custkey % 50 AS project, arg_max(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, o_custkey) AS content FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 3 = 0 GROUP BY ALL",
        "stall_alerts": """WITH m AS (SELECT (max(epoch_us(ts)) // 1000 - 7200000) * 1000 AS mark FROM events), b AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS u, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events)
SELECT user_id AS script_id, event_type AS stage, CAST(event_id AS VARCHAR) AS detail, u AS last_us, u + 86400000000 AS stalled_us FROM b, m WHERE event_id % 3 <> 0 AND least(coalesce(next, mark), mark) > u + 86400000000""",
        "rolling_replies": "SELECT event_id, avg(CAST(round(value * 100) AS DOUBLE)) OVER k AS rolling_mean, count(value) OVER k AS rolling_n FROM events WINDOW k AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)",
        "profile_fold": PROFILES,
    }
