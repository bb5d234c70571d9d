"""DuckDB SQL for the queries of assembly.py."""
from __future__ import annotations

from .script_oracles import CONV

NL = "chr(10)"
FOUND = """f AS (SELECT o_custkey AS k, o_orderkey AS i, o_orderpriority AS c, o_orderstatus AS issue, CASE WHEN o_orderkey % 2 = 0 THEN 'it shows' ELSE '' END AS why, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 20 END AS ref,
o_orderkey % 4 = 0 AS lost, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS quote FROM orders), d AS (SELECT o_custkey AS k, o_orderkey AS i, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'F')"""


def lines(text: str, order: str) -> str:
    return f"string_agg({text}, {NL} ORDER BY {order})"


def part(place: int, title: str, source: str, text: str, order: str) -> str:
    return f"SELECT k, {place} AS place, 0 AS first, '## {title}' || {NL} || {lines(text, order)} AS body FROM {source} GROUP BY k"


def report_sql() -> str:
    quote = f"CASE WHEN quote <> '' THEN {NL} || '  > ' || quote"
    parts = [
        part(1, "Coverage", "customer_", f"'**Recommendation:** PASS' || {NL} || '**Logline:** ' || m || {NL} || '**Genre:** ' || lower(m) || {NL} || CASE WHEN k % 2 = 0 THEN '**Tone:** dry' || {NL} ELSE '' END || '**Strengths:** ' || m || '; wit'", "k"),
        part(2, "Logline", "customer_", f"'**Signal:** MUDDLED' || {NL} || '**Missing:** ' || lower(m) || {NL} || '**Tightened:** ' || m", "k"),
        part(3, "Characters", "(SELECT * FROM f WHERE i % 7 = 0)", f"'- **' || issue || '** ' || c || {quote} || CASE WHEN lost THEN ' (quote not found)' ELSE '' END ELSE '' END", "i"),
        f"SELECT k, 4, min(i), '## ' || c || {NL} || " + lines(f"'- **low** ' || issue || CASE WHEN lost THEN ' (quote not found)' ELSE '' END || {quote} ELSE '' END", "i") + " FROM f GROUP BY k, c",
        part(5, "Setups and payoffs", "d", "'- **paid** ' || p || ' (scene ' || (i % 9) || '; payoff: never)' || CASE WHEN i % 3 = 0 THEN '; so' ELSE '' END", "i"),
        part(6, "Pace", "d", "'- scene ' || i || ': ' || (i % 100) || ' of 100'", "i"),
        part(7, "Dials", "d", "'- ' || p || ', ' || i || ': ' || (i % 10) || ' of 10'", "p, CAST(i AS VARCHAR)"),
        part(8, "Formatting", "d", "'- **low** general: ' || p", "i"),
        f"SELECT k, 9, 0, '## Quotes' || {NL} || 'verified ' || count(*) FILTER (NOT lost) || ', not found ' || count(*) FILTER (lost) || ', no quote 0, scene not found 0' FROM f GROUP BY k",
    ]
    return f"""WITH {FOUND}, customer_ AS (SELECT c_custkey AS k, c_mktsegment AS m FROM customer WHERE c_custkey % 3 = 0), p AS ({' UNION ALL '.join(parts)}), b AS (SELECT k, string_agg(body, {NL} || {NL} ORDER BY place, first) AS body FROM p GROUP BY k)
SELECT c_custkey AS script_id, '# Report' || {NL} || {NL} || 'Scenes: ' || (c_custkey % 90) || {NL} || 'Minutes: 0' || {NL} || {NL} || coalesce(body, '') AS markdown FROM customer LEFT JOIN b ON k = c_custkey"""


def assembly_oracles() -> dict[str, str]:
    return {
        "ledger_inputs": f"""WITH o AS (SELECT user_id AS k, {lines("'Scene ' || event_id || ': ' || event_type", 'event_id')} AS t FROM events GROUP BY k),
s AS (SELECT user_id AS k, 0 AS kind, -count(*) AS a, 0 AS b, event_type AS c, '- object ' || event_type || ' in ' || (SELECT string_agg('S' || x, ', ' ORDER BY x) FROM (SELECT DISTINCT unnest(list(event_id % 20)) AS x)) AS line FROM events GROUP BY user_id, event_type
UNION ALL SELECT user_id, 1, event_id % 50, event_id, '', '- promise of ' || upper(event_type) || ' in S' || (event_id % 50) || ': I will ' || event_id FROM events WHERE event_id % 10 = 0),
g AS (SELECT k, {lines('line', 'kind, a, b, c')} AS s FROM s WHERE k % 3 <> 0 GROUP BY k)
SELECT k AS script_id, t || {NL} || {NL} || 'Candidates:' || {NL} || coalesce(s, '(none)') AS text FROM o LEFT JOIN g USING (k)""",
        "ledger_entries": """WITH e AS (SELECT l_suppkey AS script_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS entry_index, 'line ' || l_linenumber AS setup, CASE WHEN l_returnflag = 'R' THEN 'other' ELSE l_returnflag END AS kind,
CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS INTEGER) END AS payoff, CASE l_returnflag WHEN 'R' THEN 'paid' WHEN 'A' THEN 'abandoned' ELSE 'dangling' END AS status, l_linestatus AS note FROM lineitem WHERE l_linenumber <> 1)
SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY CASE status WHEN 'dangling' THEN 0 WHEN 'abandoned' THEN 1 ELSE 3 END, entry_index, setup, kind, payoff NULLS FIRST, status, note) AS queue_rank FROM e QUALIFY queue_rank <= 12""",
        "verified_reads": f"""WITH {CONV} SELECT DISTINCT script_id, name AS character, CASE WHEN role = 'user' THEN 'scene_not_found' ELSE 'verified' END AS status, CASE WHEN role <> 'user' THEN min(scene) OVER (PARTITION BY script_id) END AS matched_scene FROM c QUALIFY role <> 'system'""",
        "logline_inputs": f"SELECT c_custkey AS script_id, 'Logline: A story of ' || lower(c_mktsegment) || {NL} || {NL} || 'Scene 1: ' || c_mktsegment AS text FROM customer WHERE c_custkey % 4 <> 0",
        "genre_inputs": f"""WITH c AS (SELECT c_custkey AS script_id, c_mktsegment AS m, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'BUILDING' ELSE c_mktsegment END AS g FROM customer)
SELECT script_id, 'Conventions of ' || lower(g) || ': keep ' || g || {NL} || {NL} || 'Scene 1: ' || m AS text FROM c""",
        "report_summaries": f"""WITH {FOUND}, a AS (SELECT k, {lines("'- (' || c || ', low) ' || coalesce('Scene ' || ref || ', Scene 30', 'General') || ': ' || issue || CASE WHEN why <> '' THEN '; ' || why ELSE '' END || CASE WHEN lost THEN ' [quote not found]' ELSE '' END", 'i')} AS found FROM f GROUP BY k),
n AS (SELECT k, {lines("'- ' || p", 'i')} AS notes FROM d GROUP BY k)
SELECT c_custkey AS script_id, CASE WHEN c_custkey % 3 <> 0 AND found IS NULL AND notes IS NULL THEN '(no report)' ELSE concat_ws({NL} || {NL}, CASE WHEN c_custkey % 3 = 0 THEN 'Coverage: PASS' || {NL} || 'Logline: ' || c_mktsegment || {NL} || 'Genre and tone: ' || lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN ' / dry' ELSE '' END || {NL} || 'Strengths: ' || c_mktsegment || '; wit' || {NL} || 'Weaknesses: ' END,
'Findings:' || {NL} || found, 'Formatting:' || {NL} || notes) END AS summary FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN n ON n.k = c_custkey""",
        "report_markdown": report_sql(),
        "chat_prompts": f"""WITH {CONV}, r AS (SELECT *, conv_id * 100 + turn AS seq, 'see scene ' || (turn + 8) || ' ' || line AS said FROM c), t AS (SELECT *, array_to_string(list(role || ': ' || said) OVER (PARTITION BY script_id ORDER BY seq ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING), {NL}) AS earlier FROM r),
p AS (SELECT script_id, name, list_sort(list(DISTINCT scene)) AS scenes FROM c WHERE role <> 'system' GROUP BY ALL), m AS (SELECT script_id, {lines("name || ': ' || array_to_string(scenes, ', ')", 'len(scenes) DESC, name')} AS map FROM p GROUP BY ALL),
b AS (SELECT script_id, scene, 'Scene ' || scene || {NL} || {lines('line', 'turn')} AS body FROM c GROUP BY script_id, scene)
SELECT t.script_id, seq AS text_id, sha256(concat_ws({NL} || {NL}, 'Cast:' || {NL} || map, CASE WHEN t.script_id % 2 = 0 THEN 'Report:' || {NL} || 'report of ' || t.script_id END, body, CASE WHEN body IS NULL THEN 'No such scenes:' || {NL} || (turn + 8) END,
CASE WHEN earlier <> '' THEN 'Earlier:' || {NL} || earlier END, CASE WHEN turn % 3 = 0 THEN 'Quoted' || CASE WHEN turn % 2 = 0 THEN ' from scene ' || greatest(turn, 1) ELSE '' END || ':' || {NL} || 'at ' || turn END, 'Writer:' || {NL} || said)) AS sha256
FROM t LEFT JOIN m ON m.script_id = t.script_id LEFT JOIN b ON b.script_id = t.script_id AND b.scene = turn + 8 WHERE role = 'user'""",
    }
