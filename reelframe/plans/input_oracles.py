"""DuckDB SQL for the queries of inputs.py."""
from __future__ import annotations

from ..operators.context import STUCK, VERDICTS
from .script_oracles import CONV

PEOPLE = f"{CONV}, pr AS (SELECT DISTINCT script_id, scene, name FROM c WHERE role <> 'system')"


def any_of(text: str, phrases: list[str]) -> list[str]:
    return [f"contains({text}, '" + p.replace("'", "''") + "')" for p in phrases]


def input_oracles() -> dict[str, str]:
    stuck = " + ".join(f"CAST({x} AS INTEGER)" for x in any_of("lower(t)", STUCK))
    return {
        "referenced_scenes": f"""WITH {PEOPLE}, t AS (SELECT script_id, conv_id * 100 + turn AS text_id, CAST(turn + 4 AS INTEGER) AS n FROM c),
s AS (SELECT script_id, text_id, n FROM t UNION SELECT t.script_id, text_id, scene FROM t JOIN pr ON pr.script_id = t.script_id WHERE pr.name IN ('USER', 'ASSISTANT'))
SELECT script_id, text_id, array_to_string(list_sort(list(n))[1:4], ',') AS scenes FROM s GROUP BY ALL""",
        "dialled_profiles": f"""WITH {PEOPLE}, k AS (SELECT script_id, name, count(DISTINCT scene) AS n, count(*) AS lines FROM c WHERE role <> 'system' GROUP BY ALL), t AS (SELECT script_id, count(DISTINCT scene) AS total FROM c GROUP BY ALL),
i AS (SELECT k.*, CASE WHEN n / total::DOUBLE >= 0.25 OR lines / sum(lines) OVER (PARTITION BY script_id)::DOUBLE >= 0.15 THEN 0 WHEN n / total::DOUBLE >= 0.08 THEN 1 ELSE 2 END AS w FROM k JOIN t USING (script_id)),
x AS (SELECT script_id, name, max(scene) AS last, max(scene) FILTER (scene <= 5) AS early FROM pr GROUP BY ALL)
SELECT script_id, name AS character, CASE WHEN script_id % 3 <> 0 THEN CAST(last * 10 AS BIGINT) END AS score, 'as in scene ' || early AS how_reads, row_number() OVER (PARTITION BY script_id ORDER BY w, n DESC, lines DESC, name) AS track_rank FROM i JOIN x USING (script_id, name)""",
        "full_fix_queue": """WITH r AS (SELECT o_custkey % 100 AS script_id, o_orderkey AS finding_index, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'major' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 20 + 1 END AS s FROM orders),
q AS (SELECT script_id, finding_index, severity, CASE WHEN s > 3 THEN CASE WHEN s <= 10 THEN 1 ELSE 2 END END AS act, CASE WHEN s % 2 = 0 THEN 'INT. ROOM ' || s END AS heading_raw, CASE WHEN finding_index % 3 = 0 THEN CASE WHEN finding_index % 2 = 0 THEN 'fixed' ELSE 'open' END END AS status FROM r)
SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'major' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, coalesce(act, 4), finding_index) AS queue_rank FROM q""",
        "rebased_pages": """WITH e AS (SELECT user_id AS script_id, event_id AS scene_number, CASE WHEN event_id % 13 <> 0 THEN event_id % 50 ELSE 0 END AS n, CASE WHEN event_id % 10 = 0 THEN event_id / 4 END AS real FROM events),
g AS (SELECT *, count(real) OVER (PARTITION BY script_id ORDER BY scene_number) AS k FROM e), b AS (SELECT *, max(real) OVER (PARTITION BY script_id, k) AS base, sum(CASE WHEN real IS NULL THEN n ELSE 0 END) OVER (PARTITION BY script_id, k ORDER BY scene_number) AS run FROM g)
SELECT script_id, scene_number, coalesce(base, 0) + run::DOUBLE / 54::DOUBLE AS page FROM b""",
        "variants_apart": """WITH n AS (SELECT DISTINCT p_type, p_name AS n, upper(p_name) AS u FROM part), v AS (SELECT DISTINCT x.p_type, least(x.n, y.n) AS a, greatest(x.n, y.n) AS b FROM n x JOIN n y ON x.p_type = y.p_type AND x.u < y.u
WHERE levenshtein(x.u, y.u) <= 2 OR (length(x.u) BETWEEN 4 AND length(y.u) AND starts_with(y.u, x.u) AND length(y.u) - length(x.u) <= 3) OR (length(y.u) BETWEEN 4 AND length(x.u) AND starts_with(x.u, y.u) AND length(x.u) - length(y.u) <= 3)),
o AS (SELECT DISTINCT p_type, upper(p_name) AS u, l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM o x JOIN o y ON x.p_type = y.p_type AND x.l_orderkey = y.l_orderkey WHERE x.p_type = v.p_type AND x.u = upper(v.a) AND y.u = upper(v.b))""",
        "long_parentheticals": f"""WITH {CONV}, l AS (SELECT conv_id, name, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, line FROM c WHERE role <> 'system'),
p AS (SELECT conv_id, name, i, 1 AS k, 'parenthetical' AS type, '(softly,' AS t FROM l UNION ALL SELECT conv_id, name, i, 2, 'parenthetical', 'turn ' || turn || ')' FROM l UNION ALL SELECT conv_id, name, i, 3, 'dialogue', 'so ' || line FROM l)
SELECT conv_id AS script_id, CAST(4 * (i - 1) + k + 1 AS INTEGER) AS element_index, type, sha256(t) AS sha256, name AS character FROM p""",
        "selected_rules": """SELECT CAST(0 AS INTEGER) AS asked, p_partkey FROM part WHERE p_type = 'ECONOMY' UNION ALL SELECT 1, p_partkey FROM part WHERE p_size % 3 = 1 AND p_size % 5 = 2 UNION ALL SELECT 2, p_partkey FROM part WHERE p_brand = 'Brand#11'""",
        "reordered_scenes": f"""WITH {CONV}, s AS (SELECT script_id, scene, row_number() OVER (PARTITION BY script_id ORDER BY scene DESC) AS n FROM (SELECT DISTINCT script_id, scene FROM c))
SELECT script_id, n AS scene_number, CAST(turn AS INTEGER) AS element_index, sha256(text) AS sha256 FROM c JOIN s USING (script_id, scene)""",
        "reply_scores": f"""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'my honest take: ' ELSE '' END || substr(text, 1, 150) AS t FROM conversations)
SELECT conv_id, turn, 2::DOUBLE - 2::DOUBLE * ({stuck}) - CASE WHEN length(t) < 60 THEN 1.5::DOUBLE ELSE 0::DOUBLE END - CASE WHEN turn % 2 = 0 AND NOT ({" OR ".join(any_of("lower(t)", VERDICTS))}) THEN 2::DOUBLE ELSE 0::DOUBLE END AS score FROM r""",
    }
