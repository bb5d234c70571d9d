"""DuckDB SQL for the operators that SQL can express."""
from __future__ import annotations


def windows(size: int) -> str:
    return rf"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + {size - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {size - 1})) AS i FROM t)),
late AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {size - 1})) AS j FROM late),
word AS (SELECT doc_id, w[j] AS x, j FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS j FROM t)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS s, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)"""


LINKS = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


TRIE = r"""WITH crc AS (SELECT list(x ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x FROM (SELECT unnest(range(256)) AS i))),
own AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 100 AS source, n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda v, b: xor(v >> 8, tab[(xor(v, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT c, count(*) AS n FROM own GROUP BY c), crc),
plan AS (SELECT a.c, a.source, a.h, least(a.h, coalesce(b.n, 0)) AS taken FROM ids a LEFT JOIN ids b ON a.source = b.c),
turn AS (SELECT c, pos AS d, r, t FROM (SELECT plan.c, own.pos, own.r, own.t, plan.taken FROM plan JOIN own ON own.c = plan.source) WHERE pos <= taken
  UNION ALL SELECT c, pos - h + taken, r, t FROM own JOIN plan USING (c) WHERE pos > h),
seq AS (SELECT plan.c, list({'r': r, 't': t} ORDER BY d) FILTER (WHERE d IS NOT NULL) AS s, count(d) AS n FROM plan LEFT JOIN turn USING (c) GROUP BY plan.c),
pre AS (SELECT c, d, d = n AS ends, md5(CAST(coalesce(s, [])[1 : d] AS VARCHAR)) AS k, md5(CAST(coalesce(s, [])[1 : d - 1] AS VARCHAR)) AS p, CASE WHEN d > 0 THEN length(s[d].t) ELSE 0 END AS size FROM (SELECT *, unnest(range(n + 1)) AS d FROM seq)),
node AS (SELECT d, k, any_value(p) AS p, min(c) AS c, count(*) AS n, any_value(size) AS size, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends) AS e FROM pre GROUP BY d, k),
kid AS (SELECT d - 1 AS d, p AS k, count(*) AS kids FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kid USING (d, k)),
below AS (SELECT pre.d, pre.k, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((f.n - 1) * f.size) AS saved FROM full_ f JOIN pre ON pre.c = f.c AND pre.d <= f.d GROUP BY ALL)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, u.c AS parent_conv_id, f.n AS n_convs, CAST(f.kids AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.e, '')) AS ends_sha256
FROM full_ f JOIN below USING (d, k) LEFT JOIN full_ u ON u.d = f.d - 1 AND u.k = f.p"""


RULES = r"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
size AS (SELECT unnest([5, 6, 7, 8, 9, 10]) AS g),
win AS (SELECT r, g, i, array_to_string(w[i : i + g - 1], ' ') AS k FROM (SELECT r, w, g, unnest(range(1, len(w) - g + 2)) AS i FROM t, size)),
seen AS (SELECT r, g, i, row_number() OVER (PARTITION BY r, g, k ORDER BY i) AS nth, count(*) OVER (PARTITION BY r, g, k) AS n FROM win),
cover AS (SELECT r, g, j, bool_or(nth > 1) AS later FROM (SELECT r, g, nth, unnest(range(i, i + g)) AS j FROM seen WHERE n > 1) GROUP BY ALL),
ngram AS (SELECT r, g, count(*) AS n, coalesce(sum(length(w[j])) FILTER (WHERE later), 0) AS chars FROM cover JOIN t USING (r) GROUP BY r, g),
line AS (SELECT r, x, length(x) AS n, row_number() OVER (PARTITION BY r, x) AS nth FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM t) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
lines AS (SELECT r, count(*) AS n, sum(n) AS chars, count(*) FILTER (WHERE nth > 1) AS again, coalesce(sum(n) FILTER (WHERE nth > 1), 0) AS again_chars FROM line GROUP BY r),
base AS (SELECT r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM t),
bad AS (SELECT r, bool_or(chars / word_chars > CASE g WHEN 5 THEN 0.15 WHEN 6 THEN 0.14 WHEN 7 THEN 0.13 WHEN 8 THEN 0.12 WHEN 9 THEN 0.11 ELSE 0.10 END) AS broken FROM ngram JOIN base USING (r) GROUP BY r),
out AS (SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, coalesce(again, 0) AS n_dup_lines, coalesce(e.n, 0) AS n_repeat_words, coalesce(broken, false) OR coalesce(again / l.n > 0.3, false) OR coalesce(again_chars / l.chars > 0.2, false) AS broken
  FROM base LEFT JOIN lines l USING (r) LEFT JOIN (SELECT r, n FROM ngram WHERE g = 8) e USING (r) LEFT JOIN bad USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR broken) AS kept FROM out"""


def oracles() -> dict[str, str]:
    return {"op11_repetition": RULES, "op12_prefix_trie": TRIE, "op4_embedding_dedup": LINKS, "op8_substrings": windows(20), "op10_suffixes": windows(50)}
