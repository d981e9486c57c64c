"""The same results in DuckDB SQL, by brute force, for those queries whose results SQL can express.

No SQL says what a trained model, a tokenizer file or a pseudorandom draw gives: op1, op3, op8, op9 and op10 have none,
and of op5 and op6 the columns that do not depend on them have queries of their own.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_ROWS = f"rows AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text, source, {_WORDS.format('text')} AS ws FROM documents)"
#: Roots of all nodes under symmetric links (a, b), from node(rid, id).
_ROOTS = """reach(rid, other) AS (SELECT rid, rid FROM node UNION SELECT r.rid, l.b FROM reach r JOIN link l ON r.other = l.a),
root AS (SELECT r.rid, min(n.id) AS root FROM reach r JOIN node n ON n.rid = r.other GROUP BY r.rid)"""

ORACLES: dict[str, str] = {}

ORACLES["op2_substring_dedup"] = f"""WITH {_ROWS},
win AS MATERIALIZED (SELECT rid, k, array_to_string(ws[k:k + 34], ' ') AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS k FROM rows)),
again AS (SELECT w FROM win GROUP BY w HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, k + j AS pos FROM (SELECT rid, k, unnest(range(35)) AS j FROM win SEMI JOIN again USING (w))),
word AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM rows),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY pos) AS t, count(*) AS n FROM word ANTI JOIN gone USING (rid, pos) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM rows LEFT JOIN kept USING (rid)"""

ORACLES["op4_embedding_near_dedup"] = f"""WITH RECURSIVE rows AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
good AS MATERIALIZED (SELECT rid, v, sqrt(list_dot_product(v, v)) AS n FROM rows WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT p.rid AS a, q.rid AS b FROM good p JOIN good q ON p.rid <> q.rid AND len(p.v) = len(q.v) AND list_dot_product(p.v, q.v) / (p.n * q.n) >= 0.9),
node AS (SELECT rid, vec_id AS id FROM rows), {_ROOTS},
links AS (SELECT a AS rid, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, root AS component_id, vec_id IS NOT DISTINCT FROM root AS kept FROM rows JOIN root USING (rid) LEFT JOIN links USING (rid)"""

_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op7_minhash_near_dedup"] = f"""WITH RECURSIVE rows AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format(_FOLDED)} AS ws FROM documents),
shingle AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(ws[k:k + 4], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS k FROM rows WHERE len(ws) > 0)),
size AS MATERIALIZED (SELECT rid, count(*) AS n FROM shingle GROUP BY rid),
common AS (SELECT p.rid AS a, q.rid AS b, count(*) AS c FROM shingle p JOIN shingle q ON p.s = q.s AND p.rid <> q.rid GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM common JOIN size x ON x.rid = a JOIN size y ON y.rid = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
node AS (SELECT rid, doc_id AS id FROM rows), {_ROOTS}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, root AS component_id, doc_id IS NOT DISTINCT FROM root AS kept FROM rows JOIN root USING (rid) LEFT JOIN size USING (rid)"""

ORACLES["quality_counts"] = rf"""WITH {_ROWS},
win AS MATERIALIZED (SELECT rid, k, array_to_string(ws[k:k + 4], ' ') AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS k FROM rows)),
again AS (SELECT rid, w FROM win GROUP BY rid, w HAVING count(*) > 1),
repeat AS (SELECT rid, count(DISTINCT k + j) AS n FROM (SELECT rid, k, unnest(range(5)) AS j FROM win SEMI JOIN again USING (rid, w)) GROUP BY rid),
line AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM rows) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
out AS (SELECT doc_id, len(ws)::BIGINT AS n_words, list_sum(list_concat([0], list_transform(ws, lambda w: length(w))))::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(line.n, 0)::BIGINT AS n_dup_lines, coalesce(repeat.n, 0)::BIGINT AS n_repeat_words
    FROM rows LEFT JOIN line USING (rid) LEFT JOIN repeat USING (rid))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM out"""

ORACLES["mix_targets"] = f"""WITH {_ROWS},
source AS (SELECT source, sum(len(ws))::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM rows GROUP BY source),
weighed AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM source),
-- in the order in which sources reach twice their size, what the others get each unit of weight once the first ones have stopped
stopped AS (SELECT *, 1.5 * sum(size) OVER () - coalesce(sum(2 * size) OVER o, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS weight
    FROM weighed WINDOW o AS (ORDER BY size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rest, weight FROM stopped WHERE rest * w / weight <= 2 * size ORDER BY size / w, k LIMIT 1)
SELECT doc_id, len(ws)::BIGINT AS size, s.size AS source_size, round(least(2.0 * s.size, coalesce(rest::DOUBLE * w / weight, 2.0 * s.size)), 6)::DOUBLE AS target
FROM rows JOIN weighed s ON rows.source IS NOT DISTINCT FROM s.source LEFT JOIN level ON true"""
