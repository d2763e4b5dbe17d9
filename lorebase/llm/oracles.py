"""DuckDB SQL for the queries that SQL can express.

The others: op2 (byte-pair merges), op5 (encoded lengths), op6 (hashes of the engine), op7 to op9 and op12 (trained models),
op10 (deflated images) and op3 (a seeded hash decides whole documents) are tested against brute force,
libraries, round trips or held-out accuracy in tests/llm.
"""

from __future__ import annotations

#: A window of 100 bytes is repeated when an equal one starts earlier; runs of repeated windows are the removed spans.
OP1 = """
WITH n AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, s, md5_number(substring(h, 2 * s + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS s FROM n)),
f AS (SELECT g, min(doc_id * 100000000 + s) AS first FROM k GROUP BY g),
r AS (SELECT doc_id, s, s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -101) + 100 AS opens FROM k JOIN f USING (g) WHERE doc_id * 100000000 + s > first),
i AS (SELECT doc_id, s, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM r),
c AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, run),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS past FROM c),
t AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substring(h, 2 * past + 1, 2 * (a - past)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS kept FROM p JOIN n USING (doc_id) GROUP BY doc_id)
SELECT n.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(from_hex(coalesce(kept, h))) AS kept_sha256 FROM n LEFT JOIN t USING (doc_id)
"""

OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v AS doc_id, min(u) AS component_id FROM r GROUP BY 1) USING (doc_id)
"""

#: crc32 of the decimal doc_id, bit by bit.
CRC = r"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"
#: Stretches of equal words q apart are found by equal runs of six words: every run holds at least six such places.
OP11 = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, coalesce(%s, 1) AS h FROM documents),
g AS (SELECT doc_id, ws, len(ws) AS n, h %% 10 = 0 AND len(ws) > 0 AS hit, h // 10 AS g FROM t),
a AS (SELECT *, CASE WHEN hit THEN g %% n END AS a FROM g),
w AS (SELECT doc_id, n, CASE WHEN hit THEN list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) %% (1 + (n - a) // (3 + g %% 8)) END + 1]) ELSE ws END AS ws FROM a),
u AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 6], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(n - 5)) AS i FROM w WHERE n > 11)),
p AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p),
l AS (SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 6 + q AS length FROM s GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM l WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
b AS (SELECT doc_id, count(*) AS n_runs, max({'length': length, 'start': -start, 'period': -period}) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(ws) AS word FROM w WHERE doc_id IN (SELECT doc_id FROM r)) ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, -best.start AS start, best.length AS length, -best.period AS period, 1000 * best.length // -best.period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, array_to_string(ws, ' '))) AS collapsed_sha256 FROM w LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
""" % CRC

#: Levels by recursion, then every leaf folded along its siblings (p: their places, q: theirs with digests, e: the fold).
OP13 = r"""
WITH RECURSIVE f AS (SELECT doc_id, lang, n_chars, coalesce(strlen(source) || ':' || source, '-') AS s, coalesce(strlen(lang) || ':' || lang, '-') AS l, coalesce(strlen(text) || ':' || text, '-') AS t, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS i,
  %s AS crc FROM documents),
d AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256(i || s || l || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || t) AS leaf,
  CASE WHEN crc %% 7 = 0 THEN sha256(i || s || l || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || t) END AS trial FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS j FROM d),
n AS (SELECT 0 AS lv, tree, j AS i, leaf AS h, count(*) OVER (PARTITION BY tree) AS c FROM o
  UNION ALL SELECT lv + 1, tree, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((c + 1) // 2) FROM n WHERE c > 1 GROUP BY lv, tree, i // 2),
r AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS k FROM n WHERE c = 1),
m AS (SELECT 0 AS lv, k AS i, subroot AS h, count(*) OVER () AS c FROM r
  UNION ALL SELECT lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((c + 1) // 2) FROM m WHERE c > 1 GROUP BY lv, i // 2),
u AS (SELECT tree, lv, i, h, c FROM n UNION ALL SELECT NULL, lv, i, h, c FROM m),
p AS (SELECT doc_id, tree, j, 0 AS top, lv, j >> lv AS i FROM o JOIN (SELECT DISTINCT tree, lv FROM n WHERE c > 1) USING (tree)
  UNION ALL SELECT doc_id, o.tree, j, 1, lv, k >> lv FROM o JOIN r USING (tree), (SELECT DISTINCT lv FROM m WHERE c > 1)),
q AS (SELECT p.tree, j, row_number() OVER (PARTITION BY p.tree, j ORDER BY top, p.lv) AS step, (p.i & 1) AS side, coalesce(a.h, b.h) AS h FROM p
  LEFT JOIN n a ON top = 0 AND a.tree = p.tree AND a.lv = p.lv AND a.i = xor(p.i, 1) LEFT JOIN m b ON top = 1 AND b.lv = p.lv AND b.i = xor(p.i, 1)),
w AS (SELECT tree, j, list({'side': side, 'h': coalesce(h, '')} ORDER BY step) AS steps, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof_sha256 FROM q GROUP BY tree, j),
e AS (SELECT tree, j, 0 AS step, coalesce(trial, leaf) AS v FROM o
  UNION ALL SELECT e.tree, e.j, step + 1, sha256(CASE WHEN steps[step + 1].side = 1 THEN steps[step + 1].h || v ELSE v || steps[step + 1].h END) FROM e JOIN w USING (tree, j) WHERE step < len(steps)),
z AS (SELECT tree, j, arg_max(v, step) AS folded_root FROM e GROUP BY tree, j)
SELECT doc_id, leaf, subroot, (SELECT h FROM m WHERE c = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = (SELECT h FROM m WHERE c = 1) AS verified
FROM o JOIN r USING (tree) LEFT JOIN w USING (tree, j) JOIN z USING (tree, j)
""" % CRC

SQL: dict[str, str] = {"op1_suffix_dedup": OP1, "op4_ngram_join": OP4, "op11_runs": OP11, "op13_manifest": OP13}
