"""DuckDB SQL for the queries that SQL can express."""

QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, unnest(CASE WHEN len(w) < 3 THEN [] ELSE range(1, len(w) - 1) END) AS i, w FROM w),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
          SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS k FROM win) WHERE k > 1)
        GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
      + CASE WHEN n_symbols > n_words THEN 4 ELSE 0 END
      + CASE WHEN n_lines > 0 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
      + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 16 ELSE 0 END)::BIGINT AS fail_bits
      FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits, 2 AS policy FROM b
"""

EXACT = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""

MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT coalesce(source, chr(1114111)) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
s1 AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source) - 1) % 3)::INT + 1]::DOUBLE AS w,
              2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s0),
s2 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT *, (SELECT level FROM s2 WHERE level * w < cap ORDER BY cap / w, source LIMIT 1) AS lv FROM s2),
s AS (SELECT source, source_size, CASE WHEN lv IS NULL THEN cap ELSE least(cap, lv * w) END AS target FROM s3),
x AS (SELECT doc_id, coalesce(d.source, chr(1114111)) AS source, size, source_size, target,
             CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS g FROM d JOIN s ON s.source = coalesce(d.source, chr(1114111))),
k0 AS (SELECT source, g, any_value(target) AS target, sum(size) AS sz FROM x WHERE size > 0 GROUP BY source, g),
k1 AS (SELECT source, g, (target - 2.0::DOUBLE * coalesce(sum(sz) OVER (PARTITION BY source ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(sz * g) OVER (PARTITION BY source ORDER BY g DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM k0),
k AS (SELECT source, coalesce(arg_max(c, g) FILTER (WHERE c * g <= 2.0), 1073741824.0)::DOUBLE AS c FROM k1 GROUP BY source),
e AS (SELECT x.*, coalesce(least(2.0::DOUBLE, k.c * g), 0.0) AS want,
             (('0x' || substr(md5('mix-1:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM x LEFT JOIN k USING (source)),
f AS (SELECT *, floor(want + 1e-9::DOUBLE) AS sure FROM e),
r AS (SELECT *, target - sum(sure * size) OVER (PARTITION BY source) AS room, want - sure AS p FROM f),
t AS (SELECT *, CASE WHEN p > 1e-9::DOUBLE AND size > 0 THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS t FROM r),
a AS (SELECT *, t IS NOT NULL AND sum(size) FILTER (WHERE t IS NOT NULL) OVER (PARTITION BY source ORDER BY t NULLS LAST, doc_id
              ROWS UNBOUNDED PRECEDING) <= room AS in1 FROM t),
b AS (SELECT *, room - coalesce(sum(size) FILTER (WHERE in1) OVER (PARTITION BY source), 0) AS room2 FROM a),
b2 AS (SELECT *, t IS NOT NULL AND NOT in1 AND size <= room2 AS cand FROM b),
c AS (SELECT *, cand AND sum(size) FILTER (WHERE cand) OVER (PARTITION BY source ORDER BY t NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING)
              - size / 2 <= room2 AS in2 FROM b2)
SELECT doc_id, size, source_size, target, ((sure + CASE WHEN in1 OR in2 THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM c
"""

DECONTAMINATE = r"""
WITH i0 AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, list_aggregate(w[i : i + least(len(w), 10) - 1], 'string_agg', ' ') AS body
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM i0 WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM win),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
g AS (SELECT doc_id, m, i, list_aggregate(w[i : i + m - 1], 'string_agg', ' ') AS body
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d CROSS JOIN lens WHERE len(w) >= m)),
h AS (SELECT g.doc_id, g.i, g.m, win.item_id FROM g JOIN win ON g.body = win.body AND g.m = win.m),
hit AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id IS NOT DISTINCT FROM hit.doc_id LEFT JOIN it ON d.doc_id IS NOT DISTINCT FROM it.doc_id
"""

REPAIR = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
       lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
               string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ord(ch)::BIGINT)),
               lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS kind
      FROM conversations, crc),
e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
             regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS solid, substr(role, 1, 1) AS initial FROM e),
f AS MATERIALIZED (SELECT *, CASE WHEN solid = '' THEN 'blank'
               WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
               WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS two FROM o),
cl(p, q, cost, audit) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'),
                                 (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 3, 2, 'I'), (3, 2, 2, 'I')),
step(p, x, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ed AS (SELECT p, q, x, 'K' AS op, 0 AS cost FROM step UNION ALL SELECT p, q, NULL, 'R', 2 FROM step WHERE x <> 's'
       UNION ALL SELECT p, p, NULL, 'D', 3 FROM (VALUES (0), (1), (2), (3)) s(p)),
mv AS MATERIALIZED (SELECT cl.p, ed.q, ed.x, ed.op, cl.cost + ed.cost AS cost, cl.audit || ed.op AS audit FROM cl JOIN ed ON cl.q = ed.p),
v(conv_id, pos, state, cost, audit) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, 0::BIGINT, '' FROM f
  UNION ALL
  SELECT conv_id, pos, state, min(cost)::BIGINT, arg_min(audit, (cost, audit)) FROM (
    SELECT v.conv_id, f.pos, mv.q AS state, v.cost + mv.cost + CASE WHEN f.fault = 'truncated' AND mv.op <> 'D' THEN 1 ELSE 0 END AS cost,
           v.audit || mv.audit AS audit
    FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.pos = v.pos + 1
    JOIN mv ON mv.p = v.state AND (mv.op = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (mv.op = 'R' OR mv.x = f.initial))))
  GROUP BY conv_id, pos, state),
told AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
         FROM f GROUP BY conv_id),
fin AS (SELECT v.conv_id, min(v.cost + cl.cost)::BIGINT AS cost,
               arg_min(v.audit || cl.audit, (v.cost + cl.cost, v.audit || cl.audit)) AS audit
        FROM v JOIN told ON told.conv_id IS NOT DISTINCT FROM v.conv_id AND v.pos = told.n JOIN cl ON cl.p = v.state AND cl.q IN (0, 3)
        GROUP BY v.conv_id),
ops AS (SELECT conv_id, i, substr(audit, i, 1) AS op FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM fin)),
num AS (SELECT *, count(*) FILTER (op <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS pos FROM ops),
outs AS (SELECT num.conv_id, num.op, f.role, f.text, row_number() OVER (PARTITION BY num.conv_id ORDER BY i) AS k, f.initial
         FROM num LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM num.conv_id AND f.pos = num.pos AND num.op <> 'I' WHERE num.op <> 'D'),
sys AS (SELECT *, max(CASE WHEN k = 1 AND op = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM outs),
rep AS (SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN (k + s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
                                   CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS body FROM sys GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN rep ON rep.conv_id IS NOT DISTINCT FROM c.conv_id
"""

#: Columns that may be null are doubles, as data frames have them on both sides.
RUNS = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
       lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t),
d0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
              xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
                string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
       FROM documents, crc),
d1 AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM d0),
d AS MATERIALIZED (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(w, lambda x, i: CASE WHEN i - 1 < a THEN x
              ELSE w[(a + (i - 1 - a) % (1 + (n - a) // parts) + 1)::INT] END) ELSE w END AS w FROM d1),
pos AS MATERIALIZED (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM d),
pair AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i),
island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pair),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM island GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(12, 2 * q)),
run AS MATERIALIZED (SELECT doc_id, s, len, min(q) AS q FROM stretch GROUP BY doc_id, s, len),
told AS (SELECT doc_id, count(*) AS n_runs, arg_min(s, (-len, s, q)) AS s, arg_min(len, (-len, s, q)) AS len, arg_min(q, (-len, s, q)) AS q,
                string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT pos.doc_id, string_agg(x, ' ' ORDER BY pos.i) AS body FROM pos LEFT JOIN gone ON gone.doc_id = pos.doc_id AND gone.i = pos.i
         WHERE gone.i IS NULL GROUP BY pos.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::DOUBLE AS start, told.len::DOUBLE AS length, q::DOUBLE AS period,
       (1000 * told.len // q)::DOUBLE AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM d LEFT JOIN told ON told.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
