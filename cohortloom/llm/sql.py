"""DuckDB SQL of the queries that SQL can express."""

ORACLE = {
    "op9_topk": """
WITH v AS (
  SELECT vec_id, len(embedding) AS n, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n = c.n AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
""",
    "op10_quality_rules": r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (SELECT doc_id, u.i, array_to_string(ws[u.i:u.i + 7], ' ') AS g FROM w, unnest(range(1, len(ws) - 6)) u(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
steps AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM rep),
covered AS (SELECT doc_id, sum(n) AS n FROM steps GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS bad
  FROM f GROUP BY source),
prior AS (SELECT avg(bad / n) AS mean, var_pop(bad / n) AS var FROM hosts),
strength AS (SELECT mean, CASE WHEN var > 0 THEN greatest(1.0, least(1e6, mean * (1 - mean) / var - 1)) ELSE 1e6 END AS k FROM prior),
verdict AS (SELECT source, (bad + mean * k) / (n + k) > 0.5 AS host_rejected FROM hosts, strength)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_rejected AS kept, host_rejected
FROM f JOIN verdict v ON f.source IS NOT DISTINCT FROM v.source
""",
    "op11_decontaminate": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[u.i:u.i + least(10, len(ws)) - 1], ' ') AS g
  FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) u(i) WHERE len(ws) > 0),
dw AS (
  SELECT rid, i, s.n, array_to_string(ws[u.i:u.i + s.n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM bw) s, unnest(range(1, len(ws) - s.n + 2)) u(i)),
hits AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT rid, count(DISTINCT i + k) AS n FROM hits, unnest(range(0, n)) v(k) GROUP BY rid),
found AS (
  SELECT rid, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(w.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(w.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words w ON d.rid = w.rid LEFT JOIN found f ON d.rid = f.rid
""",
    "op12_merkle": """
WITH RECURSIVE x AS (
  SELECT doc_id, lang, row_number() OVER () AS rid,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body,
    coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low,
    -- CRC-32 bit by bit: a byte, then seven zeros.
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))) AS crc
  FROM documents),
leaves AS (
  SELECT *, sha256(head || body) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256(head || low) END AS tampered FROM x),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
up AS (
  SELECT lang, 0 AS lvl, i, leaf AS h FROM o
  UNION ALL
  SELECT lang, lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS c FROM up) WHERE c > 1 GROUP BY lang, lvl, i // 8),
sub AS (
  SELECT lang, arg_max(h, lvl) AS h, max(lvl) AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM up GROUP BY lang),
above AS (
  SELECT 0 AS lvl, i, h FROM sub
  UNION ALL
  SELECT lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER () AS c FROM above) WHERE c > 1 GROUP BY lvl, i // 8),
top AS (SELECT arg_max(h, lvl) AS h, max(lvl) AS depth FROM above),
-- A document's node on every level, its language's levels first: (tree, group, level, place).
own AS (
  SELECT o.rid, 0 AS tree, sub.lang, v.k AS lvl, o.i // CAST(pow(8, v.k) AS BIGINT) AS i, v.k AS pos
  FROM o JOIN sub ON o.lang IS NOT DISTINCT FROM sub.lang, unnest(range(0, depth)) v(k)
  UNION ALL
  SELECT o.rid, 1, NULL, v.k, sub.i // CAST(pow(8, v.k) AS BIGINT), sub.depth + v.k
  FROM o JOIN sub ON o.lang IS NOT DISTINCT FROM sub.lang, top, unnest(range(0, top.depth)) v(k)),
nodes AS (SELECT 0 AS tree, lang, lvl, i, h FROM up UNION ALL SELECT 1, NULL, lvl, i, h FROM above),
steps AS (
  SELECT own.rid, own.pos, string_agg(h, '' ORDER BY n.i) FILTER (n.i < own.i) AS l, string_agg(h, '' ORDER BY n.i) FILTER (n.i > own.i) AS r
  FROM own JOIN nodes n ON own.tree = n.tree AND own.lang IS NOT DISTINCT FROM n.lang AND own.lvl = n.lvl AND own.i // 8 = n.i // 8
  GROUP BY own.rid, own.pos),
proofs AS (SELECT rid, string_agg(coalesce(l, '') || coalesce(r, ''), '' ORDER BY pos) AS p FROM steps GROUP BY rid),
fold AS (
  SELECT rid, CAST(0 AS BIGINT) AS pos, coalesce(tampered, leaf) AS h FROM o
  UNION ALL
  SELECT f.rid, f.pos + 1, sha256(coalesce(l, '') || f.h || coalesce(r, '')) FROM fold f JOIN steps s ON f.rid = s.rid AND f.pos = s.pos),
folded AS (SELECT rid, arg_max(h, pos) AS h FROM fold GROUP BY rid)
SELECT o.doc_id, o.leaf, sub.h AS subroot, top.h AS root, sha256(coalesce(p, '')) AS proof_sha256, folded.h AS folded_root, folded.h = top.h AS verified
FROM o JOIN sub ON o.lang IS NOT DISTINCT FROM sub.lang JOIN folded ON o.rid = folded.rid LEFT JOIN proofs ON o.rid = proofs.rid, top
""",
    "op13_filter_audit": r"""
WITH l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (
  SELECT part, good, toxic, [
      len(ws) < 200,
      100 * len(list_distinct(ws)) < 50 * len(ws),
      100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
      regexp_matches(t, '[#$%&*|]'),
      coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f
  FROM d),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS k),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT filter_order, s AS step, ks[s] AS k, ks[1:s - 1] AS before FROM orders, unnest(range(1, 6)) u(s)),
masks AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, f),
r AS (
  SELECT part, filter_order, step, k, f, n, good, toxic, f[k] AS fails, len(list_filter(before, lambda j: f[j])) > 0 AS gone FROM masks, steps),
t AS (
  SELECT part, filter_order, step, any_value(k) AS k,
    CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (gone AND fails), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (fails AND len(list_filter(f, lambda y: y)) = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS BIGINT) AS toxic_lost
  FROM r GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM t
""",
}
