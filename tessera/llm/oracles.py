"""SQL for DuckDB of the operators that SQL can express."""

#: op12: windows as joined words; a document's word sequences of the same lengths are looked up among them.
DECONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT DISTINCT item_id, w FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark)
  WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS words
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i)),
sizes AS (SELECT DISTINCT size FROM win),
seq AS (
  SELECT rid, i, size, array_to_string(w[i : i + size - 1], ' ') AS words
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
met AS (SELECT DISTINCT rid, i, seq.size, item_id FROM seq JOIN win ON seq.words = win.words AND seq.size = win.size),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM met) GROUP BY rid),
named AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM met WHERE item_id IS NOT NULL GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""

#: op13: the checksum bit by bit over the bytes of UTF-8; near words share a pattern with one letter left out or masked.
SPELLING = r"""
WITH RECURSIVE run AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents)
  WHERE length(r) >= 7 GROUP BY ALL),
bits AS (
  SELECT *, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS u FROM run),
sums AS (
  SELECT r, times, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(u, lambda c:
           CASE WHEN c < 128 THEN [c, -1, -1, -1, -1, -1, -1, -1, -1]
                ELSE [192 + (c >> 6), -1, -1, -1, -1, -1, -1, -1, -1, 128 + (c & 63), -1, -1, -1, -1, -1, -1, -1, -1] END))),
           lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS h
  FROM bits),
w AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n
  FROM (SELECT times, CASE WHEN h % 31 = 0 THEN left(r, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word FROM sums)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
pat AS (
  SELECT word, n, 'whole' AS kind, word AS p FROM w
  UNION ALL SELECT word, n, 'less', left(word, i) || substr(word, i + 2) FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)
  UNION ALL SELECT word, n, 'mask', left(word, i) || '_' || substr(word, i + 2) FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n
  FROM pat a JOIN pat b ON a.p = b.p AND a.word <> b.word AND (a.kind, b.kind) IN (('whole', 'less'), ('less', 'whole'), ('mask', 'mask'))),
best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS near_n FROM near GROUP BY word),
first AS (SELECT near.word, min(near.near) AS near FROM near JOIN best ON near.word = best.word AND near.near_n = best.near_n GROUP BY near.word),
formed AS (
  SELECT w.word, w.n, CASE WHEN best.near_n >= 10 * w.n THEN first.near END AS form, CASE WHEN best.near_n >= 10 * w.n THEN best.near_n END AS form_n,
         coalesce(best.n_near, 0) AS n_near
  FROM w LEFT JOIN best USING (word) LEFT JOIN first USING (word)),
walk AS (
  SELECT word, form AS root FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON walk.root = formed.word WHERE formed.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN formed ON walk.root = formed.word WHERE formed.form IS NULL)
SELECT formed.word, n, form, coalesce(ends.root, formed.word) AS root, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed LEFT JOIN ends USING (word)
"""
