"""SQL for DuckDB that gives whole-table results of the queries that SQL can express."""

from __future__ import annotations

#: Words of each text with their places from 1.
_WORDS = r"""words AS (SELECT doc_id, list_filter(regexp_split_to_array(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents)"""

OP1 = f"""WITH {_WORDS},
places AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35),
windows AS (SELECT p.doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM places p JOIN words USING (doc_id)),
twice AS (SELECT h FROM windows GROUP BY h HAVING COUNT(*) > 1),
starts AS (SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM twice)),
hit AS (SELECT DISTINCT doc_id, i + k AS j FROM starts, range(0, 35) r(k)),
gone AS (SELECT doc_id, list(j) AS js, COUNT(*) AS n FROM hit GROUP BY doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM words),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.j) AS t FROM each e ANTI JOIN hit h ON e.doc_id = h.doc_id AND e.j = h.j GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, COALESCE(n, 0) AS n_removed, sha256(COALESCE(t, '')) AS kept_sha256 FROM words w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP3 = """WITH hexed AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS x FROM documents),
sized AS (SELECT doc_id, x, CAST(length(x) / 2 AS BIGINT) AS n FROM hexed),
places AS (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM sized WHERE n >= 50),
windows AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 100)) AS h FROM places),
firsts AS (SELECT h, MIN(doc_id) AS d FROM windows GROUP BY h HAVING MIN(doc_id) <> MAX(doc_id)),
starts AS (SELECT w.doc_id, i FROM windows w JOIN firsts f ON w.h = f.h AND w.doc_id > f.d),
marked AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM starts),
grouped AS (SELECT doc_id, i, SUM(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
spans AS (SELECT doc_id, MIN(i) AS a, MAX(i) + 50 AS b FROM grouped GROUP BY doc_id, g),
before AS (SELECT doc_id, a, b, COALESCE(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans),
per AS (SELECT doc_id, CAST(SUM(b - a) AS BIGINT) AS removed, COUNT(*) AS n_spans, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head, MAX(b) AS last FROM before JOIN sized USING (doc_id) GROUP BY doc_id)
SELECT s.doc_id, n AS n_bytes, COALESCE(removed, 0) AS n_removed, COALESCE(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN per.doc_id IS NULL THEN x ELSE head || substr(x, 2 * last + 1) END)) AS kept_sha256 FROM sized s LEFT JOIN per USING (doc_id)"""

_ITEM = r"list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP7 = f"""WITH docs AS (SELECT doc_id, {_ITEM} AS w FROM documents), items AS (SELECT item_id, {_ITEM} AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, d.size, i, item_id FROM doc_windows d JOIN item_windows t ON d.size = t.size AND d.s = t.s),
hit AS (SELECT doc_id, COUNT(DISTINCT i + k) AS n_hit FROM found, range(0, 13) r(k) WHERE k < size GROUP BY doc_id),
named AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

OP11 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5"""

#: The smallest id of each text, masks of failures, histograms; then every order of the five filters, step by step.
OP13 = r"""WITH docs AS (SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS t, list_filter(regexp_split_to_array(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
firsts AS (SELECT t, MIN(doc_id) AS least FROM docs GROUP BY t),
marks AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM docs JOIN firsts USING (t)),
known AS (SELECT doc_id, MAX(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, MAX(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
hist AS (SELECT part, mask, COUNT(*) AS n, SUM(COALESCE(good, 0)) AS n_good, SUM(COALESCE(toxic, 0)) AS n_toxic FROM marks LEFT JOIN known USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT filter_order, step, bits[step] AS own, list_sum(bits[1:step]) - bits[step] AS earlier FROM orders, range(1, 6) r(step)),
rows_of AS (SELECT part, filter_order, step, own,
  SUM(CASE WHEN mask & CAST(own + earlier AS INTEGER) = 0 THEN n ELSE 0 END) AS kept, SUM(CASE WHEN mask & own > 0 AND mask & CAST(earlier AS INTEGER) = 0 THEN n ELSE 0 END) AS removed,
  SUM(CASE WHEN mask & own > 0 AND mask & CAST(earlier AS INTEGER) > 0 THEN n ELSE 0 END) AS redundant, SUM(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  SUM(CASE WHEN mask & own > 0 AND mask & CAST(earlier AS INTEGER) = 0 THEN n_good ELSE 0 END) AS good_lost, SUM(CASE WHEN mask & own > 0 AND mask & CAST(earlier AS INTEGER) = 0 THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM hist, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(SUM(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM rows_of"""

ORACLE_SQL = {"op1_substring_dedup": OP1, "op3_suffix_dedup": OP3, "op7_decontamination": OP7, "op11_exact_topk": OP11, "op13_filter_audit": OP13}
