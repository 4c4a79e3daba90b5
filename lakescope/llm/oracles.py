"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_WORDS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+')"

OP5 = """WITH
  held AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM held q JOIN held c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10"""

OP11 = f"""WITH
  docs AS (
    SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
  held AS (SELECT row, doc_id, w, len(w) AS n FROM docs WHERE len(w) > 0),
  totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM held),
  tf AS (SELECT row, doc_id, n, t, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(w) AS t FROM held) GROUP BY ALL),
  weights AS (
    SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), totals),
  items AS (
    SELECT item_id, t, count(*) AS k
    FROM (SELECT item_id, unnest({_TERMS}) AS t FROM (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id))
    GROUP BY ALL),
  scores AS (
    SELECT item_id, row, doc_id,
           CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length)))) AS BIGINT) AS score
    FROM items JOIN weights USING (t) JOIN tf USING (t), totals GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scores WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 10"""

OP12 = f"""WITH RECURSIVE
  split AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  sets AS (
    SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [list_aggregate(w, 'string_agg', ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM split),
  classes AS MATERIALIZED (
    SELECT min(doc_id) AS node, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets) WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY s),
  each AS MATERIALIZED (SELECT node, n, unnest(s) AS x FROM classes),
  links AS MATERIALIZED (
    SELECT a.node AS a, b.node AS b FROM each a JOIN each b ON a.x = b.x AND a.node < b.node AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90
    GROUP BY a.node, b.node, a.n, b.n HAVING count(*) * 100 >= (a.n + b.n - count(*)) * 90),
  pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, e.b FROM reach r JOIN pairs e ON e.a = r.b),
  least_of AS (SELECT a AS node, min(b) AS m FROM reach GROUP BY a)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles,
       CASE WHEN t.doc_id IS NULL THEN NULL WHEN len(t.s) = 0 THEN t.doc_id ELSE least(c.node, coalesce(l.m, c.node)) END AS component_id
FROM sets t LEFT JOIN classes c ON c.s = list_sort(t.s) LEFT JOIN least_of l ON l.node = c.node"""

ORACLE = {"op5_exact_top_k": OP5, "op11_ranked_search": OP11, "op12_ngram_join": OP12}
