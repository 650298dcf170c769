"""DuckDB SQL of the registered queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op1_exact_topk"] = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, e.vec_id AS vec_id,
         CAST(list_sum([q.c[i] * e.c[i] FOR i IN range(1, len(q.c) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""

ORACLE["op11_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
r AS (
  SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, l.pos, l.line, r.top IS NOT NULL AND l.doc_id < r.top AS gone FROM l LEFT JOIN r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

ORACLE["op12_collocations"] = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
g AS (
  SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i
  FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS a
  FROM g GROUP BY 1, 2, 3),
c AS (SELECT * FROM f WHERE k >= 2 AND a >= 100),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
part AS (
  SELECT lang, a, string_split(phrase, ' ') AS w, k FROM c WHERE k >= 3),
sub AS (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS longest
  FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i
        FROM part, (SELECT unnest(range(2, 5)) AS m) WHERE m < k) GROUP BY 1, 2, 3),
kept AS (
  SELECT c.* FROM c LEFT JOIN sub s ON s.lang = c.lang AND s.m = c.k AND s.phrase = c.phrase
  WHERE s.longest IS NULL OR 100 * s.longest < 100 * c.a),
cut AS (
  SELECT lang, phrase, a, j, array_to_string(list_slice(w, 1, j), ' ') AS head, array_to_string(list_slice(w, j + 1, k), ' ') AS tail
  FROM (SELECT lang, phrase, a, k, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM kept)),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, cut.j, x.a AS l, y.a AS r, n.n,
         CAST((CAST(1000 AS HUGEINT) * cut.a * n.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.head
  JOIN f y ON y.lang = cut.lang AND y.phrase = cut.tail JOIN n ON n.lang = cut.lang),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS b FROM scored) WHERE b = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
