"""SQL forms of registered queries, for DuckDB over the same tables."""

from __future__ import annotations

#: Links to components, by reachability.
_REACH = """sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(v, r) AS (SELECT DISTINCT a, a FROM sym UNION SELECT sym.b, reach.r FROM reach JOIN sym ON sym.a = reach.v),
parts AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)"""
OP1_NEAR = f"""
WITH RECURSIVE fine AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), {_REACH},
degrees AS (SELECT a AS v, count(*) AS n FROM sym GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN degrees ON degrees.v = vec_id LEFT JOIN parts ON parts.v = vec_id
"""
OP8_NEAR = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\x0C\\r]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM texts WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), {_REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN parts ON parts.v = doc_id
"""
OP2_REPEATS = """
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM texts)
), firsts AS (
  SELECT s, min(doc_id) AS first FROM windows GROUP BY s
), hits AS (
  SELECT doc_id, p FROM windows JOIN firsts USING (s) WHERE first < doc_id
), marked AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS begins FROM hits
), runs AS (
  SELECT doc_id, min(p) AS b, max(p) + 50 AS e FROM (SELECT doc_id, p, sum(begins) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked) GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, b, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS since FROM runs
), cut AS (
  SELECT g.doc_id, sum(e - b) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * since + 1, 2 * (b - since)), '' ORDER BY b) AS head FROM gaps g JOIN texts USING (doc_id) GROUP BY g.doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""

#: crc32 of the id as text, bit by bit: there is no such function.
OP11_MERKLE = """
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS counted,
    coalesce(strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1), '-') AS recounted,
    coalesce(strlen(text) || ':' || text, '-') AS body
  FROM documents
), hashed AS (
  SELECT doc_id, g, sha256(head || counted || body) AS leaf, sha256(head || recounted || body) AS other FROM rows
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM hashed
), tree AS (
  SELECT g, 0 AS lev, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT g, lev + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY g, lev, i // 2, n
), groups AS (
  SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS lev, i, n, h FROM groups
  UNION ALL
  SELECT lev + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lev, i // 2, n
), steps AS (
  SELECT l.g, l.i, v.lev, CASE WHEN s.h IS NULL THEN '' WHEN s.i % 2 = 0 THEN 'l' || s.h ELSE 'r' || s.h END AS beside
  FROM leaves l JOIN (SELECT DISTINCT g, lev FROM tree WHERE n > 1) v ON v.g = l.g
  LEFT JOIN tree s ON s.g = l.g AND s.lev = v.lev AND s.i = xor(l.i >> v.lev, 1)
), group_steps AS (
  SELECT q.g, v.lev, CASE WHEN s.h IS NULL THEN '' WHEN s.i % 2 = 0 THEN 'l' || s.h ELSE 'r' || s.h END AS beside
  FROM groups q JOIN (SELECT DISTINCT lev FROM top WHERE n > 1) v ON true
  LEFT JOIN top s ON s.lev = v.lev AND s.i = xor(q.i >> v.lev, 1)
), lower AS (
  SELECT g, i, list(beside ORDER BY lev) AS p FROM steps GROUP BY g, i
), upper AS (
  SELECT g, list(beside ORDER BY lev) AS p FROM group_steps GROUP BY g
), paths AS (
  SELECT l.doc_id, l.leaf, q.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, list_concat(coalesce(w.p, []), coalesce(u.p, [])) AS p,
    CASE WHEN xor(list_reduce(flatten(list_transform(range(1, strlen(l.doc_id::VARCHAR) + 1), lambda k: [ascii(substr(l.doc_id::VARCHAR, k, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT) % 7 = 0 THEN l.other ELSE l.leaf END AS held
  FROM leaves l JOIN groups q USING (g) LEFT JOIN lower w ON w.g = l.g AND w.i = l.i LEFT JOIN upper u ON u.g = l.g
), folded AS (
  SELECT *, list_reduce(p, lambda node, s: sha256(CASE s[1] WHEN 'l' THEN s[2:] || node WHEN 'r' THEN node || s[2:] ELSE node END), held) AS folded_root FROM paths
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

OP12_TOPK = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0
), placed AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 10
"""
OP13_PHRASES = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces
), sizes AS (
  SELECT lang, sum(len(w)) AS n FROM split GROUP BY lang
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w) GROUP BY lang, k, phrase HAVING count(*) >= 100
), cuts AS (
  SELECT g.lang, g.k, g.phrase, g.f AS a, j, array_to_string(string_split(g.phrase, ' ')[: j], ' ') AS head, array_to_string(string_split(g.phrase, ' ')[j + 1 :], ' ') AS tail
  FROM grams g, (SELECT unnest([1, 2, 3, 4]) AS j) WHERE j < g.k
), scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.j, x.f AS l, y.f AS r, s.n, ((1000::HUGEINT * c.a * s.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.head AND x.k = c.j JOIN grams y ON y.lang = c.lang AND y.phrase = c.tail AND y.k = c.k - c.j JOIN sizes s ON s.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), kept AS (
  SELECT * FROM lowest x WHERE NOT EXISTS (SELECT 1 FROM grams y WHERE y.lang = x.lang AND y.k > x.k AND 100 * y.f >= 100 * x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score
FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
