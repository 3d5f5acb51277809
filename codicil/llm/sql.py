"""DuckDB statements giving the rows of the queries that SQL can express."""

_COMPONENTS = """
reach AS (
  SELECT id AS a, id AS b FROM nodes
  UNION
  SELECT reach.a, edges.y FROM reach JOIN edges ON reach.b = edges.x
),
classes AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
"""

NEAR_TEXT = f"""
WITH RECURSIVE split AS (
  SELECT doc_id AS id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
grams AS (
  SELECT DISTINCT id, unnest(CASE
    WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM split
),
nodes AS (SELECT doc_id AS id FROM documents),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
shared AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
edges AS (
  SELECT x, y FROM shared JOIN sizes a ON a.id = x JOIN sizes b ON b.id = y WHERE 100 * k >= 85 * (a.n + b.n - k)
),
{_COMPONENTS}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept
FROM classes LEFT JOIN sizes USING (id)
"""

NEAR_VECTORS = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
vectors AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
edges AS (SELECT a.id AS x, b.id AS y FROM vectors a JOIN vectors b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.95),
degrees AS (SELECT x AS id, count(*) AS n FROM edges GROUP BY x),
{_COMPONENTS}
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept
FROM classes LEFT JOIN degrees USING (id)
"""

# The least depth at which a document's bucket fits; {{limit}} stands for the byte limit.
SHARDS = """
WITH bits AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
    right(repeat('0', 48) || bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT)), 48) AS b
  FROM documents
),
deep AS (SELECT doc_id, d, substr(b, 1, d) AS p, sum(n_bytes) OVER (PARTITION BY d, substr(b, 1, d)) AS total
  FROM bits, (SELECT unnest(range(0, 49)) AS d)),
least AS (SELECT doc_id, min(d) AS d FROM deep WHERE total <= {limit} GROUP BY doc_id)
SELECT doc_id, n_bytes, substr(b, 1, d) AS shard_id, CAST(d AS INTEGER) AS depth FROM bits JOIN least USING (doc_id)
"""

TOP_K = """
WITH w AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM w q JOIN w c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

COLLOCATIONS = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p
  FROM documents
),
lists AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
grams AS (
  SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda k:
    list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS phrase
  FROM lists
),
f AS (SELECT lang, phrase, count(*) AS n, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, phrase HAVING count(*) >= 30),
cuts AS (
  SELECT lang, phrase, n AS a, w, unnest(range(1, len(w))) AS k FROM f WHERE len(w) > 1
),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.n AS l, y.n AS r, k, CAST(2000000 * CAST(c.a AS HUGEINT) // (CAST(x.n AS HUGEINT) + y.n) AS BIGINT) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
  SELECT lang, phrase, max(n) AS longer FROM (
    SELECT lang, n, unnest(flatten(list_transform(range(2, len(w)), lambda k:
      list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS phrase
    FROM f WHERE len(w) > 2)
  GROUP BY lang, phrase
),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM lowest s LEFT JOIN held h ON h.lang = s.lang AND h.phrase = s.phrase
  WHERE h.longer IS NULL OR 100 * CAST(h.longer AS HUGEINT) < 80 * CAST(s.a AS HUGEINT)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

_CRC_STEPS = "flatten(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: [CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
_CRC32 = f"xor(list_reduce(list_prepend(4294967295, {_CRC_STEPS}), lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295)"

TURN_TRIE = f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
),
placed AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS place
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT c, c - c % 5 AS lender, {_CRC32} % 9 AS h FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT v.c, 0 AS part, p.place, p.role, p.text FROM convs v JOIN placed p ON p.c = v.lender AND p.place <= v.h
  UNION ALL
  SELECT v.c, 1, p.place, p.role, p.text FROM convs v JOIN placed p ON p.c = v.c AND p.place > v.h
),
lists AS (SELECT c, list(sha256(length(role) || ':' || role || text) ORDER BY part, place) AS keys, list(strlen(text) ORDER BY part, place) AS sizes FROM rebuilt GROUP BY c),
sequences AS (SELECT c, coalesce(keys, []) AS keys, sizes, len(coalesce(keys, [])) AS n FROM convs LEFT JOIN lists USING (c)),
prefixes AS (SELECT c, n, d, array_to_string(keys[1:d], ',') AS p, array_to_string(keys[1:d - 1], ',') AS above, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
  FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM sequences)),
nodes AS (
  SELECT p, d, any_value(above) AS above, any_value(size) AS size, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d
),
children AS (SELECT above AS p, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
whole AS (SELECT *, coalesce(n_children, 0) AS kids FROM nodes LEFT JOIN children USING (p, d)),
paths AS (SELECT p, d, string_split(p, ',') AS w, kids, n_convs, size FROM whole),
upward AS (SELECT unnest(list_transform(range(0, d + 1), lambda k: {{'p': array_to_string(w[1:k], ','), 'd': k}})) AS top, kids, n_convs, size FROM paths),
sums AS (
  SELECT top.p AS p, top.d AS d, CAST(sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens
  FROM upward GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.kids AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM whole n JOIN sums s ON s.p = n.p AND s.d = n.d LEFT JOIN nodes u ON n.d > 0 AND u.p = n.above AND u.d = n.d - 1
"""

# Base32 of a SHA-1: its 160 bits in groups of five.
_BITS = "array_to_string(list_transform(range(1, 41), lambda i: right('000' || bin(CAST('0x' || substr(sha1(h), i, 1) AS INTEGER)), 4)), '')"
WARC = f"""
WITH bodies AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
bits AS (SELECT page_id, h, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_BITS} AS b, max(page_id) OVER (PARTITION BY h) AS first FROM bodies)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(b, 5 * g + j + 1, 1) AS INTEGER) << (4 - j))) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""
