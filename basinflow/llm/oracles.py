"""DuckDB SQL of the text queries that SQL can express on whole tables."""

from __future__ import annotations

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.x, d.x)::BIGINT AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > low THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > low THEN low END AS refers_to FROM f
"""

#: Words are runs without ASCII white space, A-Z in lower case.
_WORDS = r"""list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS shingle FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

URL_RULES = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
k AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(v, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT k.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS nth FROM k LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE nth = 1
"""

_ALNUM = r"""regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+')"""
_FIVE = "unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"

DECONTAMINATION = f"""
WITH d AS (SELECT DISTINCT doc_id, {_FIVE} AS shingle FROM (SELECT doc_id, {_ALNUM} AS w FROM documents)),
i AS MATERIALIZED (SELECT DISTINCT item_id, {_FIVE} AS shingle FROM (SELECT item_id, {_ALNUM} AS w FROM benchmark)),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
k AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (shingle) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared FROM k JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""

#: Windows of 50 bytes are 100 digits.
REPEATS = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM t WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s),
q AS (SELECT w.doc_id, p, lag(p) OVER (PARTITION BY w.doc_id ORDER BY p) AS before FROM w JOIN f USING (s) WHERE low < w.doc_id),
g AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM q),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, k),
e AS (SELECT doc_id, a, b FROM r UNION ALL SELECT doc_id, n, NULL FROM t),
c AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b NULLS LAST), 0) AS z FROM e),
k AS (SELECT doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a, b NULLS LAST) AS kept, coalesce(sum(b - a), 0) AS gone, count(b) AS spans FROM c JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, gone::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k JOIN t USING (doc_id)
"""
