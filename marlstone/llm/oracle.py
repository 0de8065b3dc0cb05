"""DuckDB SQL with the rows of those queries that SQL can express: plain definitions, without hashes, blocks or cells."""

from __future__ import annotations

from marlstone.llm import licenses

WORDS = r"[^\x20\x09-\x0D]+"

EMBEDDING = """WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), good AS MATERIALIZED (
  SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0
), links AS MATERIALIZED (
  SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.label = q.label AND len(p.x) = len(q.x) AND p.vec_id <> q.vec_id WHERE list_cosine_similarity(p.x, q.x) >= 0.93
), low(id, m) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT links.b, low.m FROM low JOIN links ON low.id = links.a WHERE low.m < links.b
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, r.m AS component_id, r.m = v.vec_id AS kept
FROM v JOIN (SELECT id, min(m) AS m FROM low GROUP BY id) r ON r.id = v.vec_id"""

SUBSTRING = rf"""WITH words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1
), gone AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later
), kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words) x ANTI JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM words d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

SUFFIX = """WITH bytes AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, i, h[2 * i - 1:2 * i + 98] AS s FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 48)) AS i FROM bytes WHERE len(h) >= 100)
), later AS (
  SELECT w.doc_id, w.i FROM windows w JOIN (SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)) f ON f.s = w.s WHERE w.doc_id > f.first
), gone AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM later
), spans AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE before IS NULL OR before < p - 1) AS runs FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY doc_id
), kept AS (
  SELECT x.doc_id, string_agg(x.b, '' ORDER BY x.p) AS h FROM (SELECT doc_id, p, h[2 * p - 1:2 * p] AS b FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 + 1)) AS p FROM bytes WHERE doc_id IN (SELECT doc_id FROM spans))) x ANTI JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(s.n, 0) AS n_removed, coalesce(s.runs, 0) AS n_spans, sha256(unhex(CASE WHEN s.n IS NULL THEN d.h ELSE coalesce(k.h, '') END)) AS kept_sha256
FROM bytes d LEFT JOIN spans s ON s.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id"""

MINHASH = rf"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) c
  JOIN sizes p ON p.doc_id = c.a JOIN sizes q ON q.doc_id = c.b WHERE 100 * c.n >= 85 * (p.n + q.n - c.n)
), low(id, m) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT links.b, low.m FROM low JOIN links ON low.id = links.a WHERE low.m < links.b
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.m AS component_id, r.m = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT id, min(m) AS m FROM low GROUP BY id) r ON r.id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scans": licenses.sql(),
        "op4_embedding_near_dedup": EMBEDDING,
        "op5_substring_dedup": SUBSTRING,
        "op6_suffix_dedup": SUFFIX,
        "op8_minhash_near_dedup": MINHASH,
    }
