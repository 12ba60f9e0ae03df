"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

from claimloom.llm.sharding import HASH_BITS, LIMIT

SHARDING = f"""
WITH hashed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h,
         coalesce(strlen(text), 0)::BIGINT AS row_bytes
  FROM documents
), sizes AS (
  SELECT d AS depth, h >> ({HASH_BITS} - d) AS bucket,
         sum(row_bytes) <= {LIMIT} OR min(h) = max(h) AS final
  FROM hashed, range(0, {HASH_BITS + 1}) r(d) GROUP BY ALL
), placed AS (
  SELECT doc_id, row_bytes, h, min(depth)::INT AS shard_depth
  FROM hashed JOIN sizes ON sizes.final AND bucket = h >> ({HASH_BITS} - depth) GROUP BY ALL
)
SELECT doc_id,
       CASE WHEN shard_depth = 0 THEN '' ELSE lpad(bin(h >> ({HASH_BITS} - shard_depth)), shard_depth, '0') END AS shard,
       shard_depth, row_bytes
FROM placed
"""

LINES = r"""
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), windows AS (
  SELECT doc_id, unnest(range(len(l) - 2)) AS pos, l FROM split WHERE len(l) >= 3
), keyed AS (
  SELECT doc_id, pos, l[pos + 1 : pos + 3] AS w FROM windows
  WHERE regexp_matches(array_to_string(l[pos + 1 : pos + 3], chr(10)), '[^\x20\x09-\x0D]')
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS nth FROM keyed
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, range(3) r(k) WHERE nth > 1
), numbered AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM split
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS body, count(*) AS n
  FROM numbered ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, (coalesce(len(l), 0) - coalesce(n, 0))::BIGINT AS n_removed,
       CASE WHEN text IS NOT NULL THEN sha256(coalesce(body, '')) END AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

SUBSTRINGS = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + 20], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS pos FROM split WHERE len(w) >= 20)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM windows
), gone AS (
  SELECT DISTINCT doc_id, pos + j AS pos FROM ranked, range(20) r(j) WHERE nth > 1
), numbered AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM split
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS body, count(*) AS n
  FROM numbered ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

SUFFIXES = """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents
), windows AS (
  SELECT doc_id, pos, md5_number(substr(x, (2 * pos + 1)::BIGINT, 100)) AS k
  FROM (SELECT doc_id, x, unnest(range(n - 49)) AS pos FROM bytes WHERE n >= 50)
), later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY k) AS first FROM windows)
  WHERE doc_id > first
), edges AS (
  SELECT doc_id, pos, lag(pos) OVER o AS before, lead(pos) OVER o AS after FROM later
  WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), starts AS (
  SELECT doc_id, pos AS a, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM edges
  WHERE before IS NULL OR pos > before + 50
), ends AS (
  SELECT doc_id, pos + 50 AS b, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM edges
  WHERE after IS NULL OR after > pos + 50
), spans AS (
  SELECT doc_id, a, b, i, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY i), 0) AS since
  FROM starts JOIN ends USING (doc_id, i)
), kept AS (
  SELECT s.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
         string_agg(substr(x, (2 * since + 1)::BIGINT, (2 * (a - since))::BIGINT), '' ORDER BY i)
           || substr(any_value(x), (2 * max(b) + 1)::BIGINT) AS rest
  FROM spans s JOIN bytes USING (doc_id) GROUP BY s.doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, x))) AS kept_sha256
FROM bytes LEFT JOIN kept USING (doc_id)
"""

NEGATIVES = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 3
"""
