"""SQL twins (DuckDB) of the derived tables, as common table expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.text import CONNECTION_STOP, QUERY_STOP, TOPIC_STOP
from claimloom.sources.derive import CLAIM_TYPES

_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
NORM_WORDS = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
TOKENS = f"list_distinct(list_filter(string_split({NORM_WORDS}, ' '), lambda t: length(t) > 2 AND NOT list_contains({_LIST(CONNECTION_STOP)}, t)))"
TOPICS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9_-]{{4,}}'), lambda t: NOT list_contains(" + _LIST(TOPIC_STOP) + ", t))"
QUERY_TOKENS = f"list_distinct(list_filter(regexp_split_to_array(lower({{0}}), '[^a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({_LIST(QUERY_STOP)}, t)))"
JACCARD = (
    "(CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / "
    "(len({0}) + len({1}) - len(list_intersect({0}, {1}))) END)"
)


def whole_seconds(ts: str) -> Column:
    """A timestamp in whole seconds as ``epoch(ts)::BIGINT`` has it: the nearest, halves to the even one."""
    return F.rint(F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).cast("long")


SOURCES = rf"""sources AS (
  SELECT doc_id, 'srcv_' || doc_id AS source_version_id,
         {TRIM.format(r"regexp_replace(text, '\r\n?', chr(10), 'g')")} AS content
  FROM documents WHERE text IS NOT NULL
)"""

SPANS = SOURCES + rf""", lines AS (
  SELECT doc_id, content, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS line
  FROM sources
), placed AS (
  SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base
  FROM lines
), spans AS (
  SELECT doc_id, 'srcv_' || doc_id AS source_version_id, line,
         base + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS start_char,
         base + length(raw) - length(regexp_replace(raw, '^\s+', '')) + length({TRIM.format('raw')}) AS end_char,
         {TRIM.format('raw')} AS text, 'ev_' || doc_id || '_' || line AS span_id,
         row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS span_no
  FROM placed WHERE length({TRIM.format('raw')}) > 0
)"""

CLAIMS = SPANS + f""", claims AS (
  SELECT 'mem_' || s.doc_id || '_' || s.part AS claim_id, s.doc_id, s.part, s.statement, s.evidence,
         {_LIST(CLAIM_TYPES)}[(s.doc_id % 10 + 1)::BIGINT] AS claim_type, 'reported' AS epistemic, d.source, d.lang
  FROM (
    SELECT doc_id, span_no // 12 AS part, substr(string_agg(text, chr(10) || chr(10) ORDER BY span_no), 1, 2000) AS statement,
           list(span_id ORDER BY span_no) AS evidence
    FROM spans WHERE span_no // 12 < 30 GROUP BY doc_id, span_no // 12
  ) s JOIN documents d ON d.doc_id = s.doc_id
)"""

#: The same without limits: all claims of a document, with all their text.
WHOLE_CLAIMS = CLAIMS.replace("substr(string_agg(text, chr(10) || chr(10) ORDER BY span_no), 1, 2000)", "string_agg(text, chr(10) || chr(10) ORDER BY span_no)").replace(
    "FROM spans WHERE span_no // 12 < 30 GROUP BY", "FROM spans GROUP BY"
)

LEDGER = """ledger AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         concat_ws('|', user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT)) AS idempotency_key
  FROM events
)"""

REVIEWS = LEDGER + """, n_docs AS (SELECT count(*) AS n FROM documents), reviews AS (
  SELECT event_id, ts, 'mem_' || (user_id % n) || '_0' AS claim_id,
         CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'click' THEN 'edit' WHEN 'error' THEN 'remove' END AS review
  FROM ledger, n_docs WHERE event_type IN ('purchase', 'click', 'error')
)"""
