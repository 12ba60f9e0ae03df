"""Text functions as columns: normalizers, tokenizers and small classifiers.

The three normalizers and four tokenizers differ on purpose and are not interchangeable.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and tables of the source system.
TOPIC_STOP = ["about", "after", "again", "could", "from", "have", "into", "more", "should", "their", "there", "these",
              "those", "through", "using", "with", "would", "needs"]
CONNECTION_STOP = ["the", "a", "an", "and", "or", "to", "of", "for", "on", "in", "is", "are", "be", "we", "this", "that"]
QUERY_STOP = ["what", "when", "where", "which", "who", "why", "how", "the", "and", "for", "with", "from", "about", "know",
              "does", "did", "has", "have", "had", "are", "was", "were", "this", "that", "these", "those", "into", "onto"]
GENERIC_ENTITIES = ["a", "an", "and", "any", "are", "be", "but", "four", "here", "in", "it", "many", "no", "of", "one",
                    "or", "some", "that", "the", "there", "this", "three", "to", "two", "yes"]
SHORT_ENTITIES = ["api", "rpc", "sdk", "ux", "ui", "usdc", "usdt", "defi"]
POSITIVE = ["approved", "clear", "ready", "unblocked", "owned", "included", "enabled", "launched"]
NEGATIVE = ["not", "no", "blocked", "unresolved", "unclear", "rejected", "excluded", "disabled", "delayed"]
SYSTEM_SUBTYPES = ["channel_archive", "channel_join", "channel_leave", "channel_name", "channel_purpose", "channel_topic",
                   "group_archive", "group_join", "group_leave", "message_deleted", "tombstone"]
# Patterns of secrets (A19), of headings and of what titles lose (C4, C5), of blocks of a page (A5).
SECRET_BEARER = "(?i)(bearer\\s+)[^\\s\"']+"
SECRET_PARAMETER = "(?i)([?&](?:key|token|secret|password)=)[^&\\s]+"
SECRET_KEY = "\\b(?:sk|pk|eyJ)[A-Za-z0-9._-]{16,}\\b"
HEADING_MARK, HEADING_LINE, TITLE_MARK = "^#{1,6}\\s", "^[A-Z][^.!?]{0,100}:?$", "^#{1,6}\\s*"
PAGE_BLOCK = "(?is)<(?:p|h[1-6]|li|blockquote|td|th)(?:\\s[^>]*)?>(.*?)</(?:p|h[1-6]|li|blockquote|td|th)>"


def words_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def sums_before(values: Column, block: int = 256) -> Column:
    """For each of an array's numbers the sum of those before it: by blocks, so that long arrays aren't copied once for each entry."""
    total = lambda own: F.aggregate(own, F.lit(0).cast("long"), lambda s, v: s + v)
    running = lambda own, start: F.aggregate(own, F.array(start.cast("long")), lambda out, v: F.array_append(out, F.element_at(out, -1) + v))
    parts = lambda own: F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / block).cast("int")), lambda b: F.slice(own, b * block + 1, block))
    within = lambda found: F.zip_with(found, running(F.transform(found, total), F.lit(0)), lambda own, start: running(F.slice(own, 1, F.size(own) - 1), start))
    every = lambda v: let(parts(v), lambda found: F.flatten(F.slice(within(found), 1, F.size(found))))
    return let(values, lambda v: F.when(F.size(v) > 0, every(v)).otherwise(F.array().cast("array<bigint>")))


def trim_space(text: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def normalize_text(text: Column) -> Column:
    """CRLF and CR as LF; no white space at the ends."""
    return trim_space(F.regexp_replace(text, "\r\n?", "\n"))


def content_hash(text: Column) -> Column:
    return F.sha2(normalize_text(text), 256)


def normalize_key(text: Column) -> Column:
    """Lower case, white space collapsed; punctuation stays."""
    return trim_space(F.regexp_replace(F.lower(text), "(?U)\\s+", " "))


def normalize_words(text: Column) -> Column:
    """Lower case, every run of other than a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def normalize_statement(text: Column) -> Column:
    """Lower case, NFKC, runs of other than letters and digits as one space."""

    @F.pandas_udf("string")
    def compose(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None else unicodedata.normalize("NFKC", v))

    return F.trim(F.regexp_replace(compose(F.lower(text)), "[^\\p{L}\\p{N}]+", " "))


def connection_tokens(text: Column) -> Column:
    found = F.filter(F.split(normalize_words(text), " "), lambda t: F.length(t) > 2)
    return F.array_distinct(F.array_except(found, words_array(CONNECTION_STOP)))


def topic_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9_-]{4,}"), F.lit(0))
    return F.array_except(found, words_array(TOPIC_STOP))


def query_tokens(text: Column) -> Column:
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) >= 3)
    return F.array_except(found, words_array(QUERY_STOP))


def recall_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "\\s+"), lambda t: F.length(t) > 2))


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays' distinct values; zero if either is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        both / F.size(F.array_union(left, right))
    )


def distinct_jaccard(left: Column, right: Column) -> Column:
    """``jaccard`` of arrays without repeated values, by their sizes and what they share."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(both / (F.size(left) + F.size(right) - both))


def issue_tickets(text: Column) -> Column:
    """Ticket ids such as ABC-12 in upper case, distinct and sorted."""
    found = F.regexp_extract_all(F.upper(text), F.lit("\\b[A-Z][A-Z0-9]{1,15}-[0-9]{1,10}\\b"), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def merged_identities(found: Column, known: Column) -> Column:
    """Ticket ids of a text and those already known, each once, sorted."""
    return F.array_sort(F.array_union(found, known))


def redact_secrets(text: Column) -> Column:
    """Bearer tokens, secret query parameters and keys replaced; at most 1000 characters."""
    out = F.regexp_replace(F.regexp_replace(text, SECRET_BEARER, "$1[redacted]"), SECRET_PARAMETER, "$1[redacted]")
    return F.substring(F.regexp_replace(out, SECRET_KEY, "[redacted]"), 1, 1000)


def is_likely_heading(text: Column) -> Column:
    plain = trim_space(text)
    return (F.length(plain) <= 120) & (
        plain.rlike(HEADING_MARK) | plain.rlike(HEADING_LINE)
    )


def section_title(text: Column, ordinal: Column) -> Column:
    compact = trim_space(F.regexp_replace(F.regexp_replace(text, TITLE_MARK, ""), "(?U)\\s+", " "))
    return F.when(
        (F.length(compact) > 0) & (F.length(compact) <= 100), F.regexp_replace(compact, ":$", "")
    ).otherwise(F.concat(F.lit("Section "), ordinal.cast("string")))


def attachment_kind(name: Column, mime: Column, filetype: Column, mode: Column, external: Column) -> Column:
    """pdf, docx or null for a file's name and type; files kept elsewhere have none."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    kind = F.lit(None).cast("string")
    for ending, media in (
        ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), ("pdf", "application/pdf"),
    ):
        fits = (low(mime) == media) | (low(filetype) == ending) | low(name).endswith(f".{ending}")
        kind = F.when(fits, F.lit(ending)).otherwise(kind)
    return F.when(~(F.coalesce(external, F.lit(False)) | (low(mode) == "external")), kind)


def is_generic_entity(label: Column) -> Column:
    """True for labels (in normalize_words form) that name nothing in particular."""
    tokens = F.split(label, " ")
    short = (F.size(tokens) == 1) & (
        (F.length(label) <= 1) | ((F.length(label) <= 3) & ~label.isin(*SHORT_ENTITIES))
    )
    return (label == "") | (F.size(F.array_except(tokens, words_array(GENERIC_ENTITIES))) == 0) | short


def is_system_message(subtype: Column) -> Column:
    return F.coalesce(subtype.isin(*SYSTEM_SUBTYPES), F.lit(False))


def canonical_json(value: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))
