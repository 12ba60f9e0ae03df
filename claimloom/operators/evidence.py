"""Evidence spans from texts, structured documents and web pages; source versions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from claimloom.functions.text import PAGE_BLOCK, attachment_kind, content_hash, let, normalize_text, sums_before, trim_space

MAX_SPAN_CHARS, MIN_SPAN_CHARS = 2000, 200
MAX_DOCUMENT_CHARS = 200_000
MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES = 5, 10 << 20, 25 << 20
_SENTENCE = re.compile("[.!?][\\]\"')”’]*\\s+")


def sources(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """source_version_id, content (normalized) and content_hash of each text."""
    return docs.where(F.col(text).isNotNull()).select(
        F.concat(F.lit("srcv_"), F.col(key).cast("string")).alias("source_version_id"),
        normalize_text(F.col(text)).alias("content"),
        content_hash(F.col(text)).alias("content_hash"),
    )


def _with_texts(lines: Column) -> Column:
    """Of a version's lines those with text, trimmed: line (from 1), raw, text."""
    placed = F.transform(lines, lambda raw, at: F.struct((at + 1).alias("line"), raw.alias("raw"), trim_space(raw).alias("text")))
    return F.filter(placed, lambda s: F.length(s["text"]) > 0)


def line_texts(content: Column) -> Column:
    """``line_spans`` of a content as an array of line and text, without offsets."""
    return F.transform(_with_texts(F.split(content, "\n", -1)), lambda s: F.struct(s["line"].alias("line"), s["text"].alias("text")))


def numbered_spans(versions: DataFrame) -> DataFrame:
    """``line_spans`` with their number (span_no, from 0) in their version, in place: no row leaves its task."""

    def placed(lines: Column) -> Column:
        bases = sums_before(F.transform(lines, lambda raw: F.length(raw) + 1))
        return let(bases, lambda base: F.transform(_with_texts(lines), lambda s: F.struct(s["line"], s["raw"], s["text"], F.get(base, s["line"] - 1).alias("base"))))

    # An outer explode: of a plain one Spark would build the array twice, to filter by its size first.
    rows = versions.select("source_version_id", F.posexplode_outer(let(F.split("content", "\n", -1), placed)).alias("span_no", "s")).where("s is not null")
    lead = F.col("s.base") + F.length("s.raw") - F.length(F.regexp_replace("s.raw", "(?U)^\\s+", ""))
    return rows.select(
        "source_version_id", "span_no", "s.line", lead.alias("start_char"), (lead + F.length("s.text")).alias("end_char"), "s.text",
    )


def line_spans(versions: DataFrame) -> DataFrame:
    """One span per line with text: line (from 1), start_char, end_char (from 0), text.

    Offsets are a running sum of line lengths per version.
    """
    return numbered_spans(versions).drop("span_no")


def split_ranges(text: str, limit: int) -> list[tuple[int, int]]:
    """Where a long line is cut: after a sentence, else at a space, in the half before the limit; else there."""
    out, at = [], 0
    while at < len(text):
        stop = cut = min(len(text), at + limit)
        if stop < len(text):
            window = text[at:stop]
            ends = [m.end() for m in _SENTENCE.finditer(window)]
            place = at + (ends[-1] if ends else window.rfind(" "))
            if place >= at + limit // 2:
                cut = place
        end = at + len(text[at:cut].rstrip()) or cut
        end = end if end > at else stop
        out.append((at, end))
        at = end + len(text[end:]) - len(text[end:].lstrip())
    return out


def evidence_spans(versions: DataFrame, max_span_chars: int = MAX_SPAN_CHARS) -> DataFrame:
    """``line_spans`` with lines above the limit split; only those go through Python."""
    limit = max(MIN_SPAN_CHARS, max_span_chars)

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def ranges(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in split_ranges(t, limit)])

    spans = line_spans(versions)
    whole = spans.where(F.length("text") <= limit).withColumn("part", F.lit(1))
    long = spans.where(F.length("text") > limit).select("*", F.posexplode(ranges("text")).alias("p", "r"))
    parts = long.select(
        "source_version_id",
        "line",
        (F.col("start_char") + F.col("r.start")).alias("start_char"),
        (F.col("start_char") + F.col("r.end")).alias("end_char"),
        F.expr("substring(text, r.start + 1, r.end - r.start)").alias("text"),
        (F.col("p") + 1).alias("part"),
    )
    named = whole.unionByName(parts)
    return named.select(F.concat_ws("_", F.lit("ev"), F.expr("substring(source_version_id, 6)"), "line", "part").alias("span_id"), "*")


def span_violations(spans: DataFrame, versions: DataFrame) -> DataFrame:
    """Spans whose offsets are invalid or do not give their text."""
    joined = spans.join(versions.select("source_version_id", "content"), "source_version_id")
    piece = F.expr("substring(content, cast(start_char + 1 as int), cast(end_char - start_char as int))")
    bad = (F.col("start_char") < 0) | (F.col("end_char") <= F.col("start_char")) | (piece != F.col("text"))
    return joined.where(bad).drop("content")


def structured_document(blocks: DataFrame) -> DataFrame:
    """Offsets of blocks (document_id, block, text) joined by a blank line.

    ``rejected`` marks documents above the character limit.
    """
    order = Window.partitionBy("document_id").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("document_id")
    text = normalize_text(F.col("text"))
    n_lines = F.size(F.split("body", "\n", -1))
    kept = blocks.select("document_id", "block", text.alias("body")).where(F.length("body") > 0)
    return kept.select(
        "document_id",
        "block",
        F.coalesce(F.sum(F.length("body") + 2).over(before), F.lit(0)).cast("long").alias("start_char"),
        F.coalesce(F.sum(n_lines + 1).over(before), F.lit(0)).cast("long").alias("lines_before"),
        "body",
        (F.sum(F.length("body") + 2).over(whole) - 2 > MAX_DOCUMENT_CHARS).alias("rejected"),
    )


def html_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """Text of p, h1-h6, li, blockquote, td and th elements, tags stripped, entities decoded.

    A block ends at the next end tag of any of these, so of nested ones the inner end counts.
    """
    found = F.regexp_extract_all(F.col(html), F.lit(PAGE_BLOCK), F.lit(1))
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(found).alias("block", "raw"))
    text = F.regexp_replace(F.regexp_replace("raw", "(?i)<br\\s*/?>", "\n"), "<[^>]+>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return rows.select(*[c for c in rows.columns if c != "raw"], trim_space(text).alias("text")).where(F.length("text") > 0)


def meaningful(pages: DataFrame, text: str = "text", least: int = 20) -> DataFrame:
    """Texts with enough letters and digits."""
    return pages.where(F.length(F.regexp_replace(F.col(text), "[^\\p{L}\\p{N}]", "")) >= least)


def message_content(text: Column, parts: Column) -> Column:
    """A message's text and nested strings, each once, joined by a blank line."""
    trimmed = F.transform(F.concat(F.array(text), parts), lambda p: normalize_text(F.coalesce(p, F.lit(""))))
    return F.concat_ws("\n\n", F.array_distinct(F.filter(trimmed, lambda p: F.length(p) > 0)))


# Fields of nested parts whose strings are content.
TEXT_FIELDS = ("text", "title", "pretext", "fallback", "author_name", "footer")


@F.pandas_udf(ArrayType(StringType()))
def nested_texts(parts: pd.Series) -> pd.Series:
    """The strings under the content fields of a JSON value, at any depth, in the order in which they are written.

    A field that repeats in an object counts once, at its first place with its last value. What is no JSON has none. (VARIANT sorts an
    object's fields, so the written order is lost there.)
    """

    def found(part) -> list[str]:
        try:
            stack, out = [json.loads(part)], []
        except (TypeError, ValueError, RecursionError):
            return []
        if isinstance(stack[0], str):
            return []
        while stack:
            value = stack.pop()
            if isinstance(value, str):
                out.append(value)
            elif isinstance(value, list):
                stack.extend(v for v in reversed(value) if isinstance(v, dict | list))
            elif isinstance(value, dict):
                stack.extend(v for k, v in reversed(value.items()) if isinstance(v, dict | list) or isinstance(v, str) and k in TEXT_FIELDS)
        return out

    return parts.map(found)


def nested_message_content(text: Column, blocks: Column, attachments: Column) -> Column:
    """A message's text and the texts in its blocks, then its attachments (JSON), each once, joined by a blank line."""
    return message_content(text, F.concat(nested_texts(blocks), nested_texts(attachments)))


def ingest_once(batch: DataFrame, existing: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key that is not there yet."""
    first = Window.partitionBy(*key).orderBy(*order)
    new = batch.join(existing.select(*key).distinct(), key, "left_anti")
    return new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def version_sources(items: DataFrame, existing: DataFrame) -> DataFrame:
    """item_id, content_hash, version: hashes new to an item get the next numbers in order of arrival.

    ``items`` has item_id, content_hash and arrived; ``existing`` item_id, content_hash, version.
    """
    new = (
        items.groupBy("item_id", "content_hash").agg(F.min("arrived").alias("arrived"))
        .join(existing.select("item_id", "content_hash"), ["item_id", "content_hash"], "left_anti")
    )
    last = existing.groupBy("item_id").agg(F.max("version").alias("last"))
    order = Window.partitionBy("item_id").orderBy("arrived", "content_hash")
    return new.join(last, "item_id", "left").select(
        "item_id", "content_hash", (F.coalesce("last", F.lit(0)) + F.row_number().over(order)).cast("long").alias("version")
    )


def current_version(versions: DataFrame, items: DataFrame) -> DataFrame:
    """The latest version with the hash that its item has now."""
    latest = Window.partitionBy("item_id").orderBy(F.col("version").desc())
    rows = versions.join(items.select("item_id", "content_hash"), ["item_id", "content_hash"])
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def route_attachments(files: DataFrame) -> DataFrame:
    """Verdict for each file (message_id, position, file_id, name, mime, filetype, mode, external, size, url).

    Files are taken in order; the first reason that applies rejects. What is accepted counts
    against the message's budget, so each message is a fold over its few files.
    """
    first = Window.partitionBy("message_id", "file_id").orderBy("position")
    once = files.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    kind = attachment_kind(*[F.col(c) for c in ("name", "mime", "filetype", "mode", "external")])
    listed = once.select("message_id", F.struct("position", "file_id", kind.alias("kind"), "size", "url").alias("f"))
    per_message = listed.groupBy("message_id").agg(F.array_sort(F.collect_list("f")).alias("files"))
    empty = F.array().cast("array<struct<file_id:string,verdict:string>>")

    def step(acc, f):
        size = F.coalesce(f["size"], F.lit(0)).cast("long")
        verdict = (
            F.when(f["kind"].isNull(), F.lit("unsupported_media"))
            .when(acc["n"] >= MAX_FILES, F.lit("attachment_limit"))
            .when((size > MAX_FILE_BYTES) | (acc["bytes"] + size > MAX_TOTAL_BYTES), F.lit("size_limit"))
            .when(f["url"].isNull(), F.lit("missing_download_url"))
            .otherwise(F.lit("supported"))
        )
        took = (verdict == "supported").cast("int")
        return F.struct(
            (acc["n"] + took).alias("n"),
            (acc["bytes"] + size * took).alias("bytes"),
            F.array_append(acc["out"], F.struct(f["file_id"].alias("file_id"), verdict.alias("verdict"))).alias("out"),
        )

    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("bytes"), empty.alias("out"))
    routed = per_message.select("message_id", F.aggregate("files", start, step, lambda acc: acc["out"]).alias("out"))
    return routed.select("message_id", F.inline("out"))


def validate_attachment_batch(files: DataFrame) -> DataFrame:
    """message_id and the first problem of its batch (null if none)."""
    kind = attachment_kind(*[F.col(c) for c in ("name", "mime", "filetype", "mode", "external")])
    stats = files.groupBy("message_id").agg(
        F.count("*").alias("n"), F.bool_and(kind.isNotNull()).alias("known"),
        F.max("size").alias("largest"), F.sum("size").alias("total"),
    )
    problem = (
        F.when(F.col("n") > MAX_FILES, F.lit("too_many"))
        .when(~F.col("known"), F.lit("unsupported"))
        .when(F.col("largest") > MAX_FILE_BYTES, F.lit("file_too_large"))
        .when(F.col("total") > MAX_TOTAL_BYTES, F.lit("batch_too_large"))
    )
    return stats.select("message_id", problem.alias("problem"))


def spans_by_version(spans: DataFrame) -> DataFrame:
    """Nested spans of each version, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "start_char", "end_char", "text")))
    return spans.groupBy("source_version_id").agg(ordered.alias("spans"))




def ingestion_results(spans: DataFrame, active: DataFrame) -> DataFrame:
    """Per document its spans in order and the ids of its active claims (doc_id in both)."""
    listed = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "span_id", "text"))).alias("spans"))
    own = active.groupBy("doc_id").agg(F.array_sort(F.collect_list("claim_id")).alias("claim_ids"))
    return listed.join(own, "doc_id", "left").withColumn("claim_ids", F.coalesce("claim_ids", F.array().cast("array<string>")))
