"""Removal of repeated token windows by Rabin-Karp hashes counted in Spark.

A window is ``width`` consecutive words of one document. Every window of every document
is hashed; Spark counts the hashes across blocks of documents; of each repeated window
the occurrence with the smallest (doc_id, start) stays, and the words of all the others are
removed, overlapping windows merging into maximal intervals.

A word enters as 128 bits of BLAKE2b, and the two halves are rolled by different multipliers: windows
are first counted by the bucket and 24 further bits of the first hash, and those seen more than
once are compared by all 128 bits. At 100 TB (about 2e13 windows) a chance match is below one in 10^11.
See ``blocks`` for how blocks and buckets exchange this.

Defined results: null text has no words; a text shorter than the window keeps all its
words; a text of any length lies whole in one block; rows that share a doc_id are separate documents
in an order fixed by their content; of rows equal in doc_id and text the first is judged like any document,
and the others repeat all its windows, so they keep no word if they have a window at all; null doc_id sorts
first and comes back null; an empty table gives an empty result. Columns other than key and text are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import blocks as B
from claimloom.llm.common import SPACE_CLASS

WIDTH = 20
BLOCK_BYTES = 2 << 20
PER_BUCKET = 1 << 20
PRINT_BYTES = 3

WINDOWS = "bucket int, block long, local boolean, hashes binary, more binary, docs binary, starts binary, ends binary"
WINDOWS_SCHEMA = pa.schema(
    [("bucket", pa.int32()), ("block", pa.int64()), ("local", pa.bool_())]
    + [(x, pa.binary()) for x in ("hashes", "more", "docs", "starts", "ends")]
)
ANSWERS = "block long, starts binary, ends binary"
ANSWERS_SCHEMA = pa.schema([("block", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary())])
RESULT = "doc long, n_words long, n_removed long, starts array<int>, ends array<int>, kept string, kept_sha256 string"
RESULT_SCHEMA = pa.schema(
    [("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64())]
    + [(x, pa.list_(pa.int32())) for x in ("starts", "ends")]
    + [("kept", pa.string()), ("kept_sha256", pa.string())]
)

#: Odd multiplier of the second window hash.
_SECOND = 0xA0761D6478BD642F
#: Words whose hashes are kept while a block is read.
CACHE_WORDS = 1 << 20


class _Digests(dict):
    """128 bits of each word, worked out once for a block's frequent words."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = hashlib.blake2b(word, digest_size=16).digest()
        return value


def word_hashes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes per word of all texts in turn, and the number of words of each text."""
    digest = _Digests()
    parts, counts = [], []
    for body in bodies:
        words = body.split()
        counts.append(len(words))
        parts.append(b"".join(map(digest.__getitem__, words)))
    return np.frombuffer(b"".join(parts), "<u8").reshape(-1, 2).astype(np.uint64), np.array(counts, np.int64)


def window_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First hashes of the windows that lie in one document, and their first words' numbers."""
    hashes = B.mix(B.rolled(words[:, 0], width))
    doc = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes)
    at = np.flatnonzero(doc[:n] == doc[width - 1 : width - 1 + n]) if n else np.empty(0, np.int64)
    return hashes[at], at


def _repeats(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order, by the columns, the last leading; which of the ordered equal their predecessor in the last two)."""
    order = np.lexsort(columns)
    a, b = columns[-1][order], columns[-2][order]
    return order, np.r_[False, (a[1:] == a[:-1]) & (b[1:] == b[:-1])][: len(order)]


def _sent_by_bucket(out: dict[str, list], block: int, bits: int, hashes, more, docs, starts) -> None:
    """Append a block's windows, grouped by bucket, as packed arrays."""
    bucket = (hashes >> B.U64(64 - bits)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    names, cuts = B.packed_by_bucket(bucket[by], len(by))
    for name, a, b in zip(names.tolist(), cuts[:-1], cuts[1:], strict=True):
        own = by[a:b]
        values = (
            name, block, False, hashes[own].astype("<u8").tobytes(), more[own].astype("<u8").tobytes(),
            docs[own].astype("<i8").tobytes(), B.u32(starts[own]), b"",
        )
        for column, value in zip(WINDOWS_SCHEMA.names, values, strict=True):
            out[column].append(value)


def _answer(out: dict[str, list], bits: int, block: int, starts: bytes, ends: bytes) -> None:
    for column, value in zip(WINDOWS_SCHEMA.names, (block % (1 << bits), block, True, b"", b"", b"", starts, ends), strict=True):
        out[column].append(value)


def find_later(docs: DataFrame, key: str, text: str, width: int, block_bytes: int, per_bucket: int, fan_in: int):
    """(the dealt blocks, answers): for each block the intervals of words to remove."""
    rows, total, n_blocks = B.dealt(docs, key, text, block_bytes)
    bits = B.bucket_bits(docs, total / 6, per_bucket)

    def prints(key, table):
        hashes, _ = window_hashes(*word_hashes(B.block_rows(table)[1]), width)
        return B.prints_table(key[0].as_py(), hashes, bits, PRINT_BYTES)

    def windows(key, table, answers):
        block = key[0].as_py()
        if not table.num_rows:
            return WINDOWS_SCHEMA.empty_table()
        ids, bodies = B.block_rows(table)
        words, counts = word_hashes(bodies)
        hashes, at = window_hashes(words, counts, width)
        more = B.mix(B.rolled(words[:, 1], width, _SECOND))[at]
        order, same = _repeats(at, more, hashes)  # equal windows in (document, start) order
        first = np.ones(len(order), bool)
        first[order[same]] = False
        out = {c: [] for c in WINDOWS_SCHEMA.names}
        starts, ends = B.runs(at[~first], width)
        _answer(out, bits, block, B.u32(starts), B.u32(ends))
        send = np.flatnonzero(first & B.flagged(hashes, answers, bits, PRINT_BYTES))
        doc = np.repeat(np.arange(len(counts)), counts)
        _sent_by_bucket(out, block, bits, hashes[send], more[send], ids[doc[at[send]]], at[send])
        return B.to_table(WINDOWS_SCHEMA, **out)

    def compared(table, further):
        """Windows that came together: what blocks lose and, to be compared ``further``, the first of each window."""
        rows = table.to_pylist()
        out = {c: [] for c in WINDOWS_SCHEMA.names}
        for r in rows:
            if r["local"]:
                _answer(out, bits, r["block"], r["starts"], r["ends"])
        sent = sorted((r for r in rows if not r["local"]), key=lambda r: r["block"])
        if sent:
            hashes, more = (np.concatenate([np.frombuffer(r[c], "<u8") for r in sent]) for c in ("hashes", "more"))
            doc = np.concatenate([np.frombuffer(r["docs"], "<i8") for r in sent])
            at = np.concatenate([B.from_u32(r["starts"]) for r in sent])
            source = np.repeat(np.arange(len(sent)), [len(r["more"]) // 8 for r in sent])
            order, same = _repeats(at, source, doc, more, hashes)
            later = np.zeros(len(order), bool)
            later[order[same]] = True
            cuts = np.searchsorted(source, np.arange(len(sent) + 1))
            for r, a, b in zip(sent, cuts[:-1], cuts[1:], strict=True):
                gone = a + np.flatnonzero(later[a:b])
                if len(gone):
                    starts, ends = B.runs(np.sort(at[gone]), width)
                    _answer(out, bits, r["block"], B.u32(starts), B.u32(ends))
                if further:
                    left = a + np.flatnonzero(~later[a:b])
                    _sent_by_bucket(out, r["block"], bits, hashes[left], more[left], doc[left], at[left])
        return B.to_table(WINDOWS_SCHEMA, **out)

    def decided(table):
        return compared(table, False).select(ANSWERS_SCHEMA.names)

    often = B.seen_elsewhere(rows.groupBy("block").applyInArrow(prints, B.FINGERPRINTS), PRINT_BYTES)
    sent = rows.groupBy("block").cogroup(often.groupBy("block")).applyInArrow(windows, WINDOWS)
    sent = B.narrowed(sent, n_blocks, fan_in, lambda table: compared(table, True), WINDOWS)
    return rows, sent.groupBy("bucket").applyInArrow(decided, ANSWERS)


def remove_repeated_windows(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    block_bytes: int = BLOCK_BYTES,
    per_bucket: int = PER_BUCKET,
    with_text: bool = True,
    fan_in: int = B.FAN_IN,
) -> DataFrame:
    """Per document: key, n_words, n_removed, the removed word intervals (starts, ends),
    kept (words joined by a space; null without ``with_text``) and its kept_sha256."""
    once, repeated = B.parted(docs, key, text)
    rows, answers = find_later(once, key, text, width, block_bytes, per_bucket, fan_in)

    def remove(table, intervals):
        ids, bodies = B.block_rows(table)
        starts, ends = B.intervals_of(intervals)
        out: dict[str, list] = {f.name: [] for f in RESULT_SCHEMA}
        base = 0
        lo = 0
        for i, body in enumerate(bodies):
            words = body.split()
            # intervals never cross documents, but those of neighbours may touch
            while lo < len(starts) and ends[lo] <= base:
                lo += 1
            hi, keep, spans, last = lo, [], [], 0
            while hi < len(starts) and starts[hi] < base + len(words):
                a, b = max(int(starts[hi]) - base, 0), min(int(ends[hi]) - base, len(words))
                hi += 1
                if b > a:
                    keep.extend(words[last:a])
                    spans.append((a, b))
                    last = b
            keep = b" ".join(keep + words[last:] if spans else words)
            out["doc"].append(int(ids[i]))
            out["n_words"].append(len(words))
            out["n_removed"].append(sum(b - a for a, b in spans))
            out["starts"].append([a for a, _ in spans])
            out["ends"].append([b for _, b in spans])
            out["kept"].append(keep.decode() if with_text else None)
            out["kept_sha256"].append(hashlib.sha256(keep).hexdigest())
            base += len(words)
        return B.to_table(RESULT_SCHEMA, **out)

    result = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, RESULT)
    result = result.select(F.nullif("doc", F.lit(B.NULL_ID)).alias(key), *RESULT_SCHEMA.names[1:])
    return result if repeated is None else result.union(_further_copies(repeated, key, text, width, with_text))


def _further_copies(repeated: DataFrame, key: str, text: str, width: int, with_text: bool) -> DataFrame:
    """Results of all copies of a row but the first: they repeat each of its windows."""
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE_CLASS, -1), "")
    rows = repeated.select(F.col(key).cast("long").alias(key), words.alias("words"), (F.col("copies") - 1).alias("copies"))
    n = F.size("words")
    gone = n >= width
    spans = lambda value: F.when(gone, F.array(value)).otherwise(F.array().cast("array<int>"))
    kept = F.when(gone, F.lit("")).otherwise(F.array_join("words", " "))
    found = rows.select(
        key, n.cast("long").alias("n_words"), F.when(gone, n).otherwise(0).cast("long").alias("n_removed"),
        spans(F.lit(0)).alias("starts"), spans(n).alias("ends"), (kept if with_text else F.lit(None).cast("string")).alias("kept"),
        F.sha2(kept, 256).alias("kept_sha256"), "copies",
    )
    return B.copied(found, "copies")
