"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Only the first ``depth`` bytes of a suffix matter: suffixes equal through ``depth`` bytes
are exactly the repeated strings. They are ordered by most-significant-digit passes that
drop a suffix as soon as its group is a single one:

* the first digit is chosen so that most suffixes never have to leave their task. Among
  the ``GRAM``-byte strings inside a suffix's first ``depth`` bytes, the one with the least hash
  (the leftmost, on ties) is its anchor; equal suffixes have equal anchors at equal
  distances. Neighbouring suffixes share anchors, so counting anchors is cheap, and a
  suffix whose anchor no other block has is done;
* the rest are dealt out by anchor as stretches of bytes and ordered there through all
  ``depth`` bytes, first by the hash of the leading GRAM bytes and then by digits of eight bytes; the
  digits cover every byte, so equal means equal bytes and no hash decides.

A group's bytes are removed in every document but the one with the smallest id. Inside
a block this happens before anything is sent, so a passage shared by a third of all
documents leaves each block once; and what many blocks send under one anchor is sorted by ranges of blocks first
(``blocks.narrowed``), so that no task sorts more than a bounded number of equal strings.

Defined results: null text is empty; matches never cross documents; rows that share a
doc_id, equal ones among them, do not remove each other's bytes; null doc_id sorts first and comes back null;
an empty table gives an empty result; a text of any length lies whole in one block (up to 2 GiB, the most a
column holds). Columns other than key and text are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import blocks as B
from claimloom.llm.common import checkpointed

DEPTH = 50
GRAM = 20
BLOCK_BYTES = 1 << 20
ANCHORS_PER_BUCKET = 200_000
PRINT_BYTES = 4
#: Low bits of a packed (hash, position) value that hold the position in a block.
POSITION_BITS = 31

STRETCHES = "bucket int, block long, local boolean, docs binary, starts binary, counts binary, body binary"
STRETCHES_SCHEMA = pa.schema(
    [("bucket", pa.int32()), ("block", pa.int64()), ("local", pa.bool_())]
    + [(x, pa.binary()) for x in ("docs", "starts", "counts", "body")]
)
ANSWERS = "block long, starts binary, ends binary"
ANSWERS_SCHEMA = pa.schema([("block", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary())])
RESULT = "doc long, n_bytes long, n_removed long, starts array<int>, ends array<int>, kept binary, kept_sha256 string, copies long"
RESULT_SCHEMA = pa.schema(
    [("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64())]
    + [(x, pa.list_(pa.int32())) for x in ("starts", "ends")]
    + [("kept", pa.binary()), ("kept_sha256", pa.string()), ("copies", pa.int64())]
)

_BYTE_CODES = B.mix(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    return B.mix(B.rolled(_BYTE_CODES[buf], gram))


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchored_runs(hashes: np.ndarray, lengths: np.ndarray, depth: int, gram: int):
    """Runs of consecutive suffixes of one document with one anchor.

    Returns first suffix, number of suffixes, anchor hash and document number per run.
    """
    empty = np.empty(0, np.int64)
    width = depth - gram + 1
    if len(hashes) < width:
        return empty, empty, np.empty(0, np.uint64), empty
    if len(hashes) >> POSITION_BITS:
        raise ValueError(f"a block of {len(hashes)} bytes: positions hold {POSITION_BITS} bits")
    low = B.U64((1 << POSITION_BITS) - 1)
    packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    owner = (least_in_windows(packed, width) & low).astype(np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    inside = np.zeros(len(owner) + 1, np.int8)
    for b, e in zip(begins[lengths >= depth], ends[lengths >= depth] - depth + 1, strict=True):
        inside[b:e] = 1
    change = np.r_[True, owner[1:] != owner[:-1]] | (np.diff(np.r_[0, inside[:-1]]) != 0)
    change[begins[(begins < len(change)) & (lengths > 0)]] = True
    starts = np.flatnonzero(change)
    counts = np.diff(np.r_[starts, len(owner)])
    valid = inside[starts] == 1
    starts, counts = starts[valid], counts[valid]
    # the least hashes are small numbers: scramble them, for buckets are leading bits
    anchors = B.mix(hashes[owner[starts]] ^ B.U64(B.ODD))
    return starts, counts, anchors, np.searchsorted(ends, starts, side="right")


def _digits(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one number (the first byte leads)."""
    out = buf.astype(np.uint64)
    for span in (1, 2, 4):
        out = (out[:-span] << B.U64(8 * span)) | out[span:]
    return out


def equal_suffixes(buf: np.ndarray, starts: np.ndarray, leading: np.ndarray, depth: int):
    """Radix passes over the suffixes at ``starts``: (numbers, group) of those not alone.

    ``leading`` holds the first digit of each; groups come numbered and adjacent.
    """
    order = np.argsort(leading, kind="stable")
    digit = leading[order]
    group = np.cumsum(np.r_[0, digit[1:] != digit[:-1]]) if len(order) else np.empty(0, np.int64)

    def several(order, group):
        size = np.bincount(group) if len(group) else np.empty(0, np.int64)
        keep = size[group] > 1
        order, group = order[keep], group[keep]
        return order, np.cumsum(np.r_[0, group[1:] != group[:-1]]) if len(group) else group

    order, group = several(order, group)
    eights = _digits(buf)
    for offset in [*range(0, depth - 8, 8), depth - 8]:
        if not len(order):
            break
        digit = eights[starts[order] + offset]
        inner = (digit[1:] != digit[:-1]) & (group[1:] == group[:-1])
        if not inner.any():
            continue
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[1:][inner]] = True
        at = np.flatnonzero(mixed[group])
        by = np.lexsort((digit[at], group[at]))
        order[at], digit[at] = order[at][by], digit[at][by]
        new = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        order, group = several(order, np.cumsum(np.r_[0, new]))
    return order, group


def later_suffixes(buf, starts, leading, docs, depth: int) -> np.ndarray:
    """True for suffixes whose first ``depth`` bytes also start one in a smaller document."""
    later = np.zeros(len(starts), bool)
    order, group = equal_suffixes(buf, starts, leading, depth)
    if len(order):
        first = np.minimum.reduceat(docs[order], np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))
        later[order] = docs[order] > first[group]
    return later


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of start, start+1, ... for each run."""
    jump = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) if len(starts) else np.empty(0, np.int64)
    return jump + np.arange(len(jump))


def _send(out: dict[str, list], block: int, buckets, docs, shift, run, at, buf, depth: int) -> None:
    """Append the suffixes at ``at`` of a block as stretches of bytes, grouped by bucket.

    ``run`` numbers the run of each; ``buckets``, ``docs`` and ``shift`` (from ``at`` to the place in the block)
    belong to runs.
    """
    cut = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.empty(0, np.int64)
    first, own, n = at[cut], run[cut], np.diff(np.r_[cut, len(at)])
    by = np.argsort(buckets[own], kind="stable")
    first, own, n = first[by], own[by], n[by]
    names, cuts = B.packed_by_bucket(buckets[own], len(own))
    for name, a, b in zip(names.tolist(), cuts[:-1], cuts[1:], strict=True):
        values = (
            name, block, False, docs[own[a:b]].astype("<i8").tobytes(), B.u32(first[a:b] + shift[own[a:b]]), B.u32(n[a:b]),
            buf[spread(first[a:b], n[a:b] + depth - 1)].tobytes(),
        )
        for column, value in zip(STRETCHES_SCHEMA.names, values, strict=True):
            out[column].append(value)


def _answer(out: dict[str, list], bits: int, block: int, starts: bytes, ends: bytes) -> None:
    for column, value in zip(STRETCHES_SCHEMA.names, (block % (1 << bits), block, True, b"", starts, ends, b""), strict=True):
        out[column].append(value)


def find_later(docs: DataFrame, key: str, text: str, depth: int, block_bytes: int, per_bucket: int, fan_in: int):
    """(the dealt blocks, answers): for each block the byte intervals to remove."""
    gram = min(GRAM, max(1, depth // 2))
    rows, total, n_blocks = B.dealt(docs, key, text, block_bytes)
    bits = B.bucket_bits(docs, 2.0 * total / (depth - gram + 2), per_bucket)

    def prepared(table):
        ids, bodies = B.block_rows(table)
        buf = np.frombuffer(b"".join(bodies), np.uint8)
        lengths = np.array([len(x) for x in bodies], np.int64)
        hashes = gram_hashes(buf, gram)
        return ids, buf, hashes, anchored_runs(hashes, lengths, depth, gram)

    def prints(key, table):
        _, _, _, (_, _, anchors, _) = prepared(table)
        return B.prints_table(key[0].as_py(), anchors, bits, PRINT_BYTES)

    def stretches(key, table, answers):
        block = key[0].as_py()
        if not table.num_rows:
            return STRETCHES_SCHEMA.empty_table()
        ids, buf, hashes, (starts, counts, anchors, doc) = prepared(table)
        elsewhere = B.flagged(anchors, answers, bits, PRINT_BYTES)
        _, name, size = np.unique(anchors, return_inverse=True, return_counts=True)
        some = elsewhere | (size[name.ravel()] > 1)
        starts, counts, anchors, doc, elsewhere = (x[some] for x in (starts, counts, anchors, doc, elsewhere))
        at = spread(starts, counts)
        later = later_suffixes(buf, at, hashes[at], np.repeat(ids[doc], counts), depth)
        gone, ends = B.runs(at[later], depth)
        out = {c: [] for c in STRETCHES_SCHEMA.names}
        _answer(out, bits, block, B.u32(gone), B.u32(ends))
        run = np.repeat(np.arange(len(starts)), counts)
        left = ~later & np.repeat(elsewhere, counts)
        buckets = (anchors >> B.U64(64 - bits)).astype(np.int32)
        _send(out, block, buckets, ids[doc], np.zeros(len(starts), np.int64), run[left], at[left], buf, depth)
        return B.to_table(STRETCHES_SCHEMA, **out)

    def compared(table, further):
        """Suffixes that came together: what blocks lose and, to be compared ``further``, all others."""
        out = {c: [] for c in STRETCHES_SCHEMA.names}
        sent = []
        for r in table.to_pylist():
            if r["local"]:
                _answer(out, bits, r["block"], r["starts"], r["counts"])
            else:
                sent.append(r)
        if sent:
            buf = np.frombuffer(b"".join(r["body"] for r in sent), np.uint8)
            counts = np.concatenate([B.from_u32(r["counts"]) for r in sent])
            docs = np.concatenate([np.frombuffer(r["docs"], "<i8") for r in sent])
            home = np.concatenate([B.from_u32(r["starts"]) for r in sent])
            begins = np.cumsum(np.r_[0, counts + depth - 1])[:-1]
            at = spread(begins, counts)
            leading = gram_hashes(buf, gram)[at]
            later = later_suffixes(buf, at, leading, np.repeat(docs, counts), depth)
            stretch = np.repeat(np.arange(len(counts)), counts)
            source = np.repeat(np.arange(len(sent)), [len(r["counts"]) // 4 for r in sent])
            cuts = np.searchsorted(source[stretch], np.arange(len(sent) + 1))
            buckets = np.full(len(counts), sent[0]["bucket"], np.int32)
            for r, a, b in zip(sent, cuts[:-1], cuts[1:], strict=True):
                gone = a + np.flatnonzero(later[a:b])
                if len(gone):
                    starts, ends = B.runs(np.sort(home[stretch[gone]] + at[gone] - begins[stretch[gone]]), depth)
                    _answer(out, bits, r["block"], B.u32(starts), B.u32(ends))
                if further:
                    left = a + np.flatnonzero(~later[a:b])
                    _send(out, r["block"], buckets, docs, home - begins, stretch[left], at[left], buf, depth)
        return B.to_table(STRETCHES_SCHEMA, **out)

    def decided(table):
        return compared(table, False).select(["block", "starts", "counts"]).rename_columns(ANSWERS_SCHEMA.names)

    often = B.seen_elsewhere(rows.groupBy("block").applyInArrow(prints, B.FINGERPRINTS), PRINT_BYTES)
    sent = rows.groupBy("block").cogroup(often.groupBy("block")).applyInArrow(stretches, STRETCHES)
    sent = B.narrowed(sent, n_blocks, fan_in, lambda table: compared(table, True), STRETCHES)
    return rows, sent.groupBy("bucket").applyInArrow(decided, ANSWERS)


def remove_repeated_bytes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    depth: int = DEPTH,
    block_bytes: int = BLOCK_BYTES,
    per_bucket: int = ANCHORS_PER_BUCKET,
    with_text: bool = True,
    fan_in: int = B.FAN_IN,
) -> DataFrame:
    """Per document: key, n_bytes, n_removed, the removed byte intervals (starts, ends), kept
    (the other bytes; null without ``with_text``) and its kept_sha256.

    ``depth`` is at least 9.
    """
    if depth < 9:
        raise ValueError("depth must be at least 9 bytes")
    once, repeated = B.parted(docs, key, text)
    rows, answers = find_later(once, key, text, depth, block_bytes, per_bucket, fan_in)

    def remove(table, intervals):
        starts, ends = (x.tolist() for x in B.intervals_of(intervals))
        out: dict[str, list] = {f.name: [] for f in RESULT_SCHEMA}
        base = lo = 0
        for doc, _, body, copies in B.ordered(table):
            while lo < len(starts) and ends[lo] <= base:
                lo += 1
            hi, keep, spans, last = lo, [], [], 0
            while hi < len(starts) and starts[hi] < base + len(body):
                a, b = max(starts[hi] - base, 0), min(ends[hi] - base, len(body))
                hi += 1
                if b > a:
                    keep.append(body[last:a])
                    spans.append((a, b))
                    last = b
            kept = b"".join([*keep, body[last:]]) if spans else body
            out["doc"].append(doc)
            out["copies"].append(copies)
            out["n_bytes"].append(len(body))
            out["n_removed"].append(sum(b - a for a, b in spans))
            out["starts"].append([a for a, _ in spans])
            out["ends"].append([b for _, b in spans])
            out["kept"].append(kept if with_text else None)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            base += len(body)
        return B.to_table(RESULT_SCHEMA, **out)

    result = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, RESULT)
    result = result.select(F.nullif("doc", F.lit(B.NULL_ID)).alias(key), *RESULT_SCHEMA.names[1:])
    if repeated is None:
        return result.drop("copies")
    result = checkpointed(result)
    return result.where("copies = 1").drop("copies").union(B.copied(result.where("copies > 1"), "copies"))
