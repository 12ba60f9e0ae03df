"""Packing of tokenized documents into training windows by the sum-of-squares rule.

Each task packs the documents of its partition as they come. A level array holds how
many windows are open at each fill; a document goes to the level that minimises the
sum of the squared counts after it is placed (a new window being level zero), which keeps
the counts even, so that a fitting gap is likely for any length to come. Documents longer
than a window give whole windows first; their rest is placed like any other document.

At the end of a partition the few open windows are joined: the emptiest is cut up to fill
the others, and the last one is cut into sequences of power-of-two length, which need no
padding. So each sequence is either full or has a power-of-two length. Nothing is shuffled, no task waits for
another, and a lost task packs the same rows again.

Words (by ASCII white space, which the tokenizer drops) are encoded once and kept in two
generations of a bounded cache per worker process.

Defined results: null text is empty and holds the end id alone; null doc_id is passed through;
repeated rows are packed each; an empty table gives an empty result; other columns are not
carried.
"""

from __future__ import annotations

import os
import struct
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
#: Words in one generation of the cache.
CACHE_WORDS = 400_000
#: Bytes of text whose words are looked up at a time.
CHUNK_BYTES = 1 << 20
TASK_BITS = 40
#: Words of printable ASCII without "<" (which may begin a special token) and Latin-1 letters: case and
#: composition of these characters are settled one by one.
PLAIN = regex.compile("[!-;=-~À-ÖØ-öø-ÿ]+")
# Fixed by the tokenizer's file: how it parts lower-case text, and its letters for bytes
# (printable Latin-1 characters stand for themselves, the others follow from U+0100 on).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_OTHER = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(_OTHER)}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
PIECES_SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("ids", pa.list_(pa.int32()))]
)


class WordEncoder:
    """Ids of texts as little-endian 32-bit bytes, word by word.

    Most words are Latin letters, digits and marks: their pieces (``PIECE``) go to the
    tokenizer's BPE model directly, and each new piece once. All other words take the tokenizer's
    whole path. Both give the ids of the whole text, since white space separates pieces.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.limit = cache_words
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= self.limit:
                self.pieces.clear()
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = self.pieces[piece] = struct.pack(f"<{len(found := self.model.tokenize(letters))}I", *[t.id for t in found])
        return ids

    def _parts(self, text: str) -> list[str] | None:
        """The lower-case pieces of a plain word; None for any other."""
        if not text.isascii() and max(text) > "ÿ":
            return None
        if text.isalpha():
            return [text.lower()]
        if text[-1] in ",.;:!?" and text[:-1].isalpha():
            return [text[:-1].lower(), text[-1]]
        return PIECE.findall(text.lower()) if PLAIN.fullmatch(text) else None

    def encode(self, bodies: list[bytes]) -> list[bytes]:
        texts = [body.split() for body in bodies]
        known, other = {}, []
        for word in set().union(*texts):
            ids = self.young.get(word)
            if ids is None:
                ids = self.old.get(word)
                if ids is None:
                    text = word.decode("utf-8", "replace")
                    parts = self._parts(text)
                    if parts is None:
                        other.append((word, text))
                        continue
                    ids = b"".join(map(self._piece, parts))
                self.young[word] = ids
            known[word] = ids
        found = self.tokenizer.encode_batch_fast([text for _, text in other], add_special_tokens=False)
        for (word, _), encoding in zip(other, found, strict=True):
            known[word] = self.young[word] = np.array(encoding.ids, "<u4").tobytes()
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        return [b"".join(map(known.__getitem__, words)) for words in texts]


def shared_encoder(path: str, cache_words: int = CACHE_WORDS) -> WordEncoder:
    """The worker process's encoder for a file, kept from one task to the next."""
    kept = sys.modules.setdefault("claimloom_worker_state", types.ModuleType("claimloom_worker_state"))
    if getattr(kept, "of", None) != (path, cache_words):
        kept.of, kept.encoder = (path, cache_words), WordEncoder(path, cache_words)
    return kept.encoder


class Packer:
    """Sum-of-squares placement. A window is a list of pieces (doc, start, ids, doc_tokens)."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.level = np.zeros(size + 1, np.int64)  # open windows by fill; 0 and size stay empty
        self.open: dict[int, list[list]] = {}

    def place(self, piece: tuple, length: int) -> list | None:
        """Place a piece shorter than a window; the window, if that fills it."""
        size, level = self.size, self.level
        before, after = level[1 : size - length + 1], level[length + 1 : size + 1]
        cost = 2 * (after - before) + 2
        cost[-1] -= 1  # a full window is no longer counted
        cost[before == 0] = np.iinfo(np.int64).max
        best = len(cost) - 1 - int(np.argmin(cost[::-1]))  # the fullest, on ties
        if cost[best] <= 2 * level[length] + 1:
            fill = best + 1
            window = self.open[fill].pop()
            level[fill] -= 1
        else:
            fill, window = 0, []
        window.append(piece)
        fill += length
        if fill == size:
            return window
        level[fill] += 1
        self.open.setdefault(fill, []).append(window)
        return None

    def finish(self) -> Iterator[list]:
        """The open windows, joined into full ones and power-of-two sequences."""
        rest = [(fill, w) for fill, ws in sorted(self.open.items()) for w in ws]
        self.open, self.level = {}, np.zeros(self.size + 1, np.int64)
        pieces = [p for _, w in rest for p in w]  # the emptiest come first, the last is the fullest
        window, fill = [], 0
        while pieces:
            doc, start, ids, total = pieces.pop()
            take = min(len(ids) // 4, self.size - fill)
            window.append((doc, start, ids[: 4 * take], total))
            fill += take
            if 4 * take < len(ids):
                pieces.append((doc, start + take, ids[4 * take :], total))
            if fill == self.size:
                yield window
                window, fill = [], 0
        while fill:
            room = 1 << (fill.bit_length() - 1)
            fill -= room
            part = []
            while room:
                doc, start, ids, total = window.pop(0)
                take = min(len(ids) // 4, room)
                part.append((doc, start, ids[: 4 * take], total))
                room -= take
                if 4 * take < len(ids):
                    window.insert(0, (doc, start + take, ids[4 * take :], total))
            yield part


def pack_partition(
    batches: Iterator[pa.RecordBatch], encoder: WordEncoder, size: int, task: int, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    packer, sequence = Packer(size), task << TASK_BITS
    end = np.array([END_ID], "<u4").tobytes()
    rows: list[tuple] = []

    def emit(window: list) -> None:
        nonlocal sequence
        offset = 0
        for doc, start, ids, total in window:
            n = len(ids) // 4
            rows.append((doc, start, n, zlib.crc32(ids), total, sequence, offset, ids if with_ids else None))
            offset += n
        sequence += 1

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(PIECES_SCHEMA)
        ids = [None if x is None else np.frombuffer(x, "<u4").astype(np.int32) for x in columns[-1]]
        rows.clear()
        arrays = [pa.array(c, f.type) for c, f in zip([*columns[:-1], ids], PIECES_SCHEMA, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=PIECES_SCHEMA)

    def pack(docs: list, bodies: list[bytes]) -> None:
        for doc, ids in zip(docs, encoder.encode(bodies), strict=True):
            ids += end
            total = len(ids) // 4
            start = 0
            while total - start >= size:
                emit([(doc, start, ids[4 * start : 4 * (start + size)], total)])
                start += size
            if start < total:
                full = packer.place((doc, start, ids[4 * start :], total), total - start)
                if full:
                    emit(full)

    for batch in batches:
        docs, bodies, held = [], [], 0
        for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            docs.append(doc)
            bodies.append(body.as_py())
            held += len(bodies[-1])
            if held >= CHUNK_BYTES:
                pack(docs, bodies)
                docs, bodies, held = [], [], 0
                yield flush()
        pack(docs, bodies)
        yield flush()
    for window in packer.finish():
        emit(window)
    yield flush()


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    size: int = WINDOW,
    with_ids: bool = True,
    cache_words: int = CACHE_WORDS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``cache_words`` bounds what each worker process keeps (some 300 bytes a word); results do not depend on it.

    ``tokenizer_path`` must be readable on the executors; by default it is the installed
    public vocabulary's file there.
    """

    def pack(batches):
        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        yield from pack_partition(batches, shared_encoder(path, cache_words), size, TaskContext.get().partitionId(), with_ids)

    rows = docs.select(F.col(key).cast("long"), F.coalesce(F.col(text), F.lit("")).cast("binary"))
    packed = rows.mapInArrow(pack, PIECES)
    return packed.withColumnRenamed("doc_id", key)
