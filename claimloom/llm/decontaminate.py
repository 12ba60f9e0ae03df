"""Benchmark decontamination: BM25 over an index of test items, searched by block-max WAND.

The test items are the indexed collection and every passage of the training texts is a
query. Items fall into classes of length: up to 64 words, up to 128, and so on. A passage for a
class is ``2 * stride`` words, with a new one every ``stride`` words, and the stride is the class's
greatest length; so an item of any length that stands in a text lies whole in some
passage. An item's score is its BM25 sum over the passage's distinct words, divided by the
sum over all of the item's own words, and every item with a score of at least
``threshold`` is retrieved. Retrieved items are verified: enough of the word trigrams of the item's question and
of its answer (its last sentence) must occur in the passage.

Items stand in the index in blocks; for each term and block the index holds the greatest
weight. Passages for which no block's maxima add up to the threshold are dismissed, many
at a time by numpy; the others walk their posting lists document at a time, skipping
by list maxima to a pivot and over blocks whose maxima cannot reach the threshold.
No result is lost by either.

Document frequencies, the number of items and their mean length are counted by Spark over all items, and
so are the weights. The index goes to the tasks by broadcast. Its size is bounded: the items' bytes are
measured, and beyond ``MAX_INDEX_BYTES`` they are dealt into parts that are built, sent and searched one after
another; scores and rows do not depend on the number of parts. Training texts are not collected; each text is
searched whole, of any length, where it lies.

Defined results: null and empty texts match nothing, and null or empty items are
never found; rows that share a doc_id are searched each; items equal in id and text count once; an empty
table gives an empty result. ``decontaminate`` passes all columns through, of any name.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import checkpointed

K1, SLOPE = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.5
MIN_STRIDE = 64
BLOCK = 4
MAX_INDEX_BYTES = 4 << 20
#: Words whose passages are bounded at a time.
CHUNK_WORDS = 1 << 19
LEAKS = "doc_id long, item_id long, start long, score double, question_overlap double, answer_overlap double"
LEAKS_SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "item_id", "start")]
    + [(c, pa.float64()) for c in ("score", "question_overlap", "answer_overlap")]
)


def words_in(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last; a single sentence gives its
    last quarter as the answer."""
    sentences = [w for s in re.split(r"(?<=[.?!])\s+|\n+", text) if (w := words_in(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def _grams(words: list[str], n: int = 3) -> set:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def length_class(n_words: int) -> int:
    """0 for up to MIN_STRIDE words, 1 for up to twice as many, and so on."""
    return max(0, math.ceil(math.log2(max(1, n_words) / MIN_STRIDE)))


def impacts(terms: list[tuple[str, int, int]], n_items: int, mean_length: float) -> list[tuple[str, float]]:
    """(term, share of the item's score) of an item's (term, count, items that have it)."""
    terms = sorted(terms)
    norm = K1 * (1 - SLOPE + SLOPE * sum(f for _, f, _ in terms) / mean_length)
    raw = [math.log(1 + (n_items - df + 0.5) / (df + 0.5)) * f * (K1 + 1) / (f + norm) for _, f, df in terms]
    whole = sum(raw)
    return [(t, x / whole) for (t, _, _), x in zip(terms, raw, strict=True)]


class Index:
    """Impact-ordered blocks of test items of one class: (item id, text, impacts) rows."""

    def __init__(self, rows: list[tuple], stride: int, threshold: float = THRESHOLD, overlap: float = OVERLAP):
        self.threshold, self.overlap, self.stride = threshold, overlap, stride
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
        self.items = [(i, text) for i, text, _ in rows]
        n = len(rows)
        self.vocabulary = {t: k for k, t in enumerate(sorted({t for _, _, own in rows for t, _ in own}))}
        lists: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        for at, (_, _, own) in enumerate(rows):
            for t, x in own:
                lists[self.vocabulary[t]].append((at, x))
        self.postings = [([i for i, _ in p], [x for _, x in p]) for p in lists]
        self.most = [max(x for _, x in p) for p in lists]
        # the block maxima of all terms, end to end
        blocks, maxima, edges = [], [], [0]
        for p in lists:
            best: dict[int, float] = {}
            for i, x in p:
                best[i // BLOCK] = max(x, best.get(i // BLOCK, 0.0))
            blocks.extend(best)
            maxima.extend(best.values())
            edges.append(len(blocks))
        self.blocks, self.maxima, self.edges = np.array(blocks, np.int64), np.array(maxima), np.array(edges)
        self.block_max = [
            dict(zip(blocks[a:b], maxima[a:b], strict=True)) for a, b in zip(edges[:-1], edges[1:], strict=True)
        ]
        self.n_blocks = -(-n // BLOCK)
        self.parts: dict[int, tuple[set, set]] = {}

    def live_blocks(self, terms: np.ndarray, stretch: np.ndarray, n: int) -> dict[int, list[int]]:
        """Passages (of ``n`` stretches' starts) and their blocks whose maxima reach the threshold.

        ``terms`` and ``stretch`` say which terms occur in which stride of words; a passage is
        a stretch and the next one.
        """
        if not len(terms) or not self.n_blocks:
            return {}
        pairs = np.unique(stretch * len(self.vocabulary) + terms)
        stretch, terms = pairs // len(self.vocabulary), pairs % len(self.vocabulary)
        size = self.edges[terms + 1] - self.edges[terms]
        entry = np.repeat(self.edges[terms] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        cell = np.repeat(stretch, size) * self.n_blocks + self.blocks[entry]
        goal = self.threshold - 1e-9
        if n * self.n_blocks <= 4 * len(cell):  # a full table is no larger than the list of its entries
            sums = np.bincount(cell, self.maxima[entry], n * self.n_blocks).reshape(n, self.n_blocks)
            sums[:-1] += sums[1:]  # a passage's second stretch
            passages, blocks = np.nonzero(sums >= goal)
        else:
            cells, at = np.unique(np.concatenate([cell, cell - self.n_blocks]), return_inverse=True)
            sums = np.bincount(at.ravel(), np.tile(self.maxima[entry], 2))
            cells = cells[(sums >= goal) & (cells >= 0)]
            passages, blocks = cells // self.n_blocks, cells % self.n_blocks
        out: dict[int, list[int]] = {}
        for passage, block in zip(passages.tolist(), blocks.tolist(), strict=True):
            out.setdefault(passage, []).append(block)
        return out

    def search(self, terms: list[int], live: list[int] | None = None) -> list[tuple[int, float]]:
        """All (item number, score) at or above the threshold for a set of terms."""
        goal = self.threshold - 1e-9
        alive = None if live is None else sorted(live)
        lists = [[self.postings[t][0][0], 0, t] for t in set(terms)]
        out = []

        def forward(entry: list, item: int) -> None:
            numbers = self.postings[entry[2]][0]
            entry[1] = bisect_left(numbers, item, entry[1])
            entry[0] = numbers[entry[1]] if entry[1] < len(numbers) else -1

        def live_from(item: int) -> int | None:
            """The first item from ``item`` on that lies in a live block."""
            if alive is None:
                return item
            k = bisect_left(alive, item // BLOCK)
            return None if k == len(alive) else max(item, alive[k] * BLOCK)

        while lists:
            lists.sort()
            bound, pivot = 0.0, None
            for k, (item, _, t) in enumerate(lists):
                bound += self.most[t]
                if bound >= goal:
                    pivot, k_end = item, k
                    break
            if pivot is None or (start := live_from(pivot)) is None:
                break
            while k_end + 1 < len(lists) and lists[k_end + 1][0] == pivot:
                k_end += 1
            block = pivot // BLOCK
            upto = lists[: k_end + 1]
            if start > pivot:  # no item before ``start`` can reach the threshold
                for entry in lists:
                    if entry[0] < start:
                        forward(entry, start)
            elif sum(self.block_max[t].get(block, 0.0) for _, _, t in upto) < goal:
                # nothing before the next block, or before the next list's item, can reach it
                after = (block + 1) * BLOCK
                if k_end + 1 < len(lists):
                    after = min(after, lists[k_end + 1][0])
                for entry in upto:
                    forward(entry, after)
            elif lists[0][0] == pivot:
                score = sum(self.postings[t][1][pos] for item, pos, t in upto if item == pivot)
                if score >= goal:
                    out.append((pivot, score))
                for entry in upto:
                    forward(entry, pivot + 1)
            else:
                for entry in upto:
                    if entry[0] < pivot:
                        forward(entry, pivot)
            lists = [e for e in lists if e[0] >= 0]
        return out

    def verify(self, item: int, passage: list[str]) -> tuple[float, float]:
        """Shares of the question's and the answer's trigrams that the passage has."""
        if item not in self.parts:
            question, answer = question_and_answer(self.items[item][1])
            self.parts[item] = (_grams(question), _grams(answer))
        shares = []
        for grams in self.parts[item]:
            n = max((len(g) for g in grams), default=0)
            shares.append(len(grams & _grams(passage, n)) / len(grams) if grams else 1.0)
        return tuple(shares)

    def search_chunk(self, held: list[tuple[int, list[str]]], found: list[list[tuple]]) -> None:
        get, step = self.vocabulary.get, self.stride
        ids, stretches, first = [], [], []
        base = 0
        for _, words in held:
            own = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
            at = np.flatnonzero(own >= 0)
            ids.append(own[at])
            stretches.append(base + at // step)
            first.append(base)
            base += len(words) // step + 2  # a gap, so that no passage spans two texts
        live = self.live_blocks(np.concatenate(ids), np.concatenate(stretches), base)
        best: dict[tuple[int, int], tuple] = {}
        starts = np.array(first)
        for passage, blocks in live.items():
            k = int(np.searchsorted(starts, passage, side="right")) - 1
            i, words = held[k]
            begin = (passage - first[k]) * step
            part = words[begin : begin + 2 * step]
            terms = {t for w in part if (t := get(w)) is not None}
            for item, score in self.search(list(terms), blocks):
                question, answer = self.verify(item, part)
                if question >= self.overlap and answer >= self.overlap:
                    row = (question + answer, score, -begin, question, answer)
                    if row > best.get((i, item), (-1.0,)):
                        best[i, item] = row
        for (i, item), (_, score, begin, question, answer) in sorted(best.items()):
            found[i].append((self.items[item][0], -begin, score, question, answer))


def leaks(indexes: list[Index], texts: list[str | None]) -> list[list[tuple]]:
    """Per text its verified items: (item id, start word, score, question, answer), best passage each."""
    found: list[list[tuple]] = [[] for _ in texts]
    held: list[tuple[int, list[str]]] = []
    size = 0
    for i, text in enumerate(texts):
        words = words_in(text) if text else []
        if words:
            held.append((i, words))
            size += len(words)
        if held and (size >= CHUNK_WORDS or i == len(texts) - 1):
            for index in indexes:
                index.search_chunk(held, found)
            held, size = [], 0
    return found


def weighed_items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, class, terms) of the distinct items that have a word; terms are (term, impact)."""

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([words_in(x) for x in texts])

    items = benchmark.where(F.length(text) > 0).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).distinct()
    items = checkpointed(items.select("id", "text", F.md5("text").alias("digest"), words("text").alias("words")).where(F.size("words") > 0))
    n_items, total = items.agg(F.count("*"), F.sum(F.size("words"))).first()
    mean = total / n_items if n_items else 1.0
    counts = items.select("id", "digest", F.explode("words").alias("term")).groupBy("id", "digest", "term").agg(F.count("*").alias("tf"))
    found = counts.groupBy("term").agg(F.count("*").alias("df"))
    own = counts.join(found, "term").groupBy("id", "digest").agg(F.collect_list(F.struct("term", "tf", "df")).alias("terms"))

    @F.pandas_udf("array<struct<term:string,impact:double>>")
    def weighed(rows: pd.Series) -> pd.Series:
        return pd.Series([
            [{"term": t, "impact": x} for t, x in impacts([(r["term"], r["tf"], r["df"]) for r in own], n_items, mean)] for own in rows
        ])

    of = F.udf(length_class, "int")
    joined = items.alias("i").join(own.alias("o"), F.col("i.id").eqNullSafe(F.col("o.id")) & (F.col("i.digest") == F.col("o.digest")))
    return checkpointed(joined.select(
        "i.id", "i.text", "i.digest", of(F.size("i.words")).alias("class"), weighed("o.terms").alias("terms")
    ))


def index_parts(
    benchmark: DataFrame, key: str, text: str, threshold: float, overlap: float, max_bytes: int = MAX_INDEX_BYTES
) -> tuple[int, Iterator[list[Index]]]:
    """How many parts, and one after another the indexes of each: at most about ``max_bytes`` of text, by class."""
    items = weighed_items(benchmark, key, text)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / max_bytes))

    def part(p: int) -> list[Index]:
        rows = items.where(F.pmod(F.xxhash64("id", "digest"), F.lit(n)) == p).collect()
        by_class: dict[int, list] = {}
        for r in rows:
            by_class.setdefault(r["class"], []).append((r.id, r.text, [(t.term, t.impact) for t in r.terms]))
        return [Index(own, MIN_STRIDE << c, threshold, overlap) for c, own in sorted(by_class.items())]

    return n, map(part, range(n))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
    max_index_bytes: int = MAX_INDEX_BYTES,
) -> DataFrame:
    """(key, item_id, start word, score, question_overlap, answer_overlap) of the verified items of every text."""
    rows = docs.select(F.col(key).cast("long"), F.col(text))
    context = docs.sparkSession.sparkContext
    n, parts = index_parts(benchmark, item_key, item_text, threshold, overlap, max_index_bytes)
    result = None
    for indexes in parts:
        shared = _shared(context, indexes)

        def search(batches, shared=shared):
            own = cloudpickle.loads(shared.value)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = leaks(own, batch.column(1).to_pylist())
                out = [(i, *leak) for i, some in zip(ids, found) for leak in some]
                columns = list(zip(*out)) or [[]] * len(LEAKS_SCHEMA)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, LEAKS_SCHEMA)], schema=LEAKS_SCHEMA
                )

        part = rows.mapInArrow(search, LEAKS)
        # several parts are searched in jobs of their own, so that a task holds one index
        part = checkpointed(part) if n > 1 else part
        result = part if result is None else result.union(part)
    return result.withColumnRenamed("doc_id", key)


def _shared(context, indexes: list[Index]):
    """A broadcast that carries the class with it, so that executors need no copy of the package."""
    return context.broadcast(cloudpickle.dumps(indexes))


def _clean(shared):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        indexes = cloudpickle.loads(shared.value)
        for texts in batches:
            yield pd.Series([not own for own in leaks(indexes, list(texts))], dtype=bool)

    # it is costly, so it stays where it is written instead of moving below joins
    return clean.asNondeterministic()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
    max_index_bytes: int = MAX_INDEX_BYTES,
) -> DataFrame:
    """The rows of ``docs`` whose text holds no verified item."""
    context = docs.sparkSession.sparkContext
    n, parts = index_parts(benchmark, item_key, item_text, threshold, overlap, max_index_bytes)
    for indexes in parts:
        docs = docs.where(_clean(_shared(context, indexes))(F.col(text)))
        docs = checkpointed(docs) if n > 1 else docs
    return docs
