"""Repeated token and byte windows against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import types as T

from claimloom.llm.substrings import remove_repeated_windows
from claimloom.llm.suffixes import remove_repeated_bytes

SCHEMA = "doc_id long, text string, block string, doc string"


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = ["a", "bb", "ccc", "é", "日本", "wörd", "x" * 30]
    passages = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(vocabulary + [str(rng.random())], k=rng.randint(0, 40))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice([*passages, "", "a " * 50]))
        rows.append((i, rng.choice([" ", "\n", "\t\t"]).join(parts)))
    rows += [(n + 1, rows[3][1]), (n + 2, rows[3][1]), (n + 3, None), (n + 4, ""), (n + 5, "one two"), (n + 6, " \n\t")]
    rows += [(n + 7, "ab" * 400), (n + 8, "zz" * 400), (None, rows[4][1]), (n + 9, "q " * 5000)]
    rng.shuffle(rows)
    return [(a, b, "x", "y") for a, b in rows]


def brute_words(rows, width):
    docs = sorted(((-1 if i is None else i, (t or "").encode().split()) for i, t, *_ in rows))
    seen, out = {}, {}
    for d, words in docs:
        for p in range(len(words) - width + 1):
            seen.setdefault(tuple(words[p : p + width]), (d, p))
    for d, words in docs:
        gone = set()
        for p in range(len(words) - width + 1):
            if seen[tuple(words[p : p + width])] != (d, p):
                gone.update(range(p, p + width))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[d] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def brute_bytes(rows, depth):
    docs = sorted(((-1 if i is None else i, (t or "").encode()) for i, t, *_ in rows))
    seen, out = {}, {}
    for d, body in docs:
        for p in range(len(body) - depth + 1):
            seen.setdefault(body[p : p + depth], d)
    for d, body in docs:
        gone = set()
        for p in range(len(body) - depth + 1):
            if seen[body[p : p + depth]] < d:
                gone.update(range(p, p + depth))
        spans = sum(1 for g in gone if g - 1 not in gone)
        kept = bytes(c for i, c in enumerate(body) if i not in gone)
        out[d] = (len(body), len(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("width,block_bytes,fan_in", [(20, 1 << 20, 4096), (20, 2000, 3), (3, 500, 2)])
def test_words_match_brute_force(spark, width, block_bytes, fan_in):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = remove_repeated_windows(df, width=width, block_bytes=block_bytes, per_bucket=500, fan_in=fan_in).collect()
    found = {(-1 if r.doc_id is None else r.doc_id): (r.n_words, r.n_removed, r.kept_sha256) for r in got}
    assert len(got) == len(rows)
    assert found == brute_words(rows, width)
    for r in got:
        assert sum(b - a for a, b in zip(r.starts, r.ends)) == r.n_removed
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("depth,block_bytes,fan_in", [(50, 1 << 20, 4096), (50, 2000, 3), (12, 700, 2)])
def test_bytes_match_brute_force(spark, depth, block_bytes, fan_in):
    rows = corpus(6)
    df = spark.createDataFrame(rows, SCHEMA)
    got = remove_repeated_bytes(df, depth=depth, block_bytes=block_bytes, per_bucket=300, fan_in=fan_in).collect()
    found = {
        (-1 if r.doc_id is None else r.doc_id): (r.n_bytes, r.n_removed, len(r.starts), r.kept_sha256) for r in got
    }
    assert len(got) == len(rows)
    assert found == brute_bytes(rows, depth)


@pytest.mark.parametrize("operator", [remove_repeated_windows, remove_repeated_bytes])
def test_empty_and_repeated_rows(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (1, text + " more"), (2, text)], "doc_id long, text string")
    got = operator(df).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 1, 2]
    assert next(r for r in got if r.doc_id == 2).n_removed >= 40
    assert isinstance(operator(df).schema["doc_id"].dataType, T.LongType)


def test_words_that_differ_are_kept(spark):
    """A Thue-Morse word and its complement have the same polynomial modulo 2**64, whatever its base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    rest = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeated_windows(df).collect()} == {1: 0, 2: 0, 3: 20}


def test_many_equal_rows(spark):
    """100,000 copies of one row are one entry of a block; the longest group stays small."""
    from pyspark.sql import functions as F

    from claimloom.llm import blocks as B

    text = " ".join(f"w{i}" for i in range(30))
    copies = spark.range(0, 100_000, 1, 8).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    others = spark.createDataFrame([(8, text + " and more"), (6, "short"), (6, "short"), (None, None), (None, None)], "doc_id long, text string")
    df = copies.union(others)
    once, _ = B.parted(df, "doc_id", "text")
    rows, _, _ = B.dealt(once, "doc_id", "text", 1 << 20)
    assert rows.count() == 4
    got = remove_repeated_windows(df).groupBy("doc_id", "n_words", "n_removed", "kept_sha256").count().collect()
    empty, whole = hashlib.sha256(b"").hexdigest(), hashlib.sha256(text.encode()).hexdigest()
    assert {tuple(r) for r in got} == {
        (7, 30, 0, whole, 1), (7, 30, 30, empty, 99_999), (8, 32, 30, hashlib.sha256(b"and more").hexdigest(), 1),
        (6, 1, 0, hashlib.sha256(b"short").hexdigest(), 2), (None, 0, 0, empty, 2),
    }
    got = remove_repeated_bytes(df).groupBy("doc_id", "n_bytes", "n_removed", "kept_sha256").count().collect()
    n = len(text)
    assert {tuple(r) for r in got} == {
        (7, n, 0, whole, 100_000), (8, n + 9, n, hashlib.sha256(b" and more").hexdigest(), 1),
        (6, 5, 0, hashlib.sha256(b"short").hexdigest(), 2), (None, 0, 0, empty, 2),
    }


def test_order_of_rows_of_one_key(spark):
    """Which of two rows of one doc_id comes first does not depend on blocks or partitions."""
    shared = " ".join(f"s{i}" for i in range(25))
    rows = [(1, f"{shared} x{i} " + " ".join(f"y{i}{k}" for k in range(60))) for i in range(12)]
    results = []
    for partitions, size in ((4, 1 << 20), (7, 1000), (3, 300)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
        results.append(sorted(tuple(r) for r in remove_repeated_windows(df, block_bytes=size).collect()))
    assert results[0] == results[1] == results[2]
    assert sum(r[2] == 0 for r in results[0]) == 1
