"""Removal of repeated line passages by overlapping three-line windows.

A window is three consecutive lines of one text, at least one of them with a word. The
windows of all documents are compared by 128 bits of hash; of each repeated window the
first occurrence, by (doc_id, position), stays, and every line that a later occurrence covers
is removed. Windows are judged on the input, not on what is left; a text of fewer than
three lines has none.

Counting aggregates map-side and the later occurrences come from an equi-join that
adaptive execution can split, so a license header found in a third of all documents is
one group row and many small join tasks. Positions are gathered per document only.

Defined results: null text has no lines and stays null; rows that share doc_id and text count
as one document (each gets the same result), rows that share only doc_id are ordered by
a hash of their text; null doc_id sorts first; an empty table gives an empty result; texts of any length
are read whole; other columns pass through, of any name but n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import SPACES, let

WINDOW = 3


def line_windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _version (of the text), at (first line, from 0) and the hashes a and b."""
    marked = F.transform(
        F.split(text, "\n", -1),
        lambda x: F.struct(
            F.xxhash64(x).alias("a"),
            F.xxhash64(F.lit(1), x).alias("b"),
            (F.length(F.translate(x, SPACES, "")) > 0).alias("word"),
        ),
    )

    def windows(lines):
        part = lambda i, k: F.get(lines, i + k)
        return F.transform(
            F.slice(lines, F.lit(1), F.greatest(F.size(lines) - (WINDOW - 1), F.lit(0))),
            lambda x, i: F.struct(
                F.xxhash64(x["a"], part(i, 1)["a"], part(i, 2)["a"]).alias("a"),
                F.xxhash64(x["b"], part(i, 1)["b"], part(i, 2)["b"]).alias("b"),
                (x["word"] | part(i, 1)["word"] | part(i, 2)["word"]).alias("word"),
            ),
        )

    found = docs.select(
        F.col(key).alias("_id"),
        F.xxhash64(text).alias("_version"),
        F.posexplode(let(marked, windows)).alias("at", "w"),
    )
    return found.where("w.word").select("_id", "_version", "at", "w.a", "w.b")


def covered_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _version and positions: where the later windows start, one row per document."""
    windows = line_windows(docs, key, text)
    first = (
        windows.groupBy("a", "b")
        .agg(
            F.min(F.struct("_id", "_version", "at")).alias("first"),
            F.count("*").alias("n"),
        )
        .where("n > 1")
        .drop("n")
    )
    later = windows.join(first, ["a", "b"]).where(
        ~F.struct("_id", "_version", "at").eqNullSafe(F.col("first"))
    )
    return later.groupBy("_id", "_version").agg(F.collect_set("at").alias("positions"))


def dedupe_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the covered lines removed from its text, plus n_lines and n_removed."""
    covered = covered_lines(docs, key, text)
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("own"), F.xxhash64(text).alias("v"))
    joined = named.join(covered, F.col("own").eqNullSafe(F.col("_id")) & (F.col("v") == F.col("_version")), "left")
    gone = F.flatten(F.transform("positions", lambda p: F.array(*[p + k for k in range(WINDOW)])))
    body = F.col("row")[text]
    lines = F.split(body, "\n", -1)
    # null where nothing is to go
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    changed = F.array_join(let(lines, lambda x: F.transform(kept, lambda i: F.get(x, i))), "\n")
    return joined.select(
        *[F.coalesce(changed, body).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size(kept), F.lit(0)).cast("long").alias("n_removed"),
    )
