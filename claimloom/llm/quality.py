"""Quality rules with thresholds that adapt to each language and source.

Two layers decide about a document:

* base rules with fixed meaning: fewer than ``min_words`` words, or more than
  ``max_repeat_percent`` of the words lie in a five-word window that occurs at
  least twice in the text;
* adaptive rules: for each feature a quantile sketch is built per (lang, source)
  over the documents, and a document is rejected when the feature lies outside the
  group's fence: its median -/+ the greatest of a small ``floor``, ``reach`` times its q75 - q25, ``upper`` times its
  q90 - median, and ``present`` times the first tenth of the documents that have any of it. Where nearly no
  document of a group has a feature (symbols, say), the first quantiles are zero, and those that do are judged by what is
  usual among them; where having it is the group's own style, the quantiles say so. Sketches merge, so a group with
  fewer than ``min_group`` documents takes the fence of its language, from its
  groups' merged sketches, and a language that small takes that of all documents.

A sketch counts values in buckets whose bounds grow by ``GROWTH``, so a quantile is right to one part in a hundred.
Counts add up in any order: sketches merge by sums, and the thresholds are the same however rows
are dealt and whatever is run again. A sketch has at most some hundred buckets a feature, whatever its group holds.

Everything is DataFrame functions. Thresholds are one small row per group, written once and joined on (lang, source):
by broadcast up to ``MAX_BROADCAST`` groups, beyond that by a join whose hot groups are dealt over ``SALTS`` keys.

Defined results: a null or blank text has no words and fails the base rules; null
languages and sources form groups of their own; repeated rows are judged each; an empty
table gives an empty result; texts of any length are read whole; columns pass through, of any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import SPACES, checkpointed, let, words_of

#: Ratio of a sketch bucket's bounds.
GROWTH = 1.02
#: Values below this count as zero.
LEAST = 1e-6
ZERO = -(1 << 20)
#: Groups whose thresholds (some 100 bytes each) go to the tasks by broadcast.
MAX_BROADCAST = 50_000
SALTS = 32
SYMBOLS = "#*$%&|<>"
WINDOW = 5
WORD = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Fence:
    """How far from the median of its group a feature may lie."""

    feature: str
    floor: float
    reach: float
    upper: float = 0.0
    present: float = 0.0
    lower: bool = False


#: Ratios per word, but for the mean word length (characters).
FENCES = (
    Fence("symbols_per_word", floor=0.1, reach=4.0, upper=3.0, present=0.5),
    Fence("shouts_per_word", floor=0.1, reach=4.0, upper=3.0, present=0.5),
    Fence("duplicate_lines_share", floor=0.25, reach=4.0, upper=3.0, present=8.0),
    Fence("word_length", floor=1.5, reach=12.0, lower=True),
)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeat_words(text: Column) -> Column:
    """Words in windows that occur at least twice in the text.

    Windows are compared by the chained 64-bit hash of their words. Only a text with a repeated window sorts them.
    """

    def windows(hashes):
        starts = F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))
        return F.transform(
            F.slice(hashes, F.lit(1), starts),
            lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]),
        )

    def covered(ranked):
        repeated = F.filter(
            ranked,
            lambda x, i: (x["h"] == F.get(ranked, i - 1)["h"]) | (x["h"] == F.get(ranked, i + 1)["h"]),
        )
        return F.aggregate(
            F.sort_array(F.transform(repeated, lambda x: x["at"])),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, p: F.struct(
                (p + WINDOW).alias("end"),
                (acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n"),
            ),
            lambda acc: acc["n"],
        )

    def count(found):
        ranked = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        some = F.size(found) > F.size(F.array_distinct(found))
        return F.when(some, let(ranked, covered)).otherwise(F.lit(0))

    hashes = F.transform(words_of(text), lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(windows(h), count)).cast("long")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(_without(x, SPACES)) > 0)
    return docs.select(
        "*",
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("n_words"),
        F.length(_without(body, SPACES)).cast("long").alias("word_chars"),
        (F.length(body) - F.length(_without(body, SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col(text)).alias("n_repeat_words"),
    )


def cheap_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the features that the adaptive fences judge (null where a text has no word)."""
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.regexp_count(body, F.lit(WORD))
    out = docs.withColumn("_n", F.nullif(n, F.lit(0)))
    distinct = let(F.split(body, "\n", -1), lambda x: F.size(F.array_distinct(x)) / F.size(x))
    return out.select(
        *docs.columns,
        ((F.length(body) - F.length(_without(body, SYMBOLS))) / F.col("_n")).alias("symbols_per_word"),
        ((F.length(body) - F.length(_without(body, "!"))) / F.col("_n")).alias("shouts_per_word"),
        F.when(
            F.col("_n").isNotNull(),
            1 - distinct,
        ).alias("duplicate_lines_share"),
        (F.length(_without(body, SPACES)) / F.col("_n")).alias("word_length"),
    )


def bucket_of(value: Column) -> Column:
    """The sketch bucket of a value that is not negative."""
    return F.when(value < LEAST, F.lit(ZERO)).otherwise(F.ceil(F.log(value) / F.lit(math.log(GROWTH)))).cast("int")


def value_of(bucket: Column) -> Column:
    """The middle of a bucket."""
    return F.when(bucket == ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(GROWTH), bucket) * F.lit(2 / (1 + GROWTH)))


def sketches(features: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """(keys, feature, bucket, n): one sketch per group and feature. Null values are not counted."""
    values = F.array(*[F.struct(F.lit(i).alias("feature"), bucket_of(F.col(x)).alias("bucket")) for i, x in enumerate(names)])
    rows = features.select(*keys, F.explode(values).alias("v")).select(*keys, "v.*").where("bucket is not null")
    return rows.groupBy(*keys, "feature", "bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser groups."""
    return sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], names: list[str], prefix: str) -> DataFrame:
    """Per group (keys, <prefix>n, and <prefix><feature> with its q25, q50, q75, q90, and the first tenth p10 of its values above zero, null without any)."""
    own = Window.partitionBy(*keys, "feature")
    reached = F.sum("n").over(own.orderBy("bucket"))
    none = F.coalesce(F.sum(F.when(F.col("bucket") == ZERO, F.col("n"))).over(own), F.lit(0))
    rows = sketch.select(*keys, "feature", "bucket", reached.alias("reached"), F.sum("n").over(own).alias("total"), none.alias("none"))
    at = lambda q: value_of(F.min(F.when(F.col("reached") >= q * F.col("total"), F.col("bucket")))).alias(f"q{int(100 * q)}")
    tenth = (F.col("bucket") != ZERO) & (F.col("reached") - F.col("none") >= 0.1 * (F.col("total") - F.col("none")))
    present = value_of(F.min(F.when(tenth, F.col("bucket")))).alias("p10")
    per_feature = rows.groupBy(*keys, "feature").agg(F.max("total").alias("total"), at(0.25), at(0.5), at(0.75), at(0.9), present)
    quarters = F.struct("q25", "q50", "q75", "q90", "p10")
    return per_feature.groupBy(*keys).agg(
        F.max("total").alias(f"{prefix}n"),
        *[F.max(F.when(F.col("feature") == i, quarters)).alias(f"{prefix}{x}") for i, x in enumerate(names)],
    )


def thresholds(docs: DataFrame, text: str = "text", min_group: int = 200, fences: tuple[Fence, ...] = FENCES) -> DataFrame:
    """One row per (lang, source): ``<feature>_low`` and ``<feature>_high``.

    Sketches are counted map-side per group and merged, so a source that holds a third of
    all rows costs no more than any other.
    """
    features = cheap_features(docs.select("lang", "source", text), text)
    names = [f.feature for f in fences]
    groups = checkpointed(sketches(features, names, ["lang", "source"]))
    known = docs.select("lang", "source").distinct()
    own = quantiles(groups, ["lang", "source"], names, "own_").withColumnsRenamed({"lang": "l", "source": "s"})
    up = quantiles(merged(groups, ["lang"]), ["lang"], names, "up_").withColumnRenamed("lang", "u")
    # one row
    overall = quantiles(merged(groups, []), [], names, "all_")
    wide = (
        known.join(own, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
        .join(up, F.col("lang").eqNullSafe(F.col("u")), "left").join(F.broadcast(overall))
    )
    columns = []
    for f in fences:
        taken = (
            F.when(F.col("own_n") >= min_group, F.col(f"own_{f.feature}"))
            .when(F.col("up_n") >= min_group, F.col(f"up_{f.feature}"))
            .otherwise(F.col(f"all_{f.feature}"))
        )
        width = F.greatest(
            F.lit(f.floor), F.lit(f.reach) * (taken["q75"] - taken["q25"]), F.lit(f.upper) * (taken["q90"] - taken["q50"]), F.lit(f.present) * taken["p10"])
        columns.append((taken["q50"] + width).alias(f"{f.feature}_high"))
        if f.lower:
            columns.append((taken["q50"] - width).alias(f"{f.feature}_low"))
    return wide.select("lang", "source", *columns)


def with_thresholds(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` (with _l and _s) and the thresholds of their group."""
    limits = checkpointed(limits.withColumnsRenamed({"lang": "_lang", "source": "_source"}))
    same = F.col("_l").eqNullSafe(F.col("_lang")) & F.col("_s").eqNullSafe(F.col("_source"))
    if limits.count() <= MAX_BROADCAST:
        return rows.join(F.broadcast(limits), same, "left")
    salted = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_part", F.pmod(F.xxhash64("_text"), F.lit(SALTS)).cast("int")).join(
        salted, same & (F.col("_part") == F.col("_salt")), "left"
    )


def judge(
    docs: DataFrame,
    text: str = "text",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    min_group: int = 200,
    fences: tuple[Fence, ...] = FENCES,
) -> DataFrame:
    """``docs`` with the base counts, base_failed, the features' fences and kept."""
    kept_columns = docs.columns
    limits = thresholds(docs, text, min_group, fences)
    counted = base_counts(docs.select(F.struct(*kept_columns).alias("row"), F.col(text).alias("_text"),
                                      F.col("lang").alias("_l"), F.col("source").alias("_s")), "_text")
    joined = with_thresholds(cheap_features(counted, "_text"), limits)
    base = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    outside = F.lit(False)
    for f in fences:
        outside = outside | F.coalesce(F.col(f.feature) > F.col(f"{f.feature}_high"), F.lit(False))
        if f.lower:
            outside = outside | F.coalesce(F.col(f.feature) < F.col(f"{f.feature}_low"), F.lit(False))
    return joined.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & ~outside).alias("kept"),
        *[f.feature for f in fences],
        *[f"{f.feature}_high" for f in fences],
    )


def quality_filter(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    return judge(docs, text, **options).where("kept").select("row.*")
