"""The registered queries of the corpus operators, with their SQL where it exists.

Each query applies one operator to its whole table and derives the digest columns that
are compared from the operator's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import (
    decontaminate, html, lines, negatives, neighbours, packing, quality, sharding, simhash, sql, substrings, suffixes, urls, whitening,
)
from claimloom.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return sharded.select("doc_id", "shard", "shard_depth", "row_bytes")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lines.dedupe_lines(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeated_windows(table(spark, sf_dir, "documents"), with_text=False)
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
    return pieces.drop("ids")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"), with_text=False)
    return kept.select(
        "doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), "kept_sha256"
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select(
        "doc_id", "item_id", "start", F.round("score", 6).alias("score"),
        F.round("question_overlap", 6).alias("question_overlap"), F.round("answer_overlap", 6).alias("answer_overlap"),
    )


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fit_whitening(rows, components=4)
    flat = whitening.whiten(rows, model).select("row.vec_id", "deviation", F.posexplode("whitened").alias("component", "whitened"))
    explained = F.lit([float(v / model.trace) if model.trace else None for v in model.values] if model else [None])
    return flat.select(
        "vec_id", (F.col("component") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation",
        "whitened", F.get(explained, "component").cast("double").alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), lambda key: key % 50 == 0)


def op13_near_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_neighbours(table(spark, sf_dir, "embeddings"), lambda key: key % 20 == 0)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sharding": op2_sharding,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_packing": op6_packing,
    "op7_url_filters": op7_url_filters,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_html_extraction": op10_html_extraction,
    "op11_whitening": op11_whitening,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_near_neighbours": op13_near_neighbours,
}

SQL: dict[str, str] = {
    "op2_sharding": sql.SHARDING,
    "op3_line_dedup": sql.LINES,
    "op5_substring_dedup": sql.SUBSTRINGS,
    "op8_suffix_dedup": sql.SUFFIXES,
    "op12_hard_negatives": sql.NEGATIVES,
}
