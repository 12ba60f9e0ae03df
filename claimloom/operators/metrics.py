"""Evaluation: extraction metrics, connection density, fixture checks, retrieval expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extraction_metrics(expected: DataFrame, generated: DataFrame) -> DataFrame:
    """Per fixture: recall with equal type and support, recall and precision with equal support.

    Both sides: fixture_id, claim_type, support (array of span ids).
    """
    key = lambda df: df.select("fixture_id", "claim_type", F.array_join(F.array_sort("support"), ",").alias("key")).distinct()
    want, have = key(expected), key(generated)
    typed = want.join(have.withColumn("hit", F.lit(1)), ["fixture_id", "claim_type", "key"], "left")
    support = want.join(have.select("fixture_id", "key").distinct().withColumn("any", F.lit(1)), ["fixture_id", "key"], "left")
    back = have.join(want.select("fixture_id", "key").distinct().withColumn("right", F.lit(1)), ["fixture_id", "key"], "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(0)).cast("double"))
    return (
        typed.groupBy("fixture_id").agg(share("hit").alias("typed_recall"))
        .join(support.groupBy("fixture_id").agg(share("any").alias("support_recall")), "fixture_id", "full")
        .join(back.groupBy("fixture_id").agg(share("right").alias("support_precision")), "fixture_id", "full")
    )


def nearby_recall(expected: DataFrame, generated: DataFrame) -> DataFrame:
    """Per fixture the share of expected claims for which one of their type with overlapping support was generated."""
    e = expected.select("fixture_id", "claim_type", F.array_sort(F.array_distinct("support")).alias("support")).distinct()
    key = ["fixture_id", "claim_type", "span"]
    have = generated.select("fixture_id", "claim_type", F.explode("support").alias("span")).distinct().withColumn("hit", F.lit(1))
    hits = e.select("*", F.explode("support").alias("span")).join(have, key, "left").groupBy("fixture_id", "claim_type", "support").agg(F.max("hit").alias("hit"))
    return hits.groupBy("fixture_id").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("nearby_recall"))


def connection_histogram(connections: DataFrame, components: list[str]) -> DataFrame:
    """Per connection type: number, mean confidence and mean of each score component."""
    return connections.groupBy("connection_type").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), *[F.avg(c).alias(f"mean_{c}") for c in components])


def connection_density(sizes: DataFrame, connections: DataFrame, key: str) -> DataFrame:
    """Per group: possible pairs, connections, density and mean confidence."""
    found = connections.groupBy(key).agg(F.count("*").alias("n_connections"), F.avg("confidence").alias("mean_confidence"))
    rows = sizes.join(found, key, "left").withColumn("n_connections", F.coalesce("n_connections", F.lit(0)))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return rows.select(
        key, pairs.alias("n_pairs"), "n_connections",
        F.when(pairs > 0, F.col("n_connections") / pairs).otherwise(F.lit(0.0)).alias("density"), "mean_confidence",
    )


def fixture_problems(spans: DataFrame, items: DataFrame) -> DataFrame:
    """Repeated span ids, bad line ranges and missing support (fixture_id, span_id, first_line, last_line, n_lines; support)."""
    again = spans.groupBy("fixture_id", "span_id").count().where("count > 1").select("fixture_id", F.lit("duplicate_span").alias("code"))
    bad = spans.where("first_line < 1 or last_line < first_line or last_line > n_lines").select("fixture_id", F.lit("bad_range"))
    cited = items.select("fixture_id", F.explode("support").alias("span_id"))
    lost = cited.join(spans.select("fixture_id", "span_id"), ["fixture_id", "span_id"], "left_anti").select("fixture_id", F.lit("missing_support"))
    return again.union(bad).union(lost).distinct()


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with the count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def retrieval_expectations(cases: DataFrame, results: DataFrame) -> DataFrame:
    """case_id, n_returned, n_missing, n_forbidden, passed of cases (expected, forbidden arrays, least) and results (case_id, claim_id)."""
    got = results.groupBy("case_id").agg(F.collect_set("claim_id").alias("got"))
    rows = cases.join(got, "case_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    rows = rows.select(
        "case_id", F.size("got").alias("n_returned"), F.size(F.array_except("expected", "got")).alias("n_missing"),
        F.size(F.array_intersect("forbidden", "got")).alias("n_forbidden"), "least",
    )
    return rows.withColumn("passed", (F.col("n_missing") == 0) & (F.col("n_forbidden") == 0) & (F.col("n_returned") >= F.col("least")))
