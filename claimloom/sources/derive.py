"""Claims, evidence, review events and a ledger derived from the driver's tables.

The views have SQL twins in ``plans.views``. Claims are groups of twelve spans; with
that they exercise what the operators mean and how they scale, not extraction quality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.text import let, normalize_text, words_array
from claimloom.operators.evidence import line_texts, numbered_spans, sources

# The ten claim types.
CLAIM_TYPES = ["fact", "user_signal", "reported_decision", "strategic_statement", "risk", "dependency", "constraint",
               "metric", "scope_statement", "ownership_statement"]
SPANS_PER_CLAIM, MAX_CLAIMS, MAX_STATEMENT = 12, 30, 2000
#: Documents whose ids go to every task when others are to be left out.
MAX_NAMED = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(spark: SparkSession, sf_dir: str, only: DataFrame | None) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents if only is None else documents.join(only, "doc_id", "left_semi")


def spans(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """source_version_id, doc_id, line, span_no (from 0), start_char, end_char, text of all documents, or of those in ``only`` (doc_id)."""
    return numbered_spans(sources(_named(spark, sf_dir, only))).withColumn(
        "doc_id", F.expr("cast(substring(source_version_id, 6) as bigint)")
    ).withColumn("span_id", F.concat_ws("_", F.lit("ev"), "doc_id", "line"))


def fallback_claims(documents: DataFrame, whole: bool = False) -> DataFrame:
    """Model-free claims of documents (doc_id, text, ...) as rows of those: part (from 0), statement, evidence (span ids in order), texts (the spans' own).

    A document's lines become its claims in place: no row leaves its task. ``whole``: all claims of a document with all their text, not the
    first MAX_CLAIMS with MAX_STATEMENT characters.
    """
    n = SPANS_PER_CLAIM
    last = lambda found: F.greatest(F.size(found) - 1, F.lit(0)) / n if whole else F.lit(MAX_CLAIMS - 1)
    parts = lambda found: F.transform(
        F.filter(F.sequence(F.lit(0), last(found).cast("int")), lambda p: p * n < F.size(found)), lambda p: F.slice(found, p * n + 1, n)
    )
    rows = documents.where(F.col("text").isNotNull()).select(
        *[c for c in documents.columns if c != "text"], F.posexplode_outer(let(line_texts(normalize_text(F.col("text"))), parts)).alias("part", "s")
    ).where("s is not null")
    statement = F.concat_ws("\n\n", F.transform("s", lambda x: x["text"]))
    return rows.select(
        *[c for c in rows.columns if c not in ("part", "s")],
        F.col("part").cast("long").alias("part"),
        (statement if whole else F.substring(statement, 1, MAX_STATEMENT)).alias("statement"),
        F.transform("s", lambda x: F.concat_ws("_", F.lit("ev"), F.col("doc_id"), x["line"])).alias("evidence"),
        F.transform("s", lambda x: x["text"]).alias("texts"),
    )


def claims(spark: SparkSession, sf_dir: str, texts: bool = False, only: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """claim_id, doc_id, part, statement, evidence, claim_type, epistemic, source, lang (and the texts of the evidence), of the documents in ``only``, if given.

    ``whole``: without the limits on claims of a document and characters of a statement.
    """
    made = fallback_claims(_named(spark, sf_dir, only).where(F.col("doc_id").isNotNull()).select("doc_id", "text", "source", "lang"), whole)
    kind = F.element_at(words_array(CLAIM_TYPES), F.pmod("doc_id", F.lit(10)).cast("int") + 1)
    return made.select(
        F.concat_ws("_", F.lit("mem"), "doc_id", "part").alias("claim_id"),
        "doc_id", "part", "statement", "evidence", kind.alias("claim_type"), F.lit("reported").alias("epistemic"),
        "source", "lang", *["texts"] * texts,
    )


def documents_of(claim_ids: DataFrame) -> DataFrame:
    """The documents (doc_id) of claims (claim_id), once each; few of them go to every task, so that no document is shuffled to meet them."""
    ids = claim_ids.select(F.split("claim_id", "_")[1].cast("long").alias("doc_id")).distinct()
    return F.broadcast(ids) if ids.count() <= MAX_NAMED else ids


def evidence_texts(found: DataFrame) -> DataFrame:
    """claim_id, position, text of claims that carry their texts."""
    return found.select("claim_id", F.posexplode("texts").alias("position", "text"))


def claim_evidence(found: DataFrame) -> DataFrame:
    return found.select("claim_id", F.posexplode("evidence").alias("position", "span_id"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a ledger: event_id, ts, user_id, event_type, k (from props), idempotency_key."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        "event_id", "ts", "user_id", "event_type", "value", k.alias("k"),
        F.concat_ws("|", "user_id", "event_type", k).alias("idempotency_key"),
    )


def review_events(events: DataFrame, n_docs: int) -> DataFrame:
    """Ledger events as reviews of the first claim of document user_id mod ``n_docs``."""
    kind = (
        F.when(F.col("event_type") == "purchase", F.lit("confirm"))
        .when(F.col("event_type") == "click", F.lit("edit"))
        .when(F.col("event_type") == "error", F.lit("remove"))
    )
    return events.select(
        "event_id", "ts",
        F.concat(F.lit("mem_"), F.pmod("user_id", F.lit(n_docs)).cast("string"), F.lit("_0")).alias("claim_id"),
        kind.alias("review"),
    ).where("review is not null")
