"""Sections of long documents: decision, plan, validation, subdivision, consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import is_likely_heading, normalize_statement, section_title

MIN_CHARS, MIN_SPANS = 6000, 20
TARGET, MOST, MAX_SECTIONS, MAX_DEPTH = 5000, 8000, 50, 3


def sectioning_decision(spans: DataFrame, chars: int = MIN_CHARS, count: int = MIN_SPANS) -> DataFrame:
    stats = spans.groupBy("source_version_id").agg(F.max("end_char").alias("n_chars"), F.count("*").alias("n_spans"))
    reasons = F.array_compact(F.array(
        F.when(F.col("n_chars") >= chars, F.lit("chars")), F.when(F.col("n_spans") >= count, F.lit("spans"))
    ))
    return stats.select("*", (F.size(reasons) > 0).alias("needed"), F.array_join(reasons, ",").alias("reasons"))


def section_of_spans(spans: DataFrame, target: int = TARGET, most: int = MOST) -> DataFrame:
    """``spans`` with section (from 1): a greedy walk per document.

    A section ends when it reaches the target, before a likely heading from half the target on, or before
    it would exceed the limit. The walk is a fold over one document's spans.
    """
    item = F.struct("span_no", "start_char", "end_char", is_likely_heading(F.col("text")).alias("heading"))
    documents = spans.groupBy("source_version_id").agg(F.array_sort(F.collect_list(item)).alias("spans"))
    half = target // 2

    def step(acc, s):
        reach = s["end_char"] - acc["start"]
        had = acc["end"] - acc["start"]
        new = (acc["section"] == 0) | (reach > most) | (had >= target) | (s["heading"] & (acc["size"] > 1) & (had >= half))
        section = acc["section"] + new.cast("int")
        return F.struct(
            section.alias("section"),
            F.when(new, s["start_char"]).otherwise(acc["start"]).alias("start"),
            s["end_char"].alias("end"),
            F.when(new, F.lit(1)).otherwise(acc["size"] + 1).alias("size"),
            F.array_append(acc["out"], section).alias("out"),
        )

    start = F.struct(
        F.lit(0).alias("section"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"),
        F.lit(0).alias("size"), F.array().cast("array<int>").alias("out"),
    )
    numbered = documents.select(
        "source_version_id", F.arrays_zip(
            F.transform("spans", lambda s: s["span_no"]).alias("span_no"),
            F.aggregate("spans", start, step, lambda acc: acc["out"]).alias("section"),
        ).alias("z"),
    )
    return numbered.select("source_version_id", F.inline("z"))


def section_plan(spans: DataFrame, target: int = TARGET, most: int = MOST, max_sections: int = MAX_SECTIONS) -> DataFrame:
    """One row per section: first and last span, size and title; ``too_many`` marks failed plans."""
    placed = section_of_spans(spans, target, most).join(spans, ["source_version_id", "span_no"])
    plan = placed.groupBy("source_version_id", "section").agg(
        F.min("span_no").alias("first_span"), F.max("span_no").alias("last_span"),
        (F.max("end_char") - F.min("start_char")).alias("n_chars"),
        F.min_by("text", "span_no").alias("head"),
    )
    total = Window.partitionBy("source_version_id")
    return plan.select(
        "source_version_id", "section", "first_span", "last_span", "n_chars",
        section_title(F.col("head"), F.col("section")).alias("title"),
        (F.max("section").over(total) > max_sections).alias("too_many"),
    )


def plan_issues(plan: DataFrame, spans: DataFrame, most: int = MOST, max_sections: int = MAX_SECTIONS) -> DataFrame:
    """Problems of a plan (source_version_id, section, first_span, last_span): gaps, overlaps and the like."""
    size = spans.groupBy("source_version_id").agg(F.count("*").alias("n_spans"))
    bounds = spans.select("source_version_id", "span_no", "start_char", "end_char")
    first = bounds.select("source_version_id", F.col("span_no").alias("first_span"), F.col("start_char").alias("from_char"))
    last = bounds.select("source_version_id", F.col("span_no").alias("last_span"), F.col("end_char").alias("to_char"))
    order = Window.partitionBy("source_version_id").orderBy("section")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        plan.join(first, ["source_version_id", "first_span"], "left").join(last, ["source_version_id", "last_span"], "left")
        .join(size, "source_version_id")
        .withColumn("expected", F.coalesce(F.max(F.col("last_span") + 1).over(before), F.lit(0)))
        .withColumn("final", F.lead("section").over(order).isNull())
    )
    codes = F.array_compact(F.array(
        F.when(F.col("from_char").isNull() | F.col("to_char").isNull(), F.lit("unknown_span")),
        F.when(F.col("last_span") < F.col("first_span"), F.lit("out_of_order")),
        F.when(F.col("first_span") < F.col("expected"), F.lit("overlap")),
        F.when(F.col("first_span") > F.col("expected"), F.lit("gap")),
        F.when((F.col("to_char") - F.col("from_char") > most) & (F.col("last_span") > F.col("first_span")), F.lit("oversized")),
        F.when(F.col("section") > max_sections, F.lit("too_many_sections")),
        F.when(F.col("final") & (F.col("last_span") + 1 < F.col("n_spans")), F.lit("tail_not_covered")),
    ))
    return rows.select("source_version_id", "section", F.explode(codes).alias("code"))


def spans_for_section(plan: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans with the section that holds them: an equi-join on the version with a range condition."""
    return plan.select("source_version_id", "section", "first_span", "last_span").join(spans, "source_version_id").where(
        F.col("span_no").between(F.col("first_span"), F.col("last_span"))
    ).select("source_version_id", "section", "span_no")


def subdivide(spans: DataFrame, key: list[str]) -> DataFrame:
    """For each group of spans the first span of its second half: the cut nearest to half its characters."""
    group = Window.partitionBy(*key)
    order = group.orderBy("span_no")
    rows = spans.select(
        *key, "span_no", (F.lag("end_char").over(order) - F.min("start_char").over(group)).alias("left_chars"),
        (F.max("end_char").over(group) - F.min("start_char").over(group)).alias("total"),
    ).where("left_chars is not null")
    return rows.groupBy(*key).agg(
        F.min_by("span_no", F.struct(F.abs(F.col("total") / 2 - F.col("left_chars")), "span_no")).alias("split_at")
    )


def subdivide_saturated(spans: DataFrame, key: list[str], saturated, max_depth: int = 3) -> DataFrame:
    """``spans`` with a column ``path``: groups that are saturated are cut in two, and their halves again, at most ``max_depth`` times.

    ``saturated`` says of a group's number of spans and characters (columns) whether it must be cut; a single span never is. A path has a 0 for each first half
    and a 1 for each second one, so paths sort in the order of the text. Groups are brought together once: each depth is windows inside them.
    """
    rows, at = spans.repartition(*key).withColumn("path", F.lit("")), [*key, "path"]
    group = Window.partitionBy(*at)
    order = group.orderBy("span_no")
    for _ in range(max_depth):
        rows = rows.withColumns({
            "_left": F.lag("end_char").over(order) - F.min("start_char").over(group), "_chars": F.max("end_char").over(group) - F.min("start_char").over(group), "_n": F.count("*").over(group),
        })
        place = F.struct(F.abs(F.col("_chars") / 2 - F.col("_left")), "span_no")
        cut = F.min_by("span_no", F.when(F.col("_left").isNotNull(), place)).over(group)
        rows = rows.withColumn("_cut", F.when((F.col("_n") > 1) & saturated(F.col("_n"), F.col("_chars")), cut))
        side = F.when(F.col("span_no") < F.col("_cut"), F.lit("0")).otherwise(F.lit("1"))
        rows = rows.withColumn("path", F.when(F.col("_cut").isNull(), F.col("path")).otherwise(F.concat("path", side))).drop("_left", "_chars", "_n", "_cut")
    return rows


def candidate_strength(verification: Column, epistemic: Column, n_evidence: Column, review: Column) -> Column:
    checked = F.when(verification == "verified", 40).when(verification == "corrected", 35).otherwise(10)
    known = F.when(epistemic == "observed", 8).when(epistemic == "decision_reported", 7).otherwise(5)
    return checked + known + F.least(n_evidence, F.lit(12)) - F.when(review, 20).otherwise(0)


def consolidate(candidates: DataFrame, most_evidence: int = 12) -> DataFrame:
    """One claim per normalized statement: the strongest, with the union of evidence.

    ``candidates``: scope, ordinal, statement, verification, epistemic, evidence (array), review_required. Statements meet by the
    SHA-256 of their normal form (``norm_sha256``), so that texts are shuffled once a group and part, and not with each span.
    """
    strength = candidate_strength(
        F.col("verification"), F.col("epistemic"), F.size("evidence"), F.col("review_required")
    )
    rows = candidates.withColumn("norm", normalize_statement(F.col("statement"))).withColumn("strength", strength)
    rows = rows.withColumn("norm_sha256", F.sha2("norm", 256))
    claims = rows.groupBy("scope", "norm_sha256").agg(
        F.first("norm").alias("norm"),
        F.max_by("statement", F.struct("strength", -F.col("ordinal"))).alias("statement"),
        F.bool_and("review_required").alias("review_required"),
        (F.count("*") - 1).alias("n_duplicates"),
    )
    # Only the spans that are kept are gathered, however many candidates say the same.
    spans = rows.select("scope", "norm_sha256", "ordinal", F.posexplode("evidence").alias("position", "id"))
    once = spans.groupBy("scope", "norm_sha256", "id").agg(F.min(F.struct("ordinal", "position")).alias("at"))
    order = Window.partitionBy("scope", "norm_sha256").orderBy("at", "id")
    kept = once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most_evidence).groupBy(F.col("scope").alias("_s"), F.col("norm_sha256").alias("_t")).agg(
        F.array_sort(F.collect_list(F.struct("n", "id"))).alias("kept"))
    joined = claims.join(kept, F.col("scope").eqNullSafe(F.col("_s")) & F.col("norm_sha256").eqNullSafe(F.col("_t")), "left")
    none = F.array().cast(rows.schema["evidence"].dataType)
    return joined.select(
        "scope", "norm_sha256", "norm", "statement", F.coalesce(F.transform("kept", lambda x: x["id"]), none).alias("evidence"), "review_required", "n_duplicates")


def section_progress(sections: DataFrame) -> DataFrame:
    """Counts by status and a phase per plan (plan_id, section, status)."""
    counts = sections.groupBy("plan_id").agg(
        F.count("*").alias("n_sections"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("completed", "failed", "running")],
        F.min(F.when(F.col("status") != "completed", F.col("section"))).alias("current_section"),
    )
    phase = (
        F.when(F.col("n_failed") > 0, F.lit("failed"))
        .when(F.col("n_completed") == F.col("n_sections"), F.lit("completed"))
        .when(F.col("n_running") + F.col("n_completed") > 0, F.lit("extracting"))
        .otherwise(F.lit("planned"))
    )
    return counts.withColumn("phase", phase).withColumn("gate_open", F.col("n_completed") == F.col("n_sections"))


def commit_plans(plans: DataFrame) -> DataFrame:
    """The first plan of each version."""
    first = Window.partitionBy("source_version_id").orderBy("created_at", "plan_id")
    return plans.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def chunked(rows: DataFrame, key: list[str], order: list[str], size: int = 30) -> DataFrame:
    """``rows`` with the number (from 0) of their chunk of ``size`` in order."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("chunk", F.floor((place - 1) / size).cast("int"))


def completed_plans(plans: DataFrame, committed: DataFrame) -> DataFrame:
    """Plans (plan_id, proposal_id) all of whose proposals are committed."""
    done = committed.select("proposal_id").distinct().withColumn("_done", F.lit(True))
    state = plans.join(done, "proposal_id", "left").groupBy("plan_id").agg(F.bool_and(F.col("_done").isNotNull()).alias("completed"))
    return state


def bounds_outside(plans: DataFrame, spans: DataFrame) -> DataFrame:
    """Plans whose first or last span (by id) is not one of their version."""
    own = spans.select("source_version_id", "span_id")
    ends = plans.select("plan_id", "source_version_id", F.explode(F.array("first_id", "last_id")).alias("span_id"))
    return ends.join(own, ["source_version_id", "span_id"], "left_anti").select("plan_id", F.lit("bound_outside_version").alias("code")).distinct()
