import random

from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.operators import evidence as E
from claimloom.operators import sections as S


def test_spans_give_their_text(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(["word.", "more", "text!"]) for _ in range(9000))
    docs = [(1, " a\r\n\r\n  b é日 \rc  "), (2, long), (3, "x" * 5000), (4, None), (5, "  \n "), (6, "word " * 2000)]
    versions = E.sources(spark.createDataFrame(docs, "doc_id long, text string"))
    spans = E.evidence_spans(versions, 500)
    assert E.span_violations(spans, versions).count() == 0
    rows = spans.collect()
    assert [r.text for r in sorted(rows, key=lambda r: r.line) if r.source_version_id == "srcv_1"] == ["a", "b é日", "c"]
    assert all(0 < len(r.text) <= 500 and r.text == r.text.strip() for r in rows)
    assert sum(r.source_version_id == "srcv_2" for r in rows) > 20
    assert {r.source_version_id for r in rows} == {"srcv_1", "srcv_2", "srcv_3", "srcv_6"}


def test_split_prefers_sentences_then_spaces():
    assert E.split_ranges("a" * 30 + ". " + "b" * 40, 50) == [(0, 31), (32, 72)]
    assert E.split_ranges("a" * 40 + " " + "b" * 40, 50) == [(0, 40), (41, 81)]
    assert E.split_ranges("c" * 120, 50) == [(0, 50), (50, 100), (100, 120)]


def test_attachments(spark):
    rows = [(1, i, f"f{i}", n, 6 << 20, u) for i, (n, u) in enumerate(
        [("a.pdf", "u"), ("b.txt", "u"), ("c.docx", None), ("d.PDF", "u"), ("e.pdf", "u"), ("f.pdf", "u"), ("g.pdf", "u")])]
    df = spark.createDataFrame(rows, "message_id long, position int, file_id string, name string, size long, url string").select(
        "*", *[F.lit(None).cast("string").alias(c) for c in ("mime", "filetype", "mode")], F.lit(False).alias("external"))
    got = {r.file_id: r.verdict for r in E.route_attachments(df).collect()}
    assert got == {"f0": "supported", "f1": "unsupported_media", "f2": "missing_download_url", "f3": "supported",
                   "f4": "supported", "f5": "supported", "f6": "size_limit"}
    assert E.validate_attachment_batch(df).first().problem == "too_many"


def test_versions(spark):
    items = spark.createDataFrame([("a", "h1", 1), ("a", "h2", 2), ("a", "h1", 3), ("b", "h9", 1)], "item_id string, content_hash string, arrived long")
    old = spark.createDataFrame([("a", "h2", 4)], "item_id string, content_hash string, version long")
    got = {(r.item_id, r.content_hash): r.version for r in E.version_sources(items, old).collect()}
    assert got == {("a", "h1"): 5, ("b", "h9"): 1}


def test_text_functions(spark):
    df = spark.createDataFrame([("Bearer abc?token=x&y PAY-12 pay-12 sk" + "a" * 20,)], "t string")
    r = df.select(T.issue_tickets(F.col("t")).alias("tickets"), T.redact_secrets(F.col("t")).alias("safe"),
                  T.normalize_statement(F.lit("Ｆｕｌｌ, Width!")).alias("n"), T.is_generic_entity(F.lit("the two")).alias("g"),
                  T.is_generic_entity(F.lit("api")).alias("a"), T.query_tokens(F.lit("What is the Plan for plan B1 now?")).alias("q")).first()
    assert r.tickets == ["PAY-12"] and "abc" not in r.safe and "aaaa" not in r.safe
    assert r.n == "full width" and r.g and not r.a and r.q == ["plan", "now"]


def test_sections_cover_all_spans(spark):
    text = "\n".join(["# Part"] + [f"Line {i} " + "x" * (i * 37 % 400) + "." for i in range(150)])
    versions = E.sources(spark.createDataFrame([(1, text), (2, "short"), (3, "y" * 9000)], "doc_id long, text string"))
    spans = E.line_spans(versions).withColumn("span_no", F.row_number().over(
        __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("source_version_id").orderBy("line")) - 1)
    plan = S.section_plan(spans)
    assert S.plan_issues(plan, spans).count() == 0
    rows = [r for r in plan.orderBy("section").collect() if r.source_version_id == "srcv_1"]
    assert len(rows) > 3 and all(r.n_chars <= 8000 for r in rows) and rows[0].title == "Part"
    assert S.spans_for_section(plan, spans).count() == spans.count()
    broken = plan.where("section <> 2")
    assert {r.code for r in S.plan_issues(broken, spans).collect()} == {"gap"}
