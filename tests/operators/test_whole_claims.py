"""Queries that read all claims of a document and all of a statement's text: no limit on either."""

import duckdb
import pytest

import __spark_entry__

LINES = 400


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One document of 34 claims, a copy of its last lines, and one whose lines make a statement of more than 2,000 characters."""
    found = tmp_path_factory.mktemp("whole")
    long = [f"line {n} speaks of matter{n} and of subject{n // 12}" for n in range(LINES)]
    wide = [f"wide{n} " + " ".join(f"word{n}x{k}" for k in range(60)) for n in range(12)]
    rows = [(1, "\n".join(long), "en", "src1", 0), (2, "\n".join(long[384:396]), "en", "src1", 0), (3, "\n".join(wide), "en", "src2", 0), (4, "\n".join(wide[:-1] + ["other end"]), "en", "src2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{found}/documents.parquet")
    asked = [(7, "Which line speaks of matter399?"), (8, "What is word11x59?")]
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(f"{found}/benchmark.parquet")
    return str(found)


def twin(folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    return columns, sorted(str(tuple(zip(columns, r, strict=True))) for r in found.fetchall())


@pytest.mark.parametrize("name", ["cited_answers", "claim_details", "connection_histograms"])
def test_query_equals_its_sql_over_long_documents(spark, folder, name):
    columns, want = twin(folder, name)
    got = __spark_entry__.queries()[name](spark, folder).select(*columns).collect()
    assert sorted(str(tuple(zip(columns, r, strict=True))) for r in got) == want


def test_all_claims_and_all_their_text_count(spark, folder):
    details = {r.claim_id: r for r in __spark_entry__.queries()["claim_details"](spark, folder).collect()}
    assert len(details) == -(-LINES // 12) + 3 and details["mem_1_33"].n_spans == LINES % 12
    assert "mem_1_32" in details["mem_2_0"].neighbours.split(",")  # equal lines beyond the first 30 claims
    kinds = {r.connection_type: r for r in __spark_entry__.queries()["connection_histograms"](spark, folder).collect()}
    assert kinds["duplicates"].n == 1  # mem_3_0 and mem_4_0 differ behind their 2,000th character
