"""Queries of the newer modules against their SQL twins on the smallest tables."""

import duckdb
import pytest

from claimloom.plans import brief_queries, check_queries, stream_queries
from claimloom.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "benchmark", "conversations", "events", "orders"]
NAMES = sorted(n for n, f in QUERIES.items() if f.__module__ in (check_queries.__name__, brief_queries.__name__, stream_queries.__name__) and n in SQL)


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def tidy(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 5)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, twin, name):
    df = QUERIES[name](spark, FOLDER)
    found = twin.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert tidy(df.collect(), df.columns) == tidy(found.fetchall(), columns)


def test_claims_of_some_documents_are_those_of_all(spark):
    """What ``only`` derives equals what it would be among all documents, and no other document is shuffled."""
    from claimloom.sources import derive

    d = "/root/testdata/sf0.001"
    ids = derive.table(spark, d, "documents").where("doc_id % 7 = 3").select("doc_id")
    got = derive.claims(spark, d, only=ids).select("claim_id", "statement", "evidence").collect()
    want = derive.claims(spark, d).where("doc_id % 7 = 3").select("claim_id", "statement", "evidence").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and got
