import datetime

from claimloom.plans import views


def test_seconds_are_rounded_as_in_sql(spark):
    at = lambda micros: datetime.datetime(2024, 1, 1, 0, 0, 10, micros)
    rows = spark.createDataFrame([(k, at(m)) for k, m in enumerate((0, 400_000, 500_000, 600_000))], "k int, ts timestamp_ntz")
    base = 1704067210  # SQL: epoch(ts)::BIGINT
    assert [r.s - base for r in rows.select("k", views.whole_seconds("ts").alias("s")).orderBy("k").collect()] == [0, 0, 0, 1]
    assert [r.s - base for r in rows.selectExpr("k", "ts + interval 1 second as ts").select("k", views.whole_seconds("ts").alias("s")).orderBy("k").collect()] == [1, 1, 2, 2]
