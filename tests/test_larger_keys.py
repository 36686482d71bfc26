"""Queries against their SQL on tables with larger keys than the test ones have."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from eventlake import queries as core
from eventlake.operators import behavior, trim


def same_as_sql(spark, folder, name, **tables):
    """The rows of a query and of its SQL on tables of the test's own."""
    db = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = core.queries()[name](spark, str(folder))
    cur = db.execute(core.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    got, want = ({*map(tuple, df.select(*names).collect())}, {*cur.fetchall()})
    assert got == want
    return got


@pytest.mark.parametrize("name", ["click_row_errors", "click_quality"])
def test_many_clicks(spark, tmp_path, name):
    ids = [0, 1, 2, 999_998, 999_999, 1_000_000, 1_000_001, 1_000_003, 2_000_000, 2_000_001, 5_999_999]
    kinds = ["view", "click", "purchase", "signup", "error"]
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=i), i % 7, kinds[i % 5], 1.0, "{}") for i in ids]
    same_as_sql(spark, tmp_path, name, events=spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"))


def test_follow_state_of_long_keys(spark, tmp_path):
    rows = [(150_000 + i, 7 + i % 2, f"{1 + i % 3}-URGENT") for i in range(6)] + [(9, 1, "1-URGENT"), (9, 1, "2-HIGH")]
    same_as_sql(spark, tmp_path, "follow_state", orders=spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string"))


def test_stories_of_long_keys(spark, tmp_path):
    rows = [(1, 2, 1_900_001, 5, 40.0), (1, 3, 7, 5, 40.0), (2, 1, 3_000_001, 5, 50.0), (9, 13, 3, 6, 30.0), (10, 3, 1, 6, 30.0), (10, 3, 4, 6, 29.5), (10, 3, 8, 6, 30.0)]
    same_as_sql(spark, tmp_path, "stories", lineitem=spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"))


def test_devices_of_a_week(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(d, start + timedelta(days=k)) for k in (0, 1, 2, 5, 7, 12, 30) for d in range(k * 900, k * 900 + 4000)] + [(None, start), (None, start + timedelta(days=60)), (1, None), (1, start)]
    got = same_as_sql(spark, tmp_path, "sketched_devices_7d", events=spark.createDataFrame(rows, "user_id long, ts timestamp_ntz"))
    assert len(got) == 8
    whole = behavior.exact_sliding_devices(spark.createDataFrame(rows, "user_id long, ts timestamp_ntz"), "user_id", "ts", 100)
    assert {r.day.isoformat(): r.devices for r in whole.collect()}["2024-01-31"] == 4000 + 900 + 900 + 2700 + 1800 + 4000 + 4000


def test_narration_reads_no_more_scripts_than_it_needs(spark):
    known = F.when(F.col("event_id") < 9_000, F.raise_error(F.lit("an old script was read"))).otherwise(F.repeat(F.lit("x"), 90))
    s = spark.range(10_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") - F.col("id") % 50).cast("timestamp_ntz").alias("seen"), known.cast("string").alias("script"))
    spoken = s.select("event_id", F.when(F.col("event_id") % 3 == 0, F.sha2("script", 256)).otherwise("old").alias("hash"))
    assert [r.event_id for r in trim.narration_queue(s, spoken).collect()] == [9950, 9952, 9953, 9955, 9956, 9958, 9959, 9961]
    few = spark.range(3_000).select(F.col("id").alias("event_id"), F.when(F.col("id") > 0, F.col("id")).alias("seen"), F.when(F.col("id").isin(0, 5, 2_000), F.repeat(F.lit("x"), 90)).otherwise("short").alias("script"))
    assert [r.event_id for r in trim.narration_queue(few, spoken.limit(0)).collect()] == [2_000, 5, 0]
