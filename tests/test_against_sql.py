"""Queries against their SQL, on small tables made for what once went wrong."""

import datetime

import duckdb
from pyspark.sql import functions as F

import __spark_entry__


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL on these tables, sorted."""
    with duckdb.connect() as base:
        for table, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
            base.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
        got = __spark_entry__.queries()[name](spark, str(folder))
        asked = ", ".join(f'"{c}"' for c in got.columns)
        told = base.execute(f"SELECT {asked} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(told)


def test_caption_paragraphs_at_the_limit(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    at = lambda us: day + datetime.timedelta(microseconds=us)
    # Two lines of 199 bytes without the space between them; then of 200.
    rows = [(1, at(0), 1, "a", "x" * 97), (2, at(1000), 1, "a", "y" * 98), (3, at(0), 2, "a", "x" * 98), (4, at(1000), 2, "a", "y" * 98)]
    # Within a millisecond the later id comes first.
    rows += [(6, at(5), 3, "a", "first"), (5, at(7), 3, "a", "second")]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, props string")
    got, told = both(spark, tmp_path, "caption_paragraphs", events=events)
    assert got == told
    assert [(r[0], r[3]) for r in got] == [(1, 2), (2, 1), (2, 1), (3, 2)] and got[-1][4] == "a first a second"


def test_self_threads_of_one_post(spark, tmp_path):
    rows = [(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (2, 0, "a"), (3, 0, None), (3, 1, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string").withColumn("text", F.lit(""))
    got, told = both(spark, tmp_path, "self_threads", conversations=turns)
    assert got == told
    assert [r[0] for r in got] == ["1:0", "1:1", "1:2", "2:0", "3:0", "3:1"]
