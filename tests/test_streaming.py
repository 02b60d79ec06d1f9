"""Event-time state: late rows, repeats, restarts, and equality with the batch form."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.operators import encoding, transforms
from tablecraft.streaming import apply, event_time

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user", T.StringType()), T.StructField("x", T.DoubleType())])
START = datetime(2024, 3, 1)


def at(hours: float) -> datetime:
    return START + timedelta(hours=hours)


@pytest.fixture
def land(spark, tmp_path):
    """Lands rows and runs a stream over what has arrived; gives all results so far."""

    def run(rows, results, fail=None):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = event_time.arrivals(spark, f"{tmp_path}/in", SCHEMA)
        if fail is not None:
            stream = stream.withColumn("x", fail(F.col("x")))
        event_time.run_available(results(stream), f"{tmp_path}/out", f"{tmp_path}/state")
        return spark.read.parquet(f"{tmp_path}/out")

    return run


def profile(s):
    return event_time.running_profile(s, "ts", ["x"], ["user"], "1 hour", "2 hours")


def test_windows_close_in_order_and_late_rows_are_dropped(land):
    assert land([(1, at(0.1), "a", 1.0), (2, at(0.2), "a", float("nan")), (3, None, "a", 9.0)], profile).count() == 0
    assert land([(4, at(0.5), "a", 3.0), (5, at(3.2), "a", 5.0)], profile).collect()[0].n_rows == 3  # 0.5 came in time
    rows = land([(6, at(0.6), "a", 100.0), (7, at(2.1), None, 7.0), (8, at(9), "a", 1.0)], profile).orderBy("window_start").collect()
    assert [(r.window_start, r.user, r.n_rows, r.x_count, r.x_nulls, r.x_mean) for r in rows] == [
        (at(0), "a", 3, 2, 1, 2.0), (at(2), None, 1, 1, 0, 7.0), (at(3), "a", 1, 1, 0, 5.0)]


def test_a_run_goes_on_after_a_failure(land):
    land([(1, at(0.1), "a", 1.0)], profile)
    with pytest.raises(Exception):
        land([(2, at(0.2), "a", 2.0)], profile, lambda x: F.when(x == 2, F.raise_error(F.lit("lost")).cast("double")).otherwise(x))
    rows = land([(3, at(9), "a", 3.0)], profile).collect()
    assert [(r.n_rows, r.x_min, r.x_max) for r in rows] == [(2, 1.0, 2.0)]


def test_all_batches_equal_one_batch(land, spark):
    rows = [(i, at((i * 37 % 100) / 10), f"u{i % 3}", float(i)) for i in range(100)]
    for k in range(4):
        got = land(rows[25 * k : 25 * k + 25], lambda s: event_time.running_profile(s, "ts", ["x"], ["user"], "1 hour", "12 hours"))
    got = land([(1000, at(100), "end", 0.0)], lambda s: event_time.running_profile(s, "ts", ["x"], ["user"], "1 hour", "12 hours"))
    want = event_time.running_profile(spark.createDataFrame(rows, SCHEMA), "ts", ["x"], ["user"], "1 hour")
    assert got.select(F.struct("*").cast("string").alias("r")).exceptAll(want.select(F.struct("*").cast("string").alias("r"))).count() == 0
    assert got.count() == want.count() > 10


def test_sliding_windows_of_a_batch(spark):
    rows = spark.createDataFrame([(1, at(0.1), "a", 1.0), (2, at(0.8), "a", 3.0)], SCHEMA)
    got = event_time.running_profile(rows, "ts", ["x"], every="1 hour", slide="30 minutes").orderBy("window_start").collect()
    assert [(r.window_start, r.n_rows) for r in got] == [(at(-0.5), 1), (at(0), 2), (at(0.5), 1)]


def test_repeats_go_within_the_lateness_and_across_runs(land):
    first = lambda s: event_time.first_deliveries(s, ["id"], "ts", "2 hours")
    land([(1, at(1), "a", 1.0), (1, at(1), "a", 1.0), (2, at(1.1), "a", 2.0), (9, None, "a", 0.0)], first)
    land([(1, at(1), "a", 1.0), (3, at(2), "a", 3.0)], first)
    land([(4, at(9), "a", 4.0)], first)
    got = land([(2, at(1.1), "a", 2.0), (5, at(1.2), "a", 5.0), (6, at(9.1), "a", 6.0)], first)  # both of hour 1 are late by now
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 4, 6]


def test_sessions_join_over_late_rows(land, spark):
    of = lambda s: event_time.sessions(s, "ts", ["user"], "30 minutes", "3 hours")
    land([(1, at(1), "a", 0.0), (2, at(1.8), "a", 0.0)], of)
    land([(3, at(1.4), "a", 0.0), (4, at(1.4), "b", 0.0)], of)
    got = land([(5, at(12), "a", 0.0)], of)
    assert {(r.user, r.session_start, r.session_end, r.n_rows) for r in got.collect()} == {("a", at(1), at(2.3), 3), ("b", at(1.4), at(1.9), 1)}


def test_state_is_one_row_per_open_window(land, spark, tmp_path):
    rows = [(i, at(i % 50 / 60), "a", 1.0) for i in range(2_000)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/in")
    query = event_time.run_available(profile(event_time.arrivals(spark, f"{tmp_path}/in", SCHEMA)), f"{tmp_path}/out", f"{tmp_path}/state")
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_fitted_steps_run_before_the_windows(land, spark):
    known = spark.createDataFrame([(1, at(0), "a", 1.0), (2, at(0), "b", 3.0)], SCHEMA)
    steps = [transforms.standard(known, ["x"]), encoding.label(known, ["user"])]
    of = lambda s: event_time.running_profile(apply.transform_all(s, steps), "ts", ["x_scaled", "user_label"], every="1 hour", lateness="1 hour")
    got = land([(1, at(0.2), "b", 3.0), (2, at(0.3), "b", 1.0)], of)
    got = land([(3, at(9), "a", 3.0)], of).collect()
    assert [(r.n_rows, r.x_scaled_mean, r.user_label_max) for r in got] == [(2, 0.0, 1)]


def test_empty_batch(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert profile(none).count() == event_time.first_deliveries(none, ["id"], "ts").count() == event_time.sessions(none, "ts", ["user"]).count() == 0
