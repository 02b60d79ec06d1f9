"""Event-time queries: events land in slices, late and repeated, and are taken in by runs that go on from each other's state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.functions.durable import durable
from tablecraft.plans.tables import rounded, scratch, table
from tablecraft.streaming import event_time

# Slices in which events land, how late results wait, and the delays of events by the hash of their number.
SLICES, LATENESS_HOURS, WINDOW_HOURS = 4, 48, 6
DELAYS = ((80, 0), (95, 24), (100, 240))
AGAIN = 10  # one of so many events is delivered again two days later

ARRIVED = f"""SELECT event_id, ts, user_id, event_type, value,
  ts + make_interval(0, 0, 0, 0, CASE {' '.join(f'WHEN h < {top} THEN {hours}' for top, hours in DELAYS)} END + again * 48) AS arrival
  FROM (SELECT *, CAST(conv(substr(md5(CAST(event_id AS STRING)), 1, 6), 16, 10) AS BIGINT) % 100 AS h FROM {{events}})
  LATERAL VIEW explode(sequence(0, CASE WHEN h % {AGAIN} = 3 THEN 1 ELSE 0 END)) AS again"""
ARRIVED_SQL = f"""SELECT event_id, ts, user_id, event_type, value,
  ts + to_hours(CAST(CASE {' '.join(f'WHEN h < {top} THEN {hours}' for top, hours in DELAYS)} END + again * 48 AS BIGINT)) AS arrival
  FROM (SELECT *, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 6) AS BIGINT) % 100 AS h FROM events)
  CROSS JOIN (SELECT unnest([0, 1]) AS again) WHERE again = 0 OR h % {AGAIN} = 3"""


def landed(spark, sf, results):
    """Lands the events slice by slice and lets `results` take each slice in."""
    rows = spark.sql(ARRIVED, events=table(spark, sf, "events"))
    rows = durable(rows)
    ends = rows.agg(F.min("arrival").alias("a"), F.max("arrival").alias("b"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    place = F.least(F.floor((micros("arrival") - micros("a")) * SLICES / F.greatest(micros("b") - micros("a"), F.lit(1))), F.lit(SLICES - 1)).cast("int")
    rows = rows.crossJoin(F.broadcast(ends)).withColumn("slice", place).drop("a", "b", "arrival")  # one row of ends
    base = scratch(spark)
    for i in range(SLICES):
        rows.where(F.col("slice") == i).drop("slice").write.mode("append").parquet(f"{base}/in")
        stream = event_time.arrivals(spark, f"{base}/in", rows.drop("slice").schema)
        event_time.run_available(results(stream), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out")


def stream_profile(spark, sf):
    """Finished windows of the events, each with its statistics."""
    return rounded(
        landed(spark, sf, lambda s: event_time.running_profile(s, "ts", ["value"], ["event_type"], f"{WINDOW_HOURS} hours", f"{LATENESS_HOURS} hours")), 9
    )


def stream_first_deliveries(spark, sf):
    """Each event once, although some are delivered twice."""
    return rounded(landed(spark, sf, lambda s: event_time.first_deliveries(s, ["event_id"], "ts", f"{LATENESS_HOURS} hours")))


def stream_sessions(spark, sf):
    """Finished sessions of each user."""
    return rounded(landed(spark, sf, lambda s: event_time.sessions(s, "ts", ["user_id"], "90 minutes", f"{LATENESS_HOURS} hours")))


# A slice is judged by the latest time of the slices before it; a window is given when the latest time of all has passed it.
SLICED_SQL = f"""arrived AS ({ARRIVED_SQL}), ends AS (SELECT epoch_us(min(arrival)) AS a, epoch_us(max(arrival)) AS b FROM arrived),
sliced AS (SELECT arrived.*, least(CAST(floor((epoch_us(arrival) - a) * {SLICES} / greatest(b - a, 1)) AS BIGINT), {SLICES - 1}) AS slice FROM arrived, ends),
marks AS (SELECT s.slice, (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL {LATENESS_HOURS} HOURS FROM sliced p WHERE p.slice < s.slice) AS mark FROM (SELECT DISTINCT slice FROM sliced) s),
last AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL {LATENESS_HOURS} HOURS AS mark FROM sliced),
judged AS (SELECT s.*, m.mark, time_bucket(INTERVAL {WINDOW_HOURS} HOURS, s.ts, TIMESTAMP '1970-01-01') AS w FROM sliced s JOIN marks m USING (slice))"""

PROFILE_SQL = f"""WITH {SLICED_SQL}
SELECT CAST(w AS VARCHAR) AS window_start, CAST(w + INTERVAL {WINDOW_HOURS} HOURS AS VARCHAR) AS window_end, event_type, count(*) AS n_rows, count(value) AS value_count,
  count(*) - count(value) AS value_nulls, round(avg(value), 9) AS value_mean, round(stddev_samp(value), 9) AS value_std, round(min(value), 9) AS value_min, round(max(value), 9) AS value_max
FROM judged WHERE (mark IS NULL OR w + INTERVAL {WINDOW_HOURS} HOURS > mark) AND w + INTERVAL {WINDOW_HOURS} HOURS <= (SELECT mark FROM last) GROUP BY w, event_type"""

FIRST_SQL = f"""WITH {SLICED_SQL}
SELECT DISTINCT event_id, CAST(ts AS VARCHAR) AS ts, user_id, event_type, round(value, 6) AS value FROM judged WHERE mark IS NULL OR ts > mark"""


QUERIES = {
    "stream_profile": (stream_profile, PROFILE_SQL),
    "stream_first_deliveries": (stream_first_deliveries, FIRST_SQL),
    "stream_sessions": (stream_sessions, None),
}
