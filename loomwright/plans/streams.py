"""Queries of windows over events, in the batch form and as a stream that is read to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..staging import fresh_dir
from ..streaming import windows as W
from .registry import query, table


@query("window_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_tumbling(spark, d):
    counts = [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")]
    out = W.windowed(W.event_time(table(spark, d, "events")), "1 hour", counts, by=["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("window_sliding", "SELECT time_bucket(INTERVAL '30 minutes', ts) - (INTERVAL '30 minutes' * k) AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def window_sliding(spark, d):
    out = W.windowed(W.event_time(table(spark, d, "events")), "1 hour", [F.count("*").alias("n")], "30 minutes")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("session_windows", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '2 hours' THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, session
""")
def session_windows(spark, d):
    out = W.sessions(W.event_time(table(spark, d, "events")), "2 hours", [F.count("*").alias("n")], ["user_id"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


@query("stream_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    """The events as a stream of files, copied in steps to a table, whose windows are then counted."""
    source = table(spark, d, "events")
    files, taken = fresh_dir(spark, "arriving"), fresh_dir(spark, "events")
    source.repartition(4).write.parquet(files)
    stream = W.read_stream(spark, files, source.schema)
    W.ingest(stream, taken, fresh_dir(spark, "progress"))
    out = W.windowed(W.event_time(spark.read.schema(source.schema).parquet(taken)), "1 hour", [F.count("*").alias("n")])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("drop_repeats", "SELECT DISTINCT user_id, event_type FROM events")
def drop_repeats(spark, d):
    return W.drop_repeats(table(spark, d, "events").select("user_id", "event_type"), ["user_id", "event_type"])


#: Events arrive in three steps: the first half of the month, then the rest, then those with numbers divisible by ten, which come late: those of the
#: first half are behind the watermark by then, those of the last half day are not. A row far ahead closes what is open. Each step is a new start of the stream.
_HALF, _LAST, _END, _DELAY = "TIMESTAMP '2024-01-15'", "TIMESTAMP '2024-01-30 12:00:00'", "TIMESTAMP '2030-01-01'", "1 day"
_LATE = f"event_id % 10 = 0 AND (ts < {_HALF} OR ts >= {_LAST})"
_IN_TIME = f"(SELECT * FROM events WHERE NOT (event_id % 10 = 0 AND ts < {_HALF}))"


def _arriving(spark, d, build):
    """The result of a stream of events that is stopped and started again between the steps."""
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    stream = W.Resumed(spark, fresh_dir(spark, "stream"), events.schema, lambda df: build(W.event_time(df, delay=_DELAY)))
    late, half = F.expr(_LATE), F.expr(f"ts < {_HALF}")
    ahead = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.expr(_END).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("event_type"), F.lit(0.0).alias("value"))
    for step in (events.where(half & ~late), events.where(~half & ~late), events.where(late), ahead):
        stream.arrive(step)
        stream.run()
    return stream.result()


@query("stream_late_windows", f"SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {_IN_TIME} GROUP BY ALL")
def stream_late_windows(spark, d):
    counts = [F.count("*").alias("n"), F.sum("value").alias("total")]
    out = _arriving(spark, d, lambda df: W.windowed(df, "6 hours", counts, by=["event_type"])).where("event_type is not null")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sessions", f"""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '2 hours' THEN 0 ELSE 1 END AS opens FROM {_IN_TIME} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL '2 hours' AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, session
""")
def stream_sessions(spark, d):
    out = _arriving(spark, d, lambda df: W.sessions(df, "2 hours", [F.count("*").alias("n")], ["user_id"])).where("user_id is not null")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


@query("stream_repeats", f"SELECT event_id FROM {_IN_TIME} WHERE event_id % 3 < 2")
def stream_repeats(spark, d):
    """Two of three events, each sent twice: one of each stays."""
    once = _arriving(spark, d, lambda df: W.drop_repeats(df.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).where("event_id % 3 < 2"), ["event_id"]).select("event_id"))
    return once.where("event_id >= 0")
