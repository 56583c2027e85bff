"""Streaming queries over the events table as a file stream; their final state has a batch twin in SQL."""

import uuid

from pyspark.sql import functions as F

from gaugeworks.plans.dual import Dual
from gaugeworks.streaming import streams

D = Dual()


def events(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a file stream takes folders or patterns; this one matches the table alone
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("at", F.col("ts").cast("timestamp"))


def run(stream, mode):
    return streams.drain(stream, f"s{uuid.uuid4().hex}", mode)


def stream_latest(spark, sf_dir):
    """SM-7."""
    return run(streams.latest_state(events(spark, sf_dir), ["user_id"], "event_id", F.col("event_type") == "error"), "complete").select("user_id", "event_id", "event_type")


D.put("stream_latest", stream_latest, "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, event_id DESC) AS k FROM {events}) WHERE k = 1")


def stream_dedupe(spark, sf_dir):
    """SM-1: one row a key arrives."""
    return run(streams.resumable(events(spark, sf_dir), ["user_id", "event_type"], "at", "400 days"), "append").select("user_id", "event_type")


D.put("stream_dedupe", stream_dedupe, "SELECT DISTINCT user_id, event_type FROM {events}")


def stream_windows(spark, sf_dir):
    """Extension: days of event time."""
    out = run(streams.tumbling(events(spark, sf_dir), "at", "1 day", ["event_type"]), "complete")
    return out.select(F.to_date("start").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean"))


D.put("stream_windows", stream_windows, "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM {events} GROUP BY ALL")


def stream_budget(spark, sf_dir):
    """SM-4."""
    own = events(spark, sf_dir).select("user_id", "event_id", "value")
    return run(streams.budget_stop(own, "user_id", "event_id", "value", 1000.0), "append").select("user_id", "event_id")


D.put("stream_budget", stream_budget, "SELECT user_id, event_id FROM (SELECT *, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {events}) WHERE before < 1000")

ENERGY_SQL = """WITH w AS (SELECT user_id, event_id AS call, epoch(ts) AS t0, epoch(ts) + 3600 AS t1 FROM {events} WHERE event_type = 'purchase'),
s AS (SELECT user_id, epoch(ts) AS t, avg(value) AS v FROM {events} GROUP BY 1, 2),
i AS (SELECT w.*, t, v, lag(t) OVER p AS ta, lag(v) OVER p AS va FROM w JOIN s ON s.user_id = w.user_id AND t BETWEEN t0 - 7200 AND t1 + 7200 WINDOW p AS (PARTITION BY w.user_id, call ORDER BY t)),
e AS (SELECT *, greatest(ta, t0) AS a, least(t, t1) AS b FROM i),
g AS (SELECT user_id, call, any_value(t0) AS t0, any_value(t1) AS t1, min(t) AS lo, max(t) AS hi, sum(CASE WHEN b > a THEN (va + (v - va) * (a - ta) / (t - ta) + va + (v - va) * (b - ta) / (t - ta)) / 2 * (b - a) END) AS j FROM e GROUP BY user_id, call)
SELECT w.user_id, w.call, round(CASE WHEN lo <= g.t0 + 7200 AND hi >= g.t1 - 7200 THEN j END, 3) AS joules FROM w LEFT JOIN g USING (user_id, call)"""


def stream_energy(spark, sf_dir):
    """SM-3, ST-24: a stream of samples against the hour behind each purchase, its edges interpolated."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    windows = e.select("user_id", F.col("event_id").alias("call"), seconds.alias("t0"), (seconds + 3600).alias("t1"))
    samples = events(spark, sf_dir).select("user_id", (F.unix_micros("at") / 1e6).alias("t"), "value")
    pieces = run(streams.call_pieces(samples, windows, "user_id", "t", "value", 7200.0, 7200.0), "append")
    return streams.call_energy(pieces, windows, "user_id", 7200.0).select("user_id", "call", F.round("integral", 3).alias("joules"))


D.put("stream_energy", stream_energy, ENERGY_SQL)

QUERIES, SQL = D.queries, D.sql
