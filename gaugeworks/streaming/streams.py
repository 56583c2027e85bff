"""Structured Streaming: resumable logs, latest state, retention, budgets, windows (SM)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.relational import shared_dir
from gaugeworks.sources.readers import power_lines


def resumable(stream: DataFrame, keys: list[str], ts: str, delay: str = "6 hours") -> DataFrame:
    """SM-1, SM-2: each idempotency key once; state older than the watermark goes."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def sampler(spark: SparkSession, folder: str, delay: str = "6 hours") -> DataFrame:
    """SRC-22: a stream of the sampler's files of lines, `seconds,gpu,watts,mem_mib,util`, each sample once; what comes later than
    `delay` behind the latest sample is dropped, and so is the state."""
    lines = spark.readStream.schema("value string").text(folder)
    timed = lines.select(F.timestamp_millis((F.substring_index("value", ",", 1).try_cast("double") * 1000).cast("long")).alias("ts"), F.regexp_replace("value", "^[^,]*,", "").alias("value"))
    return resumable(power_lines(timed).where("ts IS NOT NULL").drop("value"), ["ts", "gpu"], "ts", delay)


def latest_state(stream: DataFrame, keys: list[str], seq: str, failed) -> DataFrame:
    """SM-7: the last record that did not fail, else the last; for update or complete mode. State is a row a key."""
    rest = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(~failed, F.col(seq))).alias("r")).select(*keys, "r.*")


def tumbling(stream: DataFrame, ts: str, width: str, keys: list[str], delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Extension: counts and means by window of event time."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, delay).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "mean")


def sessions(stream: DataFrame, ts: str, gap: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Extension: sessions of events no further apart than gap."""
    return stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("s"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *keys, "n")


def segments(stream: DataFrame, key: str, t: str, v: str) -> DataFrame:
    """A stream of samples as one of stretches between neighbours: key, ta, va, tb, vb. State is the last sample of a key, so stretches
    go on over triggers. Within a trigger samples go by time; one no later than the last of an earlier trigger makes no stretch."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = stream.schema[key].dataType.simpleString()
    names = [key, "ta", "va", "tb", "vb"]

    def run(k, frames, state):
        last = tuple(state.get) if state.exists else None
        rows = pd.concat([f[[t, v]].astype("float64") for f in frames]).dropna().sort_values([t, v], ignore_index=True)
        if last is not None:
            rows = pd.concat([pd.DataFrame([last], columns=[t, v]), rows[rows[t] > last[0]]], ignore_index=True)
        if len(rows):
            state.update((float(rows[t].iloc[-1]), float(rows[v].iloc[-1])))
        a, b = rows.iloc[:-1].reset_index(drop=True), rows.iloc[1:].reset_index(drop=True)
        yield pd.DataFrame({key: k[0], "ta": a[t], "va": a[v], "tb": b[t], "vb": b[v]}, columns=names)[lambda d: d["tb"] > d["ta"]]

    own = stream.select(key, F.col(t).cast("double").alias(t), F.col(v).cast("double").alias(v))
    return own.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, ta double, va double, tb double, vb double", "t double, v double", "append", GroupStateTimeout.NoTimeout)


def call_pieces(stream: DataFrame, windows: DataFrame, key: str, t: str, v: str, margin: float = 2.0, bucket: float = 60.0) -> DataFrame:
    """SM-3: key, call, ta, tb, piece: what each stretch of a stream of samples adds to the integral of each call of its key. windows: key, call, t0, t1.

    Stretches and calls are cut into time buckets and meet by an equal join on key and bucket, in the first bucket that both
    have; a stretch counts if both its samples are within the margin of the call, as in timeseries.integrate."""
    cut = lambda df, a, b: df.withColumn("first", F.floor(F.col(a) / bucket)).withColumn("bucket", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket))))
    calls = cut(windows.select(key, "call", "t0", "t1").withColumn("lo", F.col("t0") - margin).withColumn("hi", F.col("t1") + margin), "lo", "hi").withColumnRenamed("first", "begins")
    own = cut(segments(stream, key, t, v).where(F.col("tb") - F.col("ta") <= F.lit(_longest(windows, margin))), "ta", "tb")
    met = own.join(calls, [key, "bucket"]).where((F.col("bucket") == F.greatest("first", "begins")) & (F.col("ta") >= F.col("lo")) & (F.col("tb") <= F.col("hi")))
    at = lambda edge: F.col("va") + (F.col("vb") - F.col("va")) * (edge - F.col("ta")) / (F.col("tb") - F.col("ta"))
    a, b = F.greatest("ta", "t0"), F.least("tb", "t1")
    return met.select(key, "call", "ta", "tb", F.when(b > a, (at(a) + at(b)) / 2 * (b - a)).alias("piece"))


def _longest(windows: DataFrame, margin: float) -> float:
    """A stretch longer than the longest call with its margins counts for none, and would only fill buckets."""
    return float(windows.agg(F.max(F.col("t1") - F.col("t0"))).first()[0] or 0.0) + 2 * margin


def call_energy(pieces: DataFrame, windows: DataFrame, key: str, margin: float = 2.0) -> DataFrame:
    """SM-3: windows with their integral from the stored pieces; null unless the samples reach both edges within the margin."""
    sums = pieces.groupBy(key, "call").agg(F.sum("piece").alias("all"), F.min("ta").alias("from"), F.max("tb").alias("to"))
    whole = (F.col("from") <= F.col("t0") + margin) & (F.col("to") >= F.col("t1") - margin)
    return windows.join(sums, [key, "call"], "left").withColumn("integral", F.when(whole, F.col("all"))).drop("all", "from", "to")


def budget_stop(stream: DataFrame, key: str, seq: str, amount: str, limit: float) -> DataFrame:
    """SM-4: passes rows while the amount spent before is under the limit; state is one number a key. Within a trigger rows go by seq."""
    import pandas as pd

    schema = stream.schema

    def run(k, frames, state):
        spent = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values(seq)
        before = spent + rows[amount].cumsum().shift(fill_value=0.0)
        state.update((float(spent + rows[amount][before < limit].sum()),))
        yield rows[before < limit]

    from pyspark.sql.streaming.state import GroupStateTimeout

    return stream.groupBy(key).applyInPandasWithState(run, schema, "spent double", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str, folder: str | None = None) -> DataFrame:
    """Runs a stream over what is there and gives its final table, stored under `folder` (else the folder of spark.checkpoint.dir) with
    the stream's own checkpoint. A trigger's rows are written whole or again; complete mode keeps the last trigger's."""
    spark = stream.sparkSession
    base = f"{folder or shared_dir(spark)}/{name}"
    done: list[int] = []

    def store(rows: DataFrame, k: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/rows/trigger={k}")
        done.append(k)

    query = stream.writeStream.foreachBatch(store).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state").start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    if not done:
        return spark.createDataFrame([], stream.schema)
    parts = [max(done)] if mode == "complete" else sorted({*done})
    return spark.read.schema(stream.schema).parquet(*[f"{base}/rows/trigger={k}" for k in parts])
