"""Sampled power to energy: range and as-of joins, trapezoid integrals (JN-15, JN-16, ST-24, ST-25, WN-6, WN-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_join(samples: DataFrame, windows: DataFrame, key: str, t: str, t0: str, t1: str, margin: float = 2.0, bucket: float = 60.0) -> DataFrame:
    """JN-15: samples within [t0 - margin, t1 + margin] of a window of their key. Both sides are cut into time buckets, so it is an equi-join."""
    w = windows.withColumn("_b", F.explode(F.sequence(F.floor((F.col(t0) - margin) / bucket), F.floor((F.col(t1) + margin) / bucket))))
    s = samples.withColumn("_b", F.floor(F.col(t) / bucket))
    return s.join(w, [key, "_b"]).where((F.col(t) >= F.col(t0) - margin) & (F.col(t) <= F.col(t1) + margin)).drop("_b")


def as_of(left: DataFrame, right: DataFrame, key: str, t: str, value: str, out: str, backward: bool = True) -> DataFrame:
    """JN-16: the latest value at or before (else earliest at or after) each left row's time, by one sort per key, no pairs."""
    a = left.select(key, t, F.lit(1).alias("_l"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    b = right.select(key, t, F.lit(0).alias("_l"), F.col(value).alias("_v"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    if backward:
        w = Window.partitionBy(key).orderBy(t, "_l").rowsBetween(Window.unboundedPreceding, 0)
        v = F.last("_v", ignorenulls=True).over(w)
    else:
        w = Window.partitionBy(key).orderBy(F.desc(t), "_l").rowsBetween(Window.unboundedPreceding, 0)
        v = F.last("_v", ignorenulls=True).over(w)
    return a.unionByName(b).withColumn(out, v).where("_l = 1").select("_row.*", out)


def integrate(samples: DataFrame, windows: DataFrame, key: str, window: str, t: str, v: str, t0: str, t1: str, margin: float = 2.0, bucket: float = 60.0) -> DataFrame:
    """ST-24: integral of v over [t0, t1] by the trapezoid rule, its edges interpolated between the samples around them.
    Null unless samples stand within the margin of both edges or around them."""
    own = range_join(samples, windows, key, t, t0, t1, margin, bucket)
    w = Window.partitionBy(key, window).orderBy(t)
    own = own.withColumn("_t", F.lag(t).over(w)).withColumn("_v", F.lag(v).over(w))
    at = lambda edge: F.col("_v") + (F.col(v) - F.col("_v")) * (edge - F.col("_t")) / (F.col(t) - F.col("_t"))
    a, b = F.greatest("_t", t0), F.least(t, t1)
    piece = F.when((F.col("_t").isNotNull()) & (F.col(t) > F.col("_t")) & (b > a), (at(a) + at(b)) / 2 * (b - a))
    found = own.groupBy(key, window, t0, t1).agg(F.sum(piece).alias("_j"), F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    whole = (F.col("_lo") <= F.col(t0) + margin) & (F.col("_hi") >= F.col(t1) - margin)
    out = windows.join(found.select(key, window, F.when(whole, F.col("_j")).alias("integral")), [key, window], "left")
    return out


def marginal_energy(gross: str, baseline: str, t0: str, t1: str):
    """ST-25: above the idle baseline, never below 0."""
    return F.greatest(F.lit(0.0), F.col(gross) - F.col(baseline) * (F.col(t1) - F.col(t0)))


def growth(df: DataFrame, partition: list[str], order: str, value: str) -> DataFrame:
    """WN-7: change in percent and mean of three."""
    w = Window.partitionBy(*partition).orderBy(order)
    prior = F.lag(value).over(w)
    return df.withColumn("growth_pct", F.try_divide((F.col(value) - prior) * 100, prior)).withColumn("ma3", F.when(F.row_number().over(w) >= 3, F.avg(value).over(w.rowsBetween(-2, 0))))
