"""Ratings, votes, agreement and bootstrap."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

M = 2147483647


def leniency(ratings: DataFrame, n_judges: int, answer: list[str]) -> DataFrame:
    """AG-15, WN-14: judge, offset: mean of rating less the answer's mean, over answers that all judges rated."""
    w = Window.partitionBy(*answer)
    own = ratings.withColumn("_m", F.avg("rating").over(w)).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") == n_judges)
    return own.groupBy("judge_id").agg(F.avg(F.col("rating") - F.col("_m")).alias("offset"), F.count(F.lit(1)).alias("n"))


def calibrated(ratings: DataFrame, offsets: DataFrame, clamp: bool = True) -> DataFrame:
    """JN-4, PRJ-12: rating less the judge's offset (0 where unknown), in [0, 1] for scoring, as it is for the human study."""
    value = F.col("rating") - F.coalesce("offset", F.lit(0.0))
    out = ratings.join(F.broadcast(offsets.select("judge_id", "offset")), "judge_id", "left")
    return out.withColumn("calibrated", F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)) if clamp else value).drop("offset")


def majority(votes: DataFrame, keys: list[str], value: str, least: int) -> DataFrame:
    """AG-17: keys, label (most frequent value with at least `least` votes, ties to the smaller), n_votes, top."""
    n = votes.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    top = n.groupBy(*keys).agg(F.sum("c").alias("n_votes"), F.max("c").alias("top"), F.min_by(value, F.struct(-F.col("c"), F.col(value))).alias("label"))
    return top.select(*keys, "n_votes", "top", F.when(F.col("top") >= least, F.col("label")).alias("label"))


def element_votes(votes: DataFrame, keys: list[str], values: str, least: int) -> DataFrame:
    """AG-17 for lists: elements in (enough votes for), undecided (enough neither for nor against)."""
    n = votes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    c = votes.select(*keys, F.explode(F.array_distinct(values)).alias("element")).groupBy(*keys, "element").agg(F.count(F.lit(1)).alias("c"))
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("element"))))
    out = c.join(n, keys).groupBy(*keys).agg(pick(F.col("c") >= least).alias("value"), pick((F.col("c") < least) & (F.col("n") - F.col("c") < least)).alias("undecided"))
    return out


def panels(votes: DataFrame, families: DataFrame, keys: list[str], value: str, least: int) -> DataFrame:
    """AG-18: for each family the majority of the others; all together as family `*`."""
    others = votes.join(F.broadcast(families.withColumnRenamed("family", "panel")), F.col("family") != F.col("panel")).unionByName(votes.withColumn("panel", F.lit("*")))
    return majority(others, [*keys, "panel"], value, least)


def agreement_levels(votes: DataFrame, keys: list[str], value: str, coders: int) -> DataFrame:
    """AG-19: unanimous, majority or none, of units that all coders judged."""
    top = majority(votes, keys, value, 1).where(F.col("n_votes") == coders)
    level = F.when(F.col("top") == coders, "unanimous").when(F.col("top") * 2 > coders, "majority").otherwise("none")
    return top.select(*keys, level.alias("level"))


def alpha_by(ratings: DataFrame, keys: list[str], unit: list[str], value: str, level: str) -> DataFrame:
    """ST-15, ST-22, ST-23: keys, alpha, n_pairable: Krippendorff's alpha of every group in one pass; null if all pairable values are equal.

    Neither pairs of ratings nor of values are made: disagreement within a unit, and among all, is a sum of squares of its values
    (interval), of their middle ranks in the group (ordinal), or what equal values leave of all pairs (nominal)."""
    c = ratings.where(F.col(value).isNotNull()).groupBy(*keys, *unit, F.col(value).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    m = F.sum("c").over(Window.partitionBy(*keys, *unit))
    c = c.withColumn("m", m).where("m > 1")
    if level == "ordinal":
        same = lambda s: [F.col(k).eqNullSafe(F.col(f"{s}{k}")) for k in keys]
        n = c.groupBy(*keys, "v").agg(F.sum("c").alias("n_v"))
        upto = F.sum("n_v").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        mid = n.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col("v").alias("k_v"), (upto - F.col("n_v") / 2).alias("x"))
        c = c.join(mid, [*same("k_"), F.col("v") == F.col("k_v")])
    else:
        c = c.withColumn("x", F.col("v").cast("double") if level == "interval" else F.lit(0.0))
    x, k = F.col("x"), F.col("c")
    by_unit = c.groupBy(*keys, *unit).agg(F.first("m").alias("m"), F.sum(k * k).alias("same"), F.sum(k * x).alias("s"), F.sum(k * x * x).alias("q"))
    within = (F.col("m") ** 2 - F.col("same")) if level == "nominal" else 2 * (F.col("m") * F.col("q") - F.col("s") ** 2)
    inner = by_unit.groupBy(*keys).agg(F.sum(within / (F.col("m") - 1)).alias("d_o"), F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    if level == "nominal":
        n = c.groupBy(*keys, "v").agg(F.sum("c").alias("n_v")).groupBy(*keys).agg(F.sum(F.col("n_v") ** 2).alias("same")).withColumnsRenamed({k: f"k_{k}" for k in keys})
        inner = inner.join(n, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys] or F.lit(True))
    among = (F.col("n") ** 2 - F.col("same")) if level == "nominal" else 2 * (F.col("n") * F.col("q") - F.col("s") ** 2)
    return inner.select(*keys, F.when(among > 1e-9, 1 - (F.col("n") - 1) * F.col("d_o") / among).alias("alpha"), F.col("n").cast("long").alias("n_pairable"))


def krippendorff(ratings: DataFrame, unit: str, coder: str, value: str, level: str) -> DataFrame:
    """ST-15: alpha, n_pairable of all ratings together."""
    return alpha_by(ratings, [], [unit], value, level)


def resample_index(b, pos, task, seed: int, n):
    """An index below n by whole-number hashing alone, the same in every SQL engine. Without the model, so that all models share a resample."""
    x0 = (b * 7919 + pos * 104729 + task * 1299709 + F.lit(seed * 15485863).cast("long")) % M
    x1 = (x0 * x0 + 48271 * x0 + 12345) % M
    return ((x1 * x1 + 69621 * x1 + 12345) % M) % n


RESAMPLE_SQL = """(SELECT *, (x1 * x1 + 69621 * x1 + 12345) % 2147483647 % n AS pick FROM (SELECT *, (x0 * x0 + 48271 * x0 + 12345) % 2147483647 AS x1
FROM (SELECT *, (b * 7919 + pos * 104729 + task * 1299709 + {seed} * 15485863) % 2147483647 AS x0 FROM {cells})))"""


def resamples(items: DataFrame, draws: int, seed: int) -> DataFrame:
    """b, task, item: each task's items drawn with replacement, as many as there are. items: task, item (distinct)."""
    w = Window.partitionBy("task")
    placed = items.withColumn("pos", (F.row_number().over(w.orderBy("item")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(w))
    draws_ = placed.select("task", "pos", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("b"))
    drawn = draws_.withColumn("pick", resample_index(F.col("b"), F.col("pos"), F.col("task"), seed, F.col("n")))
    return drawn.join(placed.select("task", F.col("pos").alias("pick"), "item"), ["task", "pick"]).select("b", "task", "item")


def rank_bootstrap(scores: DataFrame, draws: int, seed: int) -> DataFrame:
    """ST-17, ST-18: b, model, overall, rank over shared, task-stratified resamples. scores: model, item, task, score.

    How often each item is drawn is counted first, so the join grows with items, not draws of repeats."""
    times = resamples(scores.select("task", "item").distinct(), draws, seed).groupBy("b", "task", "item").agg(F.count(F.lit(1)).alias("k"))
    per_task = scores.join(times, ["task", "item"]).groupBy("b", "model", "task").agg((F.sum(F.col("score") * F.col("k")) / F.sum("k")).alias("mean"))
    overall = per_task.groupBy("b", "model").agg(F.avg("mean").alias("overall"))
    return overall.withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("overall"), "model")))


def behind_leader(drawn: DataFrame, scores: DataFrame) -> DataFrame:
    """ST-18: drawn with diff (observed composite of the observed leader less the model's) and drawn_diff (the same within each resample)."""
    seen = scores.groupBy("model", "task").agg(F.avg("score").alias("mean")).groupBy("model").agg(F.avg("mean").alias("seen"))
    leader = seen.orderBy(F.desc("seen"), "model").limit(1).select(F.col("model").alias("leader"), F.col("seen").alias("best"))
    own = F.broadcast(seen.crossJoin(leader).select("model", "leader", (F.col("best") - F.col("seen")).alias("diff")))
    lead = F.max(F.when(F.col("model") == F.col("leader"), F.col("overall"))).over(Window.partitionBy("b"))
    return drawn.join(own, "model").withColumn("drawn_diff", lead - F.col("overall")).drop("leader")


def floor_quantile(x: str, p: float):
    """WN-15: the value at index floor(p (n - 1)), no interpolation."""
    s = F.array_sort(F.collect_list(x))
    return F.element_at(s, (F.floor(p * (F.size(s) - 1)) + 1).cast("int"))


@functools.lru_cache(maxsize=8)
def seeded_picks(seed: int, n: int, draws: int):
    """Places that random.Random(seed) draws out of n, n at a time; the same for all groups of one size, so a worker makes them once."""
    import random

    import numpy as np

    rng = random.Random(seed)
    return np.array([[rng.randrange(n) for _ in range(n)] for _ in range(draws)], np.int32)


def seeded_bootstrap_ci(scores: DataFrame, keys: list[str], value: str, order: str, n: int = 2000, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """ST-3: percentile interval of the mean with the draws of random.Random(seed) in row order; one value is its own interval."""
    import numpy as np
    import pandas as pd

    def run(own: pd.DataFrame) -> pd.DataFrame:
        x = own.sort_values(order)[value].dropna().to_numpy(float)
        lo = hi = mean = None
        if len(x):
            mean = lo = hi = float(x.mean())
        if len(x) > 1:
            means = [x[pick].mean() for pick in seeded_picks(seed, len(x), n)]
            lo, hi = np.quantile(means, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame([[*(own[k].iloc[0] for k in keys), mean, lo, hi]], columns=[*keys, "mean", "lo", "hi"])

    types = ", ".join(f"`{k}` {scores.schema[k].dataType.simpleString()}" for k in keys)
    return scores.groupBy(*keys).applyInPandas(run, f"{types}, mean double, lo double, hi double")
