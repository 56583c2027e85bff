"""Repetitions to items, items to tasks, tasks to composites, composites to ranks (AG-1 to AG-4, WN-2)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _even(how, c) -> Column:
    v = F.col(c) if isinstance(c, str) else c
    v = v.cast("double")
    fine = F.abs(v) < 1e12
    return F.when(F.count(v) == F.count_if(fine), how(F.when(fine, v.cast("decimal(28,14)"))).cast("double")).otherwise(how(v))


def even_mean(c) -> Column:
    """Mean of numbers to 14 decimals, added up exactly: equal means are equal, whatever the order of rows. Plain where one is 1e12 or more, or no number."""
    return _even(F.avg, c)


def even_sum(c) -> Column:
    """Sum of numbers to 14 decimals, added up exactly, as in even_mean."""
    return _even(F.sum, c)


def item_scores(fact: DataFrame) -> DataFrame:
    """AG-1: mean over repetitions; null scores are skipped, n_reps counts all rows."""
    return fact.groupBy("model", "item", "task").agg(
        F.avg("final").alias("score"), F.avg("auto").alias("auto"), F.avg("judge").alias("judge"), F.count(F.lit(1)).alias("n_reps")
    )


def task_scores(items: DataFrame) -> DataFrame:
    """AG-2: per model and task."""
    return items.groupBy("model", "task").agg(
        F.avg("score").alias("mean"),
        F.avg("auto").alias("auto_mean"),
        F.avg("judge").alias("judge_mean"),
        F.count(F.lit(1)).alias("n"),
        F.count("judge").alias("n_judged"),
    )


def composite(tasks: DataFrame, n_tasks: int | None = None, name: str = "overall") -> DataFrame:
    """AG-3 with n_tasks: null unless every task has a mean. AG-4 without: mean of the tasks present."""
    mean = F.avg("mean")
    if n_tasks is not None:
        mean = F.when(F.count("mean") == n_tasks, mean)
    return tasks.groupBy("model").agg(mean.alias(name), F.count("mean").alias("n_tasks"))


def rank_models(scores: DataFrame, by: str, key: str = "model", out: str = "rank") -> DataFrame:
    """WN-2: 1 is best; ties go to the smaller key, nulls come last. One row per model, so one task may order them."""
    return scores.withColumn(out, F.row_number().over(Window.orderBy(F.desc_nulls_last(by), key)))


def headline(tasks: DataFrame, groups: DataFrame, ceiling: float = 0.95, n_top: int = 3) -> DataFrame:
    """AG-23, SNK-5: key, value: the scalars of a report, as a relation that sinks.macros prints.

    tasks: model, task, mean, n. groups: model, grp. By task: leader, smallest, largest, mean, population sd, models at the ceiling, items, the
    leader's lead, and by group the same extremes and the gap between the groups' means; over all tasks: the composite's
    leader, its first n_top, extremes, spread, sd and each group's best. Leaders are the model's number; ties go to the smaller."""
    own = tasks.join(F.broadcast(groups), "model", "left")
    overall = composite(tasks).select("model", F.lit(None).cast("int").alias("task"), F.col("overall").alias("mean"), F.lit(None).cast("long").alias("n")).join(F.broadcast(groups), "model", "left")
    rows = own.select("model", F.col("task").cast("int").alias("task"), "mean", "n", "grp").unionByName(overall.select("model", "task", "mean", "n", "grp")).where("mean IS NOT NULL")
    of = F.coalesce(F.concat(F.lit("task"), F.col("task").cast("string")), F.lit("overall"))
    best = lambda c=F.lit(True): F.max_by("model", F.when(c, F.struct("mean", -F.col("model")))).cast("double")
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("mean")).alias("m"), "model"))), 1, n_top)  # a row a model
    figures = {
        "leader": best(), "min": F.min("mean"), "max": F.max("mean"), "mean": F.avg("mean"), "sd": F.stddev_pop("mean"), "spread": F.max("mean") - F.min("mean"), "at_ceiling": F.count_if(F.col("mean") >= ceiling).cast("double"),
        "models": F.count(F.lit(1)).cast("double"), "items": F.max("n").cast("double"),
    }
    g = rows.groupBy(of.alias("of")).agg(*[v.alias(k) for k, v in figures.items()], top.alias("top"))
    g = g.withColumn("lead", -F.get("top", F.lit(0))["m"] + F.get("top", F.lit(1))["m"]).withColumns({f"place{k + 1}": F.get("top", F.lit(k))["model"].cast("double") for k in range(n_top)})
    names = [*figures, "lead", *[f"place{k + 1}" for k in range(n_top)]]
    out = g.select(F.explode(F.array(*[F.struct(F.concat("of", F.lit(f"_{k}")).alias("key"), F.col(k).alias("value")) for k in names])).alias("r")).select("r.*")
    by = rows.where("grp IS NOT NULL").groupBy(of.alias("of"), "grp").agg(F.min("mean").alias("min"), F.max("mean").alias("max"), F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("sd"), best().alias("leader"), F.count_if(F.col("mean") >= ceiling).cast("double").alias("at_ceiling"))
    out = out.unionByName(by.select(F.explode(F.array(*[F.struct(F.concat_ws("_", "of", "grp", F.lit(k)).alias("key"), F.col(k).alias("value")) for k in ("min", "max", "mean", "sd", "leader", "at_ceiling")])).alias("r")).select("r.*"))
    gap = by.groupBy("of").agg((F.max("mean") - F.min("mean")).alias("gap"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return out.unionByName(gap.select(F.concat("of", F.lit("_gap")).alias("key"), F.col("gap").alias("value"))).where("value IS NOT NULL")
