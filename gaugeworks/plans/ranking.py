"""Scores to tasks to composites to rankings."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.operators.composite import composite, item_scores, rank_models, task_scores
from gaugeworks.plans.fact import FACT_SQL, FINAL_SQL, N_TASKS, fact

ITEM_CTE = f"""
fact AS ({FACT_SQL}),
item_score AS (SELECT model, item, task, avg({FINAL_SQL}) AS score, avg(auto) AS auto, avg(judge) AS judge, count(*) AS n_reps
               FROM fact GROUP BY model, item, task),
task_score AS (SELECT model, task, avg(score) AS mean, avg(auto) AS auto_mean, avg(judge) AS judge_mean, count(*) AS n, count(judge) AS n_judged
               FROM item_score GROUP BY model, task)"""


def leaderboard_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-1/2/3, WN-2: strict composites, ranked; a model without every task has no composite and ranks last."""
    overall = composite(task_scores(item_scores(fact(spark, sf_dir))), N_TASKS)
    return rank_models(overall, "overall").select("model", F.round("overall", 6).alias("overall"), "n_tasks", "rank")


QUERIES = {"leaderboard_composite": leaderboard_composite}
SQL = {
    "leaderboard_composite": f"""WITH {ITEM_CTE},
overall AS (SELECT model, CASE WHEN count(mean) = {N_TASKS} THEN avg(mean) END AS overall, count(mean) AS n_tasks FROM task_score GROUP BY model)
SELECT model, round(overall, 6) AS overall, n_tasks, CAST(row_number() OVER (ORDER BY overall DESC NULLS LAST, model) AS INTEGER) AS rank FROM overall""",
}
