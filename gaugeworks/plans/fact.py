"""The canonical per-item fact: one row per repetition of 25 models x 255 items x 8 tasks, derived from lineitem."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_TASKS = 8

FACT_SQL = """
SELECT l_suppkey % 25 AS model, l_partkey % 255 AS item, (l_partkey % 255) % 8 AS task,
       l_quantity / 50 AS auto,
       CASE WHEN (l_partkey % 255) % 8 IN (3, 5) THEN 1 - l_discount / 0.1 END AS judge,
       year(l_shipdate) % 3 AS judge_id, l_orderkey AS rep_key
FROM lineitem
"""

FINAL_SQL = "CASE WHEN judge IS NULL THEN auto ELSE 0.5 * auto + 0.5 * judge END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM-11 shape: model, item, task, auto, judge (null where the task has none), judge_id, rep_key, final; file and place, where the row stands."""
    item = F.col("l_partkey") % 255
    judged = (item % 8).isin(3, 5)
    out = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 25).alias("model"),
        item.alias("item"),
        (item % 8).alias("task"),
        (F.col("l_quantity") / 50).alias("auto"),
        F.when(judged, 1 - F.col("l_discount") / 0.1).alias("judge"),
        (F.year("l_shipdate") % 3).alias("judge_id"),
        F.col("l_orderkey").alias("rep_key"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.row_index").alias("place"),
    )
    return out.withColumn("final", F.when(F.col("judge").isNull(), F.col("auto")).otherwise(0.5 * F.col("auto") + 0.5 * F.col("judge")))


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of the fact (file, place kept) dealt by keys, each part in the table's order: a mean of doubles by these keys, or more, is then added up
    row by row as the table has them, so that it is the same to the last bit on any cluster. Ranks of such means and signs of their differences need that."""
    return rows.repartition(*keys).sortWithinPartitions("file", "place")
