"""One SQL text for Spark and for DuckDB: {table} stands for a table, a few function names differ."""

import re

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.plans.fact import FACT_SQL, FINAL_SQL, table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: name: (Spark, DuckDB)
NAMES = {
    "PCT": ("percentile", "quantile_cont"),
    "VARS": ("var_samp", "var_samp"),
    "SECONDS": ("unix_micros_ntz", "epoch"),
    "LEN": ("size", "len"),
    "STRPOS": ("instr", "strpos"),
    "JOIN_LIST": ("array_join", "array_to_string"),
    "EXTRACT_ALL": ("regexp_extract_all", "regexp_extract_all"),
}
FACT = "fact AS (" + FACT_SQL.replace("FROM lineitem", "FROM {lineitem}") + f"), item_score AS (SELECT model, item, task, avg({FINAL_SQL}) AS score, avg(auto) AS auto, avg(judge) AS judge, count(*) AS n_reps FROM fact GROUP BY model, item, task), task_score AS (SELECT model, task, avg(score) AS mean, count(*) AS n FROM item_score GROUP BY model, task)"


class Dual:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name: str, doc: str, text: str, duck: dict[str, str] | None = None, spark: dict[str, str] | None = None) -> None:
        """text is both; duck and spark replace strings for one side."""
        text = text.replace("@FACT", FACT)
        own = text
        for a, b in (spark or {}).items():
            own = own.replace(a, b)
        other = text
        for a, b in (duck or {}).items():
            other = other.replace(a, b)
        for k, (a, b) in NAMES.items():
            own, other = re.sub(rf"\b{k}\(", f"{a}(", own), re.sub(rf"\b{k}\(", f"{b}(", other)
        own = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.])", r"\1D", own)  # Spark reads 0.5 as a decimal
        used = [t for t in TABLES if f"{{{t}}}" in own]

        def run(session: SparkSession, sf_dir: str) -> DataFrame:
            return session.sql(own, **{t: table(session, sf_dir, t) for t in used})

        run.__name__, run.__doc__ = name, doc
        self.queries[name] = run
        for t in TABLES:
            other = other.replace(f"{{{t}}}", t)
        self.sql[name] = other

    def put(self, name: str, run, sql: str | None = None) -> None:
        self.queries[name] = run
        if sql:
            sql = sql.replace("@FACT", FACT)
            for t in TABLES:
                sql = sql.replace(f"{{{t}}}", t)
            self.sql[name] = sql
