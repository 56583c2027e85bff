"""Means of doubles are added up in the table's order, whatever the splits: their ranks and signs are those of the SQL on one thread."""

import os

import duckdb
import pytest

from gaugeworks.operators import significance
from gaugeworks.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stacked(tmp_path_factory):
    """The lines 40 times over, in row groups that Spark reads in many splits."""
    d = tmp_path_factory.mktemp("stacked")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"COPY (SELECT l.* FROM range(40), '{SF}/lineitem.parquet' l) TO '{d}/lineitem.parquet' (FORMAT parquet, ROW_GROUP_SIZE 10240)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{d}/lineitem.parquet'")
    return con, str(d)


@pytest.mark.parametrize("name", ["auto_vs_judge", "judge_reliability", "pairwise_tests", "wilcoxon_signed_z", "wilcoxon_stat"])
def test_means_in_the_order_of_rows(spark, stacked, name):
    con, d = stacked
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = catalogue.QUERIES[name](spark, d)
        columns = sorted(df.columns)
        got = {tuple(f"{float(v):.6g}" if not isinstance(v, str) else v for v in r) for r in df.select(*columns).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    cur = con.execute(catalogue.SQL[name])
    at = [[c[0] for c in cur.description].index(c) for c in columns]
    assert got == {tuple(f"{float(r[i]):.6g}" if not isinstance(r[i], str) else r[i] for i in at) for r in cur.fetchall()}


def test_of_tied_lines_the_first_counts(spark, tmp_path):
    """Two files, the second with all lines again and other quantities, so larger and read first: seq leaves open which of two is the last, the place does not."""
    con = duckdb.connect(config={"threads": 1})
    (tmp_path / "lineitem.parquet").mkdir()
    con.execute(f"COPY (FROM '{SF}/lineitem.parquet' WHERE l_orderkey % 3 > 0) TO '{tmp_path}/lineitem.parquet/a.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * REPLACE (51 - l_quantity AS l_quantity) FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet/b.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = {(r.model, r.item, r.task, round(r.score, 6), round(r.auto, 6), r.n_reps) for r in catalogue.QUERIES["judged_item_scores"](spark, str(tmp_path)).collect()}
    want = con.execute(f"SELECT model, item, task, score, auto, n_reps FROM ({catalogue.SQL['judged_item_scores']})").fetchall()
    assert len(got) == len(want) and got == {(m, i, t, round(s, 6), round(a, 6), n) for m, i, t, s, a, n in want}


def test_segments_keep_the_digits_of_their_length(spark, tmp_path):
    """Events of large ids: a length is the value, not the difference of two large times."""
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE TABLE lineitem AS FROM '{SF}/lineitem.parquet'")
    con.execute(f"CREATE TABLE events AS SELECT * REPLACE (event_id + 165 * 10000000000000 AS event_id) FROM '{SF}/events.parquet'")
    for t in ("lineitem", "events"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got = sorted(tuple(r) for r in catalogue.QUERIES["run_costs"](spark, str(tmp_path)).select("model", "gpu_hours", "usd_per_100", "kwh_gross").collect())
    assert got == con.execute(f"SELECT model, gpu_hours, usd_per_100, kwh_gross FROM ({catalogue.SQL['run_costs']}) ORDER BY 1").fetchall()


def unsteady(df, *columns):
    """df with columns that differ in their last digits each time they are computed, as means of doubles do on a cluster."""
    import random

    from pyspark.sql import functions as F

    shaken = F.udf(lambda x: None if x is None else x + random.random() * 1e-9, "double").asNondeterministic()
    return df.withColumns({c: shaken(c) for c in columns})


def test_auto_against_judge_keeps_all_rows(spark):
    rows = spark.sql("SELECT id % 10 AS model, id AS item, 3L AS task, double(pmod(id * 37, 101)) AS auto, double(pmod(id * 53, 103)) AS judge FROM range(100)")
    got = {r.level: (r.n, r.rho is not None) for r in significance.auto_against_judge(unsteady(rows, "auto", "judge")).collect()}
    assert got == {"answers": (100, True), "models": (10, True)}


def test_sensitivities_keep_all_models(spark):
    rows = spark.sql("SELECT id % 25 AS model, id AS item, id % 2 AS task, sqrt(pmod(id * 37, 501)) AS score, sqrt(pmod(id * 53, 503)) AS auto, sqrt(pmod(id * 71, 509)) AS judge FROM range(500)")
    own = lambda d: {(r.name, round(r.rho, 9), r.max_shift, r.leader_same, r.top_same) for r in significance.sensitivities(d, [1]).collect()}
    assert own(unsteady(rows, "score", "auto", "judge")) == own(rows)
