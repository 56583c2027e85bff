"""Aggregation, ranking, agreement and research-analysis queries, each with its DuckDB twin."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeworks.operators import judging, relational, significance, timeseries
from gaugeworks.operators.composite import composite, even_sum, item_scores, rank_models, task_scores
from gaugeworks.plans.dual import Dual
from gaugeworks.plans.fact import N_TASKS, fact, in_order, table

D = Dual()
add, put = D.add, D.put

# ---- aggregation (AG) and ranking (WN, SL) -------------------------------------------------------------------------

add("item_score", "AG-1.", "WITH @FACT SELECT model, item, task, round(score, 6) AS score, round(auto, 6) AS auto, round(judge, 6) AS judge, n_reps FROM item_score")
add("task_summary", "AG-2.", "WITH @FACT SELECT model, task, round(mean, 6) AS mean, n FROM task_score")
add(
    "composite_lenient_vs_strict",
    "AG-3, AG-4: strict needs all 8 tasks, lenient takes those present; and the two groups of tasks.",
    """WITH @FACT SELECT model, round(CASE WHEN count(*) = 8 THEN avg(mean) END, 6) AS strict, round(avg(mean), 6) AS lenient,
round(avg(CASE WHEN task < 6 THEN mean END), 6) AS academic, round(avg(CASE WHEN task >= 6 THEN mean END), 6) AS coding FROM task_score GROUP BY model""",
)
add(
    "hist_grouping_sets",
    "AG-8, AG-9: history per customer segment and per priority in one pass.",
    """SELECT o_orderpriority AS tier, o_orderstatus AS model, CAST(grouping(o_orderpriority) AS BIGINT) AS g, count(*) AS calls, round(avg(o_totalprice), 4) AS mean_price
FROM {orders} GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())""",
)
add(
    "privacy_pivot",
    "AG-11.",
    "SELECT o_orderpriority AS task, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS p FROM {orders} GROUP BY o_orderpriority",
)
add(
    "served_histogram_costs",
    "AG-5, PRJ-7, PRJ-13, PRJ-17: calls, errors, spend, median, share, cost of 100 calls without errors.",
    """SELECT user_id AS model, count(*) AS calls, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors, round(sum(value), 4) AS aiu, round(PCT(value, 0.5), 6) AS median_s,
count(DISTINCT event_type) AS kinds, round(sum(value) / nullif(count(*) - count(CASE WHEN event_type = 'error' THEN 1 END), 0), 9) AS usd_per_100 FROM {events} GROUP BY user_id""",
)
add(
    "served_counts",
    "RM-11: who served how often, and substitutions.",
    "SELECT user_id AS requested, event_type AS served, count(*) AS n, max(event_id) AS last_id FROM {events} GROUP BY user_id, event_type",
)
add(
    "study_cost_rollup",
    "AG-7, SRC-30: every call by stage with a total, no latest-wins.",
    "SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS aiu FROM {events} GROUP BY ROLLUP (event_type)",
)
add(
    "discrimination_spread",
    "AG-13: spread of models within tasks, population deviation.",
    "WITH @FACT SELECT task, round(min(mean), 6) AS lo, round(max(mean), 6) AS hi, round(stddev_pop(mean), 6) AS sd, count(CASE WHEN mean >= 0.5 THEN 1 END) AS n_high, round(avg(CASE WHEN model < 15 THEN mean END) - avg(CASE WHEN model >= 15 THEN mean END), 6) AS gap FROM task_score GROUP BY task",
)
add(
    "diagnostics",
    "AG-12: conditional means and rates of a model over tasks, some with null as 0.",
    "WITH @FACT SELECT model, round(avg(CASE WHEN task = 0 THEN score END), 6) AS t0, round(avg(CASE WHEN task = 3 THEN coalesce(judge, 0) END), 6) AS j3, round(sum(CASE WHEN task = 5 AND judge > 0.5 THEN 1 ELSE 0 END) * 1.0 / nullif(sum(CASE WHEN task = 5 THEN 1 ELSE 0 END), 0), 6) AS rate5 FROM item_score GROUP BY model",
)
add(
    "plan_estimate",
    "AG-10: price of a call from the model's history, else its tier's, else a default; todo times price.",
    """WITH hist AS (SELECT user_id % 40 AS model, avg(value) AS per_call FROM {events} WHERE event_type = 'purchase' GROUP BY user_id % 40),
tier AS (SELECT (user_id % 40) % 4 AS tier, avg(value) AS per_call FROM {events} WHERE event_type = 'view' GROUP BY (user_id % 40) % 4),
plan AS (SELECT user_id % 40 AS model, (user_id % 40) % 4 AS tier, count(*) AS todo FROM {events} WHERE event_type = 'error' GROUP BY user_id % 40, (user_id % 40) % 4)
SELECT plan.model, todo, round(todo * coalesce(hist.per_call, tier.per_call, 1.0), 4) AS estimate FROM plan LEFT JOIN hist ON plan.model = hist.model LEFT JOIN tier ON plan.tier = tier.tier""",
)
add(
    "headline_numbers",
    "AG-23, SNK-5: scalars as key and value.",
    """WITH @FACT, o AS (SELECT model, avg(mean) AS overall FROM task_score GROUP BY model)
SELECT 'best' AS key, round(max(overall), 6) AS value FROM o UNION ALL SELECT 'worst', round(min(overall), 6) FROM o UNION ALL SELECT 'models', CAST(count(*) AS DOUBLE) FROM o
UNION ALL SELECT 'spread', round(max(overall) - min(overall), 6) FROM o""",
)
add(
    "status_counts",
    "AG-28, AG-22.",
    "SELECT o_orderstatus AS status, count(*) AS n, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS n_high FROM {orders} GROUP BY o_orderstatus",
)
add(
    "average_ranks",
    "WN-3, ST-7: tied values share their mean rank.",
    "SELECT c_custkey, c_nationkey AS v, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2 AS avg_rank FROM {customer}",
)
add(
    "rank_shift_sensitivity",
    "WN-4, ST-20: ranking by all scores against automatic ones only.",
    """WITH @FACT, a AS (SELECT model, row_number() OVER (ORDER BY avg(mean) DESC, model) AS r FROM task_score GROUP BY model),
t2 AS (SELECT model, task, avg(auto) AS mean FROM item_score GROUP BY model, task), b AS (SELECT model, row_number() OVER (ORDER BY avg(mean) DESC, model) AS r FROM t2 GROUP BY model)
SELECT a.model, CAST(a.r AS BIGINT) AS rank_all, CAST(b.r AS BIGINT) AS rank_auto, CAST(abs(a.r - b.r) AS BIGINT) AS shift FROM a JOIN b ON a.model = b.model""",
)
add(
    "top_k_leaders",
    "SL-1, SL-4: the best four and who leads.",
    "WITH @FACT SELECT model, round(avg(mean), 6) AS overall FROM task_score GROUP BY model ORDER BY avg(mean) DESC, model LIMIT 4",
)
add(
    "sequential_ids",
    "WN-10, RM-3.",
    "SELECT p_partkey, LABEL AS id FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM {part}) AS t",
    duck={"LABEL": "printf('H%03d', k)"},
    spark={"LABEL": "format_string('H%03d', k)"},
)
add(
    "round_robin_order",
    "WN-9: first of each group, then second ones.",
    """SELECT l_orderkey AS event_id, CAST(turn AS BIGINT) AS turn, CAST(row_number() OVER (PARTITION BY turn ORDER BY g, l_orderkey) AS BIGINT) AS place FROM (
SELECT event_id AS l_orderkey, user_id AS g, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM {events}) AS t""",
)
add(
    "running_budget_stop",
    "SM-4: calls begun while the spend before was under 1000.",
    """SELECT event_id, user_id, round(before, 6) AS spent_before FROM (SELECT event_id, user_id, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {events}) AS t WHERE before < 1000""",
)
add(
    "daily_cap",
    "SM-5: the first 50 calls of a day.",
    "SELECT event_id, CAST(k AS BIGINT) AS nth FROM (SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS k FROM {events}) AS t WHERE k <= 50",
)
add(
    "growth_ma_cagr",
    "WN-7, RA-27: growth in percent, mean of three, compound rate.",
    """WITH m AS (SELECT date_trunc('month', o_orderdate) AS d, sum(o_totalprice) AS v FROM {orders} GROUP BY date_trunc('month', o_orderdate)),
w AS (SELECT d, v, lag(v) OVER (ORDER BY d) AS p, CASE WHEN row_number() OVER (ORDER BY d) >= 3 THEN avg(v) OVER (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS ma3,
first_value(v) OVER (ORDER BY d) AS v0, row_number() OVER (ORDER BY d) - 1 AS k FROM m)
SELECT CAST(d AS DATE) AS month, round((v - p) * 100 / p, 6) AS growth_pct, round(ma3, 4) AS ma3, round(CASE WHEN k > 0 THEN power(v / v0, 1.0 / k) - 1 END, 8) AS cagr FROM w""",
)
add(
    "islands",
    "RM-7: runs of one event type per user.",
    """WITH a AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS c FROM {events})
SELECT user_id, event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS island FROM a""",
)

# ---- agreement, votes, tests ---------------------------------------------------------------------------------------

RATING_SQL = "ratings AS (SELECT model, item, judge_id, avg(judge) AS rating FROM fact WHERE judge IS NOT NULL GROUP BY model, item, judge_id)"


def ratings(spark, sf_dir):
    rated = in_order(fact(spark, sf_dir).where("judge IS NOT NULL"), "model", "item")
    return rated.groupBy("model", "item", "judge_id").agg(F.avg("judge").alias("rating"))


def leniency_offsets(spark, sf_dir):
    """AG-15, WN-14."""
    return judging.leniency(ratings(spark, sf_dir), 3, ["model", "item"]).select("judge_id", F.round("offset", 6).alias("offset"), "n")


OFFSET_SQL = f"{RATING_SQL}, d AS (SELECT judge_id, rating - avg(rating) OVER (PARTITION BY model, item) AS dev, count(*) OVER (PARTITION BY model, item) AS k FROM ratings), off AS (SELECT judge_id, avg(dev) AS o, count(*) AS n FROM d WHERE k = 3 GROUP BY judge_id)"
put("leniency_offsets", leniency_offsets, f"WITH @FACT, {OFFSET_SQL} SELECT judge_id, round(o, 6) AS \"offset\", n FROM off")


def calibrated_score(spark, sf_dir):
    """JN-3, JN-4, PRJ-12: mean of clamped, calibrated ratings per answer."""
    r = ratings(spark, sf_dir)
    own = judging.calibrated(r, judging.leniency(r, 3, ["model", "item"]))
    return own.groupBy("model", "item").agg(F.round(F.avg("calibrated"), 6).alias("judge"), F.count(F.lit(1)).alias("n"))


put("calibrated_score", calibrated_score, f"WITH @FACT, {OFFSET_SQL} SELECT model, item, round(avg(least(1, greatest(0, rating - coalesce(o, 0)))), 6) AS judge, count(*) AS n FROM ratings LEFT JOIN off USING (judge_id) GROUP BY model, item")


def votes(spark, sf_dir):
    """Units of five events in order of id, users as coders; a user's vote in a unit is the type of most of its events there, ties to the smaller."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 5).alias("item"), F.col("user_id").alias("coder"), "event_type")
    return judging.majority(e, ["item", "coder"], "event_type", 1).select("item", "coder", F.col("label").alias("event_type"))


VOTES_SQL = "votes AS (SELECT item, coder, event_type FROM (SELECT item, coder, event_type, row_number() OVER (PARTITION BY item, coder ORDER BY c DESC, event_type) AS k FROM (SELECT event_id // 5 AS item, user_id AS coder, event_type, count(*) AS c FROM {events} GROUP BY ALL) AS e) AS t WHERE k = 1)"
TOP_SQL = "c AS (SELECT item, event_type, count(*) AS c FROM votes GROUP BY item, event_type), top AS (SELECT item, CAST(sum(c) AS BIGINT) AS n_votes, max(c) AS top FROM c GROUP BY item), lab AS (SELECT item, min(event_type) AS first FROM c JOIN top USING (item) WHERE c = top GROUP BY item)"


def majority_vote(spark, sf_dir):
    """AG-17."""
    return judging.majority(votes(spark, sf_dir), ["item"], "event_type", 3)


put("majority_vote", majority_vote, f"WITH {VOTES_SQL}, {TOP_SQL} SELECT item, n_votes, top, CASE WHEN top >= 3 THEN first END AS label FROM top JOIN lab USING (item)")


def agreement_levels(spark, sf_dir):
    """AG-19."""
    return judging.agreement_levels(votes(spark, sf_dir), ["item"], "event_type", 5).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


put("agreement_levels", agreement_levels, f"WITH {VOTES_SQL}, {TOP_SQL} SELECT CASE WHEN top = 5 THEN 'unanimous' WHEN top * 2 > 5 THEN 'majority' ELSE 'none' END AS level, count(*) AS n FROM top WHERE n_votes = 5 GROUP BY 1")


def panel_votes(spark, sf_dir):
    """AG-18: coders in five families; a family's panel is the coders of the others."""
    v = votes(spark, sf_dir).withColumn("family", (F.col("coder") % 5).cast("string")).select("item", "event_type", "family")
    return judging.panels(v, v.select("family").distinct(), ["item"], "event_type", 3).where("label IS NOT NULL").groupBy("panel", "label").agg(F.count(F.lit(1)).alias("n"))


put(
    "panel_votes",
    panel_votes,
    f"""WITH {VOTES_SQL}, p AS (SELECT item, event_type, CAST(b.family AS VARCHAR) AS panel FROM votes a JOIN (SELECT DISTINCT coder % 5 AS family FROM votes) b ON a.coder % 5 <> b.family UNION ALL SELECT item, event_type, '*' FROM votes),
c AS (SELECT item, panel, event_type, count(*) AS c FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item, panel ORDER BY c DESC, event_type) AS k FROM c)
SELECT panel, event_type AS label, count(*) AS n FROM r WHERE k = 1 AND c >= 3 GROUP BY panel, event_type""",
)


def alpha(level):
    def run(spark, sf_dir):
        v = votes(spark, sf_dir)
        v = v.withColumn("v", F.col("event_type") if level == "nominal" else F.length("event_type").cast("double"))
        return judging.krippendorff(v, "item", "coder", "v", level).select(F.round("alpha", 8).alias("alpha"), "n_pairable")

    run.__name__ = f"krippendorff_{level}"
    value = "event_type" if level == "nominal" else "CAST(length(event_type) AS DOUBLE)"
    delta = {"nominal": "1.0", "interval": "power(a.v - b.v, 2)", "ordinal": "power((SELECT sum(n) FROM m WHERE m.v BETWEEN least(a.v, b.v) AND greatest(a.v, b.v)) - (a.n + b.n) / 2.0, 2)"}[level]
    put(
        run.__name__,
        run,
        f"""WITH {VOTES_SQL}, v AS (SELECT item, coder, {value} AS v FROM votes), k AS (SELECT item, count(*) AS m FROM v GROUP BY item HAVING count(*) > 1), u AS (SELECT v.*, m FROM v JOIN k USING (item)),
m AS (SELECT v, count(*) AS n FROM u GROUP BY v), o AS (SELECT a.v AS x, b.v AS y, sum(1.0 / (a.m - 1)) AS o FROM u a JOIN u b ON a.item = b.item AND a.coder <> b.coder GROUP BY 1, 2),
cells AS (SELECT a.v AS x, b.v AS y, a.n * b.n AS e, {delta} AS d FROM m a, m b WHERE a.v <> b.v)
SELECT round(1 - ((SELECT sum(n) FROM m) - 1) * sum(coalesce(o, 0) * d) / sum(e * d), 8) AS alpha, CAST((SELECT sum(n) FROM m) AS BIGINT) AS n_pairable FROM cells LEFT JOIN o USING (x, y)""",
    )


for _level in ("nominal", "interval", "ordinal"):
    alpha(_level)

add(
    "spearman_rho",
    "ST-14: Pearson of average ranks.",
    """WITH p AS (SELECT c_custkey, c_acctbal AS x, sum(o_totalprice) AS y FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey, c_acctbal),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM p)
SELECT count(*) AS n, round(corr(rx, ry), 8) AS rho FROM r""",
)
add(
    "pearson_by_segment",
    "ST-13: null below three rows.",
    "SELECT p_brand, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(p_size, p_retailprice) END, 8) AS r FROM {part} GROUP BY p_brand",
)
PAIR = """WITH @FACT, t AS (SELECT model, row_number() OVER (ORDER BY avg(mean) DESC, model) AS r FROM task_score GROUP BY model),
s AS (SELECT item, t.model, r, score FROM item_score JOIN t ON item_score.model = t.model WHERE r <= 6),
pair AS (SELECT a.model AS a, b.model AS b, a.score - b.score AS d FROM s a JOIN s b ON a.item = b.item AND a.r < b.r)"""
add(
    "pairwise_top6",
    "JN-7, SO-2, ST-19: pairs of the six best over common items.",
    PAIR + " SELECT a AS model_a, b AS model_b, count(*) AS n, round(avg(d), 6) AS diff, round(stddev_samp(d), 6) AS sd FROM pair GROUP BY a, b",
)
add(
    "sign_counts",
    "ST-6: wins, losses and ties.",
    PAIR + " SELECT a AS model_a, b AS model_b, count(CASE WHEN d > 0 THEN 1 END) AS wins, count(CASE WHEN d < 0 THEN 1 END) AS losses, count(CASE WHEN d = 0 THEN 1 END) AS ties FROM pair GROUP BY a, b",
)
RANKS = """, nz AS (SELECT * FROM pair WHERE d <> 0), rk AS (SELECT a, b, d, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2 AS r,
count(*) OVER (PARTITION BY a, b, abs(d)) AS t FROM nz), agg AS (SELECT a, b, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w, sum(t * t - 1) AS tie FROM rk GROUP BY a, b)"""
add(
    "wilcoxon_stat",
    "ST-9: zeros dropped, average ranks, ties in the variance, continuity 0.5.",
    PAIR + RANKS + " SELECT a AS model_a, b AS model_b, n, w AS w_plus, round((abs(w - n * (n + 1) / 4.0) - 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tie / 48.0), 6) AS z FROM agg",
)
add(
    "wilcoxon_signed_z",
    "RA-12: the same ranks, signed z without continuity.",
    PAIR + RANKS + " SELECT a AS model_a, b AS model_b, n, w AS w_plus, n * (n + 1) / 2.0 - w AS w_minus, round((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tie / 48.0), 6) AS z FROM agg",
)
add(
    "holm_adjust",
    "WN-5, ST-10: running maximum of stepped-down p.",
    """WITH p AS (SELECT o_orderpriority AS g, o_custkey AS k, min(o_totalprice) / 1000000 AS p FROM {orders} GROUP BY o_orderpriority, o_custkey),
r AS (SELECT g, k, p, least(1.0, (count(*) OVER (PARTITION BY g) - row_number() OVER (PARTITION BY g ORDER BY p, k) + 1) * p) AS s FROM p)
SELECT g, k, round(max(s) OVER (PARTITION BY g ORDER BY p, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS p_holm FROM r""",
)


def pareto_front(spark, sf_dir):
    """JN-17, ST-16."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    return relational.pareto_front(p, "p_retailprice", "p_size").select("p_partkey", F.round("p_retailprice", 4).alias("p_retailprice"), "p_size")


put(
    "pareto_front",
    pareto_front,
    "SELECT p_partkey, round(p_retailprice, 4) AS p_retailprice, p_size FROM {part} a WHERE NOT EXISTS (SELECT 1 FROM {part} b WHERE b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))",
)

# ---- bootstrap (ST-3, ST-17, ST-18) ---------------------------------------------------------------------------------

BOOT = f"""WITH @FACT, it AS (SELECT DISTINCT task, item FROM item_score), pl AS (SELECT task, item, row_number() OVER (PARTITION BY task ORDER BY item) - 1 AS pos, count(*) OVER (PARTITION BY task) AS n FROM it),
cells AS (SELECT pl.*, b FROM pl, (SELECT unnest(range(0, {{draws}})) AS b)), drawn AS (SELECT c.b, c.task, pl.item FROM {judging.RESAMPLE_SQL} c JOIN pl ON pl.task = c.task AND pl.pos = c.pick),
pt AS (SELECT b, model, d.task, avg(score) AS mean FROM drawn d JOIN item_score s ON s.task = d.task AND s.item = d.item GROUP BY ALL), ov AS (SELECT b, model, avg(mean) AS overall FROM pt GROUP BY ALL)"""
RANK_DRAWS, CI_DRAWS = 1000, 2000


def boot_scores(spark, sf_dir):
    return item_scores(fact(spark, sf_dir)).select("model", "item", "task", "score")


def rank_bootstrap(spark, sf_dir):
    """ST-18: chance of rank 1, median rank, rank interval, difference to the observed leader and its interval, by floor index."""
    s = boot_scores(spark, sf_dir)
    g = judging.behind_leader(judging.rank_bootstrap(s, RANK_DRAWS, 3), s).groupBy("model")
    return g.agg(
        F.round(F.avg((F.col("rank") == 1).cast("int")), 6).alias("p_first"),
        F.percentile("rank", 0.5).alias("median_rank"),
        judging.floor_quantile("rank", 0.025).cast("long").alias("lo"),
        judging.floor_quantile("rank", 0.975).cast("long").alias("hi"),
        F.round(F.first("diff"), 6).alias("diff"),
        F.round(judging.floor_quantile("drawn_diff", 0.025), 6).alias("diff_lo"),
        F.round(judging.floor_quantile("drawn_diff", 0.975), 6).alias("diff_hi"),
    )


def _boot_sql(tail, draws):
    return (BOOT + tail).replace("{cells}", "cells").replace("{seed}", "3").replace("{draws}", str(draws))


put(
    "rank_bootstrap",
    rank_bootstrap,
    _boot_sql(
        """, r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY overall DESC, model) AS rank FROM ov),
seen AS (SELECT model, avg(mean) AS seen FROM task_score GROUP BY model), lead AS (SELECT model AS leader, seen AS best FROM seen ORDER BY seen DESC, model LIMIT 1),
dd AS (SELECT r.*, x.overall - r.overall AS drawn FROM r JOIN r x ON x.b = r.b AND x.model = (SELECT leader FROM lead))
SELECT dd.model, round(avg(CASE WHEN rank = 1 THEN 1 ELSE 0 END), 6) AS p_first, quantile_cont(rank, 0.5) AS median_rank, list_sort(list(rank))[CAST(floor(0.025 * (count(*) - 1)) AS INT) + 1] AS lo, list_sort(list(rank))[CAST(floor(0.975 * (count(*) - 1)) AS INT) + 1] AS hi,
round(any_value((SELECT best FROM lead) - seen), 6) AS diff, round(list_sort(list(drawn))[CAST(floor(0.025 * (count(*) - 1)) AS INT) + 1], 6) AS diff_lo, round(list_sort(list(drawn))[CAST(floor(0.975 * (count(*) - 1)) AS INT) + 1], 6) AS diff_hi
FROM dd JOIN seen USING (model) GROUP BY dd.model""",
        RANK_DRAWS,
    ),
)


def stratified_bootstrap_ci(spark, sf_dir):
    """ST-17: interval of the composite by linear percentiles."""
    drawn = judging.rank_bootstrap(boot_scores(spark, sf_dir), CI_DRAWS, 3)
    return drawn.groupBy("model").agg(F.round(F.percentile("overall", 0.025), 6).alias("lo"), F.round(F.percentile("overall", 0.975), 6).alias("hi"))


put("stratified_bootstrap_ci", stratified_bootstrap_ci, _boot_sql(" SELECT model, round(quantile_cont(overall, 0.025), 6) AS lo, round(quantile_cont(overall, 0.975), 6) AS hi FROM ov GROUP BY model", CI_DRAWS))


def bootstrap_ci(spark, sf_dir):
    """ST-3: interval of a model's item scores in each task, the draws of a seeded generator."""
    return judging.seeded_bootstrap_ci(item_scores(fact(spark, sf_dir)), ["model", "task"], "score", "item")


put("bootstrap_ci", bootstrap_ci)

# ---- joins ---------------------------------------------------------------------------------------------------------


def latest_record_wins(spark, sf_dir):
    """SRC-5: an error event is a failed record."""
    e = table(spark, sf_dir, "events")
    return relational.latest_wins(e, ["user_id"], "event_id", F.col("event_type") == "error").select("user_id", "event_id", "event_type")


put("latest_record_wins", latest_record_wins, "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, event_id DESC) AS k FROM {events}) WHERE k = 1")


def todo_anti_join(spark, sf_dir):
    """JN-5: nations x part types x two repetitions not done; done is what suppliers have of the part of their number."""
    m = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("model"))
    i = table(spark, sf_dir, "part").select(F.col("p_type").alias("item")).distinct()
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    done = s.join(p, s["s_suppkey"] == p["p_partkey"]).select(F.col("s_nationkey").alias("model"), F.col("p_type").alias("item"), (F.col("p_size") % 2).cast("int").alias("rep"))
    return relational.todo(m, i, 2, done, ["model", "item", "rep"])


put(
    "todo_anti_join",
    todo_anti_join,
    "SELECT n_nationkey AS model, item, CAST(rep AS INTEGER) AS rep FROM {nation}, (SELECT DISTINCT p_type AS item FROM {part}), (SELECT unnest([0, 1]) AS rep) WHERE NOT EXISTS (SELECT 1 FROM {supplier} JOIN {part} ON s_suppkey = p_partkey WHERE s_nationkey = n_nationkey AND p_type = item AND p_size % 2 = rep)",
)


def fingerprint_reuse_split(spark, sf_dir):
    """JN-6, PRJ-2: texts whose fingerprint was scored before, that is, labelled."""
    d = table(spark, sf_dir, "documents").withColumn("answer_hash", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16))
    scored = d.join(table(spark, sf_dir, "labels"), "doc_id").select("answer_hash", F.col("quality").alias("score"))
    reuse, again = relational.split_reuse(d.select("doc_id", "answer_hash"), scored, ["answer_hash"])
    return reuse.withColumn("reuse", F.lit(True)).unionByName(again.withColumn("reuse", F.lit(False)))


put("fingerprint_reuse_split", fingerprint_reuse_split, "WITH d AS (SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS answer_hash FROM {documents}) SELECT doc_id, answer_hash, answer_hash IN (SELECT answer_hash FROM d JOIN {labels} USING (doc_id)) AS reuse FROM d")


def manifest_full_diff(spark, sf_dir):
    """JN-10, SO-3: items and documents as manifests of two releases, by number and SHA-256."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.sha2("text", 256).alias("h"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("h"))
    return relational.full_diff(b, d, "id", "h")


put(
    "manifest_full_diff",
    manifest_full_diff,
    "WITH a AS (SELECT item_id AS id, sha256(text) AS h FROM {benchmark}), b AS (SELECT doc_id AS id, sha256(text) AS h FROM {documents}) SELECT id, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'extra' ELSE 'changed' END AS change FROM a FULL JOIN b USING (id) WHERE a.h IS DISTINCT FROM b.h",
)


def label_fallback(spark, sf_dir):
    """JN-11."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("item"), "lang", "doc_id")
    l = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("item"), F.when(F.col("n_nationkey") % 2 == 0, "en").otherwise("*").alias("family"), F.col("n_name").alias("label"))
    return relational.with_fallback(rows, l, "item", "lang").select("doc_id", "item", "lang", "label")


put(
    "label_fallback",
    label_fallback,
    "WITH l AS (SELECT n_nationkey AS item, CASE WHEN n_nationkey % 2 = 0 THEN 'en' ELSE '*' END AS family, n_name AS label FROM {nation}) SELECT doc_id, doc_id % 50 AS item, lang, coalesce(a.label, b.label) AS label FROM {documents} LEFT JOIN l a ON a.item = doc_id % 50 AND a.family = lang LEFT JOIN l b ON b.item = doc_id % 50 AND b.family = '*'",
)


def citation_gate(spark, sf_dir):
    """JN-20: cited keys against entries and their state."""
    c = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 400).alias("key"))
    e = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 5).alias("key"), (F.col("s_acctbal") > 0).alias("verified"))
    return relational.gate(c, e)


put("citation_gate", citation_gate, "WITH c AS (SELECT DISTINCT o_custkey % 400 AS key FROM {orders}), e AS (SELECT s_suppkey * 5 AS key, s_acctbal > 0 AS verified FROM {supplier}) SELECT key, CASE WHEN c.key IS NULL THEN 'unused' WHEN e.key IS NULL THEN 'unknown' WHEN verified THEN 'ok' ELSE 'unverified' END AS state FROM c FULL JOIN e USING (key)")

# ---- research analyses (RA) -----------------------------------------------------------------------------------------

add(
    "likert_descriptives",
    "RA-1: row means, centre, spread, class.",
    "SELECT CASE WHEN s < 2.6 THEN 'low' WHEN s < 3.4 THEN 'middle' ELSE 'high' END AS class, count(*) AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS sd, round(PCT(s, 0.5), 6) AS med FROM (SELECT (l_linenumber + l_quantity / 10 + l_discount * 50) / 3 AS s FROM {lineitem}) AS t GROUP BY 1",
    spark={"GROUP BY 1": "GROUP BY CASE WHEN s < 2.6 THEN 'low' WHEN s < 3.4 THEN 'middle' ELSE 'high' END"},
)
add(
    "cronbach",
    "RA-2: alpha of four items and with one left out.",
    """WITH x AS (SELECT l_linenumber * 1.0 AS a, l_quantity / 10 AS b, l_discount * 50 AS c, l_tax * 60 AS d FROM {lineitem})
SELECT round(4.0 / 3 * (1 - (VARS(a) + VARS(b) + VARS(c) + VARS(d)) / VARS(a + b + c + d)), 8) AS alpha, round(3.0 / 2 * (1 - (VARS(b) + VARS(c) + VARS(d)) / VARS(b + c + d)), 8) AS without_a, round(3.0 / 2 * (1 - (VARS(a) + VARS(b) + VARS(c)) / VARS(a + b + c)), 8) AS without_d FROM x""",
)
add("item_total_validity", "RA-3: correlation of each item with the total.", "WITH x AS (SELECT l_linenumber * 1.0 AS a, l_quantity / 10 AS b, l_discount * 50 AS c FROM {lineitem}) SELECT round(corr(a, a + b + c), 8) AS r_a, round(corr(b, a + b + c), 8) AS r_b, corr(c, a + b + c) > 0.361 AS c_valid FROM x")
add("ols_simple", "RA-5.", "SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM {lineitem}")
add(
    "student_t",
    "RA-8: pooled variance.",
    "WITH g AS (SELECT l_returnflag AS k, count(*) AS n, avg(l_quantity) AS m, VARS(l_quantity) AS v FROM {lineitem} WHERE l_returnflag IN ('A', 'R') GROUP BY l_returnflag) SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 6) AS t, a.n + b.n - 2 AS df FROM g a JOIN g b ON a.k = 'A' AND b.k = 'R'",
)
add(
    "welch_t",
    "RA-9: unequal variances, approximate degrees of freedom.",
    "WITH g AS (SELECT l_returnflag AS k, count(*) AS n, avg(l_quantity) AS m, VARS(l_quantity) AS v FROM {lineitem} WHERE l_returnflag IN ('A', 'R') GROUP BY l_returnflag) SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round(power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)), 4) AS df FROM g a JOIN g b ON a.k = 'A' AND b.k = 'R'",
)
add("paired_t", "RA-10.", "SELECT count(*) AS n, round(avg(l_tax - l_discount) / (stddev_samp(l_tax - l_discount) / sqrt(count(*))), 6) AS t FROM {lineitem}")
add(
    "mwu_u",
    "RA-11: U from average ranks, tie-corrected z with continuity.",
    """WITH x AS (SELECT CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS g, l_quantity AS v FROM {lineitem} WHERE l_returnflag IN ('A', 'R')),
r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r, count(*) OVER (PARTITION BY v) AS t FROM x),
s AS (SELECT sum(CASE WHEN g = 1 THEN r END) AS r1, sum(g) * 1.0 AS n1, count(*) - sum(g) * 1.0 AS n2, sum(t * 1.0 * t - 1) AS tie, count(*) * 1.0 AS n FROM r)
SELECT r1 - n1 * (n1 + 1) / 2 AS u, round(r1 / n1, 6) AS mean_rank, round((abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - tie / (n * (n - 1)))), 6) AS z FROM s""",
    spark={"sum(g) * 1.0": "CAST(sum(g) AS DOUBLE)", "t * 1.0 * t": "CAST(t AS DOUBLE) * t", "count(*) * 1.0 AS n": "CAST(count(*) AS DOUBLE) AS n"},
    duck={"sum(g) * 1.0": "CAST(sum(g) AS DOUBLE)", "t * 1.0 * t": "CAST(t AS DOUBLE) * t", "count(*) * 1.0 AS n": "CAST(count(*) AS DOUBLE) AS n"},
)
ANOVA = "WITH g AS (SELECT l_returnflag AS k, CAST(count(*) AS DOUBLE) AS n, avg(l_quantity) AS m, VARS(l_quantity) AS v FROM {lineitem} GROUP BY l_returnflag), t AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m, count(*) AS k FROM g)"
add("anova_oneway", "RA-13, RA-17: F from sums of squares, coefficient of variation.", ANOVA + " SELECT round(sum(g.n * power(g.m - t.m, 2)), 4) AS ss_between, round(sum((g.n - 1) * v), 4) AS ss_within, round((sum(g.n * power(g.m - t.m, 2)) / (max(t.k) - 1)) / (sum((g.n - 1) * v) / (max(t.n) - max(t.k))), 6) AS f, round(100 * sqrt(sum((g.n - 1) * v) / (max(t.n) - max(t.k))) / max(t.m), 6) AS cv FROM g CROSS JOIN t")
add(
    "anova_twoway",
    "RA-18, RA-19: sums of squares of two factors and their cells from one grouping-sets pass.",
    """WITH g AS (SELECT l_returnflag AS a, l_linenumber AS b, grouping(l_returnflag) AS ga, grouping(l_linenumber) AS gb, CAST(count(*) AS DOUBLE) AS n, avg(l_quantity) AS m, avg(l_quantity * l_quantity) AS q FROM {lineitem}
GROUP BY GROUPING SETS ((l_returnflag, l_linenumber), (l_returnflag), (l_linenumber), ())), t AS (SELECT m AS tm, n AS tn, q AS tq FROM g WHERE ga = 1 AND gb = 1)
SELECT CAST(ga AS BIGINT) AS ga, CAST(gb AS BIGINT) AS gb, round(sum(n * power(m - tm, 2)), 3) AS ss, count(*) AS levels, round(max(tn * (tq - tm * tm)), 2) AS ss_total FROM g CROSS JOIN t GROUP BY ga, gb""",
)
add(
    "kruskal_h",
    "RA-14: H over average ranks, corrected for ties.",
    """WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS r, count(*) OVER (PARTITION BY l_quantity) AS t FROM {lineitem}),
s AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, sum(r) AS rs FROM r GROUP BY g), c AS (SELECT sum(CAST(t AS DOUBLE) * t - 1) AS tie, CAST(count(*) AS DOUBLE) AS n FROM r)
SELECT round((12 / (max(c.n) * (max(c.n) + 1)) * sum(rs * rs / s.n) - 3 * (max(c.n) + 1)) / (1 - max(tie) / (power(max(c.n), 3) - max(c.n))), 4) AS h, count(*) - 1 AS df FROM s CROSS JOIN c""",
)
add(
    "chi_square_stat",
    "RA-15: independence, small expected counts.",
    """WITH o AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM {orders} GROUP BY o_orderstatus, o_orderpriority),
ra AS (SELECT a, sum(n) AS na FROM o GROUP BY a), rb AS (SELECT b, sum(n) AS nb FROM o GROUP BY b), t AS (SELECT sum(n) AS nt FROM o),
e AS (SELECT CAST(na AS DOUBLE) * nb / nt AS e, coalesce(n, 0) AS n FROM ra CROSS JOIN rb CROSS JOIN t LEFT JOIN o ON o.a = ra.a AND o.b = rb.b)
SELECT round(sum(power(n - e, 2) / e), 6) AS chi2, count(CASE WHEN e < 5 THEN 1 END) AS small, round(min(e), 4) AS min_expected FROM e""",
)
add("normalised_gain", "RA-16: (post - pre) / (1 - pre) per class.", "SELECT o_orderpriority AS class, count(*) AS n, round(avg(g), 6) AS gain, count(CASE WHEN g >= 0.7 THEN 1 END) AS high FROM (SELECT o_orderpriority, (post - pre) / (1 - pre) AS g FROM (SELECT o_orderpriority, (o_custkey % 60) / 100.0 AS pre, (o_custkey % 60 + o_orderkey % 40) / 100.0 AS post FROM {orders}) AS a) AS b GROUP BY o_orderpriority")
add(
    "confusion_macro_f1",
    "RA-21: per class precision, recall, F1 from the confusion matrix.",
    """WITH c AS (SELECT l_returnflag AS y, CASE WHEN l_quantity > 33 THEN 'N' WHEN l_quantity > 16 THEN 'A' ELSE 'R' END AS p, count(*) AS n FROM {lineitem} GROUP BY 1, 2),
k AS (SELECT y AS k, sum(n) AS act FROM c GROUP BY y), q AS (SELECT p AS k, sum(n) AS pre FROM c GROUP BY p), h AS (SELECT y AS k, n AS hit FROM c WHERE y = p)
SELECT k.k AS class, round(hit * 1.0 / pre, 6) AS prec, round(hit * 1.0 / act, 6) AS rec, round(2.0 * hit / (pre + act), 6) AS f1 FROM k JOIN q ON k.k = q.k JOIN h ON k.k = h.k""",
    spark={"GROUP BY 1, 2": "GROUP BY l_returnflag, CASE WHEN l_quantity > 33 THEN 'N' WHEN l_quantity > 16 THEN 'A' ELSE 'R' END"},
)
add("sus_score", "RA-22: odd items less one, even items from five, times 2.5.", "SELECT count(*) AS n, round(avg(s), 6) AS mean, round(min(s), 4) AS lo, round(max(s), 4) AS hi FROM (SELECT ((l_linenumber % 5) + (4 - l_orderkey % 5) + (l_partkey % 5) + (4 - l_suppkey % 5)) * CAST(2.5 AS DOUBLE) AS s FROM {lineitem}) AS t")
add("farm_economics", "RA-23: ratios of sums.", "SELECT l_returnflag AS farm, round(sum(l_extendedprice), 2) AS tr, round(sum(l_extendedprice * (l_tax + 0.5)), 2) AS tc, round(sum(l_extendedprice) / sum(l_extendedprice * (l_tax + 0.5)), 8) AS rc, round(sum(l_extendedprice * (l_tax + 0.5)) / sum(l_quantity), 6) AS bep FROM {lineitem} GROUP BY l_returnflag")
add("outlier_iqr", "RA-24: strictly beyond 1.5 spreads of linear quartiles.", "WITH q AS (SELECT PCT(n_chars, 0.25) AS q1, PCT(n_chars, 0.75) AS q3 FROM {documents}) SELECT doc_id, n_chars FROM {documents} CROSS JOIN q WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)")
add("missing_listwise", "RA-25: nulls, available and listwise means, listwise r.", "WITH x AS (SELECT CASE WHEN l_orderkey % 10 <> 0 THEN l_quantity END AS a, CASE WHEN l_partkey % 7 <> 0 THEN l_discount END AS b FROM {lineitem}) SELECT count(*) - count(a) AS na, count(*) - count(b) AS nb, round(avg(a), 6) AS available, round(avg(CASE WHEN b IS NOT NULL THEN a END), 6) AS listwise, round(corr(a, b), 8) AS r FROM x")
add("group_summary", "RA-26: groups with count, mean, median, spread.", "SELECT o_orderpriority AS g, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(PCT(o_totalprice, 0.5), 4) AS med, round(stddev_samp(o_totalprice), 4) AS sd FROM {orders} GROUP BY o_orderpriority")
add("sample_size", "RA-29: Slovin, proportional allocation rounded up.", "WITH n AS (SELECT count(*) AS big FROM {customer}), s AS (SELECT c_mktsegment AS g, count(*) AS ng FROM {customer} GROUP BY c_mktsegment) SELECT g, CAST(ceil(big / (1 + big * 0.0025)) AS BIGINT) AS n5, CAST(ceil(ceil(big / (1 + big * 0.0025)) * ng / big) AS BIGINT) AS own FROM s CROSS JOIN n")
add(
    "crosstab_rowpct",
    "RA-30: keep-first dedupe before nulls go, then row percentages.",
    """WITH f AS (SELECT * FROM (SELECT lower(trim(o_orderpriority)) AS a, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice) AS k FROM {orders}) AS t WHERE k = 1),
c AS (SELECT a, b, count(*) AS n FROM f WHERE b IS NOT NULL GROUP BY a, b) SELECT a, b, n, round(100.0 * n / sum(n) OVER (PARTITION BY a), 6) AS pct FROM c""",
)

# ---- through the operators: these SQL texts are DuckDB's alone ---------------------------------------------------------


def through(run):
    D.queries[run.__name__] = run


def _places(spark, sf_dir, value="score"):
    means = task_scores(item_scores(fact(spark, sf_dir)).withColumn("score", F.col(value))).groupBy("model").agg(F.avg("mean").alias("o"))
    return means.select("model", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("o"), "model")).cast("long").alias("rank"))


def top_scores(spark, sf_dir, top):
    """Item scores of the models of top, added up in the table's order: equal ones are equal in all pairs, on any cluster."""
    rows = fact(spark, sf_dir).join(F.broadcast(top.select("model")), "model", "left_semi")
    return item_scores(in_order(rows, "model", "item")).select("model", "item", "score")


def _pairs(spark, sf_dir):
    places = _places(spark, sf_dir)
    return relational.top_pairs(top_scores(spark, sf_dir, places.where("rank <= 6")), places, 6).select("model_a", "model_b", (F.col("score_a") - F.col("score_b")).alias("d"))


_BOTH = ["model_a", "model_b"]


@through
def average_ranks(spark, sf_dir):
    """WN-3, ST-7: tied values share their mean rank."""
    return significance.ranked(table(spark, sf_dir, "customer"), "c_nationkey", [], "avg_rank").select("c_custkey", F.col("c_nationkey").alias("v"), "avg_rank")


@through
def spearman_rho(spark, sf_dir):
    """ST-14: Pearson of average ranks."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    p = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(even_sum("o_totalprice").alias("y")).join(c.select("c_custkey", F.col("c_acctbal").alias("x")), "c_custkey")
    return significance.spearman(p, "x", "y", []).select("n", F.round("rho", 8).alias("rho"))


@through
def mwu_u(spark, sf_dir):
    """RA-11."""
    out = significance.mann_whitney(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "A", "R")
    return out.select("u", F.round("mean_rank", 6).alias("mean_rank"), F.round("z", 6).alias("z"))


@through
def kruskal_h(spark, sf_dir):
    """RA-14."""
    return significance.kruskal(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity").select(F.round("statistic", 4).alias("h"), F.col("df").cast("long").alias("df"))


@through
def pairwise_top6(spark, sf_dir):
    """JN-7, SO-2, ST-19: pairs of the six best over common items."""
    return _pairs(spark, sf_dir).groupBy(*_BOTH).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("diff"), F.round(F.stddev_samp("d"), 6).alias("sd"))


@through
def sign_counts(spark, sf_dir):
    """ST-6: wins, losses and ties."""
    return significance.sign_test(_pairs(spark, sf_dir), _BOTH, "d").drop("p")


@through
def wilcoxon_stat(spark, sf_dir):
    """ST-9: zeros dropped, average ranks, ties in the variance, continuity 0.5."""
    return significance.wilcoxon(_pairs(spark, sf_dir), _BOTH, "d").select(*_BOTH, "n", "w_plus", F.round("z", 6).alias("z"))


@through
def wilcoxon_signed_z(spark, sf_dir):
    """RA-12: the same ranks, signed z without continuity."""
    w = significance.wilcoxon(_pairs(spark, sf_dir), _BOTH, "d", False)
    return w.select(*_BOTH, "n", "w_plus", (F.col("n") * (F.col("n") + 1) / 2 - F.col("w_plus")).alias("w_minus"), F.round("z", 6).alias("z"))


@through
def holm_adjust(spark, sf_dir):
    """WN-5, ST-10."""
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g"), F.col("o_custkey").alias("k")).agg((F.min("o_totalprice") / 1000000).alias("p"))
    return relational.holm(p, "p", ["g"], "k").select("g", "k", F.round("p_holm", 8).alias("p_holm"))


@through
def rank_shift_sensitivity(spark, sf_dir):
    """WN-4, ST-20: ranking by all scores against automatic ones only."""
    out = relational.rank_shift(_places(spark, sf_dir), _places(spark, sf_dir, "auto"), "model")
    return out.select("model", F.col("rank_a").alias("rank_all"), F.col("rank_b").alias("rank_auto"), "shift")


@through
def round_robin_order(spark, sf_dir):
    """WN-9."""
    out = relational.round_robin(table(spark, sf_dir, "events"), "user_id", "event_id")
    return out.select("event_id", F.col("turn").cast("long").alias("turn"), F.col("place").cast("long").alias("place"))


@through
def running_budget_stop(spark, sf_dir):
    """SM-4."""
    return relational.running_stop(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 1000.0).select("event_id", "user_id", F.round("spent_before", 6).alias("spent_before"))


@through
def daily_cap(spark, sf_dir):
    """SM-5: the first 50 calls of a day."""
    return relational.daily_cap(table(spark, sf_dir, "events"), "ts", "event_id", 50).select("event_id", F.col("nth").cast("long").alias("nth"))


@through
def islands(spark, sf_dir):
    """RM-7."""
    return relational.islands(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type").select("user_id", "event_id", "island")


@through
def growth_ma_cagr(spark, sf_dir):
    """WN-7, RA-27: growth in percent, mean of three, compound rate; one row a month."""
    m = table(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.sum("o_totalprice").alias("v")).withColumn("g", F.lit(0))
    w = Window.partitionBy("g").orderBy("month")
    k = F.row_number().over(w) - 1
    out = timeseries.growth(m, ["g"], "month", "v").withColumn("cagr", F.when(k > 0, F.pow(F.col("v") / F.first("v").over(w), 1.0 / k) - 1))
    return out.select("month", F.round("growth_pct", 6).alias("growth_pct"), F.round("ma3", 4).alias("ma3"), F.round("cagr", 8).alias("cagr"))


QUERIES, SQL = D.queries, D.sql
