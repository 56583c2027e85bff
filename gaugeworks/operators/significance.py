"""Tests with p values, ranks without a global sort, reliability and sensitivity of rankings (ST-4, ST-6, ST-9, ST-14, ST-19 to ST-23, RA-4, RA-5,
RA-8 to RA-14, JN-8, JN-12, JN-13, AG-16, SO-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions import special
from gaugeworks.operators.composite import even_mean
from gaugeworks.operators.judging import seeded_picks
from gaugeworks.operators.relational import kept, running


def ranked(df: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    """WN-3: average-tie ranks of value within keys: counts of distinct values are summed up, not rows, and joined back."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_t"))
    if keys:
        n = n.withColumn("_upto", F.sum("_t").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    else:
        n = running(n, value, "_t", "sum", "_upto")
    n = n.withColumn(out, F.col("_upto") - (F.col("_t") - 1) / 2.0).withColumnRenamed("_t", f"{out}_ties").drop("_upto")
    return df.join(n, [*keys, value])


def spearman(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """ST-14, RA-4: keys, n, rho, p by Student's t; null below three rows or without spread."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = ranked(ranked(both, x, keys, "_rx"), y, keys, "_ry")
    return with_p(r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho")), "rho")


def with_p(df: DataFrame, r: str) -> DataFrame:
    """A correlation of n rows (column n) with its two-sided p; 0 where it is 1 or more, null below three rows."""
    good = (F.col("n") >= 3) & ~F.isnan(F.coalesce(r, F.lit(float("nan"))))
    t = F.col(r) * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col(r) * F.col(r)))
    df = df.withColumn(r, F.when(good, F.col(r)))
    return df.withColumn("p", F.when(F.abs(r) >= 1, 0.0).when(F.col(r).isNotNull(), special.t_p_value(t, F.col("n").cast("double") - 2)))


def sign_test(pairs: DataFrame, keys: list[str], d: str) -> DataFrame:
    """ST-6: keys, wins, losses, ties (nulls too), p exact."""
    g = pairs.groupBy(*keys).agg(F.count_if(F.col(d) > 0).alias("wins"), F.count_if(F.col(d) < 0).alias("losses"), F.count(F.lit(1)).alias("_n"))
    g = g.withColumn("ties", F.col("_n") - F.col("wins") - F.col("losses")).drop("_n")
    return g.withColumn("p", special.binom_p_value("wins", F.col("wins") + F.col("losses")))


def wilcoxon(pairs: DataFrame, keys: list[str], d: str, continuity: bool = True) -> DataFrame:
    """ST-9 (with continuity, from |W - mean|), RA-12 (signed, without): keys, n, w_plus, z, p; zeros dropped, average ranks, ties in the variance."""
    own = pairs.where(F.coalesce(F.col(d) != 0, F.lit(False))).withColumn("_a", F.abs(d))
    r = ranked(own, "_a", keys, "_r")
    n = F.col("n")
    g = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(d) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.col("_r_ties") * F.col("_r_ties") - 1.0).alias("_tie"))
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_tie") / 48.0
    off = F.col("w_plus") - n * (n + 1) / 4.0
    z = F.when(var > 0, ((F.abs(off) - 0.5) if continuity else off) / F.sqrt(var))
    g = g.withColumn("z", z).withColumn("p", F.coalesce(F.least(F.lit(1.0), 2 * special.norm_sf(F.greatest(F.lit(0.0), F.abs("z") if not continuity else F.col("z")))), F.lit(1.0)))
    return pairs.select(*keys).distinct().join(g.drop("_tie"), keys, "left").fillna({"n": 0, "w_plus": 0.0, "p": 1.0})


def holm(df: DataFrame, p: str, keys: list[str], order: list[str]) -> DataFrame:
    """ST-10: df with p_holm within keys."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    by = w.orderBy(p, *order)
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(w) - F.row_number().over(by) + 1) * F.col(p))
    return df.withColumn("_s", step).withColumn("p_holm", F.max("_s").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_s")


def pairwise(scores: DataFrame, order: DataFrame, top: int) -> DataFrame:
    """ST-19, JN-7: a row for each pair of the best models over common items: n, diff, Wilcoxon, sign and Holm p. order: model, place."""
    s = scores.join(F.broadcast(order.where(F.col("place") <= top)), "model")
    b = s.select("item", F.col("model").alias("model_b"), F.col("place").alias("_pb"), F.col("score").alias("_sb"))
    pairs = s.join(b, "item").where(F.col("place") < F.col("_pb")).select(F.col("model").alias("model_a"), "model_b", (F.col("score") - F.col("_sb")).alias("d"))
    keys = ["model_a", "model_b"]
    g = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("diff"))
    w = wilcoxon(pairs, keys, "d").select(*keys, F.col("p").alias("wilcoxon_p"))
    return holm(g.join(w, keys).join(sign_test(pairs, keys, "d").select(*keys, F.col("p").alias("sign_p")), keys), "wilcoxon_p", [], keys)


def paired_bootstrap(pairs: DataFrame, keys: list[str], d: str, order: str, n_boot: int = 4000, seed: int = 0) -> DataFrame:
    """ST-4: keys, n, diff, lo, hi, p: the mean difference, its percentile interval and the share of draws across 0, twice; random.Random(seed) in row order."""
    import numpy as np
    import pandas as pd

    def run(own: pd.DataFrame) -> pd.DataFrame:
        x = own.sort_values(order)[d].dropna().to_numpy(float)
        n, out = len(x), [None] * 4
        if n:
            boots = np.array([x[pick].mean() for pick in seeded_picks(seed, n, n_boot)])
            out = [float(x.mean()), *np.quantile(boots, [0.025, 0.975]).tolist(), min(1.0, 2 * min((boots <= 0).mean(), (boots >= 0).mean()))]
        return pd.DataFrame([[*(own[k].iloc[0] for k in keys), n, *out]], columns=[*keys, "n", "diff", "lo", "hi", "p"])

    types = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.groupBy(*keys).applyInPandas(run, f"{types}, n long, diff double, lo double, hi double, p double")


# ---- two and more samples: one pass of sufficient statistics ----------------------------------------------------------


def two_sample(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """RA-8, RA-9, RA-11: rows test, n, statistic, df, p of group a against b: student, welch, mann_whitney (z with continuity)."""
    own = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    r = ranked(own, value, [], "_r")
    is_a = F.col(group) == a
    side = lambda f, cond: f(F.when(cond, F.col(value)))
    g = r.agg(
        side(F.count, is_a).cast("double").alias("na"), side(F.count, ~is_a).cast("double").alias("nb"), side(F.avg, is_a).alias("ma"), side(F.avg, ~is_a).alias("mb"),
        side(F.var_samp, is_a).alias("va"), side(F.var_samp, ~is_a).alias("vb"), F.sum(F.when(is_a, F.col("_r"))).alias("ra"), F.sum(F.col("_r_ties").cast("double") * F.col("_r_ties") - 1).alias("tie"),
    )
    na, nb, n = F.col("na"), F.col("nb"), F.col("na") + F.col("nb")
    per = F.try_divide
    pooled = per((na - 1) * F.col("va") + (nb - 1) * F.col("vb"), n - 2)
    sa, sb = per(F.col("va"), na), per(F.col("vb"), nb)
    u = F.col("ra") - na * (na + 1) / 2
    z = per(F.abs(u - na * nb / 2) - 0.5, F.sqrt(na * nb / 12 * (n + 1 - per(F.col("tie"), n * (n - 1)))))
    rows = [
        F.struct(F.lit("student").alias("test"), per(F.col("ma") - F.col("mb"), F.sqrt(pooled * (per(F.lit(1.0), na) + per(F.lit(1.0), nb)))).alias("statistic"), (n - 2).alias("df")),
        F.struct(F.lit("welch").alias("test"), per(F.col("ma") - F.col("mb"), F.sqrt(sa + sb)).alias("statistic"), per((sa + sb) ** 2, per(sa**2, na - 1) + per(sb**2, nb - 1)).alias("df")),
        F.struct(F.lit("mann_whitney").alias("test"), z.alias("statistic"), F.lit(None).cast("double").alias("df")),
    ]
    out = g.select(n.cast("long").alias("n"), F.explode(F.array(*rows)).alias("r")).select("r.test", "n", "r.statistic", "r.df")
    p = F.when(F.col("df").isNull(), F.least(F.lit(1.0), 2 * special.norm_sf(F.greatest(F.lit(0.0), F.col("statistic"))))).otherwise(special.t_p_value("statistic", F.coalesce("df", F.lit(1.0))))
    return out.withColumn("p", p)


def mann_whitney(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """RA-11: u, mean_rank of group a, z with continuity and ties in the variance."""
    r = ranked(df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()), value, [], "_r")
    is_a = F.col(group) == a
    g = r.agg(F.count_if(is_a).cast("double").alias("na"), F.count_if(~is_a).cast("double").alias("nb"), F.sum(F.when(is_a, F.col("_r"))).alias("ra"), F.sum(F.col("_r_ties").cast("double") * F.col("_r_ties") - 1).alias("tie"))
    na, nb, n = F.col("na"), F.col("nb"), F.col("na") + F.col("nb")
    u = F.col("ra") - na * (na + 1) / 2
    return g.select(u.alias("u"), F.try_divide("ra", na).alias("mean_rank"), F.try_divide(F.abs(u - na * nb / 2) - 0.5, F.sqrt(na * nb / 12 * (n + 1 - F.try_divide(F.col("tie"), n * (n - 1))))).alias("z"))


def paired_t(df: DataFrame, x: str, y: str) -> DataFrame:
    """RA-10: test, n, statistic, df, p."""
    d = F.col(x) - F.col(y)
    g = df.agg(F.count(d).alias("n"), F.try_divide(F.avg(d), F.try_divide(F.stddev_samp(d), F.sqrt(F.count(d)))).alias("statistic"))
    return g.select(F.lit("paired").alias("test"), "n", "statistic", (F.col("n") - 1).cast("double").alias("df")).withColumn("p", special.t_p_value("statistic", "df"))


def ols(df: DataFrame, y: str, x: str) -> DataFrame:
    """RA-5: n, slope, intercept, se, t, p, r2 of a line."""
    g = df.agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"))
    se = F.sqrt(F.try_divide((1 - F.col("r2")) * F.col("_syy"), (F.col("n") - 2) * F.col("_sxx")))
    g = g.withColumn("se", se).withColumn("t", F.try_divide("slope", "se"))
    return g.withColumn("p", special.t_p_value("t", F.col("n").cast("double") - 2)).drop("_sxx", "_syy")


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """RA-13, RA-17: n, statistic (F), df1, df2, p of one factor."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    t = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).cast("double").alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") ** 2).alias("q"), F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("w"))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    out = t.select(F.col("n").cast("long").alias("n"), F.try_divide(F.try_divide(F.col("q") - F.try_divide(F.col("s") ** 2, F.col("n")), d1), F.try_divide(F.col("w"), d2)).alias("statistic"), d1.alias("df1"), d2.alias("df2"))
    return out.withColumn("p", special.f_p_value("statistic", "df1", "df2"))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """RA-14: n, statistic (H corrected for ties), df, p."""
    r = ranked(df.where(F.col(value).isNotNull()), value, [], "_r")
    g = r.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("_r").alias("s"), F.sum(F.col("_r_ties").cast("double") * F.col("_r_ties") - 1).alias("tie"))
    t = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("s") ** 2 / F.col("n")).alias("q"), F.sum("tie").alias("tie"))
    n = F.col("n")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - F.try_divide(F.col("tie"), n**3 - n))
    out = t.select(n.cast("long").alias("n"), h.alias("statistic"), (F.col("k") - 1).cast("double").alias("df"))
    return out.withColumn("p", special.chi2_p_value("statistic", "df"))


# ---- reliability and sensitivity ---------------------------------------------------------------------------------------


def judge_summary(ratings: DataFrame, answer: list[str]) -> DataFrame:
    """AG-16, FLT-7: judge_id, n, mean, n_common (answers that every judge rated)."""
    judges = ratings.select("judge_id").distinct().count()
    n = F.count(F.lit(1)).over(Window.partitionBy(*answer))
    return ratings.withColumn("_n", n).groupBy("judge_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean"), F.count_if(F.col("_n") == judges).alias("n_common"))


def judge_pairs(ratings: DataFrame, answer: list[str]) -> DataFrame:
    """JN-8, ST-22: judge_a, judge_b, n, rho, p over the answers both rated."""
    a = ratings.select(*answer, F.col("judge_id").alias("judge_a"), F.col("rating").alias("x"))
    b = ratings.select(*answer, F.col("judge_id").alias("judge_b"), F.col("rating").alias("y"))
    return spearman(a.join(b, answer).where("judge_a < judge_b"), "x", "y", ["judge_a", "judge_b"])


def auto_against_judge(item_scores: DataFrame) -> DataFrame:
    """ST-21: task, level (answers, models), n, rho: the automatic score and the judges' mean, on answers and on models' means.

    Both are stored: ranks are joined back by value, and a mean of doubles computed twice may differ in its last digit."""
    own = kept(item_scores.where("judge IS NOT NULL"))
    by_model = kept(own.groupBy("task", "model").agg(F.avg("auto").alias("auto"), F.avg("judge").alias("judge")))
    parts = [spearman(d, "auto", "judge", ["task"]).select("task", F.lit(k).alias("level"), "n", "rho") for k, d in (("answers", own), ("models", by_model))]
    return parts[0].unionByName(parts[1])


def overall(item_scores: DataFrame, pick: Column, tasks: Column | None = None) -> DataFrame:
    """UD-5: model, overall: mean of task means of a picked score."""
    own = item_scores if tasks is None else item_scores.where(tasks)
    return own.withColumn("_s", pick).groupBy("model", "task").agg(even_mean("_s").alias("_m")).groupBy("model").agg(even_mean("_m").alias("overall"))


def sensitivities(item_scores: DataFrame, private: list, top: int = 4) -> DataFrame:
    """ST-20, SO-6, WN-4: name, rho, max_shift, leader_same, top_same of the ranking under automatic scores, judges' scores, without private tasks, and,
    where item_scores has a column credited (the score with the credit of references found elsewhere, see runs.corrected), with that.

    Item scores are stored, and a row a model of each ranking: ranks are joined back by value, and a mean of doubles computed twice may differ in its last digit."""
    item_scores = kept(item_scores)
    kinds = {"auto_only": (F.col("auto"), None), "judge_only": (F.coalesce("judge", "score"), None), "public_only": (F.col("score"), ~F.col("task").isin(private))}
    if "credited" in item_scores.columns:
        kinds["audit_credited"] = (F.col("credited"), None)
    place = lambda d, c: d.withColumn(c, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("overall"), "model")))
    main = place(overall(item_scores, F.col("score")), "was").withColumnRenamed("overall", "before")
    out = None
    for name, (pick, tasks) in kinds.items():
        both = kept(main.join(place(overall(item_scores, pick, tasks), "now"), "model"))
        own = both.agg(
            F.max(F.abs(F.col("was") - F.col("now"))).cast("long").alias("max_shift"),
            F.max((F.col("was") == 1) & (F.col("now") == 1)).alias("leader_same"),
            (F.count_if((F.col("was") <= top) & (F.col("now") <= top)) == F.least(F.lit(top), F.count(F.lit(1)))).alias("top_same"),
        )
        own = own.crossJoin(spearman(both, "before", "overall", []).select("rho")).select(F.lit(name).alias("name"), "rho", "max_shift", "leader_same", "top_same")
        out = own if out is None else out.unionByName(own)
    return out


def human_units(first: DataFrame, second: DataFrame, criteria: list[str]) -> DataFrame:
    """JN-12: id, criterion, a, b: the ratings of two raters at their place; a rater's missing sheet counts as nulls. Sheets: id, one column a criterion."""
    long = lambda d, v: d.select("id", F.explode(F.map_from_arrays(F.array(*map(F.lit, criteria)), F.array(*[F.col(c).try_cast("int") for c in criteria]))).alias("criterion", v))
    inside = lambda v: F.when(F.col(v).between(1, 5), F.col(v))
    return long(first, "a").join(long(second, "b"), ["id", "criterion"], "full_outer").select("id", "criterion", inside("a").alias("a"), inside("b").alias("b"))


def human_means(units: DataFrame) -> DataFrame:
    """ST-23: id, human: the mean of all valid ratings as 0 to 1."""
    both = units.select("id", F.explode(F.array("a", "b")).alias("v")).where("v IS NOT NULL")
    return both.groupBy("id").agg(((F.avg("v") - 1) / 4).alias("human"))


def gold_labels(first: DataFrame, second: DataFrame) -> DataFrame:
    """SNK-9, JN-12: id, field, value where both raters judged: the silver value if both call it right, the correction if both call it wrong and agree.

    Sheets: id, field, right ('0' or '1'), fix, silver."""
    ok = F.col("right").isin("0", "1")
    a = first.where(ok).select("id", "field", F.col("right").alias("ra"), F.col("fix").alias("fa"), "silver")
    b = second.where(ok).select("id", "field", F.col("right").alias("rb"), F.col("fix").alias("fb"))
    both = a.join(b, ["id", "field"])
    kept = F.when((F.col("ra") == "1") & (F.col("rb") == "1"), F.col("silver")).when((F.col("ra") == "0") & (F.col("rb") == "0") & F.col("fa").eqNullSafe(F.col("fb")), F.col("fa"))
    use = ((F.col("ra") == "1") & (F.col("rb") == "1")) | ((F.col("ra") == "0") & (F.col("rb") == "0") & F.col("fa").eqNullSafe(F.col("fb")))
    return both.where(use).select("id", "field", kept.alias("value"))
