"""Logs of a run: records, scores, judgements and energy segments, joined to item scores and costs (SRC-6 to SRC-8, JN-1 to JN-3, JN-14,
AG-5, AG-6, PRJ-3, PRJ-6, PRJ-14, PRJ-15, FLT-2 to FLT-5, JN-9, JN-19, AG-14, AG-21, AG-24, AG-27, FN-35, JN-27)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions import text as T
from gaugeworks.operators import judging, relational

KEY = ["model", "item", "rep"]
#: Weight of the judges' mean in an item's final score.
JUDGE_WEIGHT = 0.5


def parse_ratings(text, criteria: list[str]) -> Column:
    """PRJ-15: map of criteria to whole ratings, read from the answer's object or the one under `skor`; null unless all are there and round to 1..5."""
    whole = T.parse_json_loose(text)
    inner = F.get_json_object(whole, "$.skor")
    obj = F.when(inner.startswith("{"), inner).otherwise(whole)
    values = [F.rint(F.get_json_object(obj, f"$.{k}").try_cast("double")).cast("int") for k in criteria]
    good = F.forall(F.array(*values), lambda v: F.coalesce(v.between(1, 5), F.lit(False)))
    return F.when(good, F.map_from_arrays(F.array(*map(F.lit, criteria)), F.array(*values)))


def norm_rating(ratings) -> Column:
    """PRJ-14: the mean of ratings from 1 to 5 as 0 to 1."""
    v = F.map_values(ratings)
    return (F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v) - 1) / 4


def last_scores(log: DataFrame, seq: str, ties: Sequence[str] = ()) -> DataFrame:
    """SRC-6: the last row of each model, item and repetition, whatever it says; of those of one seq, the first by the columns of ties."""
    return relational.latest_wins(log, KEY, seq, F.lit(False), ties)


def independent(judgements: DataFrame, judge_family: str = "judge_family", family: str = "family") -> DataFrame:
    """FLT-3: judgements whose judge is not of the candidate's vendor; unknown vendors count as others."""
    return judgements.where(~F.col(judge_family).eqNullSafe(F.col(family)) | F.col(family).isNull())


def last_judgements(log: DataFrame, seq: str, ties: Sequence[str] = ()) -> DataFrame:
    """SRC-7: rows with ratings, the last of each judge and answer; of those of one seq, the first by the columns of ties."""
    return relational.latest_wins(log.where("ratings IS NOT NULL"), ["judge_id", *KEY, "answer_hash"], seq, F.lit(False), ties)


def auto_score(error, score, answer_hash) -> Column:
    """PRJ-11: 0 where the model failed to answer, else what the scorer gave; null rows do not count."""
    return F.when(error.isNotNull() & score.isNull() & answer_hash.isNull(), 0.0).otherwise(score)


def item_scores(scores: DataFrame, items: DataFrame, records: DataFrame, judgements: DataFrame, n_judges: int) -> DataFrame:
    """JN-1 to JN-4, PRJ-11, PRJ-12, AG-1: model, item, task, score, auto, judge, n_reps.

    scores: KEY, error, score, answer_hash. items: item, task; others go. records: KEY, answer_hash, error (the latest). judgements: judge_id,
    KEY, answer_hash, rating in 0..1; only those of the answer that stands count, less their judge's leniency and clamped."""
    offsets = judging.leniency(judgements, n_judges, [*KEY, "answer_hash"])
    own = judging.calibrated(judgements, offsets).join(records.where("error IS NULL").select(*KEY, "answer_hash"), [*KEY, "answer_hash"])
    judged = own.groupBy(*KEY).agg(F.avg("calibrated").alias("judge"))
    rows = scores.join(items.select("item", "task"), "item").withColumn("auto", auto_score(F.col("error"), F.col("score"), F.col("answer_hash"))).where("auto IS NOT NULL")
    rows = rows.join(judged, KEY, "left")
    final = F.when(F.col("judge").isNull(), F.col("auto")).otherwise((1 - JUDGE_WEIGHT) * F.col("auto") + JUDGE_WEIGHT * F.col("judge"))
    return rows.groupBy("model", "item", "task").agg(F.avg(final).alias("score"), F.avg("auto").alias("auto"), F.avg("judge").alias("judge"), F.count(F.lit(1)).alias("n_reps"))


def served_counts(records: DataFrame) -> DataFrame:
    """AG-5: model, served, n: which model answered, by turn; records without error, turns array<struct<served,requested,..>>."""
    t = records.where("error IS NULL").select("model", F.explode("turns").alias("t"))
    return t.groupBy("model", F.coalesce("t.served", "t.requested").alias("served")).agg(F.count(F.lit(1)).alias("n"))


def costs(records: DataFrame, segments: DataFrame, usd_per_aiu: float, rental_per_hour: float, local_engine: str) -> DataFrame:
    """AG-5, AG-6, SRC-8, JN-14, PRJ-7, PRJ-13, PRJ-17: a row per model.

    records (the latest): model, engine, seq, error, turns array<struct<aiu,in_tokens,out_tokens,served,requested>>, seconds, wall_s and gross_j, marginal_j
    (null unless measured by call). segments: model, t0, t1, calls, workers, gross_j, marginal_j: those of parallel local runs add their time and energy."""
    total = lambda f: F.aggregate(F.when(F.col("error").isNull(), F.col("turns")).otherwise(F.slice("turns", 1, 0)), F.lit(0.0), lambda s, t: s + F.coalesce(t[f].cast("double"), F.lit(0.0)))
    swapped = F.size(F.filter("turns", lambda t: F.coalesce(t.served, t.requested) != t.requested))
    ok = F.col("error").isNull()
    own = records.groupBy("model").agg(
        F.max_by("engine", "seq").alias("engine"),
        F.count(F.lit(1)).alias("calls"),
        F.count("error").alias("errors"),
        F.sum(total("aiu")).alias("aiu"),
        F.sum(total("in_tokens")).cast("long").alias("in_tokens"),
        F.sum(total("out_tokens")).cast("long").alias("out_tokens"),
        F.sum(F.when(ok, swapped).otherwise(0)).alias("substituted"),
        F.percentile(F.when(ok, F.coalesce("seconds", F.lit(0.0))), 0.5).alias("median_s"),
        F.sum(F.when(ok, F.coalesce("wall_s", F.lit(0.0))).otherwise(0.0)).alias("wall_s"),
        F.count(F.when(ok, F.col("wall_s"))).alias("timed"),
        F.sum(F.when(ok, F.coalesce("gross_j", F.lit(0.0))).otherwise(0.0)).alias("gross_j"),
        F.sum(F.when(ok & F.col("gross_j").isNotNull(), F.coalesce("marginal_j", F.lit(0.0))).otherwise(0.0)).alias("marginal_j"),
        F.count(F.when(ok, F.col("gross_j"))).alias("measured"),
    )
    measured = F.col("gross_j").isNotNull()
    runs = segments.where("calls > 0 AND coalesce(workers, 1) > 1").groupBy("model").agg(
        F.sum(F.col("t1") - F.col("t0")).alias("seg_s"),
        F.sum("calls").alias("seg_calls"),
        F.sum(F.when(measured, F.col("gross_j")).otherwise(0.0)).alias("seg_gross"),
        F.sum(F.when(measured, F.coalesce("marginal_j", F.lit(0.0))).otherwise(0.0)).alias("seg_marginal"),
        F.sum(F.when(measured, F.col("calls")).otherwise(0)).alias("seg_measured"),
    )
    out = own.join(runs, "model", "left")
    local = F.col("engine") == local_engine
    for c, add in (("wall_s", "seg_s"), ("timed", "seg_calls"), ("gross_j", "seg_gross"), ("marginal_j", "seg_marginal"), ("measured", "seg_measured")):
        out = out.withColumn(c, F.when(local, F.col(c) + F.coalesce(add, F.lit(0))).otherwise(F.col(c)))
    kwh = F.col("gross_j") / 3.6e6
    answered = F.col("calls") - F.col("errors")
    rental = F.col("wall_s") / 3600 * rental_per_hour
    per_100 = F.when(local, F.when(F.col("timed") > 0, rental * 100 / F.col("timed"))).otherwise(F.when(answered > 0, F.col("aiu") * usd_per_aiu * 100 / answered))
    return out.select(
        "model", "engine", "calls", "errors", F.round("aiu", 3).alias("aiu"), F.round(F.col("aiu") * usd_per_aiu, 4).alias("usd"), "in_tokens", "out_tokens", "substituted", F.round("median_s", 2).alias("median_s"),
        F.round(per_100, 4).alias("usd_per_100"),
        F.when(local & (F.col("measured") > 0), F.round(kwh, 5)).alias("kwh_gross"),
        F.when(local & (F.col("measured") > 0), F.round(F.col("marginal_j") / 3.6e6, 5)).alias("kwh_marginal"),
        F.when(local & (F.col("measured") > 0), F.round(kwh * 100 / F.col("measured"), 5)).alias("kwh_per_100"),
        F.when(local, F.round(F.col("wall_s") / 3600, 4)).alias("gpu_hours"),
    )


def prompt_hash(system, user, json_mode) -> Column:
    """PRJ-3: the first 16 hex digits of SHA-256 of both prompts and the mode, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", F.coalesce(system, F.lit("")), F.coalesce(user, F.lit("")), json_mode.cast("int").cast("string")), 256), 1, 16)


def high_cost(tier, effort) -> Column:
    """PRJ-6."""
    return F.coalesce(tier == "premium", F.lit(False)) | F.coalesce(effort.isin("high", "xhigh", "max"), F.lit(False))


def select_models(roster: DataFrame, specs: DataFrame, tiers: list[str]) -> DataFrame:
    """FLT-2: models of the tiers, then those asked for by name, with the effort asked for; each label once, the first stands.

    roster: pos, name, tier, effort. specs: pos, name, effort. Names asked for that the roster lacks come through with null tier."""
    a = roster.where(F.col("tier").isin(tiers)).select(F.lit(0).alias("part"), "pos", "name", "tier", "effort")
    b = specs.withColumnRenamed("effort", "own").join(roster.select("name", "tier", "effort"), "name", "left").select(F.lit(1).alias("part"), "pos", "name", "tier", F.coalesce("own", "effort").alias("effort"))
    both = a.unionByName(b).withColumn("label", F.concat_ws("@", "name", "effort"))
    return relational.keep_first(both, ["label"], ["part", "pos"]).select("label", "name", "tier", "effort", high_cost(F.col("tier"), F.col("effort")).alias("high_cost"))


def gate(plan: DataFrame, most: float, allow_high: bool) -> DataFrame:
    """FLT-5: plan (model, calls, aiu, high_cost) with why a row is stopped, or null: high cost without leave, or running spend over the most."""
    spent = F.sum("aiu").over(Window.orderBy("model").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    high = F.col("high_cost") & F.lit(not allow_high)
    return plan.withColumn("spent", spent).withColumn("stopped", F.when(high, "high cost").when(F.col("spent") > most, "over the budget"))


def not_found(scores: DataFrame, records: DataFrame) -> DataFrame:
    """FLT-4, JN-19: a row for each listed reference that was not found, with the seed at its place if the answer still stands and the titles agree.

    scores: KEY, answer_hash, refs array<struct<title,exists,year,doi>>; records: KEY, answer_hash, seeds array<struct<title,author,year>>."""
    r = scores.select(*KEY, "answer_hash", F.posexplode("refs").alias("k", "ref")).where("ref.exists = false")
    own = r.join(records.select(*KEY, "answer_hash", "seeds"), [*KEY, "answer_hash"], "left").withColumn("seed", F.get("seeds", F.col("k")))
    same = F.coalesce(F.substring("seed.title", 1, 200) == F.col("ref.title"), F.lit(False))
    return own.select(*KEY, "k", F.col("ref.title").alias("title"), F.when(same, F.col("seed.author")).alias("author"), F.coalesce(F.when(same, F.col("seed.year")), F.col("ref.year")).alias("year"), (~same).alias("partial"))


def audit_class(title_known, exact_source, title_match, unchecked) -> Column:
    """FN-35: exact where a source has the work, title where one has its title alone, unchecked where one was away, else none."""
    return F.when(~title_known, "none").when(exact_source.isNotNull(), "exact").when(title_match, "title").when(unchecked, "unchecked").otherwise("none")


def corrected(per_item: DataFrame, corrections: DataFrame, n: str = "n") -> DataFrame:
    """JN-9: item scores with the credit of references found after all, over n asked for and the repetitions."""
    add = corrections.groupBy("model", "item").agg(F.sum("credit").alias("_credit"), F.count(F.lit(1)).alias("corrected"))
    out = per_item.join(add, ["model", "item"], "left")
    return out.withColumn("score", F.col("score") + F.coalesce(F.col("_credit") / F.col(n) / F.col("n_reps"), F.lit(0.0))).withColumn("corrected", F.coalesce("corrected", F.lit(0))).drop("_credit")


def field_means(rows: DataFrame, keys: list[str], fields: str) -> DataFrame:
    """AG-14: mean of each field's score over the rows that have it. fields: map<string,double>."""
    return rows.select(*keys, F.explode(fields).alias("field", "value")).groupBy(*keys, "field").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def share_true(checks) -> Column:
    """AG-21: share of a boolean map's values that hold; null for none."""
    v = F.map_values(checks)
    return F.when(F.size(v) > 0, F.size(F.filter(v, lambda x: F.coalesce(x, F.lit(False)))) / F.size(v))


def merge_reviews(reviews: DataFrame, issues: DataFrame) -> DataFrame:
    """AG-24, SL-6: of each grouped issue its reviewers, whether two of them agree, whether one calls it major; agreed and major ones first.

    issues: doc, grp, reviewer, severity. reviews: doc, reviewer, rubric, score: means come beside as map `means`."""
    means = reviews.groupBy("doc", "rubric").agg(F.avg("score").alias("mean")).groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rubric", "mean")))).alias("means"))
    g = issues.groupBy("doc", "grp").agg(F.count_distinct("reviewer").alias("reviewers"), F.max((F.col("severity") == "major").cast("int")).alias("major"))
    g = g.withColumn("agreed", F.col("reviewers") >= 2).withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("agreed"), F.desc("major"), "grp")))
    return g.join(means, "doc", "left")


def memory_by_process(before: DataFrame, after: DataFrame, least: float = 500.0) -> DataFrame:
    """JN-27, AG-27: processes with the GPUs on which they took `least` MB or more since before, their memory there, and the smallest process's place.

    before, after: pid, gpu, mb."""
    d = after.join(before.withColumnRenamed("mb", "was"), ["pid", "gpu"], "left").withColumn("took", F.col("mb") - F.coalesce("was", F.lit(0.0))).where(F.col("took") >= least)
    g = d.groupBy("pid").agg(F.round(F.sum("took"), 6).alias("mb"), F.array_sort(F.collect_set("gpu")).alias("gpus"))
    return g.withColumn("least", F.struct("mb", "pid") == F.min(F.struct("mb", "pid")).over(Window.partitionBy()))


def usage_fold(events: Column, sums: list[str]) -> Column:
    """PRJ-9: one usage record of a turn's events, an array of structs in order (fields of sums, model, ttft_s): api_calls; each sum, null where all
    of its values are; model, the last one named; ttft_s, the first one known."""
    known = lambda f: F.filter(F.transform(events, lambda e: e[f]), lambda v: v.isNotNull())
    total = lambda f: F.when(F.size(known(f)) > 0, F.aggregate(known(f), F.lit(0.0), lambda s, v: s + v.cast("double")))
    return F.struct(F.size(events).cast("long").alias("api_calls"), *[total(f).alias(f) for f in sums], F.try_element_at(F.filter(known("model"), lambda m: m != ""), F.lit(-1)).alias("model"), F.get(known("ttft_s"), F.lit(0)).alias("ttft_s"))


def diagnostics(scores: DataFrame, keys: list[str], requested: int = 5) -> DataFrame:
    """AG-12: keys, task, name, value: what the score rows of each task say beyond the score, by model, to four places.

    scores: keys, task and the columns named below (flags count as 0 where null, figures with "or 0" too; other nulls are left
    out), one pass of conditional aggregates. fields is a map: each of its keys becomes a name `field:<key>`."""
    c = F.col
    flag = lambda x: F.avg(F.coalesce(c(x).cast("double"), F.lit(0.0)))
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    some = lambda x: F.avg((zero(x) > 0).cast("double"))
    share = lambda a: F.try_divide(F.sum(a), F.sum(zero("returned")))
    of_kind = lambda k, v: F.avg(F.when(c("kind") == k, v))
    wanted = {
        "references": {"returned_mean": F.avg(zero("returned")), "hallucination_rate": share(zero("returned") - zero("found")), "doi_correct_rate": share(zero("doi_correct")), "doi_unresolvable": F.sum(zero("doi_unresolvable")), "abstained_items": F.count_if(zero("returned") < requested), "returned": F.sum(zero("returned"))},
        "coding": {"pass1": flag("pass1"), "pass_repair": flag("pass_repair"), "ran_first": flag("ran_first"), "repaired_items": F.count_if(F.coalesce("repaired", F.lit(False)))},
        "structure": {"generic_ch4_rate": flag("generic_ch4"), **{n: F.avg(n) for n in ("ch3_f1", "ch4_f1", "ch3_recall", "ch3_precision")}},
        "extraction": {"evidence_verbatim": F.avg("evidence_verbatim")},
        "grounded": {"unsupported_per_answer": F.avg(zero("unsupported_numbers")), "answers_with_unsupported": some("unsupported_numbers"), "foreign_citation_answers": some("foreign_citations"), **{n: F.avg(n) for n in ("coverage", "cited_sentences", "words")}},
        "language": {"nonstandard_per_answer": F.avg(zero("nonstandard_count")), "english_ratio": F.avg("english_ratio"), "numbers_kept": F.avg("numbers_kept"), "answers_with_new_numbers": some("numbers_fabricated")},
        "latex": {"fix_compiled": of_kind("fix", F.coalesce(c("compiled").cast("double"), F.lit(0.0))), "fix_score": of_kind("fix", c("score")), "table_cells": of_kind("table", zero("cell_accuracy")), "table_score": of_kind("table", c("score")), "bibtex": of_kind("bibtex", c("score"))},
        "methodology": {"accuracy": F.avg("score"), "unparsed": F.count_if(~F.coalesce("parsed", F.lit(False)))},
    }
    named = {t: {n: v for n, v in w.items()} for t, w in wanted.items()}
    g = scores.groupBy(*keys, "task").agg(*[v.cast("double").alias(f"{t}:{n}") for t, w in named.items() for n, v in w.items()])
    rows = F.flatten(F.array(*[F.when(c("task") == t, F.array(*[F.struct(F.lit(n).alias("name"), c(f"`{t}:{n}`").alias("value")) for n in w])).otherwise(F.array().cast("array<struct<name: string, value: double>>")) for t, w in named.items()]))
    out = g.select(*keys, "task", F.explode(rows).alias("r")).select(*keys, "task", "r.name", "r.value")
    if "fields" in scores.columns:
        each = scores.where("task = 'extraction'").select(*keys, "task", F.explode("fields").alias("key", "v")).groupBy(*keys, "task", "key").agg(F.avg("v").alias("value"))
        out = out.unionByName(each.select(*keys, "task", F.concat(F.lit("field:"), "key").alias("name"), "value"))
    return out.withColumn("value", F.round("value", 4))


def latency(records: DataFrame, keys: list[str]) -> DataFrame:
    """AG-12: keys, median_s, p90_s (of the sorted seconds, the one at floor(0.9 (n - 1))), and means of tokens and thinking: out_tokens_mean,
    reasoning_tokens_mean, thinking_chars_mean, nulls as 0. The quantile comes from counts of distinct seconds; no list of a model's calls is made."""
    from pyspark.sql import Window

    zero = lambda x: F.round(F.avg(F.coalesce(F.col(x), F.lit(0))), 4)
    own = records.groupBy(*keys).agg(F.round(F.percentile(F.when(F.col("seconds") > 0, F.col("seconds")), 0.5), 4).alias("median_s"), zero("output_tokens").alias("out_tokens_mean"), zero("reasoning_tokens").alias("reasoning_tokens_mean"), zero("thinking_chars").alias("thinking_chars_mean"))
    n = records.where("seconds > 0").groupBy(*keys, "seconds").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    n = n.withColumn("upto", F.sum("n").over(w.orderBy("seconds").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("all", F.sum("n").over(w))
    p90 = n.where(F.col("upto") >= F.floor(0.9 * (F.col("all") - 1)) + 1).groupBy(*keys).agg(F.round(F.min("seconds"), 4).alias("p90_s"))
    return own.join(p90, keys, "left").select(*keys, "median_s", "p90_s", "out_tokens_mean", "reasoning_tokens_mean", "thinking_chars_mean")
