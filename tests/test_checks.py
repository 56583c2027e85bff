"""Picks for raters, usage folds, sorted logs, call energy over triggers, names and fields, scored fields and programs."""

import glob
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import text
from gaugeworks.operators import picks, runs, scorers, timeseries
from gaugeworks.sources import sinks
from gaugeworks.streaming import streams


def one(spark, expr, schema, *rows):
    return [r.x for r in spark.createDataFrame(rows, schema).select(expr.alias("x")).collect()]


def test_balanced_picks(spark):
    rnd = random.Random(1)
    rows = [("t", f"m{m}", i) for m in range(7) for i in rnd.sample(range(12), 9)] + [("t", "few", 3), ("u", "a", 1), ("u", "b", 1)]
    df = spark.createDataFrame(rows, "task string, model string, item int")
    got = picks.balanced_picks(df, 20, 3).collect()
    own = [r for r in got if r.task == "t"]
    assert len(own) == 20 and len({(r.model, r.item) for r in own}) == 20 and all((r.task, r.model, r.item) in set(rows) for r in got)
    per = Counter(r.model for r in own)
    assert per["few"] == 1 and max(per.values()) - min(v for m, v in per.items() if m != "few") <= 1
    used = Counter(r.item for r in own)
    assert max(used.values()) <= 3 and len(used) == 12  # 20 answers over 12 items
    assert sorted(r.place for r in own) == list(range(1, 21)) and [r.turn for r in sorted(own, key=lambda r: r.place)] == sorted(r.turn for r in own)
    assert {(r.model, r.item) for r in got if r.task == "u"} == {("a", 1), ("b", 1)}
    again = picks.balanced_picks(df.repartition(5), 20, 3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got)) and sorted(map(tuple, picks.balanced_picks(df, 20, 4).collect())) != sorted(map(tuple, got))
    assert picks.balanced_picks(df.limit(0), 5, 1).count() == 0


def test_rater_sheet(spark):
    df = spark.createDataFrame([("t", f"m{m}", i, f"answer {m} {i}") for m in range(4) for i in range(5)], "task string, model string, item int, text string")
    got = sinks.rater_sheet(df, 8, 2).collect()
    assert sorted(r.id for r in got) == [f"H{k:02d}" for k in range(1, 9)] and all(r.text == f"answer {r.model[1:]} {r.item}" for r in got)
    assert set(Counter(r.model for r in got).values()) == {2}


def test_usage_fold(spark):
    kind = "v array<struct<n: int, tokens: double, model: string, ttft_s: double>>"
    rows = [([(1, None, "a", None), (2, None, None, 0.5)],), ([(1, 2.0, "a", None), (2, None, "b", 0.25), (3, 3.0, "", 0.75)],), ([],)]
    got = one(spark, runs.usage_fold(F.col("v"), ["tokens"]), kind, *rows)
    assert [tuple(r) for r in got] == [(2, None, "a", 0.5), (3, 5.0, "b", 0.25), (0, None, None, None)]


def test_sorted_log(spark, tmp_path):
    df = spark.range(997).select((F.col("id") * 7919 % 997).alias("k"), F.concat(F.lit("é"), "id").alias("v"), F.when(F.col("id") % 3 == 0, 1).alias("n"))
    seen = []
    for n in (1, 9):
        sinks.sorted_log(df.repartition(n), ["k"], f"{tmp_path}/{n}", 4)
        folders = [sorted(glob.glob(f"{tmp_path}/{n}/file={f}/part-*")) for f in range(4)]
        assert all(len(f) == 1 for f in folders)
        seen.append([open(f[0], "rb").read() for f in folders])
    assert seen[0] == seen[1]
    keys = [json.loads(line)["k"] for part in seen[0] for line in part.decode().splitlines()]
    assert keys == list(range(997)) and {len(p.splitlines()) for p in seen[0]} == {249, 250}


def test_call_energy_over_triggers(spark, tmp_path):
    """Samples that come in three files, one a trigger, give what the batch operator gives."""
    rnd = random.Random(7)
    samples = {k: [(k, round(10 * i + rnd.random() * 8, 3), rnd.random() * 100) for i in range(90)] for k in ("a", "b", "c")}
    samples["c"] = samples["c"][:40]
    for part in range(3):
        rows = [s for k in samples for s in samples[k][part * 30 : part * 30 + 30]]
        rnd.shuffle(rows)
        if rows:
            spark.createDataFrame(rows, "gpu string, t double, w double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    windows = spark.createDataFrame([(k, f"{k}{i}", 37.0 * i + 3, 37.0 * i + 3 + rnd.choice([1.0, 55.5, 130.0])) for k in ("a", "b", "c", "none") for i in range(20)], "gpu string, call string, t0 double, t1 double")
    stream = spark.readStream.schema("gpu string, t double, w double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    pieces = streams.drain(streams.call_pieces(stream, windows, "gpu", "t", "w", 20.0, 30.0), "energy", "append", str(tmp_path))
    got = {r.call: r.integral for r in streams.call_energy(pieces, windows, "gpu", 20.0).collect()}
    batch = spark.createDataFrame([s for rows in samples.values() for s in rows], "gpu string, t double, w double")
    want = {r.call: r.integral for r in timeseries.integrate(batch, windows, "gpu", "call", "t", "w", "t0", "t1", 20.0, 30.0).collect()}
    assert got == {c: None if v is None else pytest.approx(v, rel=1e-9) for c, v in want.items()} and sum(v is not None for v in got.values()) > 30 and None in got.values()


def test_names_and_fields(spark):
    t = "v string"
    assert one(spark, text.author_list("v"), t, ("Lee, Ann; Bo Chu and C. Di & Ed Fo dan Müller,Jo",), ("",), (None,), (" ; ",)) == [["Ann Lee", "Bo Chu", "C. Di", "Ed Fo", "Jo Müller"], [], [], []]
    assert one(spark, text.family_names("v"), t, (r"M{\"u}ller, Ann and {World Bank} and  Jos\'e P\'erez",), ("",), (None,), ("Lee, A and ",)) == [["muller", "bank", "perez"], [], [], ["lee"]]
    assert one(spark, text.edition_number("v"), t, ("2nd",), ("Second edition",), ("Edisi Ketiga",), ("latest",), (None,)) == [2, 2, 3, None, None]
    assert one(spark, text.year_of("v"), t, ("x2020y",), ("1899 and 1999",), ("12",)) == [2020, 1999, None]
    cases = [("edition", "3rd", "third", True), ("edition", "new", "new", False), ("pages", "1 -- 9", "1–9", True), ("pages", "1-8", "1-9", False), ("doi", "https://doi.org/10.1/A", "10.1/a", True), ("author", "Lee, Ann and B. Chu", "Ann Lee and Chu, Bo", True), ("author", "Lee", "Lee and Chu", False), ("title", "{The} Title", "the title", True), ("title", None, "x", False)]
    assert one(spark, text.field_agrees("n", "g", "w"), "n string, g string, w string", *[c[:3] for c in cases]) == [c[3] for c in cases]
    assert [text.plain_number(x) for x in ("007", "1.50", "0.85", "1.2.3", "100", "0", "12.0")] == ["7", "1.5", "0.85", "1.2.3", "100", "0", "12"]


def test_scored_fields(spark):
    kind = "got struct<n: int, l: array<string>>, want struct<n: int, l: array<string>>, undecided map<string,array<string>>, scored array<string>"
    rows = [((5, ["x"]), (None, ["x"]), {}, ["n", "l"]), ((5, ["x"]), (None, ["x"]), {}, ["l"]), ((None, None), (None, []), {}, ["n", "l"]), ((1, ["a"]), (1, ["a", "b"]), {"l": ["b"]}, None), ((1, []), (1, ["b"]), {"l": ["b"]}, ["l"]), ((1, []), (1, []), {}, [])]
    assert [r.score for r in scorers.extraction(spark.createDataFrame(rows, kind), ["n"], ["l"]).collect()] == [0.5, 1.0, 1.0, 1.0, 1.0, None]


def test_programs_by_what_they_print(spark):
    expected, tol = '{"a": 1.0, "b": "x", "c": [1, 2]}', '{"default": {"abs": 0.01}, "a": {"rel": 0.5}}'
    rows = [(1, ['{"a": 1.4, "b": " X", "c": [1, 2.001]}'], expected, tol), (2, ["boom", '{"a": 1, "b": "x", "c": [1, 2]}'], expected, tol), (3, ['{"a": 2, "b": "x"}', '{"a": 1}', '{"a": 1, "b": "y", "c": [1]}'], expected, tol), (4, [], expected, tol), (5, ["{}"], "{}", None)]
    got = {r.item: tuple(r)[1:] for r in scorers.coding_json(spark.createDataFrame(rows, "item int, attempts array<string>, expected string, tolerance string")).collect()}
    assert got == {1: (1.0, True, True, 1.0), 2: (0.0, False, True, 1.0), 3: (0.3333, False, False, 0.3333), 4: (0.0, False, False, 0.0), 5: (0.0, False, False, 0.0)}


def test_versions_invalidate_scores(spark):
    from gaugeworks.operators import relational

    now = scorers.versioned(spark.createDataFrame([(1, "coding"), (2, "grounded"), (3, "other")], "item int, task string"))
    old = spark.createDataFrame([(1, "coding", 1, 0.5), (2, "grounded", scorers.VERSIONS["grounded"], 0.5)], "item int, task string, scorer_version int, score double")
    same, anew = relational.split_reuse(now, old, ["item", "task", "scorer_version"])
    assert [r.item for r in same.collect()] == [2] and sorted(r.item for r in anew.collect()) == [1, 3]


def test_selected_stages(spark):
    from gaugeworks.operators import translation

    rows = [
        (1, {"draft": "d", "review": "r"}, {"sim_draft": 0.9, "sim_review": 0.88}), (2, {"draft": "d", "review": "r"}, {"sim_draft": 0.9, "sim_review": 0.87}), (3, {"draft": "d"}, {"sim_draft": 0.0}),
        (4, {"draft": "d", "review": "r", "back_draft": "x"}, {"sim_draft": 0.9, "back_draft_sim": 0.5, "sim_review": 0.7}), (5, {}, {}),
    ]
    df = spark.createDataFrame(rows, "unit int, out map<string,string>, metrics map<string,double>")
    got = {r.unit: (r.selected, r.final, r.metrics.get("qa_draft")) for r in translation.selected_stage(df).collect()}
    assert got == {1: ("review", "r", 0.9), 2: ("draft", "d", 0.9), 3: ("draft", "d", 0.0), 4: ("review", "r", 0.7), 5: ("draft", None, None)}
    assert {r.selected for r in translation.selected_stage(df.where("unit < 3"), qa=False).collect()} == {"review"}


def test_batches_stream_by(spark):
    from gaugeworks.operators import relational

    rnd = random.Random(2)
    rows = [(rnd.choice("ab") if k % 9 else None, k, rnd.choice([None, 0, 3, 7, 25])) for k in range(300)]
    want, state = {}, {}
    for g, k, n in rows:
        total, b = state.get(g, (0, 0))
        if g in state and total + (n or 0) > 20:
            total, b = 0, b + 1
        state[g] = (total + (n or 0), b)
        want[k] = b
    df = spark.createDataFrame(rows, "g string, k int, n int").repartition(5)
    assert {r.k: r.batch for r in relational.size_batches(df, "g", "k", "n", 20).collect()} == want


def test_latency(spark):
    from gaugeworks.operators.runs import latency

    rnd = random.Random(3)
    rows = [(m, rnd.choice([None, 0.0, round(rnd.random() * 9, 1)]), rnd.choice([None, 5])) for m in (1, 2) for _ in range(50)] + [(3, None, 1)]
    got = {r.m: r for r in latency(spark.createDataFrame([(*r, None, 4) for r in rows], "m int, seconds double, output_tokens int, reasoning_tokens int, thinking_chars int"), ["m"]).collect()}
    for m in (1, 2):
        s = sorted(x for k, x, _ in rows if k == m and x)
        assert got[m].p90_s == s[int(0.9 * (len(s) - 1))] and got[m].reasoning_tokens_mean == 0 and got[m].thinking_chars_mean == 4
    assert (got[3].median_s, got[3].p90_s, got[3].out_tokens_mean) == (None, None, 1.0)
