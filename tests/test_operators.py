import math

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import special, tex, text
from gaugeworks.sources import sinks
from gaugeworks.operators import judging, references, relational, research, scorers, timeseries


def one(spark, expr, schema, *rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_distributions():
    assert special.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.f_upper(4.965, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.gamma_q(0.5, 3.841 / 2) == pytest.approx(0.05, abs=1e-4)
    assert special.beta_inc(2, 3, 0.5) == pytest.approx(0.6875)
    assert special.beta_inc(0.5, 0.5, 0.25) == pytest.approx(2 / math.pi * math.asin(0.5))
    assert special.binom_two_sided(1, 10) == pytest.approx(22 / 1024)
    assert special.binom_two_sided(5, 10) == 1.0
    assert research.studentized_range_sf(3.877, 3, 10) == pytest.approx(0.05, abs=2e-3)


def test_loose_json_and_scanners():
    assert text.read_loose('x {"a": "}"} y') == {"a": "}"}
    assert text.read_loose('```json\n{"a": [1, 2]}\n```') == {"a": [1, 2]}
    assert text.read_loose('so: {"a": [1, 2') == {"a": [1, 2]}
    assert text.read_loose('{"a": [1, 2}') == {"a": [1, 2]}
    assert text.read_loose("nothing") is None
    assert text.read_loose('{"a": [1, 2]] and more') == {"a": [1, 2]}
    assert text.read_loose('Note {x} then {"a":1}') == {"a": 1}
    assert text.read_loose('{"a": "cut off \\" here') == {"a": 'cut off " here'}
    assert text.read_loose('is [1, {"b": 2}') == {"b": 2}
    assert text.read_loose("list: [1, 2") == [1, 2]
    assert text.read_loose("```js\n[3]\n```") == [3]
    assert text.mend_brackets('x [1, {"a}": 2') == '[1, {"a}": 2}]'
    assert text.readings("1.234") == ["1.234", "1234"]
    assert text.readings("1.234,50%") == ["1.2345", "1234.5"]
    assert text.readings("1.234.567") == ["1234567"] and text.readings("0,85") == ["0.85"] and text.readings("007") == ["7"]
    assert text.spelled("one two three, fifty-two percent, two hundred") == "1 2 3, 52 percent, 200"
    assert text.similarity("", "") == 0.0 and text.similarity("漢", "漢") == 0.0
    assert text.number_support("It was 8.5 [P12] in 2020 or 85.", ["about 8,5 of all"], ["2020"]) == (2, ["85"])
    assert text.readings("12,5") == ["12.5"]
    assert text.spelled("Twenty five and one hundred and seven items") == "25 and 107 items"
    assert text.folded("Éa–Öl  X") == "ea ol x"
    assert text.similarity("A title: one", "a TITLE one") > 0.9
    assert text.bibtex_fields('@Article{k1, title = {A {B} c}, year = 2020, note="x"}') == {"_type": "article", "_key": "k1", "title": "A {B} c", "year": "2020", "note": "x"}
    assert text.last_object('log {"a": 1} and\n{"b": 2}\n') == '{"b": 2}'
    masked, held, tags = tex.mask(r"See \cite{a} and $x$.")
    assert masked == "See ⟦0⟧ and ⟦1⟧." and held == [r"\cite{a}", "$x$"] and tags == []


def test_text_expressions(spark):
    t = "v string"
    assert one(spark, text.words("v"), t, ("Anak-anak don't 12 Éa",)) == [["Anak-anak", "don't", "12", "Éa"]]
    assert one(spark, text.number_literals("v"), t, ("a 1.5 x2 3,000% 7",)) == [["1.5", "3,000%", "7"]]
    assert one(spark, text.cited_numbers("v"), t, ("a [P1-P3], [5] and [2, P7]",)) == [[1, 2, 3, 7]]
    assert one(spark, text.cited_numbers("v"), t, ("x [P2; P2] y [see P3-5] [12]",), ("[P9-P1]",), (None,)) == [[2, 2, 3, 4, 5], [], []]
    assert one(spark, text.option_letter("v"), t, ("Answer: b.",), ("x\n(C)\n",), ("A or B",), (None,), ("Jawaban: B, bukan A.",), ('{"jawaban":"C"} A dan D',), ("E",)) == ["B", "C", None, None, "B", "C", None]
    assert one(spark, text.length_score(F.length("v"), 250, 400), t, ("x" * 200,), ("x" * 300,), ("x" * 500,), ("x" * 900,)) == [0.875, 1.0, 0.75, 0.0]
    assert one(spark, text.sentences("v"), t, ("One two three four. five six. Seven eight nine ten! No.",)) == [["One two three four. five six.", "Seven eight nine ten!"]]
    assert one(spark, text.sentences("v", 1, False), t, ("One. two. 3",)) == [["One.", "two.", "3"]]
    assert one(spark, text.clean_doi("v"), t, (" https://doi.org/10.1234/AbC.",), ("none",), ("doi:10.1/x",), (None,)) == ["10.1234/abc.", "none", "doi:10.1/x", ""]
    assert one(spark, text.surname("v"), t, ("José Müller ",), ("Müller, José",), ("O'Brien-Smith",), ("",), (None,)) == ["muller", "jose", "o brien smith", "", ""]
    fences = [
        ("a\n```python\nx=1\n```\n```\nlonger text\n```", "x=1\n"), ("```Python\na\n```\nbehind", "a\n"), ("```python title=a\nb\n```", "b\n"), ("```text\nno\n```\nand\n```py\nc\n```\n```py\nccc\n```", "ccc\n"),
        ("```\nd\n```", "d\n"), ("```sql\nselect\n```", "select\n```"), ("```python\nopen", "open"), ("no block", None), ("", None), (None, None),
    ]
    assert one(spark, text.code_block("v"), t, *[(f,) for f, _ in fences]) == [w for _, w in fences]
    assert one(spark, text.model_spec("v"), t, ("eng:ven/m@high",))[0].asDict() == {"engine": "eng", "model": "ven/m", "effort": "high", "slug": "eng_ven_m_high"}
    r = spark.createDataFrame([(r"A \textbf{b} $x$ {c}",)], t).select("v", tex.mask_latex("v").alias("m")).select("v", tex.unmask_latex("m.masked", "m.held", "m.tags").alias("back")).first()
    assert r.v == r.back
    assert one(spark, text.canonical_json_sha256("v"), t, ('{"b":1,"a":"é"}',), ('{ "a":"é", "b":1 }',))[0] == one(spark, text.canonical_json_sha256("v"), t, ('{"a":"é","b":1}',))[0]


def test_reach_is_whole_and_reports_are_not_cut(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(7, 3)], "src int, dst int")
    assert relational.fix_point_reach(chain, spark.createDataFrame([(0,)], "node int")).count() == 61
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(12), 10)


def test_quotes_are_found_by_their_words(spark):
    docs = spark.createDataFrame([(1, "so xone two  three four fivex it"), (2, "one two three four five"), (3, "ab"), (4, None)], "d int, text string")
    items = spark.createDataFrame([(10, "one two three four five"), (11, "b"), (12, "one two  three four five")], "i int, quote string")
    assert sorted(map(tuple, relational.quotes(docs, items, "d", "i").collect())) == [(1, 12), (2, 10), (3, 11)]


def test_latest_todo_upsert(spark):
    log = spark.createDataFrame([("m", 1, 1, False), ("m", 1, 2, True), ("m", 2, 3, True), ("m", 2, 4, True)], "model string, item int, seq int, err boolean")
    assert sorted((r.item, r.seq) for r in relational.latest_wins(log, ["model", "item"], "seq", F.col("err")).collect()) == [(1, 1), (2, 4)]
    old = spark.createDataFrame([(1, 0.1), (2, 0.2), (9, 0.9)], "k int, score double")
    new = spark.createDataFrame([(2, 0.5)], "k int, score double")
    known = spark.createDataFrame([(1,), (2,)], "k int")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"], known).collect())) == [(1, 0.1), (2, 0.5)]
    grid = relational.todo(spark.createDataFrame([("a",)], "model string"), spark.range(2).withColumnRenamed("id", "item"), 2, spark.createDataFrame([("a", 0, 1)], "model string, item long, rep int"), ["model", "item", "rep"])
    assert sorted(map(tuple, grid.collect())) == [("a", 0, 0), ("a", 1, 0), ("a", 1, 1)]


def test_holm_ranks_pareto(spark):
    p = spark.createDataFrame([("g", i, v) for i, v in enumerate([0.01, 0.04, 0.03])], "g string, i int, p double")
    assert [round(r.p_holm, 6) for r in relational.holm(p, "p", ["g"], "i").orderBy("i").collect()] == [0.03, 0.06, 0.06]
    v = spark.createDataFrame([(10,), (20,), (20,), (30,)], "v int")
    assert sorted(r.r for r in v.select(relational.average_rank("v").alias("r")).collect()) == [1.0, 2.5, 2.5, 4.0]
    pts = spark.createDataFrame([(1.0, 0.5), (2.0, 0.4), (2.0, 0.9), (3.0, 0.9), (0.5, 0.1), (2.0, 0.9)], "c double, q double")
    assert sorted(map(tuple, relational.pareto_front(pts, "c", "q").collect())) == [(0.5, 0.1), (1.0, 0.5), (2.0, 0.9), (2.0, 0.9)]


def test_krippendorff_textbook_matrix(spark):
    # Krippendorff's published example: four observers, twelve units
    rows = ["1 1 . 1", "2 2 3 2", "3 3 3 3", "3 3 3 3", "2 2 2 2", "1 2 3 4", "4 4 4 4", "1 1 2 1", "2 2 2 2", ". 5 5 5", ". . 1 1", ". 3 . ."]
    data = [(u, c, float(v)) for u, line in enumerate(rows) for c, v in enumerate(line.split()) if v != "."]
    df = spark.createDataFrame(data, "unit int, coder int, v double")
    for level, want in (("nominal", 0.743), ("ordinal", 0.815), ("interval", 0.849)):
        assert judging.krippendorff(df, "unit", "coder", "v", level).first().alpha == pytest.approx(want, abs=6e-4)


def test_votes(spark):
    v = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "x"), (2, "y")], "item int, v string")
    assert sorted(map(tuple, judging.majority(v, ["item"], "v", 2).collect())) == [(1, 3, 2, "a"), (2, 2, 1, None)]
    e = spark.createDataFrame([(1, ["a", "b"]), (1, ["a"]), (1, ["c", "a"])], "item int, v array<string>")
    r = judging.element_votes(e, ["item"], "v", 2).first()
    assert (r["value"], r.undecided) == (["a"], [])


def test_seeded_bootstrap(spark):
    import random

    x = [0.1, 0.5, 0.7, 0.9]
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate(x)] + [("s", 0, 0.4)], "model string, i int, v double")
    rng = random.Random(1)
    means = sorted(sum(x[rng.randrange(4)] for _ in range(4)) / 4 for _ in range(200))
    out = {r.model: r for r in judging.seeded_bootstrap_ci(df, ["model"], "v", "i", 200).collect()}
    assert (out["s"].lo, out["s"].hi) == (0.4, 0.4)
    assert out["m"].lo == pytest.approx(means[4] + (means[5] - means[4]) * (0.025 * 199 - 4))


def test_energy(spark):
    s = spark.createDataFrame([(0, float(t), 100.0 + t) for t in range(0, 11)], "gpu int, t double, w double")
    w = spark.createDataFrame([(0, 1, 2.0, 6.0), (0, 2, 2.5, 3.5), (0, 3, 50.0, 60.0)], "gpu int, call int, t0 double, t1 double")
    out = {r.call: r.integral for r in timeseries.integrate(s, w, "gpu", "call", "t", "w", "t0", "t1", 2.0, 3.0).collect()}
    assert out == {1: pytest.approx(416.0), 2: pytest.approx(103.0), 3: None}
    left = spark.createDataFrame([(0, 0.5), (0, 20.0), (1, 1.0)], "gpu int, t double")
    got = {(r.gpu, r.t): r.b for r in timeseries.as_of(left, s, "gpu", "t", "w", "b").collect()}
    assert got == {(0, 0.5): 100.0, (0, 20.0): 110.0, (1, 1.0): None}
    assert {(r.gpu, r.t): r.a for r in timeseries.as_of(left, s, "gpu", "t", "w", "a", False).collect()}[(0, 0.5)] == 101.0


def test_best_match_and_credit(spark):
    seeds = spark.createDataFrame([(1, "A study of large evaluation engines in practice", 2020, "Jane Doe"), (2, "Unrelated work", 2019, "X Y")], "seed int, title string, year int, author string")
    c = [(0, "A Study of Large Evaluation Engines in Practise", [2021], ["Doe, J."], "one"), (1, "A study of large evaluation engines in practice", [2020], ["Jane Doe"], "one"), (2, "A study of large evaluation engines in practice", [2015], ["Jane Doe"], "two")]
    cand = spark.createDataFrame(c, "pos int, title string, years array<int>, authors array<string>, source string")
    m = references.best_match(seeds, cand)
    assert [(r.seed, r.source, r.pos) for r in m.collect()] == [(1, "one", 1)]
    assert {r.seed: r.status for r in references.status(m, seeds).collect()} == {1: "SINGLE", 2: "NOT_FOUND"}
    df = spark.createDataFrame([(True, True, True), (True, False, False), (True, True, False), (False, True, True), (None, True, True)], "e boolean, g boolean, r boolean")
    assert [r[0] for r in df.select(references.credit(F.col("e"), F.col("g"), F.col("r"))).collect()] == [1.0, 0.75, 0.5, 0.0, None]


def test_scorers(spark):
    a = spark.createDataFrame([("i", "Answer: B", "b"), ("j", "?", "a")], "item string, text string, key string")
    assert [r.score for r in scorers.methodology(a).collect()] == [1.0, 0.0]
    h = spark.createDataFrame([(["1. Research Design", "Unknown"], ["Results", "About X"])], "h3 array<string>, h4 array<string>")
    rules3, rules4 = [("design", "design"), ("sample", "sample")], [("results", "result")]
    r = scorers.structure(h, (rules3, {"design": 1.0, "sample": 1.0}), (rules4, {"results": 1.0, "topical": 1.0}), "topical").first()
    assert (r.ch3.f1, r.ch4.f1, r.score) == (pytest.approx(2 / 3), 1.0, 0.8333)
    g = spark.createDataFrame([("i", "One two three four [P1]. Five six seven 8 nine ten.", ["has 8", "x"])], "item string, text string, sources array<string>")
    p = scorers.grounded(g, 5, 20).first().parts
    assert p["coverage"] == 0.5 and p["cited"] == 0.5 and p["numbers"] == 1.0 and p["length"] == 1.0
    c = spark.createDataFrame([([{"a": 1.0, "b": 2.1}, {"a": 1.0, "b": 2.0}], {"a": 1.0, "b": 2.0})], "attempts array<map<string,double>>, expected map<string,double>")
    r = scorers.coding(c).first()
    assert (r.score, r.pass1, r.pass_repair) == (0.5, False, True)
    x = spark.createDataFrame([(("u", ["a", "b"]), ("u", ["a"]), {"l": ["b"]})], "got struct<s:string,l:array<string>>, want struct<s:string,l:array<string>>, undecided map<string,array<string>>")
    assert scorers.extraction(x, ["s"], ["l"]).first().score == 1.0
    tex = r"\begin{tabular}{ll}\toprule A & \textbf{B} \\ 1 & 2 \\ \bottomrule\end{tabular}"
    t = spark.createDataFrame([(tex,)], "tex string").select(scorers.table_cells("tex").alias("c")).first().c
    assert t == [["a", "b"], ["1", "2"]]
    l = spark.createDataFrame([("i", "The model has 5 items and the value is 7.", ["5"], ["model"])], "item string, text string, numbers array<string>, terms array<string>")
    p = scorers.language(l, ["the"], ["gonna"], 5, 20).first().parts
    assert p["numbers"] == 1.0 and p["invented"] == 0.5 and p["terms"] == 1.0 and p["standard"] == 1.0 and p["english"] == 0.0


def test_regressions_and_normality(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x, z = rng.normal(size=200), rng.normal(size=200)
    y = 1 + 2 * x - 0.5 * z + rng.normal(size=200)
    df = spark.createDataFrame([(i, float(a), float(b), float(c), int(c > 1)) for i, (a, b, c) in enumerate(zip(x, z, y))], "i int, x double, z double, y double, hit int")
    r = research.ols(df, "y", ["x", "z"])
    m = np.stack([np.ones(200), x, z], 1)
    want = np.linalg.lstsq(m, y, rcond=None)[0]
    assert list(r["coef"].values()) == pytest.approx(want.tolist())
    assert r["p"]["x"] < 1e-10 and 0 < r["p_f"] < 1e-10
    assert all(1 <= v < 1.2 for v in research.vif(df, ["x", "z"]).values())
    assert 1.5 < research.durbin_watson(df, "y", ["x", "z"], "i") < 2.5
    assert research.breusch_pagan(df, "y", ["x", "z"])["p"] > 0.001
    g = research.logit(df, "hit", ["x", "z"])
    assert g["coef"]["x"] > 1 and g["accuracy"] > 0.8 and 0 < g["mcfadden"] < 1
    w, p = research.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert (w, p) == (pytest.approx(0.79, abs=5e-3), pytest.approx(0.0067, abs=5e-4))
    t = research.tukey_hsd(df.withColumn("g", F.col("i") % 3), "g", "y")
    assert len(t) == 3 and t["p"].between(0, 1).all()
    assert research.krejcie_morgan(1000) == 278


def test_batches_islands_reach(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([5, 5, 1, 9, 20, 1])], "g string, i int, n int")
    assert [r.batch for r in relational.size_batches(df, "g", "i", "n", 10).orderBy("i").collect()] == [0, 0, 1, 1, 2, 3]
    v = spark.createDataFrame([("a", i, x) for i, x in enumerate("xxyyx")], "g string, i int, v string")
    assert [r.island for r in relational.islands(v, ["g"], "i", "v").orderBy("i").collect()] == [1, 1, 2, 2, 3]
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    assert sorted(r.node for r in relational.fix_point_reach(edges, spark.createDataFrame([(1,)], "node int")).collect()) == [1, 2, 3]
