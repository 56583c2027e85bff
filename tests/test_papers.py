"""Translation runs, papers, prompts, BibTeX, seeds, lookups and the sampler on small fixtures."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import bibtex, prompts, tex
from gaugeworks.operators import references, translation
from gaugeworks.sources import readers
from gaugeworks.streaming import streams


def test_flatten_puts_files_in_once():
    files = {
        "p/main.tex": "\\newcommand{\\dir}{sec}\\documentclass{a}\n\\begin{document}\\usepackage{x}\nA \\input{\\dir/one} \\include{two.tex}\\input{gone} \\n Z",
        "p/sec/one.tex": "one \\input{sub} \\input{main}",
        "p/sec/sub.tex": "sub\\newcommand{\\n}{7}\nend",
        "p/two.tex": "two \\input{sec/one}",
    }
    assert translation.flatten(files, "p/main.tex", None).split() == "A one sub end two 7 Z".split()
    assert translation.flatten(files, "p/main.tex", 3) == "\nA "
    assert translation.flatten(files, "q.tex") == ""


def test_papers(spark):
    rows = [("a", "m.tex", "x % off\n\\input{b}", True), ("a", "b.tex", "y", False), ("b", "n.tex", "no main", False), ("c", "m.tex", None, True)]
    got = dict(translation.papers(spark.createDataFrame(rows, "paper string, path string, text string, main boolean")).collect())
    assert got["a"].split() == ["x", "y"] and "b" not in got and got["c"] == ""


def test_cache(spark):
    units = spark.createDataFrame([(1, "a ⟦0⟧"), (2, "b"), (3, "a ⟦0⟧"), (4, "")], "unit int, masked string")
    cache = [("a ⟦0⟧", 1, "old", {"draft": "z ⟦0⟧"}, {}), ("a ⟦0⟧", 2, "f", {"draft": "z", "back_draft": "q", "review": "r ⟦0⟧", "back_review": " r ⟦0⟧"}, {"sim_draft": 1.0, "qa_review": 1.0, "draft_s": 2.0}), ("", 3, "e", {}, {})]
    got = {r.unit: r for r in translation.reuse_cached(units, spark.createDataFrame(cache, "masked string, seq int, final string, out map<string,string>, metrics map<string,double>")).collect()}
    assert got[1].final == "f" and got[1].out == {"review": "r ⟦0⟧"} and got[1].metrics == {"draft_s": 2.0}
    assert got[3].out == got[1].out
    assert got[2].final is None and got[2].out == {} and got[4].final is None


def test_stage_asks_again_by_itself(spark):
    units = spark.createDataFrame([(1, "a", {}), (2, "bad", {}), (3, "once", {}), (4, "c", {"draft": "kept"})], "unit int, masked string, out map<string,string>")

    def answer(masked: pd.Series) -> pd.Series:
        return masked.map(lambda t: t.upper() if t != "once" or len(masked) == 1 else "no")

    out = translation.run_stage(units.coalesce(1), "draft", answer, lambda m, a: a == m.upper() and m != "bad")
    assert {r.unit: r.out for r in out.collect()} == {1: {"draft": "A"}, 2: {}, 3: {"draft": "ONCE"}, 4: {"draft": "kept"}}


def test_glossary_terms_are_whole_words(spark):
    units = spark.createDataFrame([(1, "The red-hot C++ x.y", "merah"), (2, "reddish", "merah"), (3, "red", None), (4, "Élan red", "MERAH tua")], "unit int, masked string, final string")
    terms = spark.createDataFrame([("red", "Merah (warna)"), ("x.y", "merah"), ("xzy", "merah"), ("red N", "m"), ("+", "m"), ("a\\Eb", "m"), ("élan", "semangat")], "term string, target string")
    assert {tuple(r) for r in translation.glossary_hits(units, terms).collect()} == {(1, 2, 2), (4, 2, 1)}


def test_documents_and_counts(spark):
    pieces = spark.createDataFrame([("f", 2, "b"), ("f", 1, "a"), ("f", 3, None), ("g", 1, "c")], "file string, pos int, text string")
    back = translation.documents(pieces)
    assert dict(back.collect()) == {"f": "a\nb", "g": "c"}
    originals = spark.createDataFrame([("f", "a\nb"), ("g", "x"), ("h", "y")], "file string, text string")
    assert dict(translation.round_trip(back, originals).collect()) == {"f": True, "g": False, "h": False}
    masked = spark.createDataFrame([(r"a \emph{b c} $x$ d",), (None,)], "t string").select(tex.mask_latex("t").alias("m")).select("m.*")
    assert tuple(translation.plan_counts(masked).first()) == (2, 4, 1, 1)
    assert tuple(translation.plan_counts(masked.limit(0)).first()) == (0, 0, 0, 0)


def test_roles():
    usual = {"draft": ("a", "b"), "review": ("c", "d"), "back": ("e", "f")}
    assert translation.roles("multi", usual) == usual
    assert translation.roles("single:x:y:z", usual) == {"draft": ("x", "y:z"), "back": ("e", "f")}
    for bad in ("single:x", "other", "multi:x"):
        with pytest.raises(ValueError):
            translation.roles(bad, usual)


def test_sources_are_enough_or_an_error(spark):
    works = spark.createDataFrame([("t", 2, "b", "x" * 9, None), ("t", 1, "a", "x" * 9, "en"), ("t", 0, "n", "x" * 9, "de"), ("t", 3, "c", "x" * 9, "id"), ("u", 1, "d", "x", "en")], "topic string, pos int, id string, abstract string, language string")
    got = {r.topic: r for r in translation.pick_sources(works, 2, 5).collect()}
    assert got["t"].ids == ["a", "b"] and got["t"].enough and got["u"].ids == [] and not got["u"].enough
    with pytest.raises(Exception, match="too few sources: u"):
        translation.pick_sources(works, 2, 5, strict=True).collect()


def test_values(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    text = lambda s: F.lit(s).cast("string")
    assert one(*[prompts.likert(F.lit(x)) for x in (0.2, 2.5, 3.5, 9.0)]) == (1, 2, 4, 5)
    assert one(prompts.near_whole(F.lit(2.99995)), prompts.near_whole(F.lit(2.9))) == (True, False)
    a = lambda *v: F.array(*map(F.lit, v)).cast("array<double>")
    assert one(prompts.deviation(a(1, 5), a(2, 2)), prompts.deviation(a(), a()), prompts.deviation(a(1), a(2, 9))) == (3.0, 0.0, 1.0)
    assert one(prompts.strip_command(text(r"\textbf{a {b} c} \textbf x"), "textbf"), prompts.expected_cell(text(" A--B  R^2 "))) == (r"a {b} c \textbf x", "a–b r²")
    s = r"\x  {a{b}c} t {open"
    assert one(*[prompts.skip_group(text(s), F.lit(k)) for k in (2, 0, 14, len(s))]) == (11, 0, len(s), len(s))
    assert one(prompts.brace_group(text(r"{a\}{b}c} d"), F.lit(1)), prompts.brace_group(text("{ab"), F.lit(1)), prompts.brace_group(text(None), F.lit(1))) == (r"a\}{b}c", "ab", "")
    assert one(prompts.issue_key(text("No. 3: É-x")), prompts.shorten(text("Big Coder (Q8)"), {" (Q8)": "", "Big": "B"})) == ("no 3 x", "B Coder")
    none = F.array().cast("array<struct<key:string,why:string,files:array<string>>>")
    some = F.array(F.struct(F.lit("k").alias("key"), F.lit("gone").alias("why"), F.array(F.lit("a"), F.lit("b")).alias("files")))
    assert one(prompts.gate_text(F.lit(2), F.lit(3), none), prompts.gate_text(F.lit(2), F.lit(3), some)) == ("2 cited of 3: all known", "2 cited of 3: 1 not allowed\n- k: gone [a, b]")
    counts = F.create_map(F.lit("pages"), F.lit(3))
    assert one(prompts.build_text(F.lit(True), text(None), counts), prompts.build_text(F.lit(False), text("x"), counts)) == ("built pages=3", "failed: x")
    assert [tuple(r) for r in one(*[prompts.preview(text(t), 1) for t in ("h\r\n1\n2\n", "", None, "h")])] == [("h\n1", 2), ("", 0), ("", 0), ("h", 0)]


def test_bibtex_normal_form():
    raw = "@article{old, title={A &amp; B of C}, month=March, pages={1–2}, doi={10.1/a_b}, url={http://dx.doi.org/10.1/a_b}, year=2020}"
    got = bibtex.normal(raw, "new")
    assert got.startswith("@article{new,\n") and r"title = {{A \& B of C}}" in got and "month = mar," in got and "pages = {1--2}" in got
    assert "url" not in got and r"note = {doi: 10.1/a\_b}" in got and "doi = {10.1/a_b}" in got
    assert bibtex.normal(got) == got
    preprint = bibtex.normal("@misc{k, note={arXiv:1}, url={https://arxiv.org/abs/1}, title={T}}")
    assert "url" not in preprint and "note = {arXiv:1}" in preprint
    assert bibtex.normal("no entry") is None and bibtex.normal(None) is None
    assert bibtex.agrees(got, "A & B of C", 2021) and not bibtex.agrees(got, "A & B of C", 2022) and not bibtex.agrees(got, "Other words", 2020) and not bibtex.agrees(None, "x", 2020)


def test_footnote_figures(spark):
    rows = [("@a{k,\n title={{Deep nets2}},}", "Deep nets"), ("@a{k, title={{Top 2}},}", "Top 2"), ("@a{k, title={{Part2}}, x={{y3}}}", "Part")]
    got = [r[0] for r in spark.createDataFrame(rows, "b string, t string").select(bibtex.without_footnote(F.col("b"), F.col("t"))).collect()]
    assert got == ["@a{k,\n title={{Deep nets}},}", "@a{k, title={{Top 2}},}", "@a{k, title={{Part}}, x={{y3}}}"]


def test_seeds_and_glossary(spark):
    rows = readers.seeds(spark, "entries:\n- {key: a, title: T, year: 2020, authors: [X, Y]}\n- {key: b, title: U, verify: manual}").collect()
    assert [(r.key, r.year, r.authors, r.verify) for r in rows] == [("a", 2020, ["X", "Y"], "auto"), ("b", None, [], "manual")]
    assert readers.seeds(spark, "").count() == 0
    with pytest.raises(ValueError, match="'a'"):
        readers.seeds(spark, "entries: [{key: a}, {key: b}, {key: a}]")
    assert [tuple(r) for r in readers.glossary(spark, "red: merah\n2: dua").collect()] == [(0, "red", "merah"), (1, "2", "dua")]
    assert readers.glossary(spark, None).count() == 0


def test_context_reads_once(spark):
    reads = []
    context = readers.Context(spark, "/items")
    read = lambda s, path: reads.append(path) or s.range(1)
    assert context.table("a", read) is context.table("a", read) and reads == ["/items/a"]
    with pytest.raises(ValueError, match="private"):
        context.table("a", read, private=True)


def test_lookups_keep_to_the_cap(spark):
    wanted = spark.createDataFrame([("s", 1, f"title {k}") for k in range(6)] + [("s", 1, "Title 0!"), ("s", 2, "title 1"), ("t", 1, "title 1"), ("s", 1, "—")], "source string, day int, title string")
    cache = spark.range(1).select(references.lookup_key(F.lit("s"), F.lit("title 5"), 5).alias("key"))
    used = spark.createDataFrame([("s", 1, 1)], "source string, day int, n int")
    got = references.lookups(wanted, cache, used, {"s": 3})
    n = {(r.source, r.day, r.state): r["count"] for r in got.groupBy("source", "day", "state").count().collect()}
    assert n == {("s", 1, "ask"): 2, ("s", 1, "paused"): 3, ("s", 1, "cached"): 1, ("s", 1, "empty"): 1, ("s", 2, "ask"): 1, ("t", 1, "ask"): 1}
    assert {r.state for r in references.lookups(wanted, cache, used, {}).collect()} == {"ask", "cached", "empty"}


def test_sampler(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("100000.5,0,20.5,10,5\n100000.5,0,20.5,10,5\nbad\n100001,1,30,20,6\n,0,1,1,1\n")
    got = streams.drain(streams.sampler(spark, str(folder)), "sampler", "append", str(tmp_path / "out"))
    assert sorted((r.ts.timestamp() % 1000, r.gpu, r.watts) for r in got.select(F.to_timestamp("ts").alias("ts"), "gpu", "watts").collect()) == [(0.5, 0, 20.5), (1.0, 1, 30.0)]
