import pytest
from hypothesis import given
from hypothesis import strategies as st

from gaugeworks.functions import tex
from gaugeworks.operators import relational

PIECES = ["a", " ", "12", ".", "{", "}", "$", "\\", "\\emph{", "\\textbf{", "\\cite[p]{k}", "~", "&", "%", "<1>", "⟦0⟧", "\\%", "\\(", "\\)", "[", "]"]


@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_masking_is_undone(pieces):
    line = "".join(pieces)
    assert tex.unmask(*tex.mask(line)) == line


def test_masks_and_what_comes_back():
    assert tex.mask(r"A \textbf{b \emph{c} d} 58\% ok~\ref{a{b}} % rest") == ("A <1>b <2>c</2> d</1> 58⟦0⟧ ok⟦1⟧ ⟦2⟧", ["\\%", "~\\ref{a{b}}", "% rest"], ["textbf", "emph"])
    assert tex.mask(None) == ("", [], []) and tex.mask(r"un \textbf{b") == ("un ⟦0⟧", [r"\textbf{b"], [])
    assert tex.unmask("“x” – 5% <1>y</1> <2> ⟦7⟧<9>z</9>", [], ["textit"]) == "``x'' -- 5\\% \\textit{y}  \\emph{z}"


def test_cells_and_macros():
    assert tex.cells(r"a & \textbf{b & c} & $x & y$ & 5\& 6") == ["a ", r" \textbf{b & c} ", " $x & y$ ", r" 5\& 6"]
    assert tex.cells("a") is None and tex.cells(None) is None and tex.cells("&") == ["", ""]
    known = tex.definitions(r"\newcommand{\num}{5{a}\}} \renewcommand*{\x} {\num} \newcommand{\e}{} \newcommand{\num}{6} \newcommand{\open}{ab")
    assert known == {"num": "6", "x": r"\num", "e": "", "open": "ab"} and tex.definitions(None) == {}
    assert tex.expand(r"\x{} and \x y\e{}, \xx", known) == r"6 and 6 y, \xx"
    assert tex.expand(r"\a", {"a": r"\b", "b": r"\c", "c": r"\d", "d": "no"}) == r"\d" and tex.expand(None, known) is None


def one(spark, expr, *rows):
    return [r.x for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, v string, w string").select("k", expr.alias("x")).orderBy("k").collect()]


def test_tex_expressions(spark):
    assert one(spark, tex.intact("v", "w"), ("5⟦0⟧ <1>a</1>", "<1>b</1> 5⟦0⟧"), ("5.2⟦0⟧", "5,2⟦0⟧"), ("5⟦0⟧", "⟦0⟧ 5"), ("⟦0⟧", "⟦0⟧⟦0⟧"), ("<1>a</1>", "<1>a"), ("a}", "a"), ("", "")) == [True, True, False, False, False, False, True]
    assert one(spark, tex.ref_words("v"), (r"See Fig.~\ref{a}, SubFigure~\ref{b}, Tables~\ref{c}; Figure 1", ""), (None, "")) == [r"See Gambar~\ref{a}, SubFigure~\ref{b}, Tabel~\ref{c}; Figure 1", None]
    assert one(spark, tex.ref_words("v", {"A": "B", "B": "C"}), (r"A~\ref{x} B~\ref{y}", "")) == [r"B~\ref{x} C~\ref{y}"]
    assert one(spark, tex.strip_comments("v"), ("a % b\r\n5\\% c%d\n%\n", ""), ("", ""), (None, "")) == ["a \n5\\% c\n", "", None]
    rows = [("x", "Heading 3"), ("x", "Title"), ("IV. Method", None), ("B. Data", ""), ("2.1.4.2 Deep", ""), ("3 Wide", ""), ("1. Ends with a point.", ""), ("NON-LINEAR MODELS", ""), ("ABC", ""), ("[ABCD]", ""), ("plain", ""), (None, None)]
    assert one(spark, tex.heading_level("w", "v"), *rows) == [3, 0, 1, 2, 3, 1, None, 1, None, None, None, None]
    assert one(spark, tex.heading_text("v"), (" 2.1 Data ", ""), ("NON-LINEAR MODELS", ""), ("plain One", ""), (None, "")) == ["Data", "Non-Linear Models", "plain One", None]
    assert [tuple(x) for x in one(spark, tex.post_edits("v", [("a", "b"), ("b", "c"), ("z", "c"), ("q", "r")], [("c", "d")]), ("a b", ""))] == [("d d", ["q"])]
    assert one(spark, tex.post_edits("v", [])["missing"], ("a", "")) == [[]]
    assert [r.open - r.close for r in one(spark, tex.brace_counts("v"), (r"{a\{}}", ""), ("{{", ""))] == [-1, 2]


def test_numbers_that_do_not_agree(spark):
    d = lambda *rows: spark.createDataFrame(list(rows), "name string, value double")
    got = relational.differing(d(("a", 1.0), ("b", 2.0), ("c", 3.0), ("n", None)), d(("a", 1.01), ("b", 2.5), ("d", 4.0), ("n", None)), "name", "value", 0.02)
    assert {r.name: (r.state, r.difference) for r in got.collect()} == {"b": ("differs", pytest.approx(0.5)), "c": ("not computed", None), "d": ("not printed", None)}
    assert relational.differing(d(("a", 1.0)).limit(0), d(("a", 1.0)).limit(0), "name", "value", 0.1).count() == 0
