"""The title join by blocks, against all pairs."""

import difflib
import random

import pytest

from gaugeworks.operators import titles


def changed(rnd, s):
    s = list(s)
    for _ in range(rnd.randint(0, 6)):
        at = rnd.randrange(len(s) + 1)
        s[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "e", " ", "é", "7"])
    return "".join(s) or "a"


def sides(n):
    rnd = random.Random(4)
    stems = ["".join(rnd.choice("abcde xyz") for _ in range(rnd.randint(1, 70))) for _ in range(n)]
    return [sorted({changed(rnd, s) for s in stems for _ in range(4)}) for _ in "ab"]


def ratio(x, y):
    return difflib.SequenceMatcher(None, x, y).ratio()


@pytest.mark.parametrize("least", [0.3, 0.6, 0.9, 0.95, 1.0])
def test_the_screen_loses_no_pair(least, monkeypatch):
    monkeypatch.setattr(titles, "FEATURES", 16)
    a, b = sides(30)
    i, j = titles._met(a, b, least)
    want = {(x, y) for x in range(len(a)) for y in range(len(b)) if ratio(a[x], b[y]) >= least}
    assert want and want <= set(zip(i.tolist(), j.tolist()))
    assert least < 0.9 or len(i) < 2 * len(want)


def test_blocks_are_bounded_and_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(titles, "BLOCK", 16)
    a, b = sides(30)
    a, b = a + ["same start of a title " + str(k) for k in range(90)], b + ["same start of a title " + str(k) for k in range(45, 135)]
    da, db = (spark.createDataFrame([(x,) for x in side], "f string").repartition(5) for side in (a, b))
    blocks = titles._blocks(da, "a", 2).collect()
    assert max(len(r.a) for r in blocks) <= 16 and sorted(x for r in blocks for x in r.a) == sorted(a)
    assert all(r.a_lo == min(map(len, r.a)) and r.a_hi == max(map(len, r.a)) for r in blocks)
    got = titles.alike_strings(da, db, 0.9)
    assert "Hash" not in got._jdf.queryExecution().executedPlan().toString()  # no pair goes through a shuffle
    assert {(r.fa, r.fb): r.ratio for r in got.collect()} == {(x, y): ratio(x, y) for x in a for y in b if ratio(x, y) >= 0.9}
