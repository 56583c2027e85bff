"""Word sets that meet in blocks, against all pairs."""

import random

import pytest

from gaugeworks.operators import relational


def sets():
    rnd = random.Random(9)
    stems = [rnd.sample(range(400), rnd.randint(1, 90)) for _ in range(25)]
    out = [frozenset(rnd.sample(s, rnd.randint(max(len(s) // 2, 1), len(s))) + rnd.sample(range(400), rnd.randint(0, 9))) for s in stems for _ in range(6)]
    # copies, a word that all have, words that one alone has
    return [*[s | {1000} for s in out], *[out[0] | {1000}] * 5, frozenset([5000]), frozenset([5001, 5002])]


def want(own, num, den):
    first = {}
    for k, s in enumerate(own):
        first.setdefault(s, k)
    node = sorted(first.items(), key=lambda x: x[1])
    return {(i, j): len(s & t) / len(s | t) for s, i in node for t, j in node if i < j and den * len(s & t) >= num * len(s | t)}


@pytest.mark.parametrize("num, den, size, words", [(35, 100, 16, 700), (35, 100, 500, 10**6), (85, 100, 16, 700), (1, 20, 7, 50)])
def test_pairs_of_blocks_are_all_pairs(spark, monkeypatch, num, den, size, words):
    for name, value in (("BLOCK_SETS", size), ("BLOCK_WORDS", words), ("FREQUENCIES", 64)):
        monkeypatch.setattr(relational, name, value)
    own = sets()
    mixed = lambda x: (x * 7919 - 999983) * 104729
    df = spark.createDataFrame([(k, [mixed(x) for x in s]) for k, s in enumerate(own)], "node long, w array<long>").repartition(5)
    blocks = relational._set_blocks(df).collect()
    assert max(len(r.node) for r in blocks) <= size and all(len(r.w) <= words or len(r.node) == 1 for r in blocks)
    got = relational.jaccard_pairs(df, num, den)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # no pair goes through a shuffle
    assert {(r.a, r.b): r.jaccard for r in got.collect()} == pytest.approx(want(own, num, den))


def test_blocks_come_with_the_order_of_their_words(spark):
    """Blocks are sorted once, when they are cut, not at every meeting."""
    df = spark.createDataFrame([(k, [int(x) for x in s]) for k, s in enumerate(sets())], "node long, w array<long>")
    for r in relational._set_blocks(df).collect():
        assert [r.w[i] for i in r.up] == sorted(r.w)
