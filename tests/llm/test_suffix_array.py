import numpy as np

from gaugeworks.llm.suffix_array import find_passages, sorted_suffixes
from tests.llm.test_substring import brute, case


def test_sorted_suffixes():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 3, (60, 5)).astype(np.uint32)
    order, common = sorted_suffixes(rows)
    ordered = rows[order].tolist()
    assert ordered == sorted(rows.tolist())
    for k in range(1, 60):
        want = next((i for i in range(5) if ordered[k][i] != ordered[k - 1][i]), 5)
        assert common[k] == want


def test_against_brute_force(spark):
    rows = case()
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, kept int").repartition(5)
    for window in (8, 50):
        out = find_passages(docs, window).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out), key=str) == brute(rows, window)


def test_empty(spark):
    assert find_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
