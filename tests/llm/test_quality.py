import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import quality
from gaugeworks.llm.common import packed


def brute(model, features):
    rows = [model.row_of[f] for f in features if model.row_of[f] >= 0]
    x = 1 / np.sqrt(max(1, len(rows)))
    z = model.bias + sum(model.weight[r] for r in rows) * x
    for i, a in enumerate(rows):
        for b in rows[:i]:
            z += float(model.factors[a] @ model.factors[b]) * x * x
    return 1 / (1 + np.exp(-z))


def test_identity_equals_all_pairs():
    texts = ["The same words the SAME", "", "a|b|c\nd $$ 12", "zz " * 40]
    buf, offs = packed(pa.array(texts))
    doc, feature = quality.features(buf, offs, np.array([5, -1, 3, 9]))
    rng = np.random.default_rng(1)
    model = quality.Model(np.full(quality.N_FEATURES, -1, np.int32), 0.3, rng.normal(size=50), rng.normal(size=(50, 3)))
    model.row_of[np.unique(feature)] = np.arange(len(np.unique(feature))) % 50
    got = quality.score(model, doc, feature, len(texts))
    assert got == pytest.approx([brute(model, feature[doc == d]) for d in range(len(texts))])


def corpus(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        text = " ".join(("word%d" if good else "W%d$$$") % k for k in rng.integers(0, 60, rng.integers(5, 60)))
        rows.append((i, text, len(text), "s"))
        labels.append((i, int(good)))
    rows += [(600, None, None, None), (601, "", 0, None), (602, "x" * 300_000, 300_000, None), (3, rows[3][1], rows[3][2], "dup")]
    labels += [(3, None), (9999, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality.train(docs, labels, max_rows=500, exclude=held)
    out = {r.doc_id: r.score for r in quality.classify(docs, model).where(held).collect()}
    right = [(s >= 0.7) == (i % 4 != 0) for i, s in out.items() if i < 600]
    assert len(right) > 80 and np.mean(right) > 0.97
    every = quality.classify(docs, model).collect()
    assert len(every) == docs.count() and all(0 <= r.score <= 1 for r in every)
    kept = quality.keep(docs, [(model, 0.7)])
    assert kept.columns == docs.columns and 440 < kept.count() < 460


def test_empty(spark):
    docs, labels = corpus(spark)
    model = quality.train(docs.limit(0), labels)
    assert quality.classify(docs.limit(0), model).count() == 0
    assert quality.classify(docs, model).count() == docs.count()


def test_rows_of_one_id_count_once(spark, monkeypatch):
    """max_rows bounds rows, also where one labelled id stands in many."""
    rows = [(1, f"text {k} of many", None) for k in range(3000)] + [(k, "good words here", None) for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda doc, feature, label, **how: seen.append(len(label)))
    quality.train(docs, labels, max_rows=10)
    quality.train(docs, labels)
    assert seen == [10, 39]
