"""The stages over planted documents, against what each promises."""

import random
import re

import corpus_pipeline
from gaugeworks.llm.common import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plant(spark, folder):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice(["ba", "ko", "mi", "tu", "re", "so", "ni", "la"]) for _ in range(rnd.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for i in range(500):
        kind = rnd.random()
        text = prose(rnd.randint(60, 160))
        if kind < 0.15:
            text = " ".join(w.upper() + "$$$" for w in text.split())
        elif kind < 0.3:
            text = text.replace(" ", " moron ", 4)
        docs.append((i, text))
        labels.append((i, int(kind >= 0.15), int(0.15 <= kind < 0.3)))
    clean = [k for k, q, t in labels if q and not t]
    texts = dict(docs)
    passage, item = prose(60), prose(40)
    base = prose(200)
    extra = {
        1000: texts[clean[0]],
        1001: base,
        1002: base + " " + prose(3),
        1003: prose(50) + " " + passage + " " + prose(50),
        1004: prose(50) + " " + passage + " " + prose(50),
        1005: prose(60) + " " + item + " " + prose(60),
        1006: None,
        1007: "",
    }
    docs += extra.items()
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item), (1, prose(30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(docs), labels, clean, passage, item


def test_stages(spark, tmp_path):
    texts, labels, clean, passage, item = plant(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, str(tmp_path)), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        seen[name] = docs
    first = {r.doc_id for r in seen["quality_filter"].collect()}
    bad = {k for k, q, t in labels if not q or t}
    assert len(first & bad) <= 0.1 * len(bad) and len(first & set(clean)) >= 0.98 * len(clean)
    second = {r.doc_id for r in seen["near_copies"].collect()}
    assert second <= first and first - second == {k for k in (1000, 1002) if k in first}
    third = {r.doc_id: r.text for r in seen["repeated_passages"].collect()}
    assert third.keys() == second
    for k in second - {1004}:
        assert third[k] == texts[k]
    assert len(WORD.findall(third[1004])) == 100
    fourth = {r.doc_id for r in seen["decontaminate"].collect()}
    assert third.keys() - fourth == {1005}
    last = seen["tokenize"].collect()
    assert {r.doc_id for r in last} == fourth and all(r.n_tokens * 4 == len(r.ids) for r in last)


def test_empty(spark, tmp_path):
    plant(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
