"""Resampling and its radix selection against plain versions."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import entries, resampling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def features(text, longest):
    ws = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b < 91 else b for b in (text or "").encode()))]
    return ws, [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


def plain(docs, target, percent=10, least=20, longest=1, buckets=10_000, seed=2024):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    rows = [(i, *features(t, longest)) for i, t in docs]
    s, t = Counter(of(f) for _, _, fs in rows for f in fs), Counter(of(f) for x in target for f in features(x, longest)[1])
    sn, tn = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sn + buckets) / ((s[b] + 1) * (tn + buckets))))
    out = []
    for i, ws, fs in rows:
        w = math.floor(sum(gain(of(f)) for f in fs) / len(fs)) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(ws), len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {r[0]: k + 1 for k, r in enumerate(fit[: len(fit) * percent // 100])}
    return sorted(((i, n, w, sc, rank.get(i)) for i, _, n, w, sc in out), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "gämma", "d3", "epsilon", "ZETA", "eta", "theta"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 20, 40])))) for i in range(-20, 180)]
    return [*docs, (500, None), (501, ""), (502, "x." * 50_000), (503, "word " * 30)], ["alpha beta", "beta eta eta", None, ""]


@pytest.mark.parametrize("longest,percent", [(1, 10), (3, 37), (1, 100)])
def test_against_plain(spark, texts, longest, percent):
    docs, target = texts
    out = resampling.resample(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), percent, 20, longest, 500)
    assert got(out) == plain(docs, target, percent, 20, longest, 500)


def test_edges(spark, texts):
    docs, target = texts
    frame, aim = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(t,) for t in target], "text string")
    assert resampling.resample(frame.limit(0), aim).count() == 0
    assert got(resampling.resample(frame, aim.limit(0))) == plain(docs, [])
    assert {r["rank"] for r in resampling.resample(frame, aim, 0).collect()} == {None}
    # repeated rows: one key, as many places as rows; a null id last
    same = spark.createDataFrame([(7, "word " * 20)] * 10 + [(None, "word " * 20)], SCHEMA)
    ranks = [r["rank"] for r in resampling.resample(same, aim, 50).collect()]
    assert sorted(r for r in ranks if r) == [1, 2, 3, 4, 5]
    own = frame.select(F.col("doc_id").cast("string"), "text", F.lit(1).alias("rank"), F.lit("x").alias("score"), F.lit(2).alias("weight"))
    taken = resampling.drawn(own, aim, percent=25)
    n = sum(len(features(t, 1)[0]) >= 20 for _, t in docs)
    assert taken.columns == own.columns and taken.count() == n // 4 and {(r["rank"], r.score, r.weight) for r in taken.collect()} == {(1, "x", 2)}


def test_kth_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice([-(2**63), -5, 0, 7, 2**40, 2**63 - 1]), rng.randrange(-(10**12), 10**12) // 10**9, k) for k in range(600)]
    frame = spark.createDataFrame(rows, "a long, b long, c long")
    for k in (1, 2, 299, 300, 600):
        key = resampling.kth_key(frame, k, ["a", "b", "c"])
        assert tuple(key) == sorted(rows)[k - 1] and frame.where(resampling.up_to(["a", "b", "c"], key)).count() == k


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_op12(spark):
    read = lambda t, c: [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c, "text").collect()]
    assert got(entries.op12_resampling(spark, SF)) == plain(read("documents", "doc_id"), [t for _, t in read("benchmark", "item_id")])
