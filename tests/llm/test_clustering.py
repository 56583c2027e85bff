"""Exact clustering against whole-number brute force; intervals hold the true distances."""

import hashlib
import math
import os
import random

import numpy as np
import pytest

from gaugeworks.llm import clustering, entries

SF = "/root/testdata/sf0.001"


def plain(rows, k=8, rounds=10, dims=64, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], float).tobytes()))
    c = [v for _, v in first[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v: min((square(v, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [best(v)[1] for _, v in kept]
        c = [[sum(x) // n for x in zip(*vs)] if (n := len(vs := [v for (_, v), o in zip(kept, own) if o == j])) else m for j, m in enumerate(c)]
    out = [(i, *best(v)[::-1]) for i, v in kept]
    fits = lambda d: d if d < 2**63 else None
    per = {j: sum(d for _, o, d in out if o == j) for j in range(len(c))}
    return sorted(((i, j, fits(d), fits(per[j]), fits(sum(per.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out), key=str)


def got(df):
    return sorted(((r[0], r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def test_small(spark):
    rng = random.Random(1)
    near = [(i, [rng.choice([-1, 0, 1, 2]) / 4 for _ in range(3)]) for i in range(300)]  # few places, many ties
    odd = [(400, None), (401, []), (402, [1.0, 2.0]), (403, [1.0, None, 2.0]), (404, [1.0, float("nan"), 0.0]), (405, [float("inf"), 0.0, 0.0]), (None, [0.5, 0.25, 0.0]), (7, [0.5, 0.25, 0.0])]
    for k, rounds in ((8, 10), (3, 0), (500, 2), (1, 3)):
        assert got(clustering.cluster(frame(spark, near + odd).repartition(3), k, rounds, 3)[0]) == plain(near + odd, k, rounds, 3)


def test_wide_numbers(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 5, 12, 30]) for _ in range(4)]) for i in range(60)] + [(90 + i, [1e300, float(i), -1e300, 0.0]) for i in range(4)]
    out = got(clustering.cluster(frame(spark, rows, "double"), 5, 4, 4)[0])
    assert out == plain(rows, 5, 4, 4) and any(r[2] is None for r in out)


def test_edges(spark):
    assert clustering.cluster(frame(spark, []))[0].count() == 0 and clustering.cluster(frame(spark, [(1, [1.0])]))[0].count() == 0
    named = spark.createDataFrame([("a", [1.0, 2.0], 3, "x")], "vec_id string, embedding array<float>, cluster int, inertia string")
    assert [(r.vec_id, r.cluster, r.distance) for r in clustering.cluster(named, dims=2)[0].collect()] == [("a", 0, 0)]


def test_intervals():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 900, (400, 64)))
    c = clustering.Centroids([[int(v) for v in r] for r in np.floor(x[:20] + rng.integers(-1, 2, (20, 64)))])
    exact = np.array([[sum((int(a) - b) ** 2 for a, b in zip(r, m)) for m in c.exact] for r in x])
    mask = clustering.shortlist(x, c)
    assert (np.take_along_axis(mask, exact.argmin(1)[:, None], 1)).all() and mask.sum() < 1.2 * len(x)
    assert (clustering.nearest(x, c) == exact.argmin(1)).all()
    twins = clustering.Centroids([*c.exact, *c.exact])
    assert clustering.shortlist(x, twins).sum() >= 2 * len(x) and (clustering.nearest(x, twins) == exact.argmin(1)).all()


def test_limbs():
    for v in (0, 5, -5, 1 << 40, -(1 << 40), 3**200, -(3**200)):
        assert sum(p << (40 * k) for k, p in clustering.limbs(v)) == v and all(abs(p) < 1 << 41 for _, p in clustering.limbs(v))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_op13(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got(entries.op13_clustering(spark, SF)) == plain(rows)
