import numpy as np

from gaugeworks.llm.ann import Codebooks, build, cosine, encode, fit, search


def brute(rows, asked, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v) and len(v) == 16}
    out = {}
    for q in asked:
        if q in good:
            s = [(-float(cosine(good[q][None], x[None])[0]), i) for i, x in good.items() if i != q]
            out[q] = [(i, -d) for d, i in sorted(s)[:k]]
    return out


def test_beam_finds_what_all_sums_show():
    rng = np.random.default_rng(1)
    books = Codebooks(rng.normal(size=(3, 4, 5)).astype(np.float32))
    x = rng.normal(size=(20, 5)).astype(np.float32)
    codes, norm = encode(books, x, 64)
    for row, code, size in zip(x, codes, norm):
        sums = {(a, b, c): books.words[0, a] + books.words[1, b] + books.words[2, c] for a in range(4) for b in range(4) for c in range(4)}
        best = min(sums, key=lambda t: np.square(row - sums[t]).sum())
        assert tuple(code) == best
        assert abs(np.square(sums[best]).sum() - size) < 1e-3
    x = rng.normal(size=(400, 5)).astype(np.float32)
    books = fit(x, 4, 8)
    codes, _ = encode(books, x)
    rest = x - books.words[np.arange(4), codes].sum(1)
    assert np.square(rest).mean() < 0.25 * np.square(x).mean()


def test_recall_and_edges(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(4000 + i, x[7].tolist()) for i in range(300)] + [(5000, None), (5050, [0.0] * 16), (5100, [1.0] * 15 + [None]), (5150, [float("nan")] * 16), (5200, [1.0, 2.0]), (5250, [float("inf")] * 16), (None, x[1].tolist()), rows[0], (5300, (x[7] * 2).tolist())]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows], "vec_id long, embedding array<double>, score double")
    asked = df.where("vec_id % 50 = 0")
    out = search(asked, build(df, sample=2000, k=32), 5, 64).collect()
    want = brute(rows, [i for i, _ in rows if i is not None and i % 50 == 0], 5)
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert [i for i, _ in got[4000]] == [i for i, _ in want[4000]]
    assert got[5300] == want[5300]
    passes = search(asked, build(df, sample=2000, k=32), 5, 64, pass_rows=30).collect()
    assert sorted(passes) == sorted(out)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    out = search(df.where("vec_id = 0"), build(df), 5).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    none = df.limit(0)
    assert search(none, build(none)).count() == 0
