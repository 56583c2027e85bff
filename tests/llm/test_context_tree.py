import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gaugeworks.llm import context_tree
from gaugeworks.llm.context_tree import log_gamma, score

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def stream(t):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
    return b"".join(w + b" " for w in WORD.findall(low)) + b"\n", WORD.findall(low)


class Brute:
    """The recursion as written, context by context."""

    def __init__(self, texts, depth):
        self.depth, self.n, self.memo = depth, {}, {}
        self.below = {}
        for t in texts:
            s = b"\n" * depth + stream(t)[0]
            for i in range(depth, len(s)):
                for d in range(depth + 1):
                    ctx = s[i - d : i]
                    for b in range(8):
                        node = (ctx, 1 << b | s[i] >> (8 - b))
                        self.n.setdefault(node, [0, 0])[s[i] >> (7 - b) & 1] += 1
                        if d:
                            self.below.setdefault((ctx[1:], node[1]), set()).add(ctx)

    def kt(self, node):
        a, b = self.n.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def pw(self, node):
        if node not in self.memo:
            kt = self.kt(node)
            if len(node[0]) < self.depth:
                kt = np.logaddexp(kt, sum(self.pw((c, node[1])) for c in self.below.get(node, ()))) - math.log(2)
            self.memo[node] = kt
        return self.memo[node]

    def p(self, node, bit, past):
        if node not in self.n:
            return 0.5
        own = (self.n[node][bit] + 0.5) / (sum(self.n[node]) + 1)
        d = len(node[0])
        if d == self.depth:
            return own
        w = math.exp(self.kt(node) - math.log(2) - self.pw(node))
        return w * own + (1 - w) * self.p((past[len(past) - d - 1 :], node[1]), bit, past)

    def score(self, t):
        s, out = b"\n" * self.depth + stream(t)[0], 0
        for i in range(self.depth, len(s)):
            for b in range(8):
                out += math.log10(self.p((b"", 1 << b | s[i] >> (8 - b)), s[i] >> (7 - b) & 1, s[i - self.depth : i]))
        return out


def case():
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(["The", "cat", "sat", "naïve", "on", "é漢", "mats"]) for _ in range(rnd.randint(0, 12)))) for i in range(40)]
    return rows + [(40, None), (41, ""), (42, " \n"), (43, "zzz" * 30), rows[3], (None, "cat")]


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 3, 10.5, 1e3, 1e7])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_against_the_recursion(spark):
    rows = case()
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    learn = lambda i: i is None or i % 4 != 0
    out = sorted(score(docs, F.col("doc_id") % 4 != 0).collect(), key=str)
    model = Brute([t for i, t in rows if learn(i)], context_tree.DEPTH)
    count = Counter()
    for i, t in rows:
        if learn(i):
            count.update([*stream(t)[1], None])
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        tokens = [*stream(t)[1], None]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)
        want.append((i, learn(i), len(tokens), sum(count[x] > 0 for x in tokens), n, base, own := model.score(t), size := len(stream(t)[0]), -own * math.log2(10) / size))
    by = lambda r: (str(r[0]), r[5])
    for r, w in zip(sorted(map(tuple, out), key=by), sorted(want, key=by), strict=True):
        assert r[:5] == w[:5]
        assert np.allclose(r[5:], w[5:], rtol=1e-9), (r, w)


def test_probabilities_sum_to_one_and_learning_helps(spark):
    rows = case()
    model = Brute([t for _, t in rows], 2)
    for past in (b"\n\n", b"at", b"qq"):
        total = 0
        for x in range(256):
            p = 1
            for b in range(8):
                p *= model.p((b"", 1 << b | x >> (8 - b)), x >> (7 - b) & 1, past)
            total += p
        assert abs(total - 1) < 1e-9


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert score(docs.limit(0), F.lit(True)).count() == 0
    r = score(docs, F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)
    assert abs(r.score - 5 * 8 * math.log10(0.5)) < 1e-9
