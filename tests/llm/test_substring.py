import random
import re

from gaugeworks.llm.substring import SuffixAutomaton, drop_repeats, find_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    for i, t in rows:
        ws = WORD.findall(t or "")
        for a in range(len(ws) - window + 1):
            k, at = tuple(ws[a : a + window]), (-1 if i is None else i, a)
            first[k] = min(first.get(k, at), at)
    out = []
    for i, t in rows:
        ws = WORD.findall(t or "")
        gone = set()
        for a in range(len(ws) - window + 1):
            if first[tuple(ws[a : a + window])] < (-1 if i is None else i, a):
                gone.update(range(a, a + window))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=str)


def test_matching_statistics():
    rnd = random.Random(1)
    held, automaton = [], SuffixAutomaton()
    for _ in range(40):
        s = [rnd.randint(0, 2) for _ in range(rnd.randint(1, 25))]
        inside = lambda x: any(h[k : k + len(x)] == x for h in held for k in range(len(h)))
        want = [max(n for n in range(e + 2) if n == 0 or inside(s[e + 1 - n : e + 1])) for e in range(len(s))]
        assert automaton.statistics(s) == want
        automaton.add(s)
        held.append(s)


def case():
    rnd = random.Random(7)
    text = lambda n, v: " ".join(rnd.choice("abcdefghijklmnop"[:v]) for _ in range(n))
    shared = [text(n, 16) for n in (8, 12, 30, 200)]
    rows = []
    for i in range(120):
        parts = [text(rnd.randint(0, 30), rnd.choice([2, 3, 16])), rnd.choice(shared), text(rnd.randint(0, 9), 16), rnd.choice(shared)]
        rows.append((i * 3 % 121, rnd.choice(["  ", "\n", " "]).join(parts)))
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "a " * 500), (504, "x y " * 300), (505, "é漢 " * 9), (None, shared[3]), (2, rows[5][1]), rows[9], rows[9]]
    return rows


def test_against_brute_force(spark):
    rows = case()
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, chunk int").repartition(5)
    for window in (8, 20):
        out = find_repeats(docs, window).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out), key=str) == brute(rows, window)
        assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in out)
    got = drop_repeats(docs, 8)
    assert got.columns == docs.columns
    want = {(i, k) for i, _, _, k in brute(rows, 8)}
    texts = got.collect()
    assert len(texts) == len(rows) and {(r.doc_id, " ".join(WORD.findall(r.text or ""))) for r in texts} == want
    clean = {i for i, n, m, _ in brute(rows, 8) if m == 0}
    assert {(r.doc_id, r.text) for r in texts if r.doc_id in clean - {2}} == {(i, t) for i, t in rows if i in clean - {2}}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert find_repeats(docs).count() == 0 and drop_repeats(docs).count() == 0


def test_long_texts_pick_places_as_short_ones_do():
    import numpy as np

    from gaugeworks.llm.substring import least_places

    g = np.tile(np.array([7, 3, 3, 9, 1, 1, 8], np.uint64), 40)
    n = len(g) - 17 + 1
    want = least_places(g, 17, n)
    assert all((least_places(g, 17, n, step) == want).all() for step in (1, 5, 64))


def test_ids_of_other_types_and_clashing_names(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(2, text, 1, 2), (1, text, 3, 4), (None, None, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _was_null int, _key int")
    got = drop_repeats(docs, 20)
    assert got.schema.simpleString() == docs.schema.simpleString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(2, "", 1, 2), rows[1], rows[2]], key=str)
