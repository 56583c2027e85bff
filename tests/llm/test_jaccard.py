import random
import re

from gaugeworks.llm.jaccard import classes, keep_one

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, n):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(ws[a : a + n]) for a in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set()


def brute(rows, n, num, den):
    own = [shingles(t, n) for _, t in rows]
    label = list(range(len(rows)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, a in enumerate(own):
        for j in range(i):
            b = own[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                label[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(own[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def case():
    rnd = random.Random(11)
    rows = []
    line = " ".join(f"boiler{k}" for k in range(12))
    for _ in range(14):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.randint(1, 14)):
            own = base[:]
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 8])):
                own[rnd.randrange(len(own))] = f"x{rnd.randint(0, 50)}"
            rows.append(" ".join(own) if rnd.random() < 0.7 else " ".join(own).upper() + "\n" + (line if rnd.random() < 0.4 else ""))
    rows += [None, "", " \n", "one", "One", "one two", "é 漢", "z " * 4000, "z " * 4001, line, line + " more"]
    rnd.shuffle(rows)
    return list(enumerate(rows)) + [(3, rows[3])]


def test_against_brute_force(spark):
    rows = case()
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, node int").repartition(6)
    for n, num, den in ((4, 85, 100), (5, 4, 5)):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in classes(docs, n, num, den).collect())
        assert got == brute(rows, n, num, den)
    kept = keep_one(docs, 5, 4, 5)
    assert kept.columns == docs.columns
    want = {c for i, n, c in brute(rows, 5, 4, 5)}
    rows_of = dict(rows)
    got = kept.collect()
    assert sorted(r.doc_id for r in got) == sorted(want) and all(r.text == rows_of[r.doc_id] for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert classes(docs).count() == 0 and keep_one(docs).count() == 0


def test_ids_of_other_types_and_clashing_names(spark):
    rows = [(3, "a b c d e f g", 1, 9), (1, "a b c d e f g", 2, 8), (2, "other words stand in here today", 3, 7), (None, None, 4, 6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _was_null int, _key int")
    got = keep_one(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[2], rows[3]], key=str)


def test_members_just_below_the_threshold(spark):
    """A group whose members link with few others: classes come out whole, and few pairs are made."""
    rnd = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(160):
        own = base[:]
        for k in rnd.sample(range(60), rnd.choice([0, 1, 1, 2, 2])):
            own[k] = f"e{rnd.randint(0, 9)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in classes(docs, 4, 85, 100).collect())
    assert got == brute(rows, 4, 85, 100)
