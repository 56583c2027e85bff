import random
import re

import numpy as np

from gaugeworks.llm.decontamination import drop_contaminated, find, verdict
from gaugeworks.llm.fm_index import FMIndex, suffix_array

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window):
    out = []
    for i, t in docs:
        ws, hit, own = words_of(t), set(), set()
        for item, b in items:
            bs = words_of(b)
            size = min(window, len(bs))
            for a in range(len(bs) - size + 1 if size else 0):
                for p in range(len(ws) - size + 1):
                    if ws[p : p + size] == bs[a : a + size]:
                        hit.update(range(p, p + size))
                        own.add(str(item))
        out.append((i, len(ws), len(hit), sorted(own), bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=str)


def test_suffix_array_and_index():
    rng = np.random.default_rng(2)
    for text in (rng.integers(0, 3, 400), np.zeros(50, np.int64), np.tile([1, 2], 60), np.array([1])):
        want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert suffix_array(text).tolist() == want
        index = FMIndex(text, 4, 7)
        phrases = rng.integers(0, 3, (30, 3))
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text) - 2) if (text[i : i + 3] == p).all()]


def case():
    rnd = random.Random(4)
    vocab = ["alpha", "Beta", "é漢", "x1", "y", "zz", "of", "THE"]
    text = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "\n", " -- ", "\x7f"]) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([2, 3, 5, 6, 9, 20, 0])] + [(7, None), (8, "..."), (10, "unheard of"), (2, text(4))]
    docs = [(k, text(rnd.randint(0, 40))) for k in range(60)] + [(60, None), (61, ""), (62, items[5][1].upper()), (63, "q " * 3000 + items[5][1]), (62, items[5][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = case()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, items int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 40):
        out = verdict(find(d, b, 5, block_bytes=block)).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in out), key=str) == brute(docs, items, 5)
        kept = drop_contaminated(d, b, 5, block_bytes=block)
        assert kept.columns == d.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(x[0] for x in brute(docs, items, 5) if not x[4])


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.spans) for r in find(d, none).collect()] == [(3, [])]
    assert drop_contaminated(d, none).count() == 1
    assert find(d.limit(0), none).count() == 0


def test_repeated_item_counts_once_in_one_pass(spark):
    d = spark.createDataFrame([(1, "a b c d e and f g h i j")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "a b c d e"), (7, "a b c d e"), (7, "f g h i j"), (8, "a b c d e")], "item_id long, text string")
    for block in (1 << 20, 8):
        assert [r["items"] for r in find(d, b, 5, block_bytes=block).collect()] == [["7", "8"]]


def test_items_without_an_id_hit_as_in_sql(spark):
    import duckdb

    from gaugeworks.llm import entries

    rows = {1: "a b c d e " * 4, 2: "z " * 9 + "f g h i j k l m n o p q r", 3: "nothing of it", 4: "f g h i j k l m n o p q r a b c d e"}
    items = [(None, "a b c d e"), (None, "a b c d e"), (7, "f g h i j k l m n o p q r"), (None, None)]
    d = spark.createDataFrame(sorted(rows.items()), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", sorted(rows.items()))
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    cur = con.execute(entries.OP2_SQL)
    at = [[c[0] for c in cur.description].index(k) for k in ("doc_id", "n_words", "n_hit", "n_items", "contaminated")]
    want = sorted(tuple(r[k] for k in at) for r in cur.fetchall())
    for block in (1 << 20, 8):
        out = verdict(find(d, b, block_bytes=block)).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"]), r.contaminated) for r in out) == want
        assert {r.doc_id: r["items"] for r in out} == {1: [None], 2: ["7"], 3: [], 4: ["7", None]}
        assert [r.doc_id for r in drop_contaminated(d, b, block_bytes=block).collect()] == [3]
