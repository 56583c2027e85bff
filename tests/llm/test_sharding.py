import zlib
from collections import defaultdict
from itertools import product

from gaugeworks.llm.sharding import differencing, shard


def spread(sizes, part, k):
    sums = [0] * k
    for s, p in zip(sizes, part):
        sums[p] += s
    return max(sums) - min(sums)


def test_differencing_is_near_the_best():
    sizes = [8, 7, 6, 5, 4, 13, 2, 9]
    best = min(spread(sizes, p, 3) for p in product(range(3), repeat=len(sizes)))
    assert spread(sizes, differencing(sizes, 3), 3) <= best + 2
    assert differencing([], 4) == []
    assert sorted(differencing([5, 5], 2)) == [0, 1]


def test_shards(spark):
    rows = [(i, t, "x", 0) for i, t in enumerate(["", None, "é" * 50, "same", "same", None] + ["w" * (i % 37) + str(i) for i in range(300)] + ["hot"] * 150)]
    rows.append(rows[2])
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    out = shard(docs, 4).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    of, slots, sums = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in out:
        of[r.group].add(r.shard)
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
    assert all(len(x) == 1 for x in of.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(sums.values()) - min(sums.values()) <= 2


def test_empty(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []
