"""Title joins: pairs of strings of a Ratcliff-Obershelp ratio of `least` or more, by blocks of strings of like length (JN-18, FN-31)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.text import edit_ratio, fold
from gaugeworks.operators.relational import kept

#: Strings in a block: a task holds one block of each side.
BLOCK = 2048
#: Counts of characters that all pairs of a block are held against first.
FEATURES = 128
#: A head, the part of a title before a colon, counts from this length on.
HEAD = 15


def views(titles: DataFrame, t: str) -> DataFrame:
    """Column t, head, f: the folded title (head false) and its folded part before a colon, if that has HEAD characters (head true)."""
    both = titles.select(t).distinct().select(t, F.posexplode(F.array(fold(t), fold(F.substring_index(t, ":", 1)))).alias("head", "f"))
    return both.select(t, (F.col("head") == 1).alias("head"), "f").where(f"f <> '' AND (NOT head OR length(f) >= {HEAD})")


def _blocks(strings: DataFrame, side: str, together: int) -> DataFrame:
    """Strings f (distinct) in blocks of up to BLOCK of like length, about `together` a partition: columns side (the strings), side_lo and side_hi (the
    shortest and longest length)."""
    n = F.length("f")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                lengths = own.column(1).to_pylist()
                yield pa.RecordBatch.from_pydict({side: [own.column(0).to_pylist()], f"{side}_lo": pa.array([min(lengths)], pa.int32()), f"{side}_hi": pa.array([max(lengths)], pa.int32())})

    parts = strings.count() // (together * BLOCK) + 1
    dealt = strings.select("f", n.alias("n")).repartitionByRange(parts, "n", "f").coalesce(parts).sortWithinPartitions("n", "f")
    return dealt.mapInArrow(cut, f"{side} array<string>, {side}_lo int, {side}_hi int")


def _counts(strings: list[str], pairs: bool = False):
    """A row a string: how often it has each character (its code modulo 128), or each pair of neighbours (modulo 1024); those of one code count together."""
    import numpy as np

    size = 1024 if pairs else 128
    code = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(strings)), [len(s) for s in strings])
    if pairs:
        code, inside = code[:-1] * 31 + code[1:], row[:-1] == row[1:]
        code, row = code[inside], row[:-1][inside]
    return np.bincount(row * size + code % size, minlength=len(strings) * size).reshape(-1, size)


def _met(a: list[str], b: list[str], least: float):
    """Places in a and in b of the pairs that have enough characters, and pairs of neighbours, in common at any place for a ratio of `least`.

    What two strings have of one character is the number of k up to which both have it k times: a product of matrices of 0
    and 1. It takes the FEATURES that differ most; of the others, all that the string of a has counts as common, and exact counts
    follow for what is left. Strings of n and m characters with c of them in common blocks have at most n + m - 2c + 1 blocks, so
    3c - n - m - 1 pairs of neighbours or more lie inside these."""
    import numpy as np

    ca, cb = _counts(a), _counts(b)
    most = np.minimum(ca.max(0), cb.max(0))
    which, k = np.repeat(np.arange(128), most), np.concatenate([np.arange(1, m + 1) for m in most])
    fa, fb = ca[:, which] >= k, cb[:, which] >= k
    share = fb.mean(0)
    by = np.argsort(share * (share - 1), kind="stable")
    own = fa[:, by[FEATURES:]].sum(1) - least / 2 * ca.sum(1)
    one = lambda n: np.ones((n, 1))
    left = np.hstack([fa[:, by[:FEATURES]], own[:, None], one(len(a))]).astype(np.float32)
    right = np.hstack([fb[:, by[:FEATURES]], one(len(b)), -least / 2 * cb.sum(1)[:, None]]).astype(np.float32)
    i, j = np.divmod(np.flatnonzero(left @ right.T >= -0.01), len(b))
    na, nb = ca.sum(1), cb.sum(1)
    for pairs in (False, True):
        if len(i):
            (ui, x), (uj, y) = (np.unique(places, return_inverse=True) for places in (i, j))
            ua, ub = (_counts([s[p] for p in u], pairs).astype(np.uint16) for s, u in ((a, ui), (b, uj)))
            common = np.concatenate([np.minimum(ua[x[at : at + 1024]], ub[y[at : at + 1024]]).sum(1) for at in range(0, len(i), 1024)])
            enough = common >= (1.5 * least - 1 if pairs else least / 2) * (na[i] + nb[j]) - pairs - 1e-6
            i, j = i[enough], j[enough]
    return i, j


def alike_strings(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """fa, fb, ratio: the pairs of a string f of a and a string f of b (both distinct) of a ratio of `least` or more.

    The ratio counts characters in common blocks, so that partners have as many characters in common at any place. Both
    sides are cut into blocks by length; each block of a meets the blocks of b that hold a fitting length, in one task: a
    product of matrices counts what each two strings have in common, and the few left get their exact ratio (see _met). No pair
    is stored or shuffled, and no gram or length that many strings share makes one task longer than others."""
    fit = F.lit(least / (2 - least) - 1e-9)
    left, right = (kept(_blocks(kept(x.select("f").distinct()), s, k)) for x, s, k in ((a, "a", 2), (b, "b", 16)))
    met = left.join(right, (F.col("b_hi") >= F.col("a_lo") * fit) & (F.col("a_hi") >= F.col("b_lo") * fit))

    def pairs(batches):
        import pyarrow as pa

        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                x, y = x.as_py(), y.as_py()
                i, j = _met(x, y, least)
                yield pa.RecordBatch.from_pydict({"fa": pa.array([x[k] for k in i], pa.string()), "fb": pa.array([y[k] for k in j], pa.string())})

    return met.select("a", "b").mapInArrow(pairs, "fa string, fb string").withColumn("ratio", edit_ratio("fa", "fb")).where(F.col("ratio") >= least)


def alike_titles(seeds: DataFrame, candidates: DataFrame, least: float) -> DataFrame:
    """st, ct, similarity: the distinct pairs of a title st of seeds and ct of candidates of a title similarity (FN-31) of `least` or more."""
    a, b = kept(views(seeds, "st")), kept(views(candidates, "ct"))
    pairs = kept(alike_strings(a, b, least))
    both = pairs.join(a.withColumnRenamed("f", "fa"), "fa").join(b.withColumnRenamed("f", "fb"), ["fb", "head"])
    return both.groupBy("st", "ct").agg(F.max("ratio").alias("similarity"))
