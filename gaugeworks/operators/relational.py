"""Joins, windows and set operators over logs, items, models and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def latest_wins(records: DataFrame, keys: list[str], seq: str, failed: Column, ties: Sequence[str] = ()) -> DataFrame:
    """SRC-5, WN-1, SM-7: the last record of a key that did not fail, else its last; of those of one seq, the first by the columns of ties."""
    w = Window.partitionBy(*keys).orderBy(failed.cast("int"), F.desc(seq), *ties)
    return records.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """WN-11: one row a key, the first in order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def todo(models: DataFrame, items: DataFrame, reps: int, done: DataFrame, keys: list[str]) -> DataFrame:
    """JN-5: models x items x repetitions without those done. Both dimensions are small by nature; done is the large side."""
    grid = models.crossJoin(items).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def split_reuse(now: DataFrame, scored: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """JN-6: rows whose fingerprint was scored before, and rows to score."""
    seen = scored.where("score IS NOT NULL").select(*keys).distinct()
    return now.join(seen, keys, "left_semi"), now.join(seen, keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], known: DataFrame | None = None) -> DataFrame:
    """SNK-2: new rows replace old ones of their key; keys not in known go."""
    out = old.join(new.select(*keys), keys, "left_anti").unionByName(new)
    return out.join(known, [c for c in known.columns if c in keys], "left_semi") if known is not None else out


def full_diff(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """JN-10: keys only left (missing), only right (extra), or of another value (changed)."""
    a = left.select(key, F.col(value).alias("_a"), F.lit(True).alias("_l"))
    b = right.select(key, F.col(value).alias("_b"), F.lit(True).alias("_r"))
    kind = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "extra").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("change")).where("change IS NOT NULL")


def top_pairs(scores: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """JN-7: item scores of each pair of the k best models, better first. ranked: model, rank."""
    top = scores.join(F.broadcast(ranked.where(F.col("rank") <= k).select("model", "rank")), "model")
    a = top.select("item", F.col("model").alias("model_a"), F.col("rank").alias("rank_a"), F.col("score").alias("score_a"))
    b = top.select("item", F.col("model").alias("model_b"), F.col("rank").alias("rank_b"), F.col("score").alias("score_b"))
    return a.join(b, "item").where("rank_a < rank_b")


def pareto_front(points: DataFrame, cost: str, quality: str) -> DataFrame:
    """JN-17, ST-16: points no other beats. One sort by ranges instead of all pairs: by rising cost, a point stays if its quality
    is the best of its cost and above that of all cheaper ones."""
    by_cost = points.groupBy(cost).agg(F.max(quality).alias("_best"))
    front = running(by_cost, cost, "_best", "max", "_before", False).where("_before IS NULL OR _best > _before")
    return points.join(front.select(cost, "_best"), cost).where(F.col(quality) == F.col("_best")).drop("_best")


def with_fallback(rows: DataFrame, labels: DataFrame, key: str, family: str) -> DataFrame:
    """JN-11: the label of the row's own family, else that of family `*`."""
    own = labels.select(key, F.col("family").alias(family), F.col("label").alias("_own"))
    star = labels.where("family = '*'").select(key, F.col("label").alias("_star"))
    return rows.join(own, [key, family], "left").join(star, key, "left").withColumn("label", F.coalesce("_own", "_star")).drop("_own", "_star")


def stratified_sample(items: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """FLT-1: n of each stratum by a seeded hash; the same rows on every run."""
    order = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), key), key)
    return items.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def average_rank(by: str, partition: list[str] | None = None) -> Column:
    """WN-3, ST-7: ranks from 1, ties share their mean."""
    parts = partition or []
    return F.rank().over(Window.partitionBy(*parts).orderBy(by)) + (F.count(F.lit(1)).over(Window.partitionBy(*parts, by)) - 1) / 2


def holm(df: DataFrame, p: str, partition: list[str], tie: str, out: str = "p_holm") -> DataFrame:
    """WN-5, ST-10: step-down adjusted p values, never falling, at most 1."""
    w = Window.partitionBy(*partition).orderBy(p, tie)
    m = F.count(F.lit(1)).over(Window.partitionBy(*partition))
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("_step", step).withColumn(out, F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def round_robin(df: DataFrame, group: str, order: str) -> DataFrame:
    """WN-9: first rows of all groups, then second ones; position from 1 within each turn."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("turn", turn).withColumn("place", F.row_number().over(Window.partitionBy("turn").orderBy(group)))


def running_stop(df: DataFrame, group: str, order: str, amount: str, limit: float) -> DataFrame:
    """SM-4: rows begun while the amount spent before was under the limit."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("spent_before", F.coalesce(F.sum(amount).over(before), F.lit(0.0))).where(F.col("spent_before") < limit)


def daily_cap(df: DataFrame, ts: str, order: str, cap: int, keys: list[str] | None = None) -> DataFrame:
    """SM-5: the first calls of each day, up to the cap."""
    day = F.to_date(ts)
    return df.withColumn("day", day).withColumn("nth", F.row_number().over(Window.partitionBy("day", *(keys or [])).orderBy(order))).where(F.col("nth") <= cap)


def rank_shift(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """WN-4: ranks of two orderings and their distance. a, b: key, rank."""
    return a.select(key, F.col("rank").alias("rank_a")).join(b.select(key, F.col("rank").alias("rank_b")), key).withColumn("shift", F.abs(F.col("rank_a") - F.col("rank_b")))


def islands(df: DataFrame, partition: list[str], order: str, value: str) -> DataFrame:
    """RM-7: numbers runs of rows of one value from 1."""
    w = Window.partitionBy(*partition).orderBy(order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    return df.withColumn("_c", change).withColumn("island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def size_batches(df: DataFrame, partition: str, order: str, size: str, limit: int) -> DataFrame:
    """WN-12: df with batch, from 0 in each group: one more begins where a row would take the running size over the limit; a row beyond it is
    alone. A null size is 0.

    Which row begins a batch depends on all before it, so a group goes through one task in order; rows stream by, sorted by
    Spark, and what is held is a batch of rows and two numbers."""
    import pandas as pd

    out = StructType([*df.schema.fields, StructField("batch", IntegerType())])

    def run(frames):
        group, total, k = None, 0, -1
        for own in frames:
            batches = []
            for key, n in zip(own[partition].astype(object).where(own[partition].notna(), None), own[size].fillna(0)):
                if k < 0 or key != group:
                    group, total, k = key, 0, 0
                elif total + n > limit:
                    k, total = k + 1, 0
                total += n
                batches.append(k)
            yield own.assign(batch=pd.Series(batches, own.index, dtype="int32"))

    return df.repartition(partition).sortWithinPartitions(partition, order).mapInPandas(run, out)


def fix_point_reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """SRC-23: nodes reached from roots over edges (src, dst), cycles allowed; a round per depth."""
    seen = roots.select("node").distinct()
    front = seen
    while not front.isEmpty():
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = kept(step.join(seen, "node", "left_anti"))
        seen = seen.union(front)
    return seen


def shared_dir(spark) -> str:
    """The folder of spark.checkpoint.dir; one under the warehouse where none is set and one machine does all."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch")
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df, stored in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Sets and words in a block of jaccard_pairs at most (one set may have more words); places of the table of frequencies.
BLOCK_SETS, BLOCK_WORDS, FREQUENCIES = 2048, 400_000, 1 << 20


def _set_blocks(sets: DataFrame) -> DataFrame:
    """Sets in blocks of like size: lo, hi (their sizes), first (the smallest node), node, n and k (words in w) a set, w: all words, set by set, rare ones first,
    up: their places in order of the words. Of equal sets the smallest node stands for all.

    Frequencies are counted by hash, in a table of bounded size: words of one place count together, which still is one order for
    all sets. Words that stand alone in their place are in no other set and go, but count in n."""
    import numpy as np

    spark = sets.sparkSession
    place = lambda w: F.pmod(w, F.lit(FREQUENCIES)).cast("int")
    counts = sets.select(F.explode("w").alias("t")).groupBy(place(F.col("t")).alias("p")).agg(F.least(F.count(F.lit(1)), F.lit(2**31 - 1)).cast("int").alias("f")).toArrow()
    table = np.zeros(FREQUENCIES, np.int32)
    table[counts["p"].to_numpy()] = counts["f"].to_numpy()
    often = spark.sparkContext.broadcast(table)

    def cut(batches):
        import pyarrow as pa

        f, now, seen = often.value, None, []
        for batch in batches:
            own = []
            for node, h, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                t = np.sort(w.values.to_numpy(zero_copy_only=False))
                if h != now:
                    now, seen = h, []
                if any(np.array_equal(t, x) for x in seen):
                    continue
                seen.append(t)
                of = f[t % FREQUENCIES]
                own.append((node, len(t), t[np.lexsort((t, of))][(of == 1).sum() :]))
            own = [x for x in own if len(x[2])]
            words = np.cumsum([len(t) for _, _, t in own])
            at = 0
            while at < len(own):
                to = min(at + BLOCK_SETS, max(at + 1, int(np.searchsorted(words, (words[at - 1] if at else 0) + BLOCK_WORDS, "right"))))
                nodes, n, t = zip(*own[at:to])
                w = np.concatenate(t)
                yield pa.RecordBatch.from_pydict({
                    "lo": pa.array([min(n)], pa.int32()), "hi": pa.array([max(n)], pa.int32()), "first": pa.array([min(nodes)], pa.int64()), "node": pa.array([nodes], pa.list_(pa.int64())),
                    "n": pa.array([n], pa.list_(pa.int64())), "k": pa.array([[len(x) for x in t]], pa.list_(pa.int64())), "w": pa.array([w], pa.list_(pa.int64())), "up": pa.array([np.argsort(w, kind="stable").astype(np.int32)], pa.list_(pa.int32())),
                })
                at = to

    dealt = sets.select(F.col("node").cast("long").alias("node"), F.xxhash64(F.array_sort("w")).alias("h"), "w", F.size("w").alias("n")).repartitionByRange("n", "h").sortWithinPartitions("n", "h", "node")
    return dealt.select("node", "h", "w").mapInArrow(cut, "lo int, hi int, first long, node array<long>, n array<long>, k array<long>, w array<long>, up array<int>")


def _alike_sets(x, y, num: int, den: int):
    """Places in x, places in y and words in common of the pairs of a Jaccard of num / den or more. x, y: n, k, w, up of a block.

    Of the c words that a set must share with any of the other block, the rarest size - c + s hold s; pairs that share too few there are
    ruled out, and of the others all words are counted."""
    import numpy as np

    least = lambda a, b: -(-num * (a + b) // (num + den))

    def start(own, other):
        n, k, w, up = own
        c = least(n, np.maximum(other[0].min(), -(-num * n // den)))
        rest = np.minimum(np.maximum(c - 1 - n // 20, 0), k)
        size = k - rest
        at = np.cumsum(k) - k
        inside = np.arange(len(w)) - np.repeat(at, k) < np.repeat(size, k)
        up = up[inside[up]]  # the rare words, in order: blocks are sorted once, not at every meeting
        return rest, w[up], np.repeat(np.arange(len(n)), k)[up], at

    (rx, wx, ix, ax), (ry, wy, iy, ay) = start(x, y), start(y, x)
    none = np.empty(0, np.int64)
    if not len(wy):
        return none, none, none
    first = np.flatnonzero(np.concatenate(([True], wy[1:] != wy[:-1])))
    known, times = wy[first], np.diff(first, append=len(wy))
    at = np.minimum(np.searchsorted(known, wx), len(known) - 1)
    hit = known[at] == wx
    at, i = at[hit], ix[hit]
    found, total = np.zeros(len(x[0]) * len(y[0]), np.int32), np.cumsum(times[at])
    lo = 0
    while lo < len(at):  # bounded parts
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 4_000_000, "right")))
        c = times[at[lo:hi]]
        each = np.arange(c.sum()) + np.repeat(first[at[lo:hi]] - (np.cumsum(c) - c), c)
        found += np.bincount(np.repeat(i[lo:hi] * len(y[0]), c) + iy[each], minlength=len(found)).astype(np.int32)
        lo = hi
    met = np.flatnonzero(found)
    i, j = np.divmod(met, len(y[0]))
    need = least(x[0][i], y[0][j])
    maybe = (found[met] + np.maximum(rx[i], ry[j]) >= need) & (den * np.minimum(x[0][i], y[0][j]) >= num * np.maximum(x[0][i], y[0][j]))
    i, j, need = i[maybe], j[maybe], need[maybe]
    whole = lambda own, at, p: own[2][at[p] : at[p] + own[1][p]]
    c = np.array([len(np.intersect1d(whole(x, ax, p), whole(y, ay, q), assume_unique=True)) for p, q in zip(i, j)], np.int64)
    return i[c >= need], j[c >= need], c[c >= need]


def jaccard_pairs(sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, jaccard: pairs a < b of a Jaccard of num / den or more. sets: node (long), w (distinct longs, not empty); of equal sets the smallest node stands for all.

    Sets are cut into blocks of like size; two blocks whose sizes fit meet in one task, by an index of their rare words. So pairs
    of sets that share a word are neither stored nor shuffled, and no word that many sets share makes one task longer."""
    blocks = _set_blocks(sets)
    blocks = kept(blocks)
    n = blocks.count()
    of = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("lo", "hi", "first", "node", "n", "k", "w", "up")]
    left, right = blocks.coalesce(max(n // 2, 1)).select(of("a")), blocks.coalesce(n // 16 + 1).select(of("b"))
    met = left.join(right, (F.col("a_first") <= F.col("b_first")) & (den * F.least("a_hi", "b_hi") >= num * F.greatest("a_lo", "b_lo")))

    def pairs(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                one, *rest = [c[row].values.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]
                a, b = (one, rest[:4]), (rest[4], rest[5:])
                i, j, c = _alike_sets(a[1], b[1], num, den)
                if batch.column(0)[row] == batch.column(1)[row]:
                    once = i < j
                    i, j, c = i[once], j[once], c[once]
                p, q = a[0][i], b[0][j]
                yield pa.RecordBatch.from_pydict({"a": np.minimum(p, q), "b": np.maximum(p, q), "jaccard": c / (a[1][0][i] + b[1][0][j] - c)})

    return met.select("a_first", "b_first", *[f"{s}_{c}" for s in "ab" for c in ("node", "n", "k", "w", "up")]).mapInArrow(pairs, "a long, b long, jaccard double")


def first_match_groups(sets: DataFrame, num: int, den: int) -> DataFrame:
    """JN-22: id, first, jaccard: in order of id, a row joins the earliest group whose first row has a Jaccard of num / den or more with it, else it begins a group.

    sets: id, w (distinct, in order); rows without words are alone, their jaccard null. Equal sets are one node. A round settles
    all nodes without an undecided smaller neighbour: they begin groups, and their neighbours cannot."""
    rows = kept(sets.withColumn("key", F.sha2(F.array_join(F.transform("w", lambda x: x.cast("string")), " "), 256)))
    nodes = rows.where(F.size("w") > 0).groupBy("key").agg(F.min("id").alias("node"))
    edges = kept(jaccard_pairs(rows.where(F.size("w") > 0).select(F.col("id").alias("node"), "w"), num, den))
    left, members = edges.select("a", "b"), edges.select("b").limit(0)
    while not left.isEmpty():
        heads = left.select("a").join(left.select(F.col("b").alias("a")), "a", "left_anti").distinct()
        out = kept(left.join(heads, "a", "left_semi").select("b").distinct())
        members = members.union(out)
        left = kept(left.join(out, "b", "left_anti").join(out.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b"))
    joins = edges.join(members.select(F.col("b").alias("a")), "a", "left_anti").groupBy("b").agg(F.min("a").alias("first"), F.min_by("jaccard", "a").alias("jaccard"))
    named = nodes.select("key", "node").join(joins.withColumnRenamed("b", "node"), "node", "left")
    named = named.select("key", F.coalesce("first", "node").alias("first"), F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"))
    return rows.select("id", "key").join(named, "key", "left").select("id", F.coalesce("first", "id").alias("first"), "jaccard")


def differing(printed: DataFrame, computed: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """JN-25: key, state, difference of numbers that do not agree: differs (by more than the tolerance), not printed, not computed.

    A null on either side counts as absent; keys are one row a side."""
    both = printed.select(key, F.col(value).alias("_p")).join(computed.select(key, F.col(value).alias("_c")), key, "full_outer")
    gap = F.abs(F.col("_p") - F.col("_c"))
    state = F.when(F.col("_p").isNull(), "not printed").when(F.col("_c").isNull(), "not computed").when(gap > tolerance, "differs")
    return both.where("_p IS NOT NULL OR _c IS NOT NULL").select(key, state.alias("state"), gap.alias("difference")).where("state IS NOT NULL")


def gate(cites: DataFrame, entries: DataFrame) -> DataFrame:
    """JN-20: key and state: ok, unverified, unknown (cited, no entry), unused (entry, not cited). entries: key, verified."""
    both = cites.select("key", F.lit(True).alias("cited")).distinct().join(entries.select("key", "verified"), "key", "full_outer")
    state = F.when(F.col("cited").isNull(), "unused").when(F.col("verified").isNull(), "unknown").when(F.col("verified"), "ok").otherwise("unverified")
    return both.select("key", state.alias("state"))


def running(df: DataFrame, order: str, value: str, how: str, out: str, own: bool = True) -> DataFrame:
    """df with the sum or max of value over all rows before in `order` (distinct values), its own too unless own is false.

    No task holds all rows: they are dealt by ranges and stored, so that ranges stay what they are; a range's total goes on to the later ones."""
    agg = {"sum": F.sum, "max": F.max}[how]
    parts = kept(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part").agg(agg(value).alias("_total"))
    before = totals.select("_part", agg("_total").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    here = agg(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    both = F.coalesce("_here", F.lit(0)) + F.coalesce("_earlier", F.lit(0)) if how == "sum" else F.greatest("_here", "_earlier")
    return parts.withColumn("_here", here).join(F.broadcast(before), "_part").withColumn(out, both).drop("_part", "_here", "_earlier")


def quotes(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str) -> DataFrame:
    """FN-15: doc_key, item_key of texts that hold a quote word for word. docs: doc_key, text; items: item_key, quote.

    Pairs come from an equal join on a hash of three neighbouring words, whole ones inside the quote, the longest together;
    containment is then checked on these. Quotes without three inner words meet every document."""
    own = items.withColumn("_w", F.split(F.trim(F.regexp_replace("quote", r"\s+", " ")), " "))
    inner = F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0)))
    third = lambda a: F.slice(a, F.lit(1), F.size(a) - 2)
    hashes = lambda a: F.transform(third(a), lambda x, i: F.xxhash64(x, F.get(a, i + 1), F.get(a, i + 2)))
    sized = lambda a: F.transform(third(a), lambda x, i: F.struct((F.length(x) + F.length(F.get(a, i + 1)) + F.length(F.get(a, i + 2))).alias("n"), F.xxhash64(x, F.get(a, i + 1), F.get(a, i + 2)).alias("h")))
    own = own.withColumn("_inner", inner).withColumn("_key", F.when(F.size("_inner") >= 3, F.array_max(sized(F.col("_inner")))["h"]))
    keys = own.where("_key IS NOT NULL").select("_key", item_key, "quote")
    w = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    place = docs.withColumn("_w", w).where(F.size("_w") >= 3).select(doc_key, F.explode(hashes(F.col("_w"))).alias("_key"))
    met = place.join(keys.select("_key", item_key), "_key").select(doc_key, item_key).distinct()
    found = met.join(items, item_key).join(docs, doc_key).where(F.col("text").contains(F.col("quote"))).select(doc_key, item_key)
    rest = own.where("_key IS NULL").select(item_key, "quote")
    return found.unionByName(docs.join(rest, F.col("text").contains(F.col("quote"))).select(doc_key, item_key))
