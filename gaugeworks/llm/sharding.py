"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import cut

BINS = 1 << 14


def differencing(sizes: list[int], k: int) -> list[int]:
    """The part, 0 to k-1, of each size. The two partial partitions with the largest spread are combined again and again,
    the largest part of one with the smallest of the other. Ties go to the partition made first."""
    if not sizes:
        return []
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [s] + [0] * (k - 1), [i] + [None] * (k - 1)))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a, ga = heapq.heappop(heap)
        _, _, b, gb = heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, reversed(b))]
        groups = [(x, y) if x is not None and y is not None else y if x is None else x for x, y in zip(ga, reversed(gb))]
        order = sorted(range(k), key=sums.__getitem__, reverse=True)
        sums = [sums[i] for i in order]
        heapq.heappush(heap, (sums[-1] - sums[0], made, sums, [groups[i] for i in order]))
        made += 1
    out = [0] * len(sizes)
    for part, top in enumerate(heap[0][3]):
        stack = [top]
        while stack:
            g = stack.pop()
            if isinstance(g, tuple):
                stack += g
            elif g is not None:
                out[g] = part
    return out


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS) -> DataFrame:
    """id_col, size (UTF-8 bytes + 1), text_crc32, group (hash of the text), shard, slot; a row for each row of docs.

    Rows of equal text are one group and share a shard (all null texts are one group; a null is not an empty text).
    A group over 1/bins of all bytes is an item of its own, of which there are fewer than bins; the others meet in bins
    by hash of their text. So the driver differences at most 2 * bins items of (key, sum) at any size of input, and what
    is broadcast has at most 2 * bins rows. Slots count from 0 without gaps in each shard. Empty input: no rows.
    Other columns of docs are not used. Repeated rows are rows like any other.
    """
    text = F.col(text_col)
    slim = cut(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.sha2(text, 256), F.lit("null")).alias("group"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        ),
        "shard",
    )
    n, total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bin_of = F.pmod(F.xxhash64("group"), F.lit(bins)).cast("int")
    groups = slim.groupBy("group").agg(F.sum("size").alias("bytes"))
    own = F.when(F.col("bytes") * bins > total, F.col("group"))
    items = groups.groupBy(own.alias("own"), F.when(own.isNull(), bin_of).alias("bin")).agg(F.sum("bytes").alias("bytes")).collect()
    items.sort(key=lambda r: (-r.bytes, r.own or "", r.bin or 0))
    part = differencing([r.bytes for r in items], n_shards)
    spark = docs.sparkSession
    own_map = spark.createDataFrame([(r.own, p) for r, p in zip(items, part) if r.own is not None], "group string, own_shard int")
    bin_map = spark.createDataFrame([(r.bin, p) for r, p in zip(items, part) if r.own is None], "bin int, bin_shard int")
    subs = max(256, n >> 16)
    put = (
        slim.withColumn("bin", bin_of)
        .join(F.broadcast(own_map), "group", "left")
        .join(F.broadcast(bin_map), "bin", "left")
        .withColumn("shard", F.coalesce("own_shard", "bin_shard"))
        .withColumn("sub", F.pmod(F.xxhash64("id", "group"), F.lit(subs)).cast("int"))
        .select("id", "size", "text_crc32", "group", "shard", "sub")
    )
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = put.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n")).select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("id", "group"))
    return (
        put.withColumn("at", at)
        .join(starts, ["shard", "sub"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", "group", "shard", (F.col("start") + F.col("at") - 1).alias("slot"))
    )
