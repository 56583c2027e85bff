"""Importance resampling towards a target distribution: gains of hashed features, Gumbel keys, and the exact best k rows by distributed radix selection."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import cut, fresh

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of a key that a pass of the selection decides, so a pass brings at most 2 ** DIGIT counts to the driver.
DIGIT = 12


def word_array(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; a null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, NOT_WORD), "")


def runs(words: str, longest: int) -> Column:
    """All runs of 1 to `longest` consecutive words of an array column, joined by one space, as often as they stand."""
    own, out = F.col(words), [F.col(words)]
    for m in range(2, longest + 1):
        n = F.greatest(F.size(own) - (m - 1), F.lit(0))
        out.append(F.zip_with(F.slice(out[-1], F.lit(1), n), F.slice(own, F.lit(m), n), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(*out) if len(out) > 1 else own


def bucket_array(words: str, longest: int, buckets: int) -> Column:
    return F.transform(runs(words, longest), lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))


def bucket_counts(rows: DataFrame, text_col: str, longest: int, buckets: int) -> list[int]:
    """Features of all rows in each bucket: at most `buckets` rows come to the driver."""
    own = rows.select(word_array(F.col(text_col)).alias("w")).select(F.explode(bucket_array("w", longest, buckets)).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    out = [0] * buckets
    for r in own.collect():
        out[r.b] = r.n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln of target share over source share) of each bucket, one added to every count."""
    s_all, t_all, n = float(sum(source)), float(sum(target)), float(len(source))
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source, target)]


def kth_key(rows: DataFrame, k: int, parts: list[str]) -> list[int]:
    """The k-th smallest, counted from 1, of the keys made of the long columns `parts`, first ones first; rows has k rows at least.

    A pass counts the rows left by the next digit of the key and keeps those of the digit where the k-th one lies; the
    counts, not the rows, come to the driver. Columns without spread cost no pass."""
    key = []
    for part in parts:
        lo, hi = rows.agg(F.min(part), F.max(part)).first()
        shift = 0
        while (hi >> shift) - (lo >> shift) >= 1 << DIGIT:
            shift += 1
        while lo < hi:
            digit = F.shiftright(part, shift)
            for d, n in sorted((r.d, r.n) for r in rows.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()):
                if k <= n:
                    break
                k -= n
            lo, hi = d << shift, ((d + 1) << shift) - 1
            rows = rows.where(F.col(part).between(lo, hi))
            shift = max(0, shift - DIGIT)
        key.append(lo)
    return key


def up_to(parts: list[str], key: list[int]) -> Column:
    """Whether a row's key is the given one or before it."""
    out = F.col(parts[-1]) <= key[-1]
    for part, v in zip(parts[-2::-1], key[-2::-1]):
        out = (F.col(part) < v) | ((F.col(part) == v) & out)
    return out


def ranked(rows: DataFrame, parts: list[str], out: str) -> DataFrame:
    """rows with their place, from 1, in order of parts: dealt by ranges, sorted there and stored; a range's place is the size of those before."""
    own = fresh(rows.columns, "at")
    sorted_rows = rows.repartitionByRange(*parts).sortWithinPartitions(*parts).withColumn(own, F.monotonically_increasing_id())
    kept = cut(sorted_rows, "ranked")
    sizes = sorted((r.p, r.n) for r in kept.groupBy(F.shiftright(own, 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, {}
    for p, n in sizes:
        starts[p], before = before, before + n
    part, start = fresh(rows.columns, "range"), fresh(rows.columns, "start")
    starts = rows.sparkSession.createDataFrame(list(starts.items()), f"`{part}` long, `{start}` long")  # a row a range
    placed = kept.withColumn(part, F.shiftright(own, 33)).join(F.broadcast(starts), part)
    return placed.withColumn(out, F.col(start) + F.col(own) % (1 << 33) + 1).drop(own, part, start)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", carry: tuple[str, ...] = (),
) -> DataFrame:
    """id_col, n_features, weight, score, rank, then the carried columns of docs; a row for each row of docs.

    Features are runs of 1 to `longest` words in `buckets` by crc32. A document's weight is the floored mean of its
    buckets' gains, its score that plus Gumbel noise drawn from its id, so a score is the same wherever it is computed.
    Of the rows of `least_words` words or more, floor(percent N / 100) of highest score get ranks from 1, the others null.
    Ties go to the smaller id, null ids last; rows of one id and score are told apart by their place in the stored table.
    Ids that are no whole numbers keep their value and are compared by a 64-bit hash.

    Texts are read twice, for the counts of all features and for the weights; both are sums over a document's own words,
    so no row moves. The gains, one number a bucket, go out with the plan. The selection and the ranks use a slim stored
    table. Nulls and texts without words have weight 0; empty tables give no rows. A text and its words are held whole.
    """
    table = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets))
    gain = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    own = docs.select(
        F.col(id_col).alias("id"),
        word_array(F.col(text_col)).alias("w"),
        F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0))).alias("noise"),
        F.struct(F.lit(0), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)]).alias("carried"),
    )
    total = F.aggregate("b", F.lit(0).cast("long"), lambda s, x: s + F.get(gain, x))
    own = own.select("id", "noise", "carried", F.size("w").alias("words"), bucket_array("w", longest, buckets).alias("b"))
    own = own.select("id", "words", "noise", "carried", F.size("b").cast("long").alias("n_features"), total.alias("total"))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0)
    number = F.col("id").cast("long") if whole else F.xxhash64("id")
    slim = own.withColumn("weight", weight).withColumn("score", F.col("weight") + F.col("noise"))
    slim = slim.select(
        "id", "n_features", "weight", "score", "carried", (F.col("words") >= least_words).alias("fit"),
        (-F.col("score")).alias("down"), F.col("id").isNull().cast("long").alias("unnamed"), F.coalesce(number, F.lit(0)).alias("number"), F.monotonically_increasing_id().alias("row"),
    )
    slim = cut(slim, "resample")
    parts = ["down", "unnamed", "number", "row"]
    fit = slim.where("fit").select(*parts)
    k = fit.count() * percent // 100
    taken = F.col("fit") & up_to(parts, kth_key(fit, k, parts)) if k else F.lit(False)
    out = ranked(slim.where(taken), parts, "rank").unionByName(slim.where(~taken).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank", *[F.col("carried")[f"c{k}"].alias(c) for k, c in enumerate(carry)])


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn rows of docs, all columns as they are, in no order."""
    rest = tuple(c for c in docs.columns if c != how.get("id_col", "doc_id"))
    own = [fresh(docs.columns, c) for c in ("n_features", "weight", "score", "rank")]
    rows = resample(docs, target, carry=rest, **how)
    named = rows.toDF(rows.columns[0], *own, *rest)
    return named.where(F.col(own[-1]).isNotNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
