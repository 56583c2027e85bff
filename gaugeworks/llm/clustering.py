"""Exact integer k-means: float32 products with rounding-error intervals shortlist centroids, overlaps are settled by exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import bounded, cut, lean, packed

#: Below this, sums of squared differences of up to 2^14 components fit 64 bits.
SMALL = float(1 << 23)
LIMB = 40
LONGEST = (1 << 63) - 1


@dataclass
class Centroids:
    """exact: rows of Python integers. The rest is derived: rounded copies, an upper bound of each norm, the squared norm."""

    exact: list[list[int]]

    def __post_init__(self):
        wide = np.array([[_float(v) for v in c] for c in self.exact], np.float64).reshape(len(self.exact), -1)
        with np.errstate(over="ignore"):
            self.low = wide.astype(np.float32)
            self.norm = np.sqrt((wide * wide).sum(1)) * (1 + 1e-12)
        self.square = np.array([_float(sum(v * v for v in c)) for c in self.exact])
        self.small = bool((np.abs(wide) < SMALL).all())
        self.whole = wide.astype(np.int64) if self.small else None


def _float(v: int) -> float:
    try:
        return float(v)
    except OverflowError:
        return float("inf") if v > 0 else float("-inf")


def squared(x: np.ndarray, c: Centroids, row: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact squared distances of pairs (row of x, centroid): int64 where all components are small, else Python integers."""
    if c.small and (np.abs(x) < SMALL).all():
        d = x[row].astype(np.int64) - c.whole[j]
        return (d * d).sum(1)
    return np.array([sum((int(a) - b) ** 2 for a, b in zip(x[r], c.exact[k])) for r, k in zip(row, j)], object)


def shortlist(x: np.ndarray, c: Centroids) -> np.ndarray:
    """mask[row, centroid] of the centroids that can be nearest, from float32 products.

    With u = 2^-24 and n components, a float32 dot product of rounded inputs, summed in any order, is off by at most
    (n+2)u / (1 - (n+2)u) times the sum of |x_i c_i|, which is at most |x| |c|. The components are whole numbers, so nothing underflows; what
    overflows has no finite interval, and then every centroid is listed. Distances less |x|^2 lie in [mid - err, mid + err];
    a centroid is out if its interval lies above another one's."""
    m = (x.shape[1] + 2) * 2.0**-24
    with np.errstate(over="ignore", invalid="ignore"):
        dot = (x.astype(np.float32) @ c.low.T).astype(np.float64)
        norm = np.sqrt((x * x).sum(1)) * (1 + 1e-12)
        mid = c.square - 2 * dot
        err = 2 * m / (1 - m) * norm[:, None] * c.norm * (1 + 1e-12) + 2.0**-50 * (c.square + 2 * np.abs(dot))
        low, high = mid - err, mid + err
        bad = ~np.isfinite(low).all(1) | ~np.isfinite(high).all(1)
        return (low <= high.min(1)[:, None]) | bad[:, None]


def nearest(x: np.ndarray, c: Centroids) -> np.ndarray:
    """The nearest centroid of each row of whole numbers (as doubles); the smaller number wins ties."""
    if not len(x):
        return np.zeros(0, np.int64)
    mask = shortlist(x, c)
    out = mask.argmax(1)
    open_ = np.flatnonzero(mask.sum(1) > 1)
    if len(open_):
        row, j = np.nonzero(mask[open_])
        d = squared(x[open_], c, row, j)
        order = np.lexsort((j, d, row)) if d.dtype != object else np.array(sorted(range(len(d)), key=lambda k: (row[k], d[k], j[k])))
        first = order[np.searchsorted(row[order], np.arange(len(open_)))]
        out[open_] = j[first]
    return out


def _rows(b: pa.RecordBatch, dims: int, at: int = 1) -> np.ndarray:
    return packed(b.column(at))[0].view(np.float64).reshape(-1, dims)


def vectors(rows: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """id and v: the components floor(scale x) as little-endian doubles, of vectors with exactly dims components, all finite."""
    bounded(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            col = b.column(1).cast(pa.list_(pa.float64()))
            sizes = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            ids = b.column(0).filter(pa.array(sizes == dims))
            x = col.filter(pa.array(sizes == dims)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            good = np.isfinite(x).all(1)  # a null component reads as NaN
            with np.errstate(over="ignore"):
                x = np.floor(scale * x[good])
            fits = np.isfinite(x).all(1)
            data = pa.py_buffer(np.ascontiguousarray(x[fits]).tobytes())
            n = int(fits.sum())
            offs = pa.py_buffer((np.arange(n + 1) * dims * 8).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)).filter(pa.array(fits)), pa.Array.from_buffers(pa.binary(), n, [None, offs, data])], ["id", "v"])

    return rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).mapInArrow(lean(run), f"id {kind}, v binary")


def first_centroids(stored: DataFrame, k: int, dims: int, seed: int) -> list[list[int]]:
    """The k vectors of smallest sha256 of seed:id; of one id, by the stored bytes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    top = stored.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [[int(x) for x in np.frombuffer(r.v, np.float64)] for r in top]


def limbs(v: int) -> list[tuple[int, int]]:
    """v as a sum of part * 2^(LIMB * place); all parts but the last are from 0 to 2^LIMB - 1."""
    out, place = [], 0
    while not -(1 << LIMB) < v < 1 << LIMB:
        out.append((place, v & ((1 << LIMB) - 1)))
        v >>= LIMB
        place += 1
    return [*out, (place, v)]


def moved(stored: DataFrame, exact: list[list[int]], dims: int) -> list[list[int]]:
    """A round: each non-empty centroid becomes the floored mean of its vectors. A task adds up its own vectors and gives a few
    numbers a centroid and component; those are summed by Spark, so the driver gets as many numbers as the centroids have."""
    shared = stored.sparkSession.sparkContext.broadcast(exact)

    def run(batches: Iterator[pa.RecordBatch]):
        c = Centroids(shared.value)
        total = np.zeros((len(c.exact), dims + 1), object)
        for b in batches:
            x = _rows(b, dims)
            own = nearest(x, c)
            ints = x.astype(np.int64) if (np.abs(x) < SMALL).all() else np.array([[int(v) for v in r] for r in x], object).reshape(-1, dims)
            for j in np.unique(own):
                part = ints[own == j]
                total[j, :dims] += part.sum(0).astype(object)
                total[j, dims] += len(part)
        rows = [(j, i, place, part) for j, r in enumerate(total) if r[dims] for i, v in enumerate(r) for place, part in limbs(int(v))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["j", "i", "place", "part"])

    sums = np.zeros((len(exact), dims + 1), object)
    for r in stored.mapInArrow(lean(run), "j int, i int, place int, part long").groupBy("j", "i", "place").agg(F.sum("part").alias("part")).collect():
        sums[r.j, r.i] += r.part << (LIMB * r.place)
    return [[int(v // s[dims]) for v in s[:dims]] if s[dims] else c for c, s in zip(exact, sums)]


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each vector that takes part; the centroids).

    Vectors of exactly dims components, none null or non-finite, become whole numbers floor(scale x); others take no part.
    (A vector whose scaled component is beyond the largest double takes no part either.)
    The first centroids are the k vectors of smallest hash of id (fewer, if there are fewer vectors). A round assigns all
    vectors and moves each centroid that has any to the floored mean; empty ones stay. Ties go to the smaller number.
    Results are exact whatever the order of rows: every comparison is decided by a rigorous interval or by whole numbers,
    and sums are of whole numbers. A squared distance (or a sum of them) beyond 2^63 - 1 is null.

    What is broadcast and what comes to the driver is k * dims numbers a round. Repeated rows and ids are rows of their
    own, null ids too; empty input gives no rows. Other columns are not read.
    """
    stored = cut(vectors(rows, dims, scale, id_col, vec_col), "vectors")
    exact = first_centroids(stored, k, dims, seed)
    for _ in range(rounds if exact else 0):
        exact = moved(stored, exact, dims)
    spark, kind = rows.sparkSession, rows.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(exact)

    def run(batches: Iterator[pa.RecordBatch]):
        c = Centroids(shared.value) if shared.value else None
        for b in batches:
            if not len(b):
                continue
            x = _rows(b, dims)
            own = nearest(x, c)
            d = [int(v) if v <= LONGEST else None for v in squared(x, c, np.arange(len(x)), own)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int32()), pa.array(d, pa.int64())], ["id", "cluster", "distance"])

    done = cut(stored.mapInArrow(lean(run), f"id {kind}, cluster int, distance long"), "clusters")
    known = F.count("distance") == F.count(F.lit(1))
    per = done.groupBy("cluster").agg(F.when(known, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()
    fits = lambda v: int(v) if v is not None and v <= LONGEST else None
    total = fits(None if any(r.s is None for r in per) else sum(r.s for r in per))
    facts = spark.createDataFrame([(r.cluster, fits(r.s), total, digest(exact[r.cluster])) for r in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = done.join(F.broadcast(facts), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), exact
