"""Nearest neighbours by additive quantisation: full-dimensional codebooks, beam-search encoding, stored norms,
look-up-table scores, then exact reranking on the original vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import cut, lean

BLOCK = 4096


@dataclass
class Codebooks:
    """words: codebooks x entries x dimensions; gram: inner products of all entries."""

    words: np.ndarray

    def __post_init__(self):
        self.flat = self.words.reshape(-1, self.words.shape[-1])
        self.gram = self.flat @ self.flat.T


def encode(books: Codebooks, x: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x codebooks) and squared norms of the reconstructions. Codebook by codebook, the `beam` sums nearest to each vector go on."""
    m, k, _ = books.words.shape
    n = len(x)
    dots = (x @ books.flat.T).reshape(n, m, k)
    codes = np.zeros((n, 1, 0), np.int32)
    cost, norm = np.zeros((n, 1), np.float32), np.zeros((n, 1), np.float32)
    own = np.diag(books.gram).reshape(m, k)
    for level in range(m):
        cross = np.zeros((n, codes.shape[1], k), np.float32)
        for before in range(level):
            cross += books.gram[before * k + codes[:, :, before], level * k : (level + 1) * k]
        grown = 2 * cross + own[level]
        total = (cost[:, :, None] + grown - 2 * dots[:, level, None, :]).reshape(n, -1)
        keep = min(beam if level < m - 1 else 1, total.shape[1])
        best = np.argpartition(total, keep - 1, 1)[:, :keep] if keep < total.shape[1] else np.tile(np.arange(keep), (n, 1))
        parent, entry = best // k, best % k
        norm = np.take_along_axis(norm, parent, 1) + np.take_along_axis(grown.reshape(n, -1), best, 1)
        cost = np.take_along_axis(total, best, 1)
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), entry[:, :, None].astype(np.int32)], 2)
    pick = cost.argmin(1)
    return codes[np.arange(n), pick], norm[np.arange(n), pick]


def fit(x: np.ndarray, m: int = 8, k: int = 128, rounds: int = 3, seed: int = 5) -> Codebooks:
    """Codebooks from residual k-means, then rounds of encoding all and solving for all codebooks together (least squares)."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    rest, words = x.copy(), np.zeros((m, k, x.shape[1]), np.float32)
    for level in range(m):
        if not len(x):
            break
        centre = rest[rng.integers(0, len(rest), k)].copy()
        for _ in range(6):
            near = (np.square(centre).sum(1) - 2 * rest @ centre.T).argmin(1)
            count = np.bincount(near, minlength=k)
            total = np.stack([np.bincount(near, rest[:, d], k) for d in range(x.shape[1])], 1)
            centre[count > 0] = (total[count > 0] / count[count > 0, None]).astype(np.float32)
        words[level] = centre
        rest = rest - centre[(np.square(centre).sum(1) - 2 * rest @ centre.T).argmin(1)]
    books = Codebooks(words)
    for _ in range(rounds if len(x) else 0):
        codes, _ = encode(books, x)
        slot = codes + np.arange(m) * k
        left = np.zeros((m * k, m * k))
        for a in range(m):
            for b in range(m):
                np.add.at(left, (slot[:, a], slot[:, b]), 1)
        right = np.stack([sum(np.bincount(slot[:, a], x[:, d], m * k) for a in range(m)) for d in range(x.shape[1])], 1)
        books = Codebooks(np.linalg.solve(left + np.eye(m * k), right + books.flat).reshape(m, k, -1).astype(np.float32))
    return books


def vectors(df: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> DataFrame:
    """id and x (array of double) of rows that take part: all components there and finite, not all zero, of `dim` components."""
    x = F.col(vec_col).cast("array<double>")
    out = df.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(
        F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    )
    return out.where(F.size("x") == dim) if dim is not None else out


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def build(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = 8192, m: int = 12, k: int = 128) -> tuple[Codebooks, DataFrame, int]:
    """Codebooks fitted on the `sample` vectors of smallest hash of id, the index of all vectors (blocks of ids, codes, norms and
    original vectors, in the scratch folder), and their dimension: the most frequent in the sample, ties to the larger."""
    own = vectors(df, id_col, vec_col)
    rows = own.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    sizes = [len(v) for v in rows.column("x").to_pylist()]
    dim = max(set(sizes), key=lambda d: (sizes.count(d), d), default=1)
    x = np.array([v for v in rows.column("x").to_pylist() if len(v) == dim]).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    books = fit(x, m, k)
    shared = df.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for b in batches:
            for a in range(0, len(b), BLOCK):
                part = b.slice(a, BLOCK)
                ids, x = part.column(0).to_numpy(), _matrix(part.column(1), dim)
                u = x / np.abs(x).max(1, keepdims=True)
                u = (u / np.linalg.norm(u, axis=1, keepdims=True)).astype(np.float32)
                codes, norm = encode(shared.value, u)
                yield pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary()) for y in (ids, codes.astype(np.uint8 if k <= 256 else np.int32), norm.astype(np.float32), x)], ["ids", "codes", "norms", "x"])

    return books, cut(vectors(df, id_col, vec_col, dim).mapInArrow(lean(run), "ids binary, codes binary, norms binary, x binary"), "index", 4), dim


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of rows in double precision, each summed in the same order wherever it stands."""
    scale = np.abs(q).max(-1), np.abs(x).max(-1)
    wild = (scale[0].max(initial=1) > 1e100) | (scale[1].max(initial=1) > 1e100) | (scale[0].min(initial=1) < 1e-100) | (scale[1].min(initial=1) < 1e-100)
    if wild:
        q, x = q / scale[0][..., None], x / scale[1][..., None]
    return (q * x).sum(-1) / (np.sqrt((q * q).sum(-1)) * np.sqrt((x * x).sum(-1)))


def _block_best(books: Codebooks, qid: np.ndarray, q: np.ndarray, table: np.ndarray, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, x: np.ndarray, k: int, short: int):
    """The k nearest of a block for each query, by id and score; copies of a vector are scored once and keep their k + 1 smallest ids."""
    order = np.argsort(ids, kind="stable")
    ids, codes, norms, x = ids[order], codes[order], norms[order], x[order]
    keys = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    of = np.argsort(back, kind="stable")
    begin = np.searchsorted(back[of], np.arange(len(first) + 1))
    codes, norms, x = codes[first].astype(np.int64), norms[first], x[first]
    out_q, out_id, out_s = [], [], []
    for a in range(0, len(q), 256):
        lut = table[a : a + 256]
        rough = np.zeros((len(lut), len(norms)), np.float32)
        for level in range(codes.shape[1]):
            rough += lut[:, level, :][:, codes[:, level]]
        rough /= np.sqrt(np.maximum(norms, 1e-12))  # by the stored norms: cosine with the reconstruction
        n = min(short, len(norms))
        near = np.argpartition(-rough, n - 1, 1)[:, :n] if n < len(norms) else np.tile(np.arange(n), (len(lut), 1))
        score = cosine(np.repeat(q[a : a + 256], n, 0), x[near.ravel()]).reshape(len(lut), n)
        n_best = min(k + 1, n)
        best = np.argsort(-score, 1, kind="stable")[:, :n_best]
        for i in range(len(lut)):
            rows = near[i, best[i]]
            worst = score[i, best[i][-1]]
            if n_best < n:  # all of equal score at the edge
                rows = near[i, score[i] >= worst]
            for r in rows.tolist():
                own = ids[of[begin[r] : min(begin[r] + k + 1, begin[r + 1])]]
                own = own[own != qid[a + i]][:k]
                s = score[i, np.flatnonzero(near[i] == r)[0]]
                out_q += [qid[a + i]] * len(own)
                out_id += own.tolist()
                out_s += [s] * len(own)
    return np.array(out_q, np.int64), np.array(out_id, np.int64), np.array(out_s)


def _top(q: np.ndarray, i: np.ndarray, s: np.ndarray, k: int):
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    fresh = np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] != i[:-1])]) if len(q) else np.zeros(0, bool)
    q, i, s = q[fresh], i[fresh], s[fresh]
    head = np.searchsorted(q, q)
    keep = np.arange(len(q)) - head < k
    return q[keep], i[keep], s[keep]


def search(queries: DataFrame, index: tuple[Codebooks, DataFrame, int], k: int = 5, short: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", pass_rows: int = 100_000) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest by cosine found for each query among rows of other ids, ties to the smaller id.

    Of each block of the index the `short` best by look-up tables are scored exactly. Queries go out in passes of at most
    pass_rows (a bound on what is broadcast), each against the whole index. Queries that are null, zero, not finite or of another
    dimension have no rows; repeated ids count once.
    """
    books, blocks, dim = index
    spark = blocks.sparkSession
    asked = vectors(queries, id_col, vec_col, dim)
    asked = cut(asked.groupBy("id").agg(F.min("x").alias("x")), "queries")
    passes = 1 + asked.count() // pass_rows
    m, entries = books.words.shape[:2]
    code_type = np.uint8 if entries <= 256 else np.int32
    out = None
    for p in range(passes):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p).orderBy("id").toArrow()
        qid, q = own.column("id").to_numpy(), np.array(own.column("x").to_pylist()).reshape(-1, dim)
        shared = spark.sparkContext.broadcast((books, qid, q))

        def run(batches, shared=shared):
            books, qid, q = shared.value
            u = q / np.abs(q).max(1, keepdims=True) if len(q) else q
            u = u / np.linalg.norm(u, axis=1, keepdims=True)
            table = np.einsum("qd,mkd->qmk", u.astype(np.float32), books.words, optimize=True)
            best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for b in batches:
                for ids, codes, norms, x in zip(*[c.to_pylist() for c in b.columns]):
                    x = np.frombuffer(x).reshape(-1, dim)
                    found = _block_best(books, qid, q, table, np.frombuffer(ids, np.int64), np.frombuffer(codes, code_type).reshape(-1, m), np.frombuffer(norms, np.float32), x, k, short)
                    best = _top(*[np.concatenate(y) for y in zip(best, found)], k)
            yield pa.RecordBatch.from_arrays([pa.array(y) for y in best], ["query_id", "vec_id", "score"])

        found = blocks.mapInArrow(lean(run), "query_id long, vec_id long, score double")
        out = found if out is None else out.union(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
