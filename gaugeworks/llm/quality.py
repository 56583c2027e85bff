"""Factorisation machine over hashed words, structure statistics and metadata, scored by the sum-of-squares identity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import IS_SPACE, LOWER, bounded, lean, packed, slices, word_hashes, words

BITS = 18
#: Steps of a fit at least, so that few labelled rows are gone through more often.
STEPS = 320
LEVELS = 24
#: Structure statistics, each cut into LEVELS one-hot levels behind the hashed words.
STATS = ("bytes", "word length", "upper", "symbols", "digits", "bars", "newlines", "punctuation", "high bytes", "distinct words", "distinct lines", "longest word", "stated length")
_class = np.zeros(256, np.uint8)
_class[0x41:0x5B] = 1
_class[[*b"#$%&*@^~`\\_=+<>{}[]/!"]] = 2
_class[0x30:0x3A] = 3
_class[ord("|")] = 4
_class[0x0A] = 5
_class[[*b".,;:?'\"()-"]] = 6
_class[0x80:] = 7


@dataclass
class Model:
    """row_of: a row of the weights for each hashed feature, -1 where none was learned."""

    row_of: np.ndarray
    bias: float
    weight: np.ndarray
    factors: np.ndarray


def features(buf: np.ndarray, offs: np.ndarray, stated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of whole documents as sorted pairs (document, feature), each pair once. stated: lengths of the metadata, -1 for none."""
    n = len(offs) - 1
    low = LOWER[buf]
    starts, ends, first = words(low, offs, IS_SPACE ^ True)
    h = word_hashes(low, starts, ends)
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    pairs = np.unique(doc.astype(np.uint64) << np.uint64(32) | h >> np.uint64(64 - BITS))
    own = (pairs >> np.uint64(32)).astype(np.int64)
    size = np.maximum(np.diff(offs), 1)
    of_byte = np.repeat(np.arange(n), np.diff(offs))
    kinds = np.bincount(of_byte * 8 + _class[buf], minlength=8 * n).reshape(n, 8)
    word_len = (ends - starts).astype(np.float64)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, word_len)
    ls, le, lf = words(buf, offs, _LINE)
    lines = np.unique(np.repeat(np.arange(n), np.diff(lf)).astype(np.uint64) << np.uint64(40) | word_hashes(buf, ls, le) >> np.uint64(24))
    n_lines = np.diff(lf)
    distinct_lines = np.bincount((lines >> np.uint64(40)).astype(np.int64), minlength=n)
    share = kinds / size[:, None]
    stats = [
        np.log2(size) / 24,
        np.bincount(doc, word_len, n) / np.maximum(count, 1) / 24,
        share[:, 1],
        np.sqrt(share[:, 2]),
        np.sqrt(share[:, 3]),
        np.sqrt(share[:, 4]),
        np.sqrt(share[:, 5]) * 2,
        share[:, 6] * 4,
        share[:, 7],
        np.bincount(own, minlength=n) / np.maximum(count, 1),
        distinct_lines / np.maximum(n_lines, 1),
        np.log2(np.maximum(longest, 1)) / 16,
        np.where(stated < 0, 1.0, np.log2(np.maximum(stated, 1)) / 24),
    ]
    level = np.clip(np.stack(stats, 1) * (LEVELS - 1), 0, LEVELS - 1).astype(np.int64)
    slot = (1 << BITS) + np.arange(len(STATS)) * LEVELS + level
    return np.concatenate([own, np.repeat(np.arange(n), len(STATS))]), np.concatenate([(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), slot.ravel()])


_LINE = np.ones(256, bool)
_LINE[0x0A] = False
N_FEATURES = (1 << BITS) + len(STATS) * LEVELS


def score(model: Model, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    """Probability of label 1 for each of n documents. Linear in features times factors: the sum over pairs of
    <v_i, v_j> x_i x_j is half of (sum of v_i x_i)^2 - sum of (v_i x_i)^2. Each present feature counts 1 / sqrt(present)."""
    row = model.row_of[feature]
    doc, row = doc[row >= 0], row[row >= 0]
    x = 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))
    out = model.bias + np.bincount(doc, model.weight[row], n) * x
    for v in model.factors.T:
        out += 0.5 * (np.bincount(doc, v[row], n) ** 2 - np.bincount(doc, v[row] ** 2, n)) * x * x
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit(doc: np.ndarray, feature: np.ndarray, label: np.ndarray, k: int = 6, epochs: int = 8, least: int = 12, seed: int = 7) -> Model:
    """Logistic loss by Adam over mini-batches. Features of fewer than `least` rows learn no weight."""
    n = len(label)
    seen = np.bincount(feature, minlength=N_FEATURES)
    live = np.flatnonzero(seen >= least)
    row_of = np.full(N_FEATURES, -1, np.int32)
    row_of[live] = np.arange(len(live))
    row = row_of[feature]
    doc, row = doc[row >= 0], row[row >= 0]
    order = np.argsort(doc, kind="stable")
    doc, row = doc[order], row[order]
    at = np.searchsorted(doc, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    p = np.clip(label.mean() if n else 0.5, 0.01, 0.99)
    params = [np.array([np.log(p / (1 - p))]), np.zeros(len(live)), rng.normal(0, 0.02, (len(live), k))]
    m1, m2 = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    step = 0
    epochs = max(epochs, -(-STEPS // max(1, -(-n // 256))))
    for _ in range(epochs if len(live) else 0):
        turn = rng.permutation(n)
        for a in range(0, n, 256):
            own = turn[a : a + 256]
            size = at[own + 1] - at[own]
            in_batch = np.repeat(np.arange(len(own)), size)
            r = row[np.repeat(at[own] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            x = 1 / np.sqrt(np.maximum(size, 1))
            w0, w, v = params
            s = np.stack([np.bincount(in_batch, f[r], len(own)) for f in v.T], 1) * x[:, None]
            squares = np.bincount(in_batch, (v * v).sum(1)[r], len(own)) * x * x
            z = w0 + np.bincount(in_batch, w[r], len(own)) * x + 0.5 * ((s * s).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[own]) / len(own)
            gx, gxx = (g * x)[in_batch], np.bincount(r, (g * x * x)[in_batch], len(w))
            dv = np.stack([np.bincount(r, gx * f[in_batch], len(w)) for f in s.T], 1) - gxx[:, None] * v
            grads = [np.array([g.sum()]), np.bincount(r, gx, len(w)) + 1e-5 * w, dv + 1e-4 * v]
            step += 1
            for q, d, u1, u2 in zip(params, grads, m1, m2):
                u1 += 0.1 * (d - u1)
                u2 += 0.001 * (d * d - u2)
                q -= 0.02 * (u1 / (1 - 0.9**step)) / (np.sqrt(u2 / (1 - 0.999**step)) + 1e-8)
    return Model(row_of, float(params[0][0]), params[1].astype(np.float64), params[2].astype(np.float64))


def _stated(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return np.array([-1 if v is None else v for v in batch.column(k).to_pylist()], np.int64)


def _inputs(docs: DataFrame, id_col: str, text_col: str, chars_col: str, more: tuple = ()) -> DataFrame:
    stated = F.col(chars_col).cast("long") if chars_col in docs.columns else F.lit(None).cast("long")
    bounded(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), stated.alias("stated"), *more)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 12_000, exclude=None, epochs: int = 8, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> Model:
    """Fit on at most max_rows labelled documents, the ones of smallest hash of id; exclude is a condition on id_col of rows not to learn from.

    Only labels, texts and n_chars are read. Null labels are no labels; one document with several labels counts by its smallest,
    an id that stands in many rows by the row of smallest text, so the bound holds for rows too.
    """
    own = labels.where(F.col(label_col).isNotNull())
    if exclude is not None:
        own = own.where(~exclude)
    own = own.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(max_rows)

    def run(batches):
        for b in batches:
            buf, offs = packed(b.column(1))
            stated, label, ids = _stated(b, 2), b.column(3).to_numpy(), b.column(0)
            for a, z in slices(offs):
                doc, feature = features(buf[offs[a] : offs[z]], offs[a : z + 1] - offs[a], stated[a:z])
                order = np.argsort(doc, kind="stable")
                at = np.searchsorted(doc[order], np.arange(z - a + 1))
                blobs = [feature[order[p:q]].astype("<u4").tobytes() for p, q in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a), pa.array(blobs, pa.binary()), pa.array(label[a:z], pa.int32())], ["id", "features", "label"])

    inputs = _inputs(docs, id_col, text_col, chars_col).join(F.broadcast(own), "id")
    inputs = inputs.groupBy("id").agg(F.min(F.struct("text", "stated", "label")).alias("r")).select("id", "r.*")
    got = inputs.select("id", "text", "stated", "label").mapInArrow(lean(run), "id long, features binary, label int").toArrow()
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    blobs = got.column("features").to_pylist()
    parts = [np.frombuffer(blobs[k], "<u4") for k in order]
    label = got.column("label").to_numpy()[order].astype(np.float64)
    doc = np.repeat(np.arange(len(parts)), [len(x) for x in parts]) if parts else np.zeros(0, np.int64)
    return fit(doc, np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64), label, epochs=epochs)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """id_col and score (probability of label 1), a row for each row of docs, from the whole text; null and empty texts are scored by their structure.

    Other columns of docs are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            buf, offs = packed(b.column(1))
            stated = _stated(b, 2)
            for a, z in slices(offs):
                got = score(shared.value, *features(buf[offs[a] : offs[z]], offs[a : z + 1] - offs[a], stated[a:z]), z - a)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(got, pa.float64())], ["id", "score"])

    return _inputs(docs, id_col, text_col, chars_col).mapInArrow(lean(run), "id long, score double").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, models: list[tuple[Model, float]], text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of docs, all columns as they are, that every model scores at its threshold or above."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = docs.columns
    at, chars = names.index(text_col), names.index(chars_col) if chars_col in names else -1

    def run(batches):
        for b in batches:
            buf, offs = packed(b.column(at))
            stated = _stated(b, chars) if chars >= 0 else np.full(len(b), -1)
            good = np.ones(len(b), bool)
            for a, z in slices(offs):
                own = features(buf[offs[a] : offs[z]], offs[a : z + 1] - offs[a], stated[a:z])
                for model, least in shared.value:
                    good[a:z] &= score(model, *own, z - a) >= least
            yield b.filter(pa.array(good))

    return docs.mapInArrow(lean(run), docs.schema)
