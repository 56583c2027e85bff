"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text is its words in lower case, a blank after each, then one end. Every byte is eight bits; each of the 255 nodes of a
byte's bit tree has its own tree of byte contexts. At all depths nodes hold Krichevsky-Trofimov estimates, and each inner
node mixes its own with its children's, half and half before data: Pw = (KT + product of the children's Pw) / 2.
Scores are of the model after all training texts, held fixed: going up from the deepest context,
p = w * KT + (1 - w) * p below, w being KT / (2 Pw).

Counts are of (context, byte) strings, so the tree is cut by the two latest context bytes: below them each shard works
alone, above them are at most 257 contexts of 255 bit nodes, which is all that is ever collected or broadcast. No shard
table is broadcast: each group of chunks names the strings it holds and gets their probabilities back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import IS_SPACE, LOWER, blobs, chunked, cut, lean, lean_cogroup, lean_group, mix, text_bytes, unpack, word_hashes, words

DEPTH = 5
END = 0x0A
NOT_SPACE = ~IS_SPACE
LN2, LN10 = np.log(2), np.log(10)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of x > 0: eight steps up, then Stirling's series."""
    x = np.asarray(x, np.float64)
    up, shift = x + 8, np.ones_like(x)
    for k in range(8):
        shift *= x + k
    r = 1 / (up * up)
    return (up - 0.5) * np.log(up) - up + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / up - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - np.log(np.pi)


def strings(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of packed documents: for each byte of their streams the string (latest context byte first, then earlier ones, the byte
    itself last) as an integer, with where each document's begin; hashes of words, with where each document's begin."""
    low = LOWER[buf]
    starts, ends, first = words(low, offs, NOT_SPACE)
    h = word_hashes(low, starts, ends)
    n = len(offs) - 1
    count, size = np.diff(first), ends - starts
    doc = np.repeat(np.arange(n), count)
    length = np.bincount(doc, size + 1, n).astype(np.int64) + 1 + DEPTH
    begin = np.concatenate([[0], np.cumsum(length)])
    out = np.full(begin[-1], END, np.uint8)
    at = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(size)])[:-1] + doc * (1 + DEPTH) + DEPTH
    body = np.repeat(at - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
    out[body] = low[NOT_SPACE[low]]
    out[at + size] = 0x20
    key = np.zeros(len(out), np.uint64)
    wide = out.astype(np.uint64)
    for back in range(1, DEPTH + 1):
        key[back:] |= wide[:-back] << np.uint64(8 * (DEPTH + 1 - back))
    key |= wide
    real = np.ones(len(out), bool)
    pad = begin[:-1, None] + np.arange(DEPTH)
    real[pad.ravel()] = False
    return key[real], begin - np.arange(n + 1) * DEPTH, h, first


class Tree:
    """Nodes of contexts of DEPTH down to `top` bytes, by depth and bit level, from counts of strings."""

    def __init__(self, key: np.ndarray, count: np.ndarray, top: int):
        self.top = top
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        for depth in range(DEPTH, top - 1, -1):
            if depth < DEPTH:
                key, back = np.unique((key >> np.uint64(16) << np.uint64(8)) | key & np.uint64(255), return_inverse=True)
                count = np.bincount(back, count, len(key))
            for b in range(8):
                ident = key >> np.uint64(8 - b)
                one = (key >> np.uint64(7 - b) & np.uint64(1)).astype(bool)
                head = np.flatnonzero(np.concatenate([[True], ident[1:] != ident[:-1]])) if len(key) else np.zeros(0, np.int64)
                n1 = np.add.reduceat(np.where(one, count, 0), head) if len(head) else np.zeros(0)
                n0 = np.add.reduceat(np.where(one, 0, count), head) if len(head) else np.zeros(0)
                kt, ident = log_kt(n0, n1), ident[head]
                pw = kt
                if depth < DEPTH:
                    child, _, _, child_pw, _ = self.nodes[depth + 1, b]
                    parent = (child >> np.uint64(8 + b) << np.uint64(b)) | child & np.uint64((1 << b) - 1)
                    below = np.bincount(np.searchsorted(ident, parent), child_pw, len(ident))
                    pw = np.logaddexp(kt, below) - LN2
                self.nodes[depth, b] = ident, n0, n1, pw, np.exp(kt - LN2 - pw) if depth < DEPTH else np.ones(len(kt))

    def predict(self, key: np.ndarray, b: int) -> np.ndarray:
        """Probability of bit b of each string at depth `top`, mixed over all depths below."""
        one = (key >> np.uint64(7 - b) & np.uint64(1)).astype(bool)
        p = np.full(len(key), 0.5)
        x = key & np.uint64(255)
        for depth in range(DEPTH, self.top - 1, -1):
            ident, n0, n1, _, w = self.nodes[depth, b]
            own = ((key >> np.uint64(8 * (DEPTH + 1 - depth)) << np.uint64(8)) | x) >> np.uint64(8 - b)
            if not len(ident):
                continue
            at = np.minimum(np.searchsorted(ident, own), len(ident) - 1)
            hit = ident[at] == own
            kt = (np.where(one, n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1)
            p = np.where(hit, w[at] * kt + (1 - w[at]) * p, 0.5)
        return p


class Top:
    """Depths 1 and 0, from sums over the shards: counts, and log Pw of the children, by latest byte and bit node."""

    def __init__(self, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        self.n = np.zeros((2, 2, 256, 256))  # depth, bit, byte, bit node
        self.n[1, 0].ravel()[node], self.n[1, 1].ravel()[node] = n0, n1
        sums = np.zeros((256, 256))
        sums.ravel()[node] = below
        self.w = np.ones((2, 256, 256))
        self.seen = np.zeros((2, 256, 256), bool)
        pw = sums
        for depth in (1, 0):
            if depth == 0:
                self.n[0, :, 0] = self.n[1].sum(1)
                sums = np.zeros((256, 256))
                sums[0] = pw.sum(0)
            kt = log_kt(self.n[depth, 0], self.n[depth, 1])
            self.seen[depth] = self.n[depth].sum(0) > 0
            pw = np.where(self.seen[depth], np.logaddexp(kt, sums) - LN2, 0)
            self.w[depth] = np.exp(kt - LN2 - pw)

    def predict(self, key: np.ndarray, b: int, p: np.ndarray) -> np.ndarray:
        one = (key >> np.uint64(7 - b) & np.uint64(1)).astype(np.int64)
        bit_node = ((key & np.uint64(255) | np.uint64(256)) >> np.uint64(8 - b)).astype(np.int64)
        for depth in (1, 0):
            byte = (key >> np.uint64(8 * DEPTH)).astype(np.int64) if depth else 0
            n0, n1 = self.n[depth, 0][byte, bit_node], self.n[depth, 1][byte, bit_node]
            w = self.w[depth][byte, bit_node]
            p = np.where(self.seen[depth][byte, bit_node], w * (np.where(one, n1, n0) + 0.5) / (n0 + n1 + 1) + (1 - w) * p, 0.5)
        return p


def log10_probability(tree: Tree, top: Top, key: np.ndarray) -> np.ndarray:
    out = np.zeros(len(key))
    for b in range(8):
        out += np.log(top.predict(key, b, tree.predict(key, b)))
    return out / LN10


def _counted(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return sorted_keys[head], np.diff(np.append(head, len(sorted_keys)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def bucket_bits(size: int) -> int:
    """How many bits of buckets a corpus of so many (compressed) bytes gets: a bucket's share stays about 2 MB as the corpus grows."""
    return max(8, (size >> 21).bit_length())


def _bucket_of(keys: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Strings by their two latest context bytes (at most 65536 buckets), words by hash."""
    return ((mix(keys >> np.uint64(8 * (DEPTH - 1))) if kind == 0 else keys) >> np.uint64(64 - (min(bits, 16) if kind == 0 else bits))).astype(np.int64)


def _messages(chunks: DataFrame, bits: int) -> DataFrame:
    """kind (0 strings, 1 words), bucket, block, keys, counts: what a block of 16 chunks holds, counted in training documents."""

    def run(batches):
        block, held = None, None

        def emit():
            for kind in (0, 1):
                if not held[kind]:
                    continue
                keys, count = _merged(held[kind])
                bucket = _bucket_of(keys, kind, bits)
                order = np.argsort(bucket, kind="stable")
                keys, count, bucket = keys[order], count[order], bucket[order]
                edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
                on = np.arange(len(edges) - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(on), kind), pa.int32()),
                        pa.array(bucket[edges[:-1]], pa.int32()),
                        pa.array(np.full(len(on), block), pa.int64()),
                        pa.array([keys[edges[k] : edges[k + 1]].tobytes() for k in on], pa.binary()),
                        pa.array([count[edges[k] : edges[k + 1]].astype(np.uint32).tobytes() for k in on], pa.binary()),
                    ],
                    ["kind", "bucket", "block", "keys", "counts"],
                )

        for b in batches:
            for chunk, buf, offs, rows in unpack(b):
                if chunk >> 4 != block:
                    if held:
                        yield from emit()
                    block, held = chunk >> 4, ([], [])
                key, begin, h, first = strings(buf, offs)
                train = rows.field(1).to_numpy(zero_copy_only=False).astype(bool)
                for kind, every, size in ((0, key, np.diff(begin)), (1, h, np.diff(first))):
                    own = np.repeat(train, size)
                    learned = _counted(np.sort(every[own]))
                    rest = _counted(np.sort(every[~own]))[0]
                    held[kind].extend([learned, (rest, np.zeros(len(rest), np.int64))])
        if held:
            yield from emit()

    return chunks.mapInArrow(lean(run), "kind int, bucket int, block long, keys binary, counts binary")


def _gathered(t: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each message; all distinct keys, their training counts, and where each message's keys are among them."""
    rows = t.column("keys").to_pylist()
    keys, back = np.unique(blobs(rows, np.uint64), return_inverse=True)
    return rows, keys, np.bincount(back, blobs(t.column("counts").to_pylist(), np.uint32), len(keys)), back


def _sums(t: pa.Table) -> pa.Table:
    _, keys, count, _ = _gathered(t)
    tree = Tree(keys[count > 0], count[count > 0], 2)
    node, n0s, n1s, below = [], [], [], []
    for b in range(8):
        ident, n0, n1, pw, _ = tree.nodes[2, b]
        latest = (ident >> np.uint64(8 + b)).astype(np.int64)
        at, back = np.unique(latest << 8 | 1 << b | (ident & np.uint64((1 << b) - 1)).astype(np.int64), return_inverse=True)
        node.append(at)
        for out, x in ((n0s, n0), (n1s, n1), (below, pw)):
            out.append(np.bincount(back, x, len(at)))
    return pa.table([pa.array(np.concatenate(node), pa.int32()), *[pa.array(np.concatenate(x), pa.float64()) for x in (n0s, n1s, below)]], ["node", "n0", "n1", "below"])


def _answers(shared):
    def run(t: pa.Table) -> pa.Table:
        kind = t.column("kind")[0].as_py()
        rows, keys, count, back = _gathered(t)
        value = (log10_probability(Tree(keys[count > 0], count[count > 0], 2), shared.value, keys) if kind == 0 else count).astype(np.float64)
        known = int((count > 0).sum())
        ends = np.cumsum([len(r) // 8 for r in rows])
        value = value[back]
        return pa.table(
            [t.column("block"), pa.array(np.full(len(rows), kind), pa.int32()), pa.array(rows, pa.binary()), pa.array([value[a:z].tobytes() for a, z in zip([0, *ends[:-1]], ends)], pa.binary()), pa.array([known] + [0] * (len(rows) - 1), pa.int64())],
            ["block", "kind", "keys", "vals", "known"],
        )

    return run


def _scores(log_total: float, end_count: int):
    names = ["id", "train", "n_tokens", "n_known", "n_bytes", "base_score", "score"]

    def run(_key, chunks: pa.Table, answers: pa.Table) -> pa.Table:
        known = []
        for kind in (0, 1):
            own = answers.filter(pc.equal(answers.column("kind"), kind))
            keys, at = np.unique(blobs(own.column("keys").to_pylist(), np.uint64), return_index=True)
            known.append((keys, blobs(own.column("vals").to_pylist(), np.float64)[at]))
        out = []
        for b in chunks.to_batches():
            for _, buf, offs, rows in unpack(b):
                n = len(offs) - 1
                key, begin, h, first = strings(buf, offs)
                score = np.zeros(n)
                for a in range(0, n, 1 << 15):  # by document, then string: look-ups go up through the table
                    z = min(n, a + (1 << 15))
                    doc = np.repeat(np.arange(z - a, dtype=np.uint64), np.diff(begin[a : z + 1]))
                    both = np.sort(doc << np.uint64(48) | key[begin[a] : begin[z]])
                    at = np.searchsorted(known[0][0], both & np.uint64((1 << 48) - 1))
                    score[a:z] = np.bincount((both >> np.uint64(48)).astype(np.int64), known[0][1][at], z - a)
                doc = np.repeat(np.arange(n), np.diff(first))
                count = known[1][1][np.searchsorted(known[1][0], h)] if len(h) else np.zeros(0)
                tokens = np.diff(first) + 1
                base = np.bincount(doc, np.log10(count + 0.1), n) + np.log10(end_count + 0.1) - tokens * log_total
                n_known = np.bincount(doc, count > 0, n).astype(np.int64) + (end_count > 0)
                out.append(pa.RecordBatch.from_arrays([rows.field(0), rows.field(1), pa.array(tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(np.diff(begin), pa.int64()), pa.array(base), pa.array(score)], names))
        return pa.Table.from_batches(out)

    return run


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte, for each row of docs; train: a condition, where true (or null) the model learns from the row.

    A null text is empty: one token, the end. Repeated rows count as often as they stand. base_score is of single tokens,
    log10((c + 0.1) / (N + 0.1 (V + 1))) each; score is the context tree's log10 probability of the text; bits_per_byte is its code length over the n_bytes of
    the text's stream (words, a blank after each, the end). Without training rows
    every bit has probability one half. Words are told apart by 64-bit hashes. A text is held whole by the task that works on it, with 16 bytes for each
    of its bytes. Other columns are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(True)).alias("train"), F.col(text_col).alias("text"))
    chunks = chunked(own, "text", ["id", "train"], "lm")
    sent = cut(_messages(chunks, bucket_bits(text_bytes(chunks))), "counts")
    sums = sent.where("kind = 0").select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(lean_group(_sums), "node int, n0 double, n1 double, below double")
    sums = sums.groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")).orderBy("node").toArrow()
    top = Top(*[sums.column(c).to_numpy() for c in ("node", "n0", "n1", "below")])
    shared = docs.sparkSession.sparkContext.broadcast(top)
    answers = cut(sent.groupBy("kind", "bucket").applyInArrow(lean_group(_answers(shared)), "block long, kind int, keys binary, vals binary, known long"), "answers")
    ends = own.where("train").count()
    learned = answers.where("kind = 1").agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    total = round(_blank_count(top)) + ends
    log_total = float(np.log10(total + 0.1 * (learned + (ends > 0) + 1)))
    block = chunks.withColumn("block", F.shiftright("chunk", 4))
    out = block.groupBy("block").cogroup(answers.select("block", "kind", "keys", "vals").groupBy("block")).applyInArrow(lean_cogroup(_scores(log_total, ends)), "id long, train boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double")
    per_byte = (-F.col("score") * F.lit(LN10 / LN2) / F.col("n_bytes")).alias("bits_per_byte")
    return out.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", per_byte)


def _blank_count(top: Top) -> float:
    """How often a blank was seen, that is, how many words: down the bits of 0x20 from the root."""
    return float(top.n[0, 0x20 & 1, 0, (0x20 | 0x100) >> 1])
