"""Repeated passages by sparse suffix arrays.

Only suffixes at content-selected places are kept: each window of `window` words picks the smallest of its 4-word hashes,
so equal passages keep suffixes at equal places. Suffixes whose first four words occur once go nowhere; the others go to
the shard of those words. A shard sorts its suffixes, and what stands before them read backwards, and compares
neighbours: the common lengths of neighbours say which suffixes agree over how many words to the right, and which to the
left. A passage that agrees over l words to the left and window - l to the right is repeated; all but its first go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugeworks.llm.common import blobs
from gaugeworks.llm.substring import GRAM, META, find_repeats

WINDOW = 50


def sorted_suffixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a matrix of words, and the common length of each with the one before it in that order."""
    keys = np.ascontiguousarray(rows.astype(">u4")).view(np.dtype((np.void, rows.shape[1] * 4))).ravel()
    order = np.argsort(keys, kind="stable")
    differ = rows[order][1:] != rows[order][:-1]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, np.concatenate([[0], common])


def classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Number of the run of neighbours that agree over depth words, for each row."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth) if depth else 0
    return out


def neighbours(window: int):
    def run(t: pa.Table) -> pa.Table:
        meta = blobs(t.column("meta").to_pylist(), np.int64).reshape(-1, META)
        words32 = blobs(t.column("words").to_pylist(), np.uint32)
        found = [meta[meta[:, 5] == 0][:, [2, 3, 4]]]
        own = meta[meta[:, 5] == 1]
        n, size = len(own), own[:, 4]
        at = np.cumsum(size) - size
        offset = own[:, 1] - (own[:, 3] & ((1 << 40) - 1))
        col = np.arange(window)
        right, left = np.zeros((n, window), np.uint32), np.zeros((n, window), np.uint32)
        has_right, has_left = col < (size - offset)[:, None], col < offset[:, None]
        if n:
            anchor, last = (at + offset)[:, None], len(words32) - 1
            right[has_right] = words32[np.minimum(anchor + col, last)][has_right]
            left[has_left] = words32[np.maximum(anchor - 1 - col, 0)][has_left]
        to_right, to_left = sorted_suffixes(right), sorted_suffixes(left)
        by_place = np.lexsort((own[:, 1], own[:, 0]))
        fresh = np.concatenate([[True], (own[by_place][1:, :2] != own[by_place][:-1, :2]).any(1)]) if n else np.zeros(0, bool)
        place = np.empty(n, np.int64)
        place[by_place] = np.cumsum(fresh)
        for l in range(min(int(offset.max(initial=0)), window - GRAM) + 1):
            ok = np.flatnonzero((offset >= l) & (size - offset >= window - l))
            if len(ok) < 2:
                continue
            key = classes(*to_right, window - l)[ok] * (n + 1) + classes(*to_left, l)[ok]
            _, same = np.unique(key, return_inverse=True)
            first = np.full(same.max() + 1, n + 1)
            np.minimum.at(first, same, place[ok])
            gone = ok[place[ok] > first[same]]
            found.append(np.stack([own[gone, 2], own[gone, 3] + offset[gone] - l, np.full(len(gone), window)], 1))
        out = np.concatenate(found)
        out = out[np.argsort(out[:, 0], kind="stable")]
        head = np.flatnonzero(np.concatenate([[True], out[1:, 0] != out[:-1, 0]])) if len(out) else np.zeros(0, np.int64)
        ends = np.append(head, len(out))[1:]
        return pa.table([pa.array(out[head, 0], pa.int64()), pa.array([np.ascontiguousarray(out[a:z, 1:]).tobytes() for a, z in zip(head, ends)], pa.binary())], ["chunk", "runs"])

    return run


def find_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_removed, spans, kept, for each row of docs: words of passages of `window` words that also start earlier go.

    Earlier is a smaller id, or an earlier place under the same id; a null id is smaller than all others. Rows alike in id and text
    keep alike. Null and empty texts have no words; shorter texts lose nothing. Other columns are not read.
    """
    return find_repeats(docs, window, id_col, text_col, neighbours)
