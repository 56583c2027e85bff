"""FM-index over a sequence of small integers: suffix array, Burrows-Wheeler transform, wavelet-matrix ranks, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; only ranks still shared are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    width = 1
    while True:
        heads = np.flatnonzero(np.diff(np.append(head, n)) > 1)
        if not len(heads):
            return order
        size = np.diff(np.append(head, n))[heads]
        rows = np.repeat(head[heads] - np.cumsum(size) + size, size) + np.arange(size.sum())
        at = order[rows]
        nxt = at + width
        key = rank[at] * (n + 1) + np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        turn = np.argsort(key, kind="stable")
        order[rows], key = at[turn], key[turn]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        first = rows[fresh]
        rank[order[rows]] = np.repeat(first, np.diff(np.append(np.flatnonzero(fresh), len(rows))))
        head = np.union1d(head, first)
        width *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, every: int = 16):
        """text: values 0 to sigma-1, not empty. Every `every`-th suffix position is kept."""
        text, sigma = np.append(text + 1, 0), sigma + 1  # the end is a symbol of its own, below all others
        n = len(text)
        sa = suffix_array(text)
        last = text[sa - 1]
        self.n = n
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        row = last
        for b in range(self.bits - 1, -1, -1):
            bit = (row >> b & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(n - self.ones[-1][-1]))
            row = np.concatenate([row[~bit], row[bit]])
        self.marked = sa % every == 0
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.samples = sa[self.marked]

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many c stand before position at of the transform."""
        lo, hi = np.zeros_like(at), at
        for k in range(self.bits):
            bit = (c >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = self.ones[k][lo], self.ones[k][hi]
            lo, hi = np.where(bit, self.zeros[k] + a, lo - a), np.where(bit, self.zeros[k] + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        c = np.zeros_like(at)
        for k in range(self.bits):
            a = self.ones[k][at]
            bit = self.ones[k][at + 1] > a
            c = c << 1 | bit
            at = np.where(bit, self.zeros[k] + a, at - a)
        return c

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [from, to) of equally long phrases, one a row of the matrix, by backward search."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for col in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, col] + 1
            lo[live], hi[live] = self.before[c] + self.rank(c, lo[live]), self.before[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        found = lo < hi
        return np.where(found, lo, 0), np.where(found, hi, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back to the next kept position and add the steps."""
        out, rows, left, step = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(left):
            hit = self.marked[rows]
            out[left[hit]] = self.samples[self.mark_rank[rows[hit]]] + step
            left, rows = left[~hit], rows[~hit]
            c = self.access(rows)
            rows = self.before[c] + self.rank(c, rows)
            step += 1
        return out
