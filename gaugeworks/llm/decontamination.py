"""Benchmark decontamination: an FM-index for each training shard, searched for all test phrases."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import IS_ALNUM, LOWER, bounded, cut, fresh, lean, packed, slices, word_hashes, words
from gaugeworks.llm.fm_index import FMIndex

WINDOW = 13
#: Bytes of benchmark text that go out to the executors at once; a larger benchmark is searched in several passes.
BLOCK_BYTES = 32 << 20
SHARD_WORDS = 1 << 20


def hashed_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (a-z after lowering, 0-9 and all above ASCII) of each document, and where each document's begin."""
    low = LOWER[buf]
    starts, ends, first = words(low, offs, IS_ALNUM)
    return word_hashes(low, starts, ends), first


class Phrases:
    """Distinct windows by length, each length with an alphabet of its own words, and the items that hold each window."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        by_size: dict[int, dict[bytes, set[int]]] = defaultdict(lambda: defaultdict(set))
        self.items = [None if i is None else str(i) for i, _ in items]
        buf, offs = packed(pa.array([t for _, t in items], pa.string()))
        h, first = hashed_words(buf, offs)
        for k in range(len(items)):
            own = h[first[k] : first[k + 1]]
            size = min(window, len(own))
            for a in range(len(own) - size + 1 if size else 0):
                by_size[size][own[a : a + size].tobytes()].add(k)
        self.sizes = []
        for size, windows in sorted(by_size.items()):
            rows = np.frombuffer(b"".join(windows), np.uint64).reshape(-1, size)
            alphabet, codes = np.unique(rows, return_inverse=True)
            self.sizes.append((size, alphabet, codes.reshape(rows.shape) + 1, [sorted(x) for x in windows.values()]))


def in_order(items: Iterable[str | None]) -> list[str | None]:
    """Distinct items, the one for all without an id last."""
    return sorted({*items}, key=lambda i: (i is None, i or ""))


class Shard:
    """Stretches of one phrase length's own words, collected from documents until they are indexed.

    A stretch shorter than the phrases cannot hold one, and no phrase crosses a word that is in none."""

    def __init__(self, size: int, alphabet: np.ndarray, codes: np.ndarray, holders: list[list[int]]):
        self.size, self.alphabet, self.codes, self.holders = size, alphabet, codes, holders
        self.text, self.place, self.n = [], [], 0

    def add(self, h: np.ndarray, doc: np.ndarray, base: int) -> None:
        at = np.minimum(np.searchsorted(self.alphabet, h), len(self.alphabet) - 1)
        known = self.alphabet[at] == h
        same = np.concatenate([[False], known[1:] & known[:-1] & (doc[1:] == doc[:-1])])
        starts = np.flatnonzero(known & ~same)
        ends = np.flatnonzero(known & ~np.append(same[1:], False)) + 1
        long = ends - starts >= self.size
        size = (ends - starts)[long]
        if not len(size):
            return
        rows = np.repeat(starts[long] - np.cumsum(size) + size, size) + np.arange(size.sum())
        gap = np.cumsum(size)[:-1]
        self.text.append(np.append(np.insert(at[rows] + 1, gap, 0), 0))
        self.place.append(np.append(np.insert(rows + base, gap, -1), -1))
        self.n += len(self.text[-1])

    def hits(self) -> tuple[np.ndarray, np.ndarray]:
        """Places where a phrase occurs, and which phrase."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        index = FMIndex(np.concatenate(self.text), len(self.alphabet) + 1)
        lo, hi = index.search(self.codes)
        count = hi - lo
        rows = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
        place = np.concatenate(self.place)[index.locate(rows)]
        self.text, self.place, self.n = [], [], 0
        return place, np.repeat(np.arange(len(lo)), count)


def search(phrases: Phrases, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str | None]]]:
    """For each packed document: its number of words, merged spans of hit words, items with occurring windows."""
    n = len(offs) - 1
    shards = [Shard(*x) for x in phrases.sizes]
    begin, base = np.zeros(n + 1, np.int64), 0
    found: list[tuple[np.ndarray, np.ndarray, Shard]] = []
    for a, z in slices(offs):
        h, first = hashed_words(buf[offs[a] : offs[z]], offs[a : z + 1] - offs[a])
        begin[a : z + 1] = first + base
        doc = np.repeat(np.arange(z - a), np.diff(first))
        for s in shards:
            if len(h):
                s.add(h, doc, base)
            if s.n > SHARD_WORDS:
                found.append((*s.hits(), s))
        base += len(h)
    found += [(*s.hits(), s) for s in shards]
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[set[int]] = [set() for _ in range(n)]
    start = np.concatenate([p for p, _, _ in found] or [np.zeros(0, np.int64)])
    stop = np.concatenate([p + s.size for p, _, s in found] or [np.zeros(0, np.int64)])
    for place, phrase, s in found:
        own = np.searchsorted(begin, place, "right") - 1
        for d, p in {*zip(own.tolist(), phrase.tolist())}:
            items[d].update(s.holders[p])
    order = np.argsort(start, kind="stable")
    start, stop = start[order], stop[order]
    own = np.searchsorted(begin, start, "right") - 1
    for d, a, b in zip(own.tolist(), (start - begin[own]).tolist(), (stop - begin[own]).tolist()):
        if spans[d] and spans[d][-1][1] >= a:
            spans[d][-1] = (spans[d][-1][0], max(b, spans[d][-1][1]))
        else:
            spans[d].append((a, b))
    return np.diff(begin), spans, [in_order(phrases.items[k] for k in x) for x in items]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def phrase_blocks(benchmark: DataFrame, window: int, item_col: str, text_col: str, block_bytes: int):
    """The benchmark in passes of bounded size, split by a hash of the item; one pass for the usual test sets. Yields phrases and whether it is the last pass."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = 1 + total // block_bytes
    for k in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) if parts > 1 else rows
        yield Phrases(sorted(((r.item, r.text or "") for r in own.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1])), window), k + 1 == parts


_FOUND = "n_words long, spans array<struct<start:int,stop:int>>, items array<string>"


def _found_arrays(phrases: Phrases, col: pa.Array) -> list[pa.Array]:
    n_words, spans, items = search(phrases, *packed(col))
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    return [pa.array(n_words, pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in x] for x in spans], pa.list_(span)), pa.array(items, pa.list_(pa.string()))]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id_col, n_words, spans (merged runs of hit words, [start, stop) in words), items (ids of items with an occurring window), for each row of docs.

    A window is `window` consecutive words of an item, or all of a shorter item that has words. Null and empty texts have
    no words and no hits; items without words have no windows; repeated items count once, and so do all items with a null id,
    as one null at the end of items. No row is dropped; other columns are not read.
    """
    bounded(docs.sparkSession)
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    names = ["id", "text", "n_words", "spans", "items"]
    for k, (phrases, last) in enumerate(phrase_blocks(benchmark, window, item_col, item_text, block_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(phrases)

        def run(batches, shared=shared, k=k):
            for b in batches:
                found = _found_arrays(shared.value, b.column(1))
                if k:
                    both = [[*x, *y] for x, y in zip(b.column(3).to_pylist(), found[1].to_pylist())]
                    found[1] = pa.array([[{"start": a, "stop": z} for a, z in merge_spans([(s["start"], s["stop"]) for s in x])] for x in both], found[1].type)
                    found[2] = pa.array([in_order([*x, *y]) for x, y in zip(b.column(4).to_pylist(), found[2].to_pylist())], found[2].type)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *found], names)

        out = out.mapInArrow(lean(run), f"id long, text string, {_FOUND}")
        if not last:  # so that one block of phrases is out at a time
            out = cut(out, "hits")
            shared.unpersist()
    return out.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def verdict(found: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated: hit words are at least a twentieth of the document's."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start)
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns as they are, whose hit words are less than a twentieth of their words."""
    bounded(docs.sparkSession)
    at, names = docs.columns.index(text_col), docs.columns
    spans_col = fresh(names, "_spans")
    kind = "array<struct<start:int,stop:int>>"
    out = docs.withColumn(spans_col, F.array().cast(kind))
    for phrases, last in phrase_blocks(benchmark, window, item_col, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(phrases)

        def run(batches, shared=shared, last=last):
            for b in batches:
                n_words, more, _ = search(shared.value, *packed(b.column(at)))
                spans = [merge_spans([*((s["start"], s["stop"]) for s in x), *y]) for x, y in zip(b.column(len(names)).to_pylist(), more)]
                if last:
                    hit = np.array([sum(z - a for a, z in x) for x in spans], np.int64)
                    yield b.filter(pa.array((hit == 0) | (20 * hit < n_words))).select(names)
                else:
                    spans = pa.array([[{"start": a, "stop": z} for a, z in x] for x in spans], b.column(len(names)).type)
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], spans], b.schema.names)

        out = out.mapInArrow(lean(run), docs.schema if last else out.schema)
        if not last:
            out = cut(out, "hits")
            shared.unpersist()
    return out
