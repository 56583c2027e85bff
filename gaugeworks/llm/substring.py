"""Removal of repeated passages by suffix automata of reference shards.

An automaton of all documents cannot be sent anywhere, so the reference is cut by content: each window of `window` words
names its anchor, the smallest of its 4-word hashes. Equal windows name equal anchors at equal places, so all windows of
one anchor, as one stretch of words, go to the shard of that anchor and meet every window equal to them there. Stretches
whose anchor occurs once in all documents go nowhere. In a shard, stretches come by document and place; each is
streamed through the shard's suffix automaton, which holds what came earlier, then added to it. Where the matching
statistic reaches the window's length, the window also starts earlier, and its words go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import IS_SPACE, blobs, by_bucket, chunked, fresh, grams, lean, lean_group, mix, text_bytes, unpack, word_hashes, words

GRAM = 4
WINDOW = 20
NOT_SPACE = ~IS_SPACE
LOW = np.iinfo(np.int64).min
META = 6


class SuffixAutomaton:
    """Of several sequences; every path from state 0 spells a stretch of one of them."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        new = self._state(self.length[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, sequence: list[int]) -> None:
        nxt, link, length, last = self.next, self.link, self.length, 0
        for c in sequence:
            p, q = last, nxt[last].get(c)
            if q is not None:
                last = q if length[p] + 1 == length[q] else self._split(p, c, q)
                continue
            last = self._state(length[p] + 1, 0, {})
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = last
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[last] = q if length[p] + 1 == length[q] else self._split(p, c, q)

    def statistics(self, sequence: list[int]) -> list[int]:
        """For each place, the length of the longest stretch that ends there and is in the automaton."""
        nxt, link, length, state, size, out = self.next, self.link, self.length, 0, 0, []
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(c)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            out.append(size)
        return out


def least_places(g: np.ndarray, span: int, n: int, step: int = 1 << 23) -> np.ndarray:
    """For each of n windows of span hashes the place of the smallest, the leftmost of equals. Places are counted from the
    start of a step, so that 24 bits hold them however long the text is."""
    low, out = np.uint64((1 << 24) - 1), np.empty(n, np.int64)
    for a in range(0, n, step):
        z = min(n, a + step)
        least, size = mix(g[a : z + span - 1]) & ~low, 1
        least |= np.arange(len(least), dtype=np.uint64)
        while 2 * size <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[: z - a], least[span - size : span - size + z - a])
        out[a:z] = a + (least & low).astype(np.int64)
    return out


def stretches(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Per run of windows with one anchor: key of the anchor, its place, first word and word count, document."""
    empty = np.zeros(0, np.int64)
    if len(h) < window:
        return np.zeros(0, np.uint64), empty, empty, empty, empty
    g = grams(h, GRAM)
    n = len(h) - window + 1
    at = np.arange(n)
    doc = np.searchsorted(first, at, "right") - 1
    good = at + window <= first[doc + 1]
    at, doc, anchor = at[good], doc[good], least_places(g, window - GRAM + 1, n)[good]
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else empty
    count = np.diff(np.append(head, len(at)))
    return g[anchor[head]], anchor[head], at[head], count + window - 1, doc[head]


def _of_chunk(buf: np.ndarray, offs: np.ndarray):
    starts, ends, first = words(buf, offs, NOT_SPACE)
    return word_hashes(buf, starts, ends), first, starts, ends


def _repeated_anchors(chunks: DataFrame, window: int, n: int) -> DataFrame:
    """chunk, keys: those anchors of a chunk that occur more than once in all chunks."""

    def count(batches):
        for b in batches:
            for chunk, buf, offs, _ in unpack(b):
                h, first, *_ = _of_chunk(buf, offs)
                keys, times = np.unique(stretches(h, first, window)[0], return_counts=True)
                cut_at, _ = by_bucket(keys, n)
                on = np.flatnonzero(np.diff(cut_at))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(on, pa.int32()),
                        pa.array(np.full(len(on), chunk), pa.int64()),
                        pa.array([keys[cut_at[k] : cut_at[k + 1]].tobytes() for k in on], pa.binary()),
                        pa.array([(times[cut_at[k] : cut_at[k + 1]] > 1).tobytes() for k in on], pa.binary()),
                    ],
                    ["bucket", "chunk", "keys", "twice"],
                )

    def meet(t: pa.Table) -> pa.Table:
        rows = t.column("keys").to_pylist()
        keys, twice = blobs(rows, np.uint64), blobs(t.column("twice").to_pylist(), bool)
        every = np.sort(np.concatenate([keys, keys[twice]]))
        more = every[1:][every[1:] == every[:-1]]
        at = np.minimum(np.searchsorted(more, keys), max(len(more) - 1, 0))
        hit = more[at] == keys if len(more) else np.zeros(len(keys), bool)
        ends = np.cumsum([len(r) // 8 for r in rows])
        out = [keys[a:z][hit[a:z]].tobytes() for a, z in zip([0, *ends[:-1]], ends)]
        on = [k for k, x in enumerate(out) if x]
        return pa.table([t.column("chunk").take(pa.array(on, pa.int64())), pa.array([out[k] for k in on], pa.binary())], ["chunk", "keys"])

    counted = chunks.select("chunk", "offs", "text").mapInArrow(lean(count), "bucket int, chunk long, keys binary, twice binary")
    return counted.groupBy("bucket").applyInArrow(lean_group(meet), "chunk long, keys binary")


def _send(chunks: DataFrame, window: int, n: int) -> DataFrame:
    """bucket, meta, words: stretches to shards. Of stretches with the same words in one task only the first carries them."""
    step = np.uint64(0x9E3779B97F4A7C15)

    def flush(held):
        key, ident, meta, lens = (np.concatenate(x) for x in zip(*[h[:4] for h in held]))
        words32 = np.concatenate([h[4] for h in held])
        at = np.cumsum(lens) - lens
        order = np.lexsort((meta[:, 1], meta[:, 0], ident))
        same = np.concatenate([[False], ident[order][1:] == ident[order][:-1]])
        lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        later = np.zeros(len(key), bool)
        later[order] = same & ((meta[order, 0] != meta[lead, 0]) | (meta[order, 1] != meta[lead, 1]))
        meta[:, 5] = np.where(later, 0, 1)
        order = np.argsort(key, kind="stable")
        cut_at, _ = by_bucket(key[order], n)
        on, metas, texts = [], [], []
        for k in np.flatnonzero(np.diff(cut_at)):
            own = order[cut_at[k] : cut_at[k + 1]]
            on.append(k)
            metas.append(meta[own].tobytes())
            texts.append(b"".join(words32[at[i] : at[i] + lens[i]].tobytes() for i in own[~later[own]]))
        return pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(metas, pa.binary()), pa.array(texts, pa.binary())], ["bucket", "meta", "words"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for chunk, buf, offs, rows, keys in unpack(b, ("keys",)):
                keys = np.sort(blobs(keys, np.uint64))
                if not len(keys):
                    continue
                h, first, *_ = _of_chunk(buf, offs)
                key, anchor, start, count, doc = stretches(h, first, window)
                hit = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
                key, anchor, start, count, doc = key[hit], anchor[hit], start[hit], count[hit], doc[hit]
                ids = rows.field(0).fill_null(LOW).to_numpy(zero_copy_only=False)
                meta = np.stack([ids[doc], anchor - first[doc], np.full(len(doc), chunk), doc << 40 | (start - first[doc]), count, count], 1)
                at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
                place = (at - np.repeat(start, count)).astype(np.uint64) * step
                ident = mix(np.add.reduceat(mix(h[at] + place), np.cumsum(count) - count) + count.astype(np.uint64)) if len(count) else np.zeros(0, np.uint64)
                ident ^= mix(key + (anchor - start).astype(np.uint64))
                held.append((key, ident, meta, count, (h[at] >> np.uint64(32)).astype(np.uint32)))
                size += len(at)
                if size > 1 << 20:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return chunks.mapInArrow(lean(run), "bucket int, meta binary, words binary")


def _judge(window: int):
    """Streams a shard's stretches through its automaton; gives the runs of words to remove, by chunk."""

    def run(t: pa.Table) -> pa.Table:
        meta = blobs(t.column("meta").to_pylist(), np.int64).reshape(-1, META)
        words32 = blobs(t.column("words").to_pylist(), np.uint32)
        size = np.where(meta[:, 5] == 1, meta[:, 4], 0)
        at = np.cumsum(size) - size
        out = meta[meta[:, 5] == 0][:, [2, 3, 4]]
        own = np.flatnonzero(meta[:, 5] == 1)
        own = own[np.lexsort((meta[own, 1], meta[own, 0]))]
        automaton, seen, waiting, found = SuffixAutomaton(), set(), [], []
        before = None
        for k in own.tolist():
            place = (meta[k, 0], meta[k, 1])
            if place != before:
                for data in waiting:
                    if data not in seen:
                        seen.add(data)
                        automaton.add(np.frombuffer(data, np.uint32).tolist())
                waiting, before = [], place
            data = words32[at[k] : at[k] + size[k]].tobytes()
            waiting.append(data)
            if data in seen:
                found.append((meta[k, 2], meta[k, 3], meta[k, 4]))
                continue
            stats = automaton.statistics(np.frombuffer(data, np.uint32).tolist())
            for end, length in enumerate(stats):
                if length >= window:
                    found.append((meta[k, 2], meta[k, 3] + end - window + 1, window))
        if found:
            out = np.concatenate([out, np.array(found, np.int64)])
        out = out[np.argsort(out[:, 0], kind="stable")]
        head = np.flatnonzero(np.concatenate([[True], out[1:, 0] != out[:-1, 0]])) if len(out) else np.zeros(0, np.int64)
        ends = np.append(head, len(out))[1:]
        return pa.table([pa.array(out[head, 0], pa.int64()), pa.array([np.ascontiguousarray(out[a:z, 1:]).tobytes() for a, z in zip(head, ends)], pa.binary())], ["chunk", "runs"])

    return run


def repeated_runs(docs: DataFrame, window: int, id_col: str, text_col: str, carry: list[str], judge=_judge) -> DataFrame:
    """The chunks of docs with `runs`: for each word run to remove its document << 40 | first word, and its length."""
    chunks = chunked(docs.withColumn(id_col, F.col(id_col).try_cast("long")), text_col, [id_col, *[c for c in carry if c != id_col]], "passages")
    n = max(512, text_bytes(chunks) >> 21)
    repeated = _repeated_anchors(chunks, window, n).groupBy("chunk").agg(F.collect_list("keys").alias("keys"))
    sent = _send(chunks.join(repeated, "chunk"), window, 4 * n)
    runs = sent.groupBy("bucket").applyInArrow(lean_group(judge(window)), "chunk long, runs binary")
    return chunks.join(runs.groupBy("chunk").agg(F.collect_list("runs").alias("runs")), "chunk", "left")


def removed(runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words of a chunk the runs cover."""
    runs = runs.reshape(-1, 2)
    change = np.zeros(int(first[-1]) + 1, np.int64)
    start = first[runs[:, 0] >> 40] + (runs[:, 0] & ((1 << 40) - 1))
    np.add.at(change, start, 1)
    np.add.at(change, start + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def find_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", judge=_judge) -> DataFrame:
    """id_col, n_words, n_removed, spans (removed runs of words, [start, stop)), kept (other words, joined by one blank), for each row of docs.

    A word goes if some window of `window` words that covers it also starts earlier: in a document of smaller id, or at an
    earlier place under the same id. A null id is smaller than all others. Rows alike in id and text keep alike. Null and empty texts have no words.
    Texts shorter than a window lose nothing. Other columns are not read. Words are compared by 64-bit hashes of anchors
    and 32-bit hashes of each word of a window.
    """

    def run(batches):
        for b in batches:
            for _, buf, offs, rows, runs in unpack(b, ("runs",)):
                starts, ends, first = words(buf, offs, NOT_SPACE)
                gone = removed(blobs(runs, np.int64), first)
                data, n_removed, spans, kept = buf.tobytes(), [], [], []
                for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
                    own = gone[a:z]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                    n_removed.append(int(own.sum()))
                    spans.append([{"start": x, "stop": y} for x, y in edge.reshape(-1, 2).tolist()])
                    keep = a + np.flatnonzero(~own)
                    kept.append(b" ".join([data[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist())]).decode())
                span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
                yield pa.RecordBatch.from_arrays(
                    [rows.field(0), pa.array(np.diff(first), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.string())],
                    ["id", "n_words", "n_removed", "spans", "kept"],
                )

    out = repeated_runs(docs.select(id_col, text_col), window, id_col, text_col, [], judge)
    return out.mapInArrow(lean(run), "id long, n_words long, n_removed long, spans array<struct<start:int,stop:int>>, kept string").withColumnRenamed("id", id_col)


def drop_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated passages cut out of text_col; all rows and columns stay. Texts without repeats stay as they are, nulls null;
    a removed run of words goes with the white space behind it. Ids may be of any whole-number type; others count as null. Extra
    columns may have any name. A text is held whole by the task that works on it, with 8 bytes for each of its words."""
    names = docs.columns
    key, was_null = fresh(names, "_key"), fresh(names, "_was_null")
    carry = [key, *[c for c in names if c != text_col], was_null]
    marked = docs.withColumn(was_null, F.col(text_col).isNull()).withColumn(key, F.col(id_col).try_cast("long"))
    order = [carry.index(c) if c != text_col else -1 for c in names]

    def run(batches):
        for b in batches:
            for _, buf, offs, rows, runs in unpack(b, ("runs",)):
                starts, ends, first = words(buf, offs, NOT_SPACE)
                gone = removed(blobs(runs, np.int64), first)
                null, texts = rows.field(len(carry) - 1).to_pylist(), []
                for d in range(len(offs) - 1):
                    a, z = first[d], first[d + 1]
                    own = gone[a:z]
                    if null[d]:
                        texts.append(None)
                        continue
                    mask = np.ones(offs[d + 1] - offs[d], bool)
                    if own.any():
                        stop = np.append(starts[a + 1 : z], offs[d + 1])
                        for w in np.flatnonzero(own).tolist():
                            mask[starts[a + w] - offs[d] : stop[w] - offs[d]] = False
                    texts.append(buf[offs[d] : offs[d + 1]][mask].tobytes().decode())
                cols = [pa.array(texts, pa.string()) if k < 0 else rows.field(k) for k in order]
                yield pa.RecordBatch.from_arrays(cols, names)

    return repeated_runs(marked, window, key, text_col, carry).mapInArrow(lean(run), docs.schema)
