"""BPE as a streaming transducer with bounded lookahead, and its inverse.

A merge list has a sufficient lookahead: whatever follows a text, the tokens that end at least that many symbols before
its end stay as they are. Take two texts with one prefix and go through the merges in order. The place left of which both
have the same tokens moves left only when a merge (u, v) joins across it in one of them, by the length of u; what stands
right of it afterwards begins with u in both. So the next merge (u', v') to move it has a later place in the list and a v'
that begins with u. The largest sum of such lengths over the list is the bound, found in one pass over the merges.

Text goes through a transducer piece by piece: what it holds is the open end of the text, up to a place that later text
cannot change, and of a long word only the stretch behind the last stable token. The end of a word makes its tokens stable.
Memory is constant however long a text or a word is (only a run of combining marks is held whole, as its normal form orders
them all). Closed words of several texts go through the merges side by side.
"""

from __future__ import annotations

import codecs
import heapq
import itertools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from unicodedata import combining, decomposition, normalize

from gaugeworks.llm.common import bounded, lean, packed

CACHE = 1 << 17
BLOCK = 1 << 16
#: Characters of an open word that tell how it goes on; no split pattern looks back further.
TAIL = 64
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, nxt = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else nxt))
        nxt += b not in plain
    return out


NO_MERGE = np.iinfo(np.int32).max


class PairTable:
    """Ranks of pairs of symbols, by hash in an open table that whole arrays are looked up in."""

    def __init__(self, pair: dict[tuple[int, int], tuple[int, int]]):
        self.made = np.zeros(max([0, *(r for r, _ in pair.values())]) + 1, np.int32)
        self.bits = max(4, (8 * len(pair)).bit_length())
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        keys = np.array([a << 32 | b for a, b in pair], np.int64)
        ranks = np.array([r for r, _ in pair.values()], np.int32)
        for r, new in pair.values():
            self.made[r] = new
        while len(keys):
            slot_key, slot_rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO_MERGE, np.int32)
            at = self.slot(keys, len(self.levels))
            slot_key[at], slot_rank[at] = keys, ranks
            lost = slot_key[at] != keys
            slot_rank[at[~lost]] = ranks[~lost]
            more = np.zeros(1 << self.bits, bool)
            more[at[lost]] = True
            self.levels.append((slot_key, slot_rank, more))
            keys, ranks = keys[lost], ranks[lost]

    def slot(self, keys: np.ndarray, level: int) -> np.ndarray:
        odd = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF)
        return ((keys.astype(np.uint64) * odd) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF
        out = np.full(keys.shape, NO_MERGE, np.int32)
        flat, keys = out.reshape(-1), keys.reshape(-1)
        left = slice(None)
        for level, (slot_key, slot_rank, more) in enumerate(self.levels):
            at = self.slot(keys, level)
            flat[left] = np.where(slot_key[at] == keys, slot_rank[at], flat[left])
            again = np.flatnonzero(more[at] & (flat[left] == NO_MERGE))
            if not len(again):
                break
            left, keys = again if level == 0 else left[again], keys[again]
        return out


class Tokenizer:
    """What a tokenizers JSON file of byte-level BPE says: normalizing, splitting, merging, special strings."""

    def __init__(self, spec: str):
        conf = json.loads(spec)
        model = conf["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pair = {}
        for rank, (u, v) in enumerate(merges):
            joined = u + v
            if u in self.vocab and v in self.vocab and joined in self.vocab:
                self.pair.setdefault((self.vocab[u], self.vocab[v]), (rank, self.vocab[joined]))
        self.lookahead = sufficient_lookahead(merges)
        self.keep = 4 * self.lookahead + 64
        chars = byte_chars()
        self.inner = [self.vocab.get(c) for c in chars]
        self.final = [self.vocab.get(c + self.suffix) for c in chars]
        self.special = {a["content"]: a["id"] for a in conf.get("added_tokens", [])}
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        kinds = _kinds(conf.get("normalizer"))
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        self.splitter = regex.compile(_pattern(conf["pre_tokenizer"]).replace("\\s", SPACE))
        self.decoder = conf.get("decoder")
        self.cache: dict[str, bytes] = {}
        self.table = PairTable(self.pair)
        self.symbols = None if None in self.inner or None in self.final else (np.array(self.inner, np.int32), np.array(self.final, np.int32))

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of a bounded run of symbols, lowest rank first, leftmost first."""
        pair = self.pair
        if len(ids) > 48:
            return self._merge_long(ids)
        while len(ids) > 1:
            best = None
            for ab in zip(ids, ids[1:]):
                m = pair.get(ab)
                if m is not None and (best is None or m < best):
                    best, at = m, ab
            if best is None:
                break
            a, b = at
            new, out, i, n = best[1], [], 0, len(ids)
            while i < n:
                if ids[i] == a and i + 1 < n and ids[i + 1] == b:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        pair, n = self.pair, len(ids)
        ids, left, right = ids[:], list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            m = pair.get((ids[i], ids[i + 1]))
            if m:
                heap.append((m[0], i, m[1], ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = new, -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (m := pair.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, m[1], ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of one word, given as bytes, each emitted once no later byte can change it."""
        word = OpenWord(self)
        for byte in data:
            yield from word.feed((byte,))
        yield from word.close()

    def width(self, token: int) -> int:
        return len(self.text_of[token]) - (len(self.suffix) if self.suffix and self.text_of[token].endswith(self.suffix) else 0)

    def word(self, piece: str) -> bytes:
        """Ids of one word as little-endian uint32."""
        data = piece.encode()
        if len(data) <= self.keep:
            symbols = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
            ids = self.merge([s for s in symbols if s is not None])
        else:
            ids = self.stream(data)
        return np.fromiter(ids, "<u4").tobytes()

    def words(self, pieces: list[str]) -> list[bytes]:
        """word() of many pieces at once: those of like length go through the merges side by side."""
        data = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(data)
        size = np.fromiter(map(len, data), np.int64, len(data))
        a = 0
        for wide in (8, 16, 32):
            own = np.flatnonzero((size > a) & (size <= wide)) if self.symbols else []
            if len(own):
                for k, ids in zip(own.tolist(), self._side_by_side([data[k] for k in own.tolist()], size[own], wide)):
                    out[k] = ids
                a = wide
        for k in np.flatnonzero(size > a).tolist():
            out[k] = self.word(pieces[k])
        return out

    def _side_by_side(self, data: list[bytes], size: np.ndarray, wide: int) -> Iterator[bytes]:
        inner, final = self.symbols
        n, cols = len(data), np.arange(wide)
        ids = np.full((n, wide), -1, np.int32)
        ids[cols < size[:, None]] = inner[np.frombuffer(b"".join(data), np.uint8)]
        ids[np.arange(n), size - 1] = final[np.fromiter((d[-1] for d in data), np.uint8, n)]
        rank = self.table.ranks(ids[:, :-1], ids[:, 1:])
        live, cur = np.arange(n), ids
        while len(live):
            at = rank.argmin(1)
            best = rank[np.arange(len(live)), at]
            on = best < NO_MERGE
            if not on.all():
                ids[live[~on]] = cur[~on]
                live, cur, rank, at, best = live[on], cur[on], rank[on], at[on], best[on]
                if not len(live):
                    break
            rows = np.arange(len(live))
            cur[rows, at] = self.table.made[best]
            cur[:, :-1] = np.where(cols[:-1] > at[:, None], cur[:, 1:], cur[:, :-1])
            cur[:, -1] = -1
            rank[:, :-1] = np.where(cols[: wide - 2] > at[:, None], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NO_MERGE
            here = np.minimum(at, wide - 2)
            rank[rows, here] = self.table.ranks(cur[rows, here], cur[rows, here + 1])
            has = np.flatnonzero(at > 0)
            rank[has, at[has] - 1] = self.table.ranks(cur[has, at[has] - 1], cur[has, at[has]])
        kept = ids >= 0
        flat, ends = ids[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(1)) * 4
        return (flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()))

    def normal(self, text: str) -> str:
        if self.nfc:
            text = normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # by character: no final sigma
        return text

    def look_up(self, found: list[list[str | bytes]]) -> list[bytes]:
        """Ids of each list of closed words and of ids already; words not met yet are merged together."""
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        new = [*{p for x in found for p in x if type(p) is str}.difference(cache)]
        cache.update(zip(new, self.words(new)))
        return [b"".join([cache[p] if type(p) is str else p for p in x]) for x in found]

    def parts(self, text: str) -> Iterator[str | bytes]:
        """Closed words of a text, and ids of its long words and special strings as they become stable."""
        a = 0
        for m in self.special_at.finditer(text) if self.special_at else ():
            yield from self.plain(text[a : m.start()])
            yield np.array([self.special[m[0]]], "<u4").tobytes()
            a = m.end()
        yield from self.plain(text[a:] if a else text)

    def plain(self, text: str) -> Iterator[str | bytes]:
        own = Transducer(self)
        for a in range(0, max(len(text), 1), BLOCK):
            yield from own.push(text[a : a + BLOCK], a + BLOCK >= len(text))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """encode() of many texts, which share their look-ups."""
        out: list[bytes] = [b""] * len(texts)
        wait: list[int] = []
        found: list[list[str | bytes]] = []
        size = 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if len(text) > BLOCK:
                out[k] = self.encode(text)
                continue
            wait.append(k)
            found.append([*self.parts(text)])
            size += len(text)
            if size > 16 * BLOCK:
                for j, ids in zip(wait, self.look_up(found)):
                    out[j] = ids
                wait, found, size = [], [], 0
        for j, ids in zip(wait, self.look_up(found)):
            out[j] = ids
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian uint32; a null is an empty text."""
        parts, out = self.parts(text or ""), []
        while own := [*itertools.islice(parts, BLOCK)]:
            out += self.look_up([own])
        return b"".join(out)


def _joins_before() -> frozenset[str]:
    """Characters that can become one with what stands before them in normal form C."""
    out = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}  # Hangul vowels and final consonants
    for c in range(0x110000):
        parts = decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


JOINS_BEFORE = _joins_before()


class OpenWord:
    """A word whose end has not come yet: gives out tokens once the lookahead behind them is full, holds the rest."""

    def __init__(self, tokenizer: Tokenizer):
        self.t = tokenizer
        self.held: list[int] = []
        self.last: int | None = None

    def feed(self, data: Iterable[int]) -> Iterator[int]:
        t = self.t
        for byte in data:
            if self.last is not None and t.inner[self.last] is not None:
                self.held.append(t.inner[self.last])
            self.last = byte
            if len(self.held) >= t.keep:
                tokens, stable, used = t.merge(self.held), 0, 0
                while used + t.width(tokens[stable]) <= len(self.held) - t.lookahead:
                    used += t.width(tokens[stable])
                    stable += 1
                yield from tokens[:stable]
                self.held = self.held[used:]

    def close(self) -> Iterator[int]:
        if self.last is not None and self.t.final[self.last] is not None:
            self.held.append(self.t.final[self.last])
        yield from self.t.merge(self.held)
        self.held, self.last = [], None


class Transducer:
    """Text in, piece by piece; out come closed words (str) and ids of long words (bytes), each as soon as no later text can
    change it. Holds raw text behind the last place where normalizing can be cut, the open word, and the symbols of a long one."""

    def __init__(self, tokenizer: Tokenizer):
        self.t = tokenizer
        self.raw, self.open, self.word = "", "", None

    def held(self) -> int:
        return len(self.raw) + len(self.open) + (len(self.word.held) if self.word else 0)

    def push(self, text: str, end: bool = False) -> list[str | bytes]:
        t = self.t
        if end and not (self.raw or self.open or self.word):
            return t.splitter.findall(t.normal(text))
        raw = self.raw + text
        at = len(raw)
        if not end:
            at -= 1
            while at > 0 and (combining(raw[at]) or raw[at] in JOINS_BEFORE):
                at -= 1
        self.raw = raw[max(at, 0) :]
        text, out = self.open + t.normal(raw[: max(at, 0)]), []
        if self.word:
            first = t.splitter.match(text)
            more = first.end() if first else 0
            out += self._long(text[len(self.open) : more])
            if more == len(text) and not end:
                self.open = text[-TAIL:]
                return out
            out.append(np.fromiter(self.word.close(), "<u4").tobytes())
            self.word, text = None, text[more:]
        if end:
            self.open = ""
            return out + t.splitter.findall(text)
        found = [*t.splitter.finditer(text)]
        if found and found[-1].end() == len(text):
            self.open = found.pop()[0]
        else:
            self.open = text[max(len(text) - TAIL, found[-1].end() if found else 0) :]
        out += [m[0] for m in found]
        if len(self.open) > t.keep:
            self.word = OpenWord(t)
            out += self._long(self.open)
            self.open = self.open[-TAIL:]
        return out

    def _long(self, text: str) -> list[bytes]:
        ids = np.fromiter(self.word.feed(text.encode()), "<u4")
        return [ids.tobytes()] if len(ids) else []


class Vocabulary:
    """What decoding needs of a tokenizers JSON file."""

    def __init__(self, spec: str):
        conf = json.loads(spec)
        self.text_of = {i: t for t, i in conf["model"]["vocab"].items()} | {a["id"]: a["content"] for a in conf.get("added_tokens", [])}
        self.decoder = conf.get("decoder")


class Decoder:
    """Incremental ids to text. Without a decoder in the file tokens are joined by blanks; a byte-level decoder
    turns them into bytes, and a UTF-8 state machine gives out the characters that are complete."""

    def __init__(self, tokenizer: Tokenizer | Vocabulary):
        self.text_of = tokenizer.text_of
        self.bytes_out = bool(tokenizer.decoder) and "ByteLevel" in _kinds(tokenizer.decoder)
        self.byte_of = {c: b for b, c in enumerate(byte_chars())}
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def push(self, ids: list[int], end: bool = False) -> str:
        texts = map(self.text_of.__getitem__, ids)
        if self.bytes_out:
            return self.utf8.decode(b"".join(bytes(self.byte_of[c] for c in t) for t in texts), end)
        out = " ".join(texts)
        if ids and self.begun:
            out = " " + out
        self.begun |= bool(ids)
        return out


def decode(tokenizer: Tokenizer | Vocabulary, ids: bytes, step: int = 1 << 16) -> str:
    every, d = np.frombuffer(ids, "<u4"), Decoder(tokenizer)
    return "".join([d.push(every[a : a + step].tolist()) for a in range(0, len(every), step)] + [d.push([], True)])


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    best: dict[str, int] = {}
    most = 0
    for u, v in merges:
        far = len(u) + max((best.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
        if far > best.get(u, 0):
            best[u] = far
            most = max(most, far)
    return most + max((len(u) + len(v) for u, v in merges), default=0)


def _kinds(conf: dict | None) -> list[str]:
    if not conf:
        return []
    below = conf.get("normalizers") or conf.get("decoders") or []
    return [conf["type"]] + [k for x in below for k in _kinds(x)]


def _pattern(conf: dict) -> str:
    for x in conf.get("pretokenizers", [conf]):
        if x["type"] == "Split":
            return x["pattern"]["Regex"]
    raise ValueError("the file has no split pattern")


_loaded: dict = {}


def _load(kind, spec: str):
    key = kind.__name__, hash(spec)
    if key not in _loaded:
        _loaded[key] = kind(spec)
    return _loaded[key]


def _grouped(values: Iterator[tuple], schema: pa.Schema, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of rows whose sized cells have about limit bytes together."""
    rows, size = [], 0
    for row in values:
        rows.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str))) + 16
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def bpe_encode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids (binary, little-endian uint32), a row for each row of docs; null and empty texts have no ids.

    spec is the content of a tokenizers JSON file, read once by the driver; its size is that of the vocabulary.
    Other columns of docs are not used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    schema = pa.schema([("id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        t = _load(Tokenizer, shared.value)

        def rows():
            for b in batches:
                for a in range(0, len(b), 256):
                    part = b.slice(a, 256)
                    yield from zip(part.column(0).to_pylist(), t.encode_all(part.column(1).to_pylist()))

        yield from _grouped(rows(), schema)
        t.cache.clear()

    bounded(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(lean(run), "id long, ids binary").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, spec: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, ids and text decoded from them, a row for each row; no ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(spec)
    schema = pa.schema([("id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches):
        t = _load(Vocabulary, shared.value)

        def rows():
            for b in batches:
                buf, offs = packed(b.column(1))
                for k, i in enumerate(b.column(0).to_pylist()):
                    ids = buf[offs[k] : offs[k + 1]].tobytes()
                    yield i, ids, decode(t, ids)

        yield from _grouped(rows(), schema)

    return encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(lean(run), "id long, ids binary, text string").withColumnRenamed("id", id_col)


def bpe_round_trip(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bpe_decode(bpe_encode(docs)) in one pass over the rows: id_col, ids, and text decoded from them."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    schema = pa.schema([("id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches):
        t = _load(Tokenizer, shared.value)

        def rows():
            for b in batches:
                for a in range(0, len(b), 256):
                    part = b.slice(a, 256)
                    for i, ids in zip(part.column(0).to_pylist(), t.encode_all(part.column(1).to_pylist())):
                        yield i, ids, decode(t, ids)

        yield from _grouped(rows(), schema)
        t.cache.clear()

    bounded(docs.sparkSession)
    own = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return own.mapInArrow(lean(run), "id long, ids binary, text string").withColumnRenamed("id", id_col)
