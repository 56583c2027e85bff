"""Chat formatting in budgeted windows: turn-aligned spans chosen on prefix sums of turn tokens, the system turn kept in
each window, some history repeated, repeated targets masked.

Template: a turn is `### role: text</turn>` and a line feed. In roles and texts every backslash, `#`, `<` and (in roles) `:`
gets a backslash before it, so that no control string can come from inside a text and reading back is exact.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import bounded, lean

OPEN, END = "### ", "</turn>\n"
_escape = re.compile(r"([\\#<])")
_escape_role = re.compile(r"([\\#<:])")
_unescape = re.compile(r"\\(.)", re.DOTALL)
_turn = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.DOTALL)


def format_turn(role: str, text: str) -> str:
    return f"{OPEN}{_escape_role.sub(r'\\\1', role)}: {_escape.sub(r'\\\1', text)}{END}"


def read_turns(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _turn.match(text, at)
        if not m:
            raise ValueError("not a formatted conversation")
        out.append((_unescape.sub(r"\1", m[1]), _unescape.sub(r"\1", m[2])))
        at = m.end()
    return out


def unescape(text: str) -> str:
    return _unescape.sub(r"\1", text)


def tokens(text: str) -> int:
    """The measure of a turn: its white-space separated pieces, long ones counted by fours of characters."""
    return sum(1 + (len(w) - 1) // 16 for w in text.split())


@dataclass
class Window:
    text: str
    loss: list[tuple[int, int]]
    repeated: int
    first: int


def windows(turns: Iterator[tuple], budget: int, history: int, trains=("assistant",), count=tokens) -> Iterator[Window]:
    """Windows over a conversation's turns, holding no more than one window's turns and its history.

    Each starts with the system turn (the conversation's first turn, if its role is system) and the latest turns of at most
    `history` tokens together, both without loss; then come new turns, at least one, whole. All of it is within `budget`:
    history makes room for the first new turn. Only a turn that is over the budget alone or with the system turn exceeds it,
    in a window of its own without history. A turn is role, text and, if known, the tokens of the formatted turn; else count gives them.
    """
    system: list[tuple[str, int]] = []
    past: list[tuple[str, int]] = []
    new: list[tuple[str, int, tuple[int, int] | None]] = []
    sums, seen = [0], 0

    def emit() -> Window:
        lead = [t for t, _ in system if new[0][0] is not t] + [t for t, _ in past]
        text, at, loss = "".join(lead), sum(map(len, lead)), []
        for t, _, span in new:
            if span:
                loss.append((at + span[0], at + span[1]))
            at += len(t)
        return Window(text + "".join(t for t, _, _ in new), loss, len(lead), seen - len(new))

    for role, text, *known in turns:
        t = format_turn(role, text)
        n = known[0] if known else count(t)
        fixed = sum(c for _, c in system)
        if new and fixed + sum(c for _, c in past) + sums[-1] + n > budget:
            yield emit()
            turns_past = [*past, *((x, c) for x, c, _ in new if not (system and x is system[0][0]))]
            back = [0]
            for _, c in reversed(turns_past):
                back.append(back[-1] + c)
            keep = bisect_right(back, max(0, min(history, budget - fixed - n))) - 1
            past = turns_past[len(turns_past) - keep :]
            new, sums = [], [0]
        start = len(OPEN) + len(_escape_role.sub(r"\\\1", role)) + 2
        new.append((t, n, (start, len(t) - len(END)) if role in trains else None))
        sums.append(sums[-1] + n)
        seen += 1
        if seen == 1 and role == "system":
            system = [(t, n)]
            sums[-1] = 0  # counted as the lead of its window
    if new:
        yield emit()


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _runs(rows: Iterator[tuple]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Consecutive rows of one key, one after another; like itertools.groupby, but nulls are a key too."""
    import itertools

    yield from itertools.groupby(rows, key=lambda r: r[0])


def bpe_count(spec: str):
    """Counts tokens with the package's BPE; spec is the content of a tokenizers JSON file."""
    from gaugeworks.llm.bpe import Tokenizer, _load

    own = _load(Tokenizer, spec)
    return lambda text: len(own.encode(text)) // 4


def _counted(batches: Iterator[pa.RecordBatch], spec: str | None) -> Iterator[tuple]:
    """conv, role, text, tokens: the turns of a batch are counted together, so that their words go through the merges side by side."""
    from gaugeworks.llm.bpe import Tokenizer, _load

    own = None if spec is None else _load(Tokenizer, spec)
    for b in batches:
        rows = list(zip(*[c.to_pylist() for c in b.columns]))
        turns = [format_turn(role, text) for _, role, text in rows]
        counts = map(tokens, turns) if own is None else [len(ids) // 4 for ids in own.encode_all(turns)]
        yield from ((*row, n) for row, n in zip(rows, counts))


def format_windows(conversations: DataFrame, budget: int = 512, history: int = 128, spec: str | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_col, window (from 0), text, loss (spans [start, stop) in code points of text), repeated (leading turns shown before), first_turn.

    Turns come by turn_col, nulls first, ties by role and text. A null role or text is empty. Tokens are those of the BPE file whose
    content is spec; without one, white-space pieces of at most 16 characters. A turn over the budget is a window of its own, whole. Conversations are dealt by key and streamed: a task holds a window at a time, however long one is.
    Other columns are not read.
    """
    bounded(conversations.sparkSession)
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    schema = pa.schema([("conv", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("loss", pa.list_(span)), ("repeated", pa.int32()), ("first_turn", pa.int64())])

    shared = conversations.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        out, size = [], 0
        for conv, own in _runs(_counted(batches, shared.value)):
            for k, w in enumerate(windows((r[1:] for r in own), budget, history)):
                out.append((conv, k, w.text, [{"start": a, "stop": z} for a, z in w.loss], w.repeated, w.first))
                size += len(w.text)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    dealt = rows.repartition(F.col("conv")).sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    return dealt.mapInArrow(lean(run), "conv long, window long, text string, loss array<struct<start:long,stop:long>>, repeated int, first_turn long").withColumnRenamed("conv", conv_col)


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from windows in order: turns shown before are skipped."""
    import hashlib

    schema = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        out = []
        for conv, own in _runs(_by_key(batches)):
            turns, loss, n, chars, formatted = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, text, spans, repeated in own:
                for role, said in read_turns(text)[repeated:]:
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for s in spans:
                    said = unescape(text[s["start"] : s["stop"]])
                    loss.update(said.encode())
                    chars += len(said)
                formatted += len(text)
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))
        if out:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], schema)

    rows = formatted.select(F.col(conv_col).alias("conv"), "window", "text", "loss", "repeated").repartition(F.col("conv")).sortWithinPartitions("conv", "window").select("conv", "text", "loss", "repeated")
    return rows.mapInArrow(lean(run), "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conv_col)
