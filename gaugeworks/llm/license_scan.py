"""License scan: ordered signature regexes behind a keyword prefilter; priorities and interval containment settle overlapping detections."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm import license_rules
from gaugeworks.llm.common import IS_ALNUM, LOWER, bounded, hash_bytes, lean, packed, slices, word_hashes, words

#: Phrases that always count, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_CLASS, BASE_CERTAINTY = "base", 0.5
_KINDS = [*license_rules.CLASSES, BASE_CLASS]
_CERTAINTY = {**license_rules.CLASSES, BASE_CLASS: BASE_CERTAINTY}
FIELDS = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "array<string>", "labels": "array<string>", "score": "double", "detections": "array<struct<label: string, kind: string, first: long, last: long>>"}
_BLANK = bytes(b if IS_ALNUM[b] else 0x20 for b in range(256))


@dataclass
class Rule:
    kind: str
    label: str
    keys: tuple[str, ...]
    regex: re.Pattern
    base: bool


def compiled(rules: list[tuple[str, str, tuple[str, ...], str]], base: dict[str, str]) -> list[Rule]:
    """All rules in order, base phrases last. A phrase is found at all places, also where one overlaps another of its own."""
    out = [Rule(kind, label, keys, re.compile(f"(?<![^ ])(?:{regex})(?![^ ])".encode()), False) for kind, label, keys, regex in rules]
    for phrase, label in base.items():
        place = re.compile(b"(?<![^ ])(?=(" + re.escape(phrase.encode()) + b")(?![^ ]))")
        out.append(Rule(BASE_CLASS, label, tuple(phrase.split(" ")), place, True))
    return out


def detections(text: bytes, rules: list[Rule], which: list[int]) -> list[tuple[int, int, int]]:
    """(first word, word behind the last, rule) of all matches of the rules numbered in `which` in a text of words joined by single blanks."""
    blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
    out = []
    for k in which:
        at = [m.span(1 if rules[k].base else 0) for m in rules[k].regex.finditer(text)]
        if at:
            a, z = np.array(at).T
            out += zip(np.searchsorted(blanks, a).tolist(), (np.searchsorted(blanks, z) + 1).tolist(), [k] * len(at))
    return out


def settled(found: list[tuple[int, int, int]], rules: list[Rule]) -> list[tuple[int, int, int]]:
    """What stays, in order of place. Classes go by priority: a detection that overlaps a kept one of a higher class goes; of the
    others, one that lies within another of its class goes; of equal intervals the earliest rule stays. Base phrases come last,
    so one inside a larger detection is no detection of its own."""
    kept: list[tuple[int, int, int]] = []
    for kind in _KINDS:
        own = sorted((d for d in found if rules[d[2]].kind == kind), key=lambda d: (d[0], -d[1], d[2]))
        if not own:
            continue
        before = np.array(sorted(kept), np.int64).reshape(-1, 3)
        reach = np.maximum.accumulate(before[:, 1]) if len(before) else before[:, 1]
        furthest = -1
        for a, z, k in own:
            at = int(np.searchsorted(before[:, 0], z))  # kept ones that begin before this one's end
            if at and reach[at - 1] > a:
                continue
            if z > furthest:
                kept.append((a, z, k))
                furthest = z
    return sorted(kept)


def scan(docs: DataFrame, rules: list[tuple[str, str, tuple[str, ...], str]] | None = None, base: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Words are runs of 0-9, A-Z (lower-cased) and bytes beyond ASCII. n_base counts all places of base phrases, first_word
    and last_word are the smallest and largest of them, in words from 0 (null: none). detections is what stays of all
    rules, in order of place: label, kind (class of rule), first (word), last (word). labels are those of the base phrases
    and of the detections, distinct and sorted; score is the certainty of the surest detection, 0 without any.

    A rule's regex runs only on texts that hold all of its keywords, found by hash among a text's words. Rows stay where
    they are and are read once; a text is held whole. Nulls are empty texts. Ids of any type, nulls and repeated rows
    are kept; other columns are not read. Empty input gives no rows.
    """
    listed, phrases = license_rules.parsed() if rules is None else rules, BASE if base is None else base
    bounded(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = ", ".join(f"{c} {t}" for c, t in FIELDS.items())

    def run(batches):
        own = compiled(listed, phrases)
        names = sorted({k for r in own for k in r.keys})
        hashes = np.array([hash_bytes(k.encode()) for k in names], np.uint64)
        order = np.argsort(hashes)
        hashes, number = hashes[order], {names[k]: n for n, k in enumerate(order)}
        needs = [frozenset(number[k] for k in r.keys) for r in own]
        by_key: dict[int, list[int]] = {}
        for k, need in enumerate(needs):
            # a rule is looked up by its longest keyword, the rarest as a rule
            by_key.setdefault(number[max(own[k].keys, key=lambda w: (len(w), w))], []).append(k)

        def one(text: bytes, keys: set[int]):
            which = sorted(k for key in keys for k in by_key.get(key, ()) if needs[k] <= keys)
            clean = b" ".join(text.translate(_BLANK).split()) if which else b""
            found = detections(clean, own, which)
            places = sorted(d[0] for d in found if own[d[2]].base)
            sure = settled(found, own)
            named = sorted({own[d[2]].label for d in found if own[d[2]].base})
            return (
                len(places), places[0] if places else None, places[-1] if places else None, named, sorted({*named, *(own[d[2]].label for d in sure)}),
                max((_CERTAINTY[own[d[2]].kind] for d in sure), default=0.0), [{"label": own[k].label, "kind": own[k].kind, "first": a, "last": z - 1} for a, z, k in sure],
            )

        nothing = (0, None, None, [], [], 0.0, [])
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))]
        for b in batches:
            buf, offs = packed(b.column(1))
            for a, z in slices(offs):
                low, o = LOWER[buf[offs[a] : offs[z]]], offs[a : z + 1] - offs[a]
                starts, ends, first = words(low, o, IS_ALNUM)
                h = word_hashes(low, starts, ends)
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = np.flatnonzero(hashes[at] == h) if len(hashes) else np.zeros(0, np.int64)
                doc = np.searchsorted(first, hit, "right") - 1
                pairs = np.unique(doc * len(names) + at[hit])
                rows = [nothing] * (z - a)
                keys: dict[int, set[int]] = {}
                for d, k in zip((pairs // len(names)).tolist(), (pairs % len(names)).tolist()):
                    keys.setdefault(d, set()).add(k)
                for d, ks in keys.items():
                    rows[d] = one(low[o[d] : o[d + 1]].tobytes(), ks)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(np.diff(first), pa.int64()), *columns], ["id", *FIELDS])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), f"id {kind}, {fields}")
    return out.withColumnRenamed("id", id_col)
