"""License scan against a plain version, rule gates by generated matches, settled overlaps, edges."""

import os
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gaugeworks.llm import entries, license_rules, license_scan

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"


def plain_words(text):
    return [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b < 91 else b for b in (text or "").encode()))]


def plain_places(words):
    return sorted((i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())


def plain(text):
    """The definition: every rule on every text; a detection goes if one that stays is of a higher class and overlaps, or of its class and holds it."""
    words = plain_words(text)
    joined, order = " ".join(words), [*license_rules.CLASSES, "base"]
    rules = license_rules.parsed()
    found = [(order.index(kind), len(joined[: m.start()].split()), len(joined[: m.end()].split()), k, label) for k, (kind, label, _, regex) in enumerate(rules) for m in re.finditer(rf"(?<![^ ])(?:{regex})(?![^ ])", joined)]
    places = plain_places(words)
    ends = {label: len(phrase.split()) for phrase, label in license_scan.BASE.items()}
    found += [(len(order) - 1, i, i + ends[label], len(rules), label) for i, label in places]
    kept = []
    for c in range(len(order)):
        level = [d for d in found if d[0] == c and not any(k[0] < c and k[1] < d[2] and d[1] < k[2] for k in kept)]
        kept += [d for d in level if not any(e is not d and e[1] <= d[1] and d[2] <= e[2] and ((e[1], e[2]) != (d[1], d[2]) or e[3] < d[3]) for e in level)]
    sure = {**license_rules.CLASSES, "base": 0.5}
    base = sorted({label for _, label in places})
    return (
        len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, base, sorted({*base, *(d[4] for d in kept)}),
        max((sure[order[d[0]]] for d in kept), default=0.0), sorted((d[1], d[2] - 1, d[4]) for d in kept),
    )


def got(rows):
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, sorted((d.first, d.last, d.label) for d in r.detections)) for r in rows}


def test_rules():
    rules = license_rules.parsed()
    assert len(rules) >= 300 and {r[0] for r in rules} == set(license_rules.CLASSES) and all("," not in r[1] and r[2] for r in rules)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_every_match_holds_the_keywords(data):
    for _, _, keys, regex in license_rules.parsed():
        match = data.draw(st.from_regex(re.compile(regex.replace("[^ ]", "[a-z]"), re.A), fullmatch=True))
        assert set(keys) <= set(match.split(" ")), (keys, match)


TEXTS = [
    None, "", " .,; ", "no licence here", "All rights reserved. all RIGHTS-reserved", "CC BY cc by 4.0", MIT, f"{MIT}. Licensed under the Apache License, Version 2.0.",
    "Released under the MIT License.", "SPDX-License-Identifier: GPL-2.0-or-later", "licensed under the GNU General Public License version 3 or any later version", "(c) 2020 mit der lizenz", "gnu general public license version 2 june 1991",
    "distributed under the terms of the GNU Lesser General Public License version 2.1 and the BSD license", "http://creativecommons.org/licenses/by-sa/4.0/ Copyright (c) 2020 général", "all rights reserved " * 400 + "mit license",
    "x" * 200_000 + " cc by " + "wörter " * 30_000 + "all rights reserved",
]


def test_against_plain(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    out = license_scan.scan(spark.createDataFrame([*rows, (None, "cc by"), (3, "cc by")], SCHEMA)).collect()
    assert got(r for r in out if r.doc_id is not None and not (r.doc_id == 3 and r.n_words == 2)) == {i: plain(t) for i, t in rows}
    assert len(out) == len(TEXTS) + 2 and [r.labels for r in out if r.doc_id is None] == [["cc-by"]]


def test_settled(spark):
    out = got(license_scan.scan(spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0. See the GNU General Public License.")], SCHEMA)).collect())[1]
    assert out[5] == ["apache-2.0", "gpl"] and out[4] == ["gpl"] and (10, 13, "gpl") in out[7] and not any(d[2] == "apache" for d in out[7])


def test_edges(spark):
    named = spark.createDataFrame([("a", "cc by", 1, "x")], "doc_id string, text string, score int, labels string")
    assert [(r.doc_id, r.base_labels) for r in license_scan.scan(named).collect()] == [("a", ["cc-by"])]
    assert license_scan.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    own = license_scan.scan(spark.createDataFrame([(1, "a b a b a")], SCHEMA), rules=[], base={"a b a": "aba"}).first()
    assert (own.n_base, own.first_word, own.last_word) == (2, 0, 2)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_op11(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: plain(t) for i, t in docs.items()}
    out = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, r.n_detections) for r in entries.op11_licenses(spark, SF).collect()}
    assert out == {i: (*w[:4], ",".join(w[4]), ",".join(w[5]), w[6], len(w[7])) for i, w in want.items()} and any(w[1] for w in want.values())
