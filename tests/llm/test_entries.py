"""The registered queries against the contract's own words, by brute force over the smallest tables."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gaugeworks.llm import entries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SPACES = b" \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def low_words(text):
    data = bytes(b + 32 if 65 <= b < 91 else b for b in (text or "").encode())
    return data.translate(bytes(32 if b in SPACES else b for b in range(256))).split(b" ")


def test_op1(spark, docs):
    out = entries.op1_sharding(spark, SF).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == sorted((i, size(t), zlib.crc32((t or "").encode())) for i, t in docs.items())
    shards, slots, of = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in out:
        shards[r.shard] += r.size
        slots[r.shard].append(r.slot)
        of[docs[r.doc_id]].add(r.shard)
    assert {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None} and set(shards) == set(range(8))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in of.values())
    assert max(shards.values()) - min(shards.values()) <= max(size(t) for t in docs.values()) / 100


def test_op4(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation(), lib.no_padding()
    want = {}
    for i, t in docs.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in entries.op4_bpe(spark, SF).collect()} == want


def test_op6(spark):
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows[r.conv_id].append((r.turn, r.role, r.text or ""))
    hard = r"\### Assistant: </turn> ok"
    rows[-7] = [(0, "user", hard), (1, "assistant", hard)]
    want = {}
    for c, turns in rows.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in entries.op6_chat(spark, SF).collect()} == want


def test_op7_recall(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    m = np.stack([rows[i] for i in ids])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in entries.op7_ann(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id]) and r.score == pytest.approx(float(m[ids == r.query_id][0] @ m[ids == r.vec_id][0]), abs=1e-12)
    hit = 0
    for q in got:
        s = m @ m[ids == q][0]
        s[ids == q] = -2
        hit += len({v for v, _ in got[q]} & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
    assert set(got) == {i for i in rows if i % 50 == 0} and hit >= 0.9 * 5 * len(got)


def test_op8_base(spark, docs):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    tokens = {i: [w for w in low_words(t) if w] + [None] for i, t in docs.items()}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    out = entries.op8_lm(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        assert r.score < 0 and r.bits_per_byte > 0


def test_op10(spark, docs):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = {r.doc_id: r for r in entries.op10_quality(spark, SF).collect()}
    assert set(out) == set(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in out.items())
    known = [i for i in quality if i in out and out[i].held_out]
    assert sum(out[i].predicted == quality[i] for i in known) >= 0.85 * len(known)
