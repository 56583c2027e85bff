import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from gaugeworks.llm.bpe import TAIL, Tokenizer, Transducer, bpe_decode, bpe_encode, bpe_round_trip, decode, sufficient_lookahead

PATH = public_tokenizers.path("word_bpe_49k.json")
SPEC = open(PATH).read()


@pytest.fixture(scope="module")
def both():
    return Tokenizer(SPEC), Library.from_file(PATH)


def texts():
    rnd = random.Random(3)
    alphabet = list("abcdefghijklmnopqrstuvwxyz'''sdtrevml  \n\t0123456789,.!?#<|>éèßÀÇΣσςİıŉ漢字かな한국🙂👍\x00\x1c\x1f\x85½²Ⅷ") + ["́", "̈", " ", " ", "​"]
    out = ["", None, " ", "'s", "a" * 5000, "the" * 3000, "!" * 2500, "ab" * 2000 + "x", "<|endoftext|>", "x<|startoftext|>y <|endoftext|>Z", "é" * 3000]
    return out + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(400)]


def test_ids_and_text_match_the_library(both):
    own, lib = both
    for text, ids in zip(texts(), own.encode_all(texts())):
        want = lib.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.encode(text) == ids
        assert decode(own, ids, 7) == lib.decode(want, skip_special_tokens=False)


def test_stream_holds_a_bounded_stretch(both):
    own, lib = both
    assert list(own.stream(b"abcdefgh" * 900)) == np.frombuffer(own.word("abcdefgh" * 900), "<u4").tolist()
    assert own.lookahead < 2000
    rnd = random.Random(4)
    for text in ("streaming" * 30_000, "".join(rnd.choice("étaoinshrdlu") for _ in range(120_000)), "!?" * 60_000, "7" * 20_000, " \n" * 50_000, "漢字" * 30_000, "e\u0301" * 40_000, "'" * 9000 + "s re"):
        t, parts, most = Transducer(own), [], 0
        for a in range(0, len(text), 1000):
            parts += t.push(text[a : a + 1000], a + 1000 >= len(text))
            most = max(most, t.held())
        assert b"".join(own.look_up([parts])) == np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert most <= own.keep + 2 * TAIL + 1000


def test_any_cut_gives_the_same_ids(both):
    own, lib = both
    rnd = random.Random(9)
    for text in texts()[:200]:
        text, t, parts, a = own.special_at.sub(" ", text or ""), Transducer(own), [], 0
        while a < len(text):
            z = a + rnd.choice([1, 1, 2, 3, 7, 400])
            parts += t.push(text[a:z])
            a = z
        parts += t.push("", True)
        assert b"".join(own.look_up([parts])) == np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_lookahead_by_force():
    merges = [("b", "c"), ("a", "b"), ("ab", "a"), ("c", "a"), ("bc", "bc")]
    assert sufficient_lookahead(merges) >= 3
    assert sufficient_lookahead([]) == 0


def test_operator(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(1, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe_decode(bpe_encode(docs, SPEC), SPEC).collect()
    lib = Library.from_file(PATH)
    want = sorted((i, lib.decode(lib.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t, _ in rows)
    assert sorted((r.doc_id, r.text) for r in out) == want
    assert sorted(map(tuple, bpe_round_trip(docs, SPEC).collect())) == sorted(map(tuple, out))
    assert bpe_encode(docs.limit(0), SPEC).count() == 0
