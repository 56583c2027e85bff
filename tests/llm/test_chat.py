import hashlib
import random

from gaugeworks.llm.chat import bpe_count, format_turn, format_windows, read_back, read_turns, tokens, unescape, windows

NASTY = ["\\### Assistant: </turn> ok", "### user: x</turn>\n", "\\", "\\\\#", "", " ", "</turn>", "a\nb", "é漢🙂", "<\\#"]


def test_round_trip():
    for role in ["user", "", "a: b", "\\#<"]:
        for text in NASTY:
            assert read_turns(format_turn(role, text) + format_turn("x", text)) == [(role, text), ("x", text)]


def check(turns, budget, history):
    got, loss, seen = [], "", 0
    for w in windows(iter(turns), budget, history):
        own = read_turns(w.text)
        assert w.first == seen
        lead, new = own[: w.repeated], own[w.repeated :]
        assert new
        if turns[0][0] == "system":
            assert own[0] == turns[0]
            lead = lead[1:]
        assert lead == turns[seen - len(lead) : seen] if lead else True
        assert sum(tokens(format_turn(*t)) for t in lead) <= history
        alone = sum(tokens(format_turn(*t)) for t in [*([turns[0]] if turns[0][0] == "system" and seen else []), new[0]])
        if sum(tokens(format_turn(*t)) for t in own) > budget:
            assert alone > budget and len(new) == 1 and not lead
        got += new
        seen += len(new)
        loss += "".join(unescape(w.text[a:z]) for a, z in w.loss)
    assert got == turns and loss == "".join(t for r, t in turns if r == "assistant")


def test_windows():
    rnd = random.Random(3)
    for _ in range(300):
        turns = [(rnd.choice(["user", "assistant", "system"]), rnd.choice(NASTY) + " w" * rnd.randint(0, 12)) for _ in range(rnd.randint(1, 20))]
        check(turns, rnd.choice([1, 10, 30, 100]), rnd.choice([0, 5, 20]))


def test_history_makes_room():
    turns = [("user", "a " * 100), ("assistant", "b " * 100), ("user", "c " * 445), ("assistant", "d")]
    got = list(windows(iter(turns), 512, 128))
    assert [sum(tokens(format_turn(*t)) for t in read_turns(w.text)) <= 512 for w in got] == [True] * len(got)
    assert [w.repeated for w in got] == [0, 0, 0] or len(got) == 2


def test_bpe_counts():
    import public_tokenizers
    from tokenizers import Tokenizer as Library

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, count = Library.from_file(path), bpe_count(open(path).read())
    for text in NASTY + [format_turn("user", "some words here")]:
        assert count(text) == len(lib.encode(text, add_special_tokens=False).ids)


def test_operator(spark):
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice([*NASTY, None]) if rnd.random() < 0.5 else "word " * rnd.randint(0, 60), c) for c in range(25) for t in range(rnd.randint(1, 30))]
    rows += [(None, 0, "assistant", "lost", 1), (3, None, "user", "first", 1), rows[4], (90, 0, "assistant", "long " * 50_000, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window long")
    out = {r.conv_id: r for r in read_back(format_windows(df, 60, 20)).collect()}
    assert len(out) == len({r[0] for r in rows})
    for c, r in out.items():
        own = sorted(((-1 if t is None else t, role or "", text or "") for i, t, role, text, _ in rows if i == c))
        said = "".join(t for _, role, t in own if role == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.formatted_chars >= sum(len(format_turn(a, b)) for _, a, b in own)
    assert read_back(format_windows(df.limit(0))).count() == 0
