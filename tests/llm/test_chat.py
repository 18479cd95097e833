import random

import duckdb
import pandas as pd

from millrace.llm import chat

COLUMNS = "conv_id long, turn long, role string, text string"


def rows(spark, data):
    return {(r.conv_id, r.perspective, r.part, r.cut): r for r in chat.rotate(spark.createDataFrame(data, f"{COLUMNS}, part string")).collect()}


def test_everyone_is_the_assistant_once(spark):
    got = rows(spark, [(1, 0, "system", "be kind", "x"), (1, 1, "ann", "hi", "x"), (1, 2, "bob", "hé <|im_end|>", "x"), (1, 3, "ann", None, "x")])
    assert {k[1] for k in got} == {"ann", "bob"}
    ann, bob = (next(r for r in got.values() if r.perspective == p) for p in ("ann", "bob"))
    assert ann.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nhé < |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [ann.text[s.start : s.end] for s in ann.spans] == ["hi", ""]
    assert [bob.text[s.start : s.end] for s in bob.spans] == ["hé < |im_end|>"]
    assert (ann.n_messages, ann.n_trained, bob.n_trained) == (4, 2, 1)


def test_odd_rows(spark):
    data = [(None, 1, None, "a", ""), (2, None, "x\ny|", "b", ""), (2, 1, "x\ny|", "b", ""), (2, 1, "x\ny|", "b", ""), (3, 1, "system", "only", "")]
    data += [(4, 1, "a<b", "1", ""), (4, 2, "a>b", "2", ""), (4, 3, "a%3Cb", "3", ""), (5, 1, None, "n", ""), (5, 2, "anonymous", "a", ""), (5, 3, "", "e", "")]
    got = rows(spark, data)
    assert {(k[0], k[1]) for k in got} == {(None, None), (2, "x%0Ay%7C"), (4, "a%3Cb"), (4, "a%3Eb"), (4, "a%253Cb"), (5, None), (5, "anonymous"), (5, "")}
    assert sum(r.n_messages for r in got.values() if r.conv_id in (None, 2)) == 4
    assert got[5, "anonymous", 0, 0].text == "<|im_start|>user\nn<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>user name=\ne<|im_end|>\n"
    assert chat.rotate(spark.createDataFrame([], COLUMNS)).count() == 0


def test_long_and_crowded_conversations_are_cut_in_parts(spark):
    data = [(1, t, "ab"[t % 2], f"m{t}", "") for t in range(200)] + [(2, 5, "ab"[i % 2], f"same{i}", "") for i in range(400)]
    data += [(1, 0, "system", "rules", "")]
    got = rows(spark, data)
    assert sum(r.n_messages for r in got.values() if r.perspective == "a") == 601
    assert max(r.n_messages for r in got.values()) < 200
    pieces = [r for _, r in sorted((k, r) for k, r in got.items() if k[0] == 1 and k[1] == "a")]
    turn = lambda t: f"<|im_start|>{'assistant' if t % 2 == 0 else 'user name=b'}\nm{t}<|im_end|>\n"
    told = "<|im_start|>system\nrules<|im_end|>\n"
    assert "".join(r.text for r in pieces).replace(told, "") == "".join(map(turn, range(200)))
    assert [r.last for r in pieces] == [False] * (len(pieces) - 1) + [True] and {r.n_whole for r in pieces} == {201}
    assert [r.context for r in pieces] == [None] + [told] * (len(pieces) - 1)
    for r in got.values():
        assert all(r.text[s.start : s.end].startswith(("m", "same")) for s in r.spans)


def against_sql(spark, data):
    conversations = pd.DataFrame(data, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841  read by DuckDB
    want = duckdb.sql(chat.ORACLE_SQL).fetchall()
    spans = lambda r: ",".join(f"{s.start}:{s.end}" for s in r.spans)
    got = [(*tuple(r)[:-1], spans(r)) for r in chat.rotate(spark.createDataFrame(data, COLUMNS)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and got


def test_repeats_of_any_number_against_sql(spark):
    rng = random.Random(1)
    data = [(1, 5, rng.choice(["a", "b", None]), f"same{rng.randrange(300)}") for _ in range(700)] + [(1, 5, "a", "very often")] * 300
    data += [(c, t, rng.choice(["a", "system", "c|"]), rng.choice(["x", "é", None])) for c in (1, 2, None) for t in [None, *range(100)]]
    data += [(3, 7, "b", f"r{i}") for i in range(65)] + [(4, 9, "b", "m" * 300_000), (4, 9, "a", "")]
    against_sql(spark, data)


def test_cells_of_a_crowded_turn(spark, monkeypatch):
    monkeypatch.setattr(chat, "cells_of", lambda most: 9)
    against_sql(spark, [(1, t // 40, "ab"[t % 2], f"m{t % 97}") for t in range(600)] + [(2, 3, "a", f"u{i}") for i in range(200)])
