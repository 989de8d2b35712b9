from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from circula.llm import chat

TEXT = st.lists(st.sampled_from([*"ab<>[]/\\s \n", "[INST]", "[/INST]", "</s>", "é", "[/ROLE]", "[TEXT]"]),
                max_size=20).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[ROLE]"]), TEXT), max_size=6))
def test_round_trip(turns):
    out = "".join(chat.formatted_turn(r, t) for r, t in turns)
    assert [(r, t) for r, t, _ in chat.parse(out)] == turns
    masked = [chat.unescaped(out[a:b]) for a, b in chat.loss_mask(out)]
    assert masked == [t for r, t in turns if r == "assistant"]


def test_broken_output_is_refused():
    for bad in ("x", "[INST]a", "[ROLE]a[/ROLE]", "<s>a</s>b"):
        with pytest.raises(ValueError):
            list(chat.parse(bad))


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3},
     [("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "completion": "a", "score": 1.5}, [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "response": "a"}, [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"system": "s", "instruction": "do", "input": "", "output": "done"},
     [("system", "s"), ("user", "do"), ("assistant", "done")]),
    ({"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
    ({"unknown": 1}, None), ({"messages": []}, None), ([], None),
]


MIXED = [
    ({"prompt": "p", "messages": [{"role": "user", "content": "q"}]}, [("user", "q")]),
    ({"system": "s", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
     [("system", "s"), ("user", "q"), ("assistant", "")]),
    ({"system": "s", "instruction": "do", "output": "done"}, [("system", "s"), ("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": None, "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"data": {"prompt": "q", "response": "a"}, "id": 1}, [("user", "q"), ("assistant", "a")]),
    ({"row": {"chat": {"messages": [{"role": "user", "content": "q"}]}}}, [("user", "q")]),
    ({"prompt": "q", "response": "a", "old": {"messages": [{"role": "user", "content": "z"}]}}, [("user", "q"), ("assistant", "a")]),
    ([{"role": "user", "content": "q"}, "odd", {"role": "bot", "content": "a"}], [("user", "q"), ("assistant", "a")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}]}, [("user", "x\n\ny")]),
    ({"prompt": 3, "completion": {"k": 1}}, [("user", "3"), ("assistant", '{"k": 1}')]),
    ({"prompt": None, "completion": "a"}, [("user", ""), ("assistant", "a")]),
    ({"prompt": "q"}, None), ({"input": "q", "system": "s"}, None), ("text", None), (None, None),
]


@pytest.mark.parametrize("record,turns", MIXED)
def test_mixed_layouts(record, turns):
    assert chat.turns_of(record) == turns


def test_other_columns_do_no_harm(spark):
    rows = [(1, 0, "user", "q", "p", "s"), (1, 1, "assistant", None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string, at string")
    for c in ("system", "output", "question", "messages", "record", "fingerprint", "_c_record"):
        df = df.withColumn(c, df["prompt"])
    got = sorted((r["turn"], r["role"], r["text"]) for r in chat.turn_rows(df, "conv_id", "turn").collect())
    assert got == [(0, "user", "q"), (1, "assistant", "")]
    assert {r["fingerprint"] for r in chat.canonical(chat.turn_records(df, "conv_id", "turn"), ["conv_id"]).collect()} == {
        chat.fingerprint(["role", "text"])}


@pytest.mark.parametrize("record,turns", LAYOUTS)
def test_layouts(record, turns):
    assert chat.turns_of(record) == turns


def test_fingerprints_are_distinct():
    assert len(chat.BY_FINGERPRINT) == len(chat.MAPPINGS)
    assert chat.fingerprint(["messages[].role", "messages[].content", "zz"]) == chat.fingerprint(
        ["messages[].content", "messages[].role"])


def test_canonical_frame(spark):
    rows = [(i, json.dumps(r), "x") for i, (r, _) in enumerate(LAYOUTS)] + [(90, None, "x"), (91, "{broken", "x"), (92, "", "x")]
    df = spark.createDataFrame(rows, "id long, record string, turn string")
    got = {}
    for r in sorted(chat.canonical(df, ["id"]).collect(), key=lambda r: (r["id"], r["turn"] or 0)):
        got.setdefault(r["id"], []).append((r["role"], r["text"]))
    for i, (_, turns) in enumerate(LAYOUTS):
        assert got[i] == (turns or [(None, None)])
    assert got[90] == got[91] == got[92] == [(None, None)]


def test_read_back(spark):
    rows = [(1, 1, "assistant", "a<b"), (1, 0, "user", None), (1, 2, "assistant", "é"), (2, 0, None, "x"),
            (None, 0, "user", "n"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "user", "l" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.turn_rows(df, "conv_id", "turn")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert got.keys() == {1, 2, 3, 4, None}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == sha("user\n\nassistant\na<b\nassistant\né\n")
    assert got[1]["loss_sha256"] == sha("a<bé") and got[1]["loss_chars"] == 4
    assert got[3]["n_turns"] == 2 and got[2]["loss_sha256"] == sha("")
    whole = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(turns).collect()}
    assert all(len(whole[k]) == got[k]["formatted_chars"] for k in got)
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.turn_rows(df.drop("text"), "conv_id", "turn")
