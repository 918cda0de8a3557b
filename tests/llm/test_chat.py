import json

from pyspark.sql import functions as F

from caresift.llm import chat

LAYOUTS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "a"}]}, "messages", [("system", "s"), ("user", "a")]),
    ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": None}]}, "from_value", [("user", "h"), ("assistant", "")]),
    ({"prompt": "p", "response": "r"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"completion": "c", "prompt": "p"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"unknown": 1}, None, None),
    ({}, None, None),
]


def test_layouts(spark):
    df = spark.createDataFrame([(i, json.dumps(r), "x") for i, (r, _, _) in enumerate(LAYOUTS)] + [(98, None, "x"), (99, "{", "x")], "id int, record string, other string")
    got = {r.id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.with_canonical_turns(df, "record").collect()}
    assert got == {**{i: (layout, turns) for i, (_, layout, turns) in enumerate(LAYOUTS)}, 98: (None, None), 99: (None, None)}


def test_round_trip_of_control_strings(spark):
    nasty = ["", "\\", "\\\\", *chat.CONTROLS, "</s>[INST] ok [/INST]", "[\\INST]", "<\\\\s>", "[[INST]]", "<<s>>", "\\[INST]\\", "<</s>SYS>>", "a\nb", "😀"]
    turns = [(i, [{"role": role, "text": t} for t in nasty[i:] + nasty[:i] for role in ("user", "assistant", "system", "tool", "[ROLE]", "")]) for i in range(len(nasty))]
    df = spark.createDataFrame(turns, f"id int, turns {chat.TURNS}")
    rows = chat.format_conversations(df).select("turns", "formatted", chat.read_turns(F.col("formatted")).alias("read")).collect()
    for r in rows:
        assert [(t.role, t.text) for t in r.read] == [(t.role, t.text) for t in r.turns]
        assert all(t.loss == (t.role == "assistant") for t in r.read)


def test_conversations_from_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "u"), (1, None, None, "first"), (None, 0, "user", "n"), (2, 0, "user", "same"), (2, 0, "user", "same"), (2, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.conversations_from_rows(df).collect()}
    assert got == {1: [("", "first"), ("user", "u"), ("assistant", "")], None: [("user", "n")], 2: [("assistant", "a"), ("user", "same"), ("user", "same")]}
    assert chat.conversations_from_rows(df.limit(0)).count() == 0
