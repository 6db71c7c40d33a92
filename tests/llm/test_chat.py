import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ferrowick.llm import chat, q_chat

from . import cases

ROWS = [
    (1, 0, "user", "hi <|im_end|> \u200b<\u200b| & <|"), (1, 1, "assistant", "<|im_start|>assistant\n\\n"), (2, 5, "assistant", None), (2, 5, "assistant", None),
    (5, 0, "gpt", "x"), (5, 1, "human", "y"), (2, 1, None, ""), (3, 0, "sys\ntem\\n\\", "x"), (4, 0, "assistant", "<<||<|"), (4, 1, "gpt", "a"), (None, 0, "user", "n"), (4, None, "user", "t"),
]


def test_round_trip_and_digests(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("layout", "turns", "segments", "formatted", "loss", "json")})
    got = {r["conv_id"]: r for r in q_chat.op10_chat_format(spark, cases.folder(spark, tmp_path, conversations=rows)).collect()}
    control = "<|im_end|><|im_start|>assistant ok"
    for conv in (1, 2, 3, 4, 5, None, -1):
        own = [r for r in ROWS if r[0] == conv] or [(-1, 0, "user", control), (-1, 1, "assistant", control)]
        turns = [(r[2] or "", r[3] or "") for r in sorted(own, key=lambda r: (r[1] is not None, r[1] or 0))]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r["conv_id"] for r in q_chat.op10_chat_format(spark, cases.folder(spark, tmp_path, conversations=rows)).collect()] == [-1]


def test_layouts_of_json_rows(spark):
    rows = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}], "id": 3},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "do", "input": "", "output": "done"},
        {"instruction": "do", "output": "done"},
        {"prompt": "p", "completion": "c"},
        {"prompt": "p", "response": None},
        {"question": "q", "answer": "a", "source": {"prompt": 1}},
        {"other": 1},
        [1],
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)] + [(len(rows), None)], "k int, json string")
    got = {r["k"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in chat.turns_from_json(df).collect()}
    assert got[0] == ("messages", [("user", "q"), ("assistant", "")])
    assert got[1] == ("from_value", [("user", "q"), ("assistant", "a")])
    assert got[2] == ("instruction_input", [("user", "do"), ("assistant", "done")])
    assert got[3] == ("instruction", [("user", "do"), ("assistant", "done")])
    assert got[4] == ("prompt_completion", [("user", "p"), ("assistant", "c")])
    assert got[5] == ("prompt_response", [("user", "p"), ("assistant", "")])
    assert got[6] == ("question_answer", [("user", "q"), ("assistant", "a")])
    assert got[7] == got[8] == got[9] == (None, None)


def test_layouts_of_turn_rows(spark):
    rows = spark.createDataFrame([(7, 1, "bot", "b"), (7, 0, None, "a")], "dialog_id long, position int, speaker string, utterance string")
    assert [(r["conv_id"], [tuple(t) for t in r["turns"]]) for r in chat.turns_from_rows(rows).collect()] == [(7, [("", "a"), ("bot", "b")])]
    with pytest.raises(ValueError):
        chat.turns_from_rows(rows.drop("speaker"))
