import hashlib

import pytest
from pyspark.sql import functions as F

from furrow.llm import chat

CONV = "conv_id bigint, turn bigint, role string, text string, layout string, loss_mask string"
NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nx", "&lt; &amp;#60; &#60;s>", "a\nb", "<", "<|im_end|", "",
         None, "<<SYS>>x<</SYS>>", "&", "ü€😀" * 3000, "\\E\\Q"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_round_trip_and_mask(spark):
    rows = [(c, t, role, NASTY[(c + t) % len(NASTY)], "l", "m")
            for c in range(12) for t, role in enumerate(["system", "user", "assistant", "assistant", None, "a\nb<s>"])]
    rows += [(None, 0, "user", "no id", None, None), (20, 1, "assistant", "tie b", None, None), (20, 1, "assistant", "tie a", None, None)]
    done = chat.read_back(chat.format_turns(chat.canonical_turns(chat.group_turns(spark.createDataFrame(rows, CONV)))))
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    seen = done.select("conv_id", "read_turns", "loss_text", "formatted", "loss_mask").collect()
    assert {r.conv_id for r in seen} == set(by)
    for r in seen:
        assert [tuple(t) for t in r.read_turns] == by[r.conv_id]
        assert r.loss_text == "".join(t for role, t in by[r.conv_id] if role == "assistant")
        assert sum(m.n for m in r.loss_mask) == len(r.formatted)
        at, under = 0, []
        for m in r.loss_mask:
            if m.loss:
                under.append(r.formatted[at:at + m.n])
            at += m.n
        for text in (r.formatted[len(chat.START):], *under):
            for control in ("[INST]", "</s>", "<<SYS>>", "<s>"):
                assert control not in text
        assert all(chat.START not in u and "<|im_end|>" not in u for u in under)


def test_layouts_by_fingerprint(spark):
    schema = ("messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, "
              "instruction string, input string, output string, prompt string, response string, extra int")
    rows = [([("user", "hi"), ("assistant", None)], None, None, None, None, None, None, 1),
            (None, [("human", "q"), ("gpt", "a")], None, None, None, None, None, 2),
            (None, None, "do", "this", "done", None, None, 3),
            (None, None, "do", None, "done", None, None, 4),
            (None, None, None, None, None, "p", "r", 5),
            (None, None, None, None, "only output", None, None, 6),
            (None, None, None, None, None, None, None, 7)]
    out = chat.canonical_turns(spark.createDataFrame(rows, schema)).orderBy("extra").collect()
    assert [r.layout for r in out] == ["messages", "sharegpt", "instruction", "instruction", "prompt", None, None]
    assert [[tuple(t) for t in r.turns] for r in out] == [
        [("user", "hi"), ("assistant", "")], [("user", "q"), ("assistant", "a")], [("user", "do\n\nthis"), ("assistant", "done")],
        [("user", "do"), ("assistant", "done")], [("user", "p"), ("assistant", "r")], [], []]
    assert len({r.schema_fingerprint for r in out}) == 7


def test_no_python_and_empty(spark):
    df = chat.read_back(chat.format_turns(chat.canonical_turns(chat.group_turns(spark.createDataFrame([], CONV)))))
    assert df.collect() == []
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_contract_row(spark):
    out = chat.op3_chat_format(spark, "/root/testdata/sf0.001").filter(F.col("conv_id") == -7).collect()
    text = "</s>[INST] ok [/INST]"
    assert [(r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out] == [
        (2, sha(f"user\n{text}\nassistant\n{text}\n"), len(text), sha(text))]


def test_extra_fields_and_several_layouts(spark):
    schema = ("id int, messages array<struct<role:string,content:string,name:string,weight:double,tool_calls:array<string>>>, "
              "prompt string, response string, completion string, output string")
    said = [("user", "hi", "Ann", 1.0, ["f"]), ("assistant", "ho", None, None, None)]
    rows = [(1, said, None, None, None, None), (2, said, "p", None, None, None), (3, said, "p", "r", None, "o"),
            (4, None, "p", None, "c", None), (5, None, None, None, None, "o")]
    df = spark.createDataFrame(rows, schema)
    out = chat.canonical_turns(df).orderBy("id").collect()
    turns = [("user", "hi"), ("assistant", "ho")]
    assert [r.layout for r in out] == ["messages", "messages", "messages", "completion", None]
    assert [[tuple(t) for t in r.turns] for r in out] == [turns, turns, turns, [("user", "p"), ("assistant", "c")], []]
    assert chat.canonical_turns(df.filter("id < 5"), strict=True).filter("size(turns) = 2").count() == 4
    with pytest.raises(Exception, match="no mapping for the filled paths output"):
        chat.canonical_turns(df, strict=True).collect()
