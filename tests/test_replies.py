"""JSON of any shape as VARIANT: solutions, replies that need no mending, messages."""

import json

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import replies as R
from sparkfolio.operators import solve


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_solutions_of_any_shape(spark):
    texts = [
        '{"steps": [{"title": "a", "content": "b"}, {"title": 3, "content": null}, "no step", 5, null, [1], {}], "final_answer": "c)"}',
        '{"steps": "none", "final_answer": 12}', '{"final_answer": 1.50}', '{"final_answer": true}', '{"final_answer": null}', '{"final_answer": {"a": 1}}', '{"final_answer": [1, "b", null]}',
        "[1]", "no JSON", "", None, '{"steps": [', '{"steps": [{"title": "t"}], "extra": {"deep": [1, {"x": 2}]}}',
    ]
    got = column(spark, texts, lambda t: R.solution(t, F.lit(True), F.lit("A) 1\nB) 2\nC) 3\nD) 12")))
    assert [tuple(s) for s in got[0].steps] == [("a", "b"), ("", ""), ("", ""), ("", "")] and got[0].final_answer == "C"
    assert [g.final_answer for g in got[1:7]] == ["D", "1.5", "true", "", "[object Object]", "1,b,"]
    assert all(g.steps == [] and g.final_answer == "" for g in got[7:12]) and got[12].steps[0].title == "t"


REPLIES = [
    '{"steps": [{"step_idx": 1, "title": "t", "content": "c"}], "final_answer": "7", "confidence": "high"}', '```json\n{"steps": [], "final_answer": "x"}\n```', '{"steps": [{"step_idx": 1, "title": "t", "content": "c"},], "final_answer": "8"}',
    "Here it is: {\"final_answer\": \"9\"} done", '{"final_answer": "\\sqrt 1"}', '{"steps": [{"step_idx": "2", "title": 5, "content": {"a": 1}}]}', '[{"final_answer": "first"}]', '{"final_answer": 5}', '{"steps": [null, 3, {"title": null}]}', "nothing", "", None, "null", '{"a": 1, "a": 2, "final_answer": "d"}',
]


def test_replies_read_natively_equal_mended_ones(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(REPLIES)], "i int, t string")
    mended = {r.i: r.x for r in rows.select("i", solve.repair_json(F.col("t")).alias("x")).collect()}
    assert {r.i: r.x for r in R.parsed(rows, "t", "x").collect()} == mended
    kept = {r.i for r in rows.withColumn("v", F.try_parse_json("t")).where(R.sound(F.col("v"))).collect()}
    assert kept == {0, 8}


def test_only_what_is_not_sound_reaches_python(spark, capsys):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(REPLIES)], "i int, t string")
    R.parsed(rows, "t", "x").explain()
    plan = capsys.readouterr().out
    native, python = plan.split("ArrowEvalPython")[0], plan.split("ArrowEvalPython")[1]
    assert "Union" in native and "Filter" in native and "ArrowEvalPython" not in native
    assert "Filter" in python and "NOT" in python.upper()


MESSAGES = [
    {"role": "user", "content": "plain"}, {"content": [{"type": "text", "text": "t"}, {"type": "text"}, {"type": "text", "text": None}, {"type": "text", "text": 5}]},
    {"role": "assistant", "content": [{"type": "image", "source": {"type": "base64", "data": "QQ=="}}, {"type": "image", "source": {"type": "base64", "media_type": "image/jpeg", "data": "Qg=="}}, {"type": "image", "source": "x"}]},
    {"role": "user", "content": [{"type": "image_url", "image_url": {"url": "u"}}, {"type": "image_url", "image_url": "v"}, {"type": "image_url", "image_url": {}}, "word", 7, True, None, {"type": "odd", "deep": [1, {"a": "é"}]}]}, {"role": "user"}, {"role": "user", "content": 3},
]


def as_chat(item):
    if not isinstance(item, dict):
        return item
    source = item["source"] if isinstance(item.get("source"), dict) else {}
    if item.get("type") == "image" and source.get("type") == "base64":
        return {"type": "image_url", "image_url": {"url": f"data:{source.get('media_type', 'image/png')};base64,{source.get('data', '')}"}}
    return str(item.get("text", "")) if item.get("type") == "text" else item


def test_chat_messages_keep_what_they_do_not_know(spark):
    (got,) = column(spark, [json.dumps(MESSAGES)], lambda t: F.transform(R.chat_messages(F.try_parse_json(t)), lambda m: F.struct(m["role"].alias("role"), F.to_json(m["content"]).alias("content"))))
    want = [(m.get("role", "user"), [as_chat(x) for x in m["content"]] if isinstance(m.get("content"), list) else m.get("content", "")) for m in MESSAGES]
    assert [(m.role, json.loads(m.content)) for m in got] == want


def test_response_messages(spark):
    (got,) = column(spark, [json.dumps(MESSAGES)], lambda t: R.response_messages(F.lit("solve"), F.try_parse_json(t)))
    assert [m.role for m in got] == ["system", "user", "user", "assistant", "user", "user", "user"]
    flat = [[(c.type, c.text, c.image_url) for c in m.content] for m in got]
    assert flat[0] == [("input_text", "solve", None)] and flat[1] == [("input_text", "plain", None)] and flat[5] == [("input_text", "", None)] and flat[6] == [("input_text", "3", None)]
    assert flat[2] == [("input_text", x, None) for x in ("t", "", "None", "5")]
    assert flat[3][:2] == [("input_image", None, "data:image/png;base64,QQ=="), ("input_image", None, "data:image/jpeg;base64,Qg==")] and json.loads(flat[3][2][1]) == {"type": "image", "source": "x"}
    assert flat[4][:2] == [("input_image", None, "u"), ("input_image", None, "v")] and json.loads(flat[4][2][1]) == {"type": "image_url", "image_url": {}}
    assert [x[1] for x in flat[4][3:7]] == ["word", "7", "True", "None"] and json.loads(flat[4][7][1]) == {"type": "odd", "deep": [1, {"a": "é"}]}


@pytest.mark.parametrize("text", [None, "", "{}", '"x"', "3"])
def test_messages_that_are_no_list(spark, text):
    (got,) = column(spark, [text], lambda t: R.chat_messages(F.try_parse_json(t)))
    assert got is None


def test_a_solution_is_parsed_once(spark):
    rows = spark.createDataFrame([('{"steps": [{"title": "a"}], "final_answer": 2}', True, "A) 1\nB) 2"), ("no", True, None)], "t string, sat boolean, p string")
    got = rows.select(R.solution(F.col("t"), F.col("sat"), F.col("p")).alias("s"))
    assert [(len(r.s.steps), r.s.final_answer) for r in got.collect()] == [(1, "B"), (0, "")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= 1
