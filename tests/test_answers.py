"""Model answers that are broken, nested or long, and the tails of recognised names."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from confab.functions import text as T
from confab.operators import extract
from confab.schemas import RESPONSE
from confab.sources.messages import DEPTH, first_object, model_object


def tried_at_each_brace(text):
    at = text.find("{")
    while at >= 0:
        try:
            return json.JSONDecoder().raw_decode(text, at)[0]
        except ValueError:
            at = text.find("{", at + 1)
    return None


def test_first_object_is_what_trying_each_brace_finds():
    rng = random.Random(5)
    parts = ["{", "}", "[", "]", '"a"', '"', ":", ",", " ", "1", "true", "\\", '{"b":1}', "-", "0.5e3", "x", '"k":', "{}", "\n", '"{', "null", "01", "NaN"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        want, got = tried_at_each_brace(text), first_object(text)
        assert (want is None) == (got is None) and (want is None or json.loads(got) == want or want != want or "NaN" in got), text


@pytest.mark.parametrize("unit", ["{", '{"a":', '{"', '{"{":":",', '{"a":"', "{ "])
def test_long_answers_take_linear_time(unit):
    first_object(unit * 1000)
    began = time.perf_counter()
    first_object(unit * (300_000 // len(unit)))
    assert time.perf_counter() - began < 3


NESTED = '{"a":' * 20_000
ODD = {
    "open": NESTED, "closed": NESTED + "1" + "}" * 20_000, "fenced": f"```json\n{NESTED}1{'}' * 20_000}\n```", "braces": "{" * 100_000, "deep enough": '{"a":' * 300 + '"x"' + "}" * 300,
    "second": 'no {bad} but {"messages": [{"content": "hi", "sender": "a"}]} there', "empty": "", "null": None, "array": "[1]",
}


def test_nested_answers_are_values_or_null(spark):
    got = {r.k: r.v for r in spark.createDataFrame(list(ODD.items()), "k string, t string").select("k", model_object(F.col("t")).alias("v")).collect()}
    assert got["second"] == '{"messages": [{"content": "hi", "sender": "a"}]}' and json.loads(got["deep enough"])
    assert DEPTH > 300 and all(got[k] is None for k in ("open", "closed", "fenced", "braces", "empty", "null", "array"))


def test_one_nested_answer_fails_alone(spark):
    good = json.dumps({"messages": [{"sender": "a", "content": "hello", "type": "text"}]})
    rows = [("r", i, f"s{i}", "c", i, 9, "message_extraction", False, t) for i, t in enumerate([good, *ODD.values(), good])]
    tasks = spark.createDataFrame(rows, RESPONSE)
    states = {r.task_pos: r.state for r in extract.judged_tasks(tasks).collect()}
    assert states[0] == states[10] == states[6] == "completed" and all(states[i] == "failed" for i in (1, 2, 3, 4, 9))
    assert [r.content for r in extract.extract_chat(tasks, F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")).collect()] == ["hello", "hi"]


NAMES = {
    "22 Chapel and 30M 昨天23": "22 Chapel", "群2 12:30": "群2", "曲亦琳 今天回我": "曲亦琳", "Hackathon Super Girlsse": "Hackathon Super Girls", "Team 周三 5:30": "Team 周三", "Design and 3 the": "Design and 3", "Max 3 and": "Max 3",
    "Team 周三": "Team", "Team周三": "Team", "Team 星期三下午": "Team 星期三下午", "Team 周三12": "Team", "Team 周三:30": "Team", "Team 周三：3": "Team", "A 2024-01-05": "A", "A 2024年1月5日": "A", "A 2024/1/5号 x": "A 2024/1/5号 x",
    "News 3 4": "News", "News 3ab 44 5abc": "News", "News 3abcd": "News 3abcd", "3": "3", "3 4": "3", "Club · …": "Club", "Rock and 1234b": "Rock", "Rock And 12": "Rock", "Rock AND 1234": "Rock AND 1234", "x THE": "x", "the": "the",
    "张三 5分钟前": "", "一二三四五六七八九十 5 分 钟 前": "一二三四五", "abc hello 3小时前": "abc", "Classe": "Clas", "asse": "asse", "Girls  and  boys 7": "Girls  and  boys", "": "", "Team 5 2024-01-05": "Team", "周三": "", "Team 0012": "Team 0012",
}


def test_tails_are_cut_in_order(spark):
    got = {r.s: r.n for r in spark.createDataFrame([(k,) for k in NAMES], "s string").select("s", T.strip_preview(F.col("s")).alias("n")).collect()}
    assert got == NAMES
