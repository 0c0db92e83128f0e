"""Extraction within a window of hours: times and answers are parsed in steps, each once."""

import json

from pyspark.sql import functions as F

from confab.functions import timeparse as P
from confab.operators import extract
from confab.schemas import RESPONSE
from confab.sources.messages import model_object, with_model_object

NOW = "2026-04-10 12:00:00"
TIMES = [
    None, "", " ", "no clock", "11:59", "12:04", "12:06", "２３：０５", "24:00", "9:60", "12:10 am", "12:10 pm", "下午 3:15", "晚上 11:20", "凌晨 12:30", "2026-04-09 08:30", "2026/4/9 8:30", "2026.04.09  08:30", "2026年4月9日 08：30",
    "2026-02-30 10:00", "4月11日 11:00", "4月12日 11:00", "12-31 23:59", "2月30日 10:00", "昨天 10:00", "Yesterday 3:05 PM", "今天 10:00", "Today 23:00", "周五 10:00", "Fri 13:00", "星期日 7:07", "tues 1:01", "monday sunday 5:05", "99:99:12:30", "2026-04-09",
]


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def uses(df, *names):
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    return sum(plan.count(x) for x in names)


def test_times_in_steps_are_those_of_one_expression_and_use_far_fewer_patterns(spark):
    rows = spark.createDataFrame(list(enumerate(TIMES)), "k int, time string")
    steps, plain = P.with_message_time(rows, F.col("time"), now(), "t"), rows.withColumn("t", P.parse_message_time(F.col("time"), now()))
    assert steps.columns == ["k", "time", "t"] and sorted(map(tuple, steps.collect())) == sorted(map(tuple, plain.collect()))
    timed = P.with_effective_time(rows, now(), [], ["k"])
    assert 4 * uses(timed, "regexp_extract", "rlike", "contains(") < uses(plain, "regexp_extract", "rlike", "contains(")


def test_objects_in_steps_are_those_of_one_expression(spark):
    texts = [None, "", "{}", '{"a": 1}', 'so ```json\n{"a": [1, 2]}\n```', '```{"a": 1```', 'and { so {"b": 2} ', "{broken", "```json```", '[{"c": 3}]']
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    steps = with_model_object(rows, F.col("t"), "v")
    assert steps.columns == ["k", "t", "v"] and sorted(map(tuple, steps.collect()), key=repr) == sorted(map(tuple, rows.withColumn("v", model_object(F.col("t"))).collect()), key=repr)


def test_chunks_before_the_cutoff_go_with_rows_that_have_no_chunk_or_chat(spark):
    old, new = "2026-04-01 00:00:00", "2026-04-10 11:00:00"
    some = [("a", 0, new), ("a", 1, old), ("a", 1, new), ("a", 2, None), ("a", 3, new), ("b", 0, new), ("b", 5, None), ("c", 0, None), ("c", 1, None), ("c", 4, old), ("d", None, old), ("d", 2, new), (None, 1, new), (None, None, old)]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(some)], "k int, chat string, chunk_index int, t string").withColumn("effective_time", F.col("t").cast("timestamp_ntz"))
    got = P.drop_chunks_before_cutoff(rows, 24, now(), ["chat"])
    assert got.columns == rows.columns
    assert sorted(r.k for r in got.collect()) == [1, 2, 3, 4, 5, 6, 9, 11]


def test_answers_are_read_once(spark):
    item = lambda content, time: {"sender": "A", "content": content, "time": time, "type": "text"}
    chunks = [[item("older", "2026-04-10 11:30")], [item("old", "2026-03-01 10:00"), item("in", "2026-04-10 10:00")], [item("in", "2026-04-10 10:00"), item("later", "昨天 13:00")]]
    tasks = spark.createDataFrame([("r", i, f"s{i}", "C", i, 3, "message_extraction", False, json.dumps({"messages": m})) for i, m in enumerate(chunks)], RESPONSE)
    out = extract.extract_chat(tasks, now(), hours=24)
    assert [(r.msg_index, r.content) for r in out.orderBy("msg_index").collect()] == [(0, "in"), (1, "later")]
    assert uses(out, "from_json", "try_parse_json") == 0  # what is left reads the checkpoint, twice
