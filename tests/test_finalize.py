"""Finalising a run: what fails and why, what is counted, and times that are carried over a whole run in blocks."""

import json
import random

from pyspark.sql import functions as F

from confab.functions.timeparse import with_effective_time
from confab.operators import extract
from confab.schemas import RESPONSE

NOW = "2026-04-10 12:00:00"


def run_of(spark, texts, kind="message_extraction"):
    return spark.createDataFrame([("r", i, f"s{i}", "C", i, len(texts), kind, False, t) for i, t in enumerate(texts)], RESPONSE)


def item(content, time=None, sender="A"):
    return {"sender": sender, "content": content, "time": time, "type": "text"}


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def test_errors_and_counts(spark):
    some = json.dumps({"messages": [item("a"), item("a"), item("old", "2000-01-01 10:00"), {"sender": "x"}, "text", 7, None, item("b", "2026-04-10 11:00")]})
    tasks = run_of(spark, [some, "no object", json.dumps({"messages": {"content": "x"}}), None, json.dumps({"messages": "text"}), some])
    rows, summary = extract.finalize(tasks, now(), hours=24)
    s = summary.first()
    assert (s.total, s.completed, s.missing, s.failed, s.ok) == (6, 2, "s3", "s1,s2,s4", False)
    assert s.errors.split("\n") == [extract.NO_OBJECT, extract.NO_LIST, extract.NO_LIST]
    # entries that are no objects with a content are skipped; a, a, old and b of each answer are messages
    assert (s.messages_before, s.messages_in_window, s.messages_extracted) == (8, 6, 2)
    assert sorted(r.content for r in rows.collect()) == ["a", "b"]
    told = {r.step_id: (r.state, r.error) for r in extract.failures(extract.judged_tasks(tasks)).collect()}
    assert told == {"s3": ("missing", None), "s1": ("failed", extract.NO_OBJECT), "s2": ("failed", extract.NO_LIST), "s4": ("failed", extract.NO_LIST)}


def test_times_carried_in_blocks_are_those_of_one_window(spark, monkeypatch):
    rng = random.Random(4)
    times = [None, "", "2026-04-10 11:00", "昨天 10:00", "no time", "2026-04-09 08:30"]
    rows = spark.createDataFrame([(f"r{i % 2}", i // 6, i % 3, rng.choice(times)) for i in range(400)], "run_id string, task_pos int, pos int, time string").dropDuplicates(["run_id", "task_pos", "pos"])
    monkeypatch.setattr(extract, "CARRY_BLOCK", 7)
    got = sorted(map(tuple, extract.carried_time(rows, now()).collect()), key=repr)
    assert got == sorted(map(tuple, with_effective_time(rows, now(), ["run_id"], ["task_pos", "pos"]).collect()), key=repr)


def test_global_scope(spark):
    tasks = run_of(spark, [json.dumps({"messages": [item("old", "2000-01-01 10:00")]}), json.dumps({"messages": [item("after old")]}), json.dumps({"messages": [item("new", "2026-04-10 11:00"), item("after new")]})])
    by_task, _ = extract.finalize(tasks, now(), hours=24)
    of_run, _ = extract.finalize(tasks, now(), hours=24, scope="global")
    assert sorted(r.content for r in by_task.collect()) == ["after new", "after old", "new"] and sorted(r.content for r in of_run.collect()) == ["after new", "new"]
