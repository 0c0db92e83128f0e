"""Streams that are stopped and run again, late rows, and checks of sources over several runs."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from confab.operators import extract
from confab.operators.clean import dedup_lookback
from confab.schemas import MESSAGE, RESPONSE
from confab.sources.messages import discover_sources, source_files
from confab.streaming import jobs

NOW = "2024-01-31 12:00:00"


def answer(chat, chunk, lines):
    text = json.dumps({"messages": [{"sender": "a", "content": x, "type": "text"} for x in lines]}) if lines is not None else "broken"
    return ("r", chunk, f"s{chunk}", chat, chunk, 9, "message_extraction", False, text)


def put(spark, folder, rows, schema=RESPONSE):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)  # files are taken in the order of their times


@pytest.mark.parametrize("dies_in", ["messages", "outcomes"])
def test_a_batch_that_is_run_again_doubles_no_row(spark, tmp_path, dies_in):
    inp, state, messages, outcomes = (str(tmp_path / x) for x in ("in", "state", "messages", "outcomes"))
    for k in range(3):
        put(spark, inp, [answer(f"C{k}", 0, [f"one {k}", f"two {k}"]), answer(f"D{k}", 1, None if k == 1 else [f"three {k}"])])
    calls = []

    def take(batch):
        calls.append(1)
        rows = extract.extract_chat(batch, F.lit(NOW).cast("timestamp_ntz"))
        if len(calls) == 2 and dies_in == "messages":
            return rows.withColumn("content", F.raise_error(F.lit("killed while messages are written")).cast("string"))
        return rows

    run = lambda: jobs.ingest_stream(spark, inp, state, take, messages, outcomes, files_per_batch=1)
    if dies_in == "outcomes":
        calls.append(1)
        original = jobs.model_object
        jobs.model_object = lambda c: F.when(F.col("chat_name") == "C1", F.raise_error(F.lit("killed before outcomes are written")).cast("string")).otherwise(original(c))
    with pytest.raises(Exception, match="killed"):
        run().awaitTermination()
    if dies_in == "outcomes":
        jobs.model_object = original
        # the messages of the broken batch are there, but not yet told
        assert {r.batch_id for r in spark.read.parquet(messages).collect()} == {0, 1} and {r.batch_id for r in jobs.ingested(spark, messages, outcomes).collect()} == {0}
    run().awaitTermination()
    got = sorted((r.chat_name, r.content) for r in jobs.ingested(spark, messages, outcomes).collect())
    assert got == sorted([(f"C{k}", f"{n} {k}") for k in range(3) for n in ("one", "two")] + [("D0", "three 0"), ("D2", "three 2")])
    told = [(r.chat_name, r.responses, r.unreadable, r.submit_index) for r in spark.read.parquet(outcomes).collect()]
    assert sorted(told) == sorted([(f"C{k}", 1, 0, 0) for k in range(3)] + [(f"D{k}", 1, int(k == 1), 1) for k in range(3)])


def test_sources_over_several_checks(spark, tmp_path):
    folder, state = tmp_path / "chats", str(tmp_path / "state")
    folder.mkdir()

    def chat(name, at):
        (folder / f"{name}.json").write_text("[]")
        os.utime(folder / f"{name}.json", (at, at))

    def check():
        told = jobs.new_sources(discover_sources(source_files(spark, str(folder))), state).collect()
        return {r.first_call for r in told}, [os.path.basename(r.source_path)[:-5] for r in told]

    chat("a", 1_700_000_000), chat("b", 1_700_000_100), chat("last_check", 1_700_000_200)
    assert check() == ({True}, ["b", "a"])
    assert check() == (set(), [])
    chat("c", 1_600_000_000), chat("a", 1_700_000_300)
    assert check() == ({False}, ["a", "c"])
    (folder / "b.json").unlink()
    assert check() == (set(), [])
    chat("b", 1_500_000_000)  # gone in between, so new, however old
    assert check() == ({False}, ["b"])
    for d, _, files in os.walk(state):
        for f in files:
            if f.endswith(".parquet"):
                (tmp_path / "state" / os.path.relpath(d, state) / f).write_bytes(b"no table")
            elif f.endswith(".crc"):
                os.remove(os.path.join(d, f))
    assert check() == ({True}, ["a", "c", "b"])


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


TIMED = MESSAGE + ", at timestamp"


def test_late_rows_are_sorted_in(spark, tmp_path, rocksdb):
    """Rows of some minutes are spread over files out of order; two runs over one checkpoint; then a pause ends all chats."""
    rng, rows = random.Random(2), []
    for c in "xyz":
        for i in range(80):
            line = rng.choice(["one", "two", "three", "four", "five", "six", "seven", "eight", "nine"])
            rows.append((c, i, c, rng.choice("ab"), rng.choice([None, f"10:{i % 60:02d}"]), line, "text", 1_700_000_000 + 60 * i))
    inp, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = MESSAGE + ", at long"

    def write(some):
        spark.createDataFrame(some, schema).withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(inp)
        time.sleep(0.05)

    def run():
        stream = jobs.ordered_lookback_stream(jobs.new_messages(spark, inp, TIMED, files_per_batch=1), "at", "30 minutes", 600_000)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(MESSAGE).parquet(out)

    jittered = sorted(rows, key=lambda r: r[-1] + rng.randint(0, 1200))
    for at in range(0, 120, 40):
        write(jittered[at : at + 40])
    early = run().count()
    for at in range(120, 240, 40):
        write(jittered[at : at + 40])
    middle = run().count()
    write([(None, None, None, None, None, None, None, 1_700_100_000)])
    got = sorted(map(tuple, run().collect()), key=repr)
    want = sorted(map(tuple, dedup_lookback(spark.createDataFrame(rows, schema).drop("at")).collect()), key=repr)
    assert got == want and early < middle < len(want)


def test_rows_wait_without_reading_those_before():
    """Rows that come are added to the waiting ones in few calls of the state, whatever waits already."""
    import pandas as pd

    calls = []

    class Named:
        def __init__(self, name):
            self.name, self.value = name, None

        def __getattr__(self, call):
            def called(*args):
                calls.append((self.name, call))
                if call in ("update", "put"):
                    self.value = args[0]
                return self.value if call == "get" else self.value is not None if call == "exists" else [] if call == "listTimers" else None

            return called

    class Handle(Named):
        def getListState(self, name, schema):
            return Named(name)

        getValueState = getListState

    p = jobs.OrderedLookbackProcessor(1000)
    p.init(Handle("handle"))
    watermark = type("T", (), {"getCurrentWatermarkInMs": lambda self: 0})()
    for n in range(3):
        frame = pd.DataFrame({"source_path": ["a"], "msg_index": [n], "chat_name": ["a"], "sender": ["s"], "time": [None], "content": ["x"], "type": ["text"], "at": pd.to_datetime([f"2024-01-0{n + 1}"])})
        assert sum(len(x) for x in p.handleInputRows(("a",), iter([frame]), watermark)) == 0
        assert ("waiting", "get") not in calls and len(calls) <= 4
        calls.clear()
