"""Streaming forms: new sources, ingestion, deduplication."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from confab.operators.fold import LOOKBACK, Window, lookback_step
from confab.operators.search import changed_sources
from confab.schemas import MESSAGE, RESPONSE
from confab.sources.messages import model_object
from confab.streaming.scratch import remove


# ST1
def new_messages(spark: SparkSession, folder: str, schema: str = MESSAGE, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the rows of Parquet files in ``folder`` that no earlier run with the same checkpoint has read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def changed_since_last_run(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands what is new since the last run to ``sink`` and stops; the checkpoint is the state."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _checks(spark: SparkSession, state: str) -> list[int]:
    """The numbers of the checks whose states are whole, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName()[6:]) for p in names if p.getName().startswith("check=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def new_sources(listing: DataFrame, state: str) -> DataFrame:
    """``first_call, source_path, modified, ...``: the sources of ``listing`` that are new or were modified since the last check with the same ``state``, newest first.

    ``state`` is a folder in which each check leaves its listing, so a source that is gone vanishes from the state. The first check reports all sources, and so does one that finds no
    state that can be read. A check that dies before its listing is whole leaves the state as it was. The listing is read once, as it is now; states older than the last are deleted."""
    spark = listing.sparkSession
    checks = _checks(spark, state)
    before = None
    if checks:
        try:
            before = spark.read.schema(listing.schema).parquet(f"{state}/check={checks[-1]}").select("source_path", "modified")
            before.agg(F.max("source_path"), F.max("modified")).collect()  # reads every file
        except (PySparkException, Py4JJavaError):
            before = None
    at = f"{state}/check={checks[-1] + 1 if checks else 0}"
    listing.write.mode("overwrite").parquet(at)
    remove(spark, *[f"{state}/check={n}" for n in checks[:-1]])
    current = spark.read.schema(listing.schema).parquet(at)
    return changed_sources(current, before).select(F.lit(before is None).alias("first_call"), *listing.columns).orderBy(F.desc("modified"), "source_path")


# ST2
def ingest_stream(spark: SparkSession, folder: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame], messages_out: str, outcomes_out: str, files_per_batch: int = 100) -> StreamingQuery:
    """RESPONSE files flow through ``extract`` into a message table; a batch's readable and unreadable responses are told in an outcome table, chats in the order of submission.

    Each batch owns a part of either table, named by the batch's id, and writes it whole; a batch that is run again after a failure, with the same files by the checkpoint, takes the place of what
    it had written, so no row is there twice. The outcomes are written last: messages of batches without them may be incomplete (:func:`ingested`)."""
    stream = spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        part = lambda out: f"{out}/batch_id={batch_id}"
        batch = batch.persist()
        try:
            extract(batch).write.mode("overwrite").parquet(part(messages_out))
            found = batch.withColumn("__o", model_object(F.col("response_text")))
            told = found.groupBy("chat_name").agg(F.count("*").alias("responses"), F.count_if(F.col("__o").isNull()).alias("unreadable"), F.min("task_pos").alias("submit_index"))
            told = told.withColumn("error", F.when(F.col("unreadable") > 0, F.lit("response without a JSON object")))
            told.repartitionByRange("submit_index").sortWithinPartitions("submit_index").write.mode("overwrite").parquet(part(outcomes_out))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, messages_out: str, outcomes_out: str) -> DataFrame:
    """The messages of the batches that are whole."""
    whole = spark.read.parquet(outcomes_out).select("batch_id").distinct()
    return spark.read.parquet(messages_out).join(F.broadcast(whole), "batch_id", "left_semi")  # a number for each batch


# ST3
def dedup_exact_stream(stream: DataFrame, event_time: str, late: str = "1 hour") -> DataFrame:
    """Drops repeats of (source, sender, time, content, type) that arrive within the watermark."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["source_path", "sender", "time", "content", "type"])


class LookbackProcessor(StatefulProcessor):
    """Keeps the keys of a chat's last few kept rows; a row whose key is among them goes. Rows of a chat must arrive in order."""

    SIZE = 5

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "keys array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        keys = list(self.kept.get()[0]) if self.kept.exists() else []
        for frame in rows:
            keep = []
            for r in frame.sort_values("msg_index").itertuples():
                k = "\x1f".join(str(x) for x in (r.sender, r.content, r.type))
                if k not in keys:
                    keep.append(r.Index)
                    keys = [*keys, k][-self.SIZE :]
            yield frame.loc[keep]
        self.kept.update((keys,))

    def close(self) -> None: ...


def dedup_lookback_stream(stream: DataFrame) -> DataFrame:
    """Streaming form of the lookback over sender, content and type, for rows that arrive in order: each goes out at once, so times are not filled in."""
    return stream.groupBy("source_path").transformWithStateInPandas(LookbackProcessor(), MESSAGE, "append", "none")


_FIELDS = [f.split()[0] for f in MESSAGE.split(", ")]
_INDEX = _FIELDS.index("msg_index")


class OrderedLookbackProcessor(StatefulProcessor):
    """Rows wait until the watermark has passed them, then enter the lookback in their order; a row goes out when it leaves the window, with the time that a repeat may have given it.

    State: the waiting rows, packed in chunks that are added without reading the others; and one value of the timer, when the last row came and the first waiting one, and the few kept rows, packed.
    One timer is set: for the first waiting row, or, if none waits, for the end of the pause after which a chat's window is emptied. Each call of the state is a round trip, so there are few."""

    CHUNK = 10_000

    def __init__(self, pause_ms: int, size: int = LOOKBACK):
        self.pause, self.size = pause_ms, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.state = handle.getValueState("state", "timer long, last long, first long, kept binary")

    def _wait(self, rows: list[tuple], replace: bool = False) -> None:
        chunks = [(pickle.dumps(rows[i : i + self.CHUNK]),) for i in range(0, len(rows), self.CHUNK)]
        (self.waiting.put if replace else self.waiting.appendList)(chunks)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            at = frame["at"].astype("datetime64[ms]").astype("int64").tolist()
            columns = [[None if x is None or x != x else x for x in frame[f].tolist()] for f in _FIELDS]
            # whole numbers beside nulls arrive as floating ones
            columns[_INDEX] = [None if x is None else int(x) for x in columns[_INDEX]]
            new += [r for r in zip(*columns, at, strict=True) if r[0] is not None]
        if not new:
            return
        self._wait(new)
        found = self.state.get()
        before, last, first, kept = found if found else (None, None, None, None)
        last = max([r[-1] for r in new] + ([] if last is None else [last]))
        first = min([r[-1] for r in new] + ([] if first is None else [first]))
        when = max(first, timerValues.getCurrentWatermarkInMs()) + 1  # timers fire once the watermark is at them or beyond
        if when != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(when)
        self.state.update((when, last, first, kept))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        _, last, first, kept = self.state.get()
        waiting = [r for chunk in self.waiting.get() for r in pickle.loads(chunk[0])] if first is not None else []
        ready = sorted((r for r in waiting if r[-1] < now), key=lambda r: (r[1] is None, r[1] or 0, r[-1]))
        later = [r for r in waiting if r[-1] >= now]
        window = Window(lookback_step(), self.size)
        window.kept.extend(pickle.loads(kept) if kept else [])
        out = []
        for r in ready:
            out += window.put(dict(zip(_FIELDS, r[:-1], strict=True)))
        if later:
            self._wait(later, replace=True)
            first = min(r[-1] for r in later)
            when = max(first, now) + 1
        else:
            if waiting:
                self.waiting.clear()
            first = None
            when = last + self.pause + 1
        if not later and now > last + self.pause:  # the chat has ended for now
            out += window.end()
            self.state.clear()
        else:
            self.handle.registerTimer(when)
            self.state.update((when, last, first, pickle.dumps(list(window.kept))))
        if out:
            yield pd.DataFrame({f: pd.Series([r[f] for r in out], dtype=object) for f in _FIELDS})

    def close(self) -> None: ...


def ordered_lookback_stream(stream: DataFrame, event_time: str = "at", late: str = "1 hour", pause_ms: int = 3_600_000) -> DataFrame:
    """Streaming form of the lookback with times filled in. Rows may arrive in any order within ``late``; they are sorted in before they are compared. A chat that is silent for ``pause_ms`` has its last
    kept rows sent out. Rows without a source only move the watermark on. What comes later than ``late`` is left out, as the watermark says."""
    timed = stream.select(*_FIELDS, F.col(event_time).alias("at")).withWatermark("at", late)
    out = timed.groupBy("source_path").transformWithStateInPandas(OrderedLookbackProcessor(pause_ms), MESSAGE, "append", "eventTime")
    return out.filter("source_path IS NOT NULL")
