"""Sinks: chat tables and their JSON, envelope and transcript exports, run and task tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confab.functions.text import safe_file_key, transcript_line, utrim
from confab.operators.order import place_in_order, running

_MESSAGE = ["chat_name", "sender", "time", "content", "type"]


# K1, K2
def write_store(messages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The table of record: Parquet, clustered by chat and in order within each file."""
    messages.repartition("source_path").sortWithinPartitions("source_path", "msg_index").write.mode(mode).parquet(path)


#: Folders of chats, by a hash of the source, and places of a chat in one of its blocks.
PAGE_BUCKETS, PAGE_BLOCK = 16, 10_000


def page_bucket(source: Column) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(PAGE_BUCKETS)).cast("int")


def write_pages(messages: DataFrame, path: str) -> None:
    """A store for pages of chats of any size: each message with its ``place`` in its chat, from 0, in folders by (bucket of chats, block of places); and how many messages each chat has."""
    placed = running(messages, ["source_path"], [F.col("msg_index")], "place").withColumns({"bucket": page_bucket(F.col("source_path")), "block": F.floor(F.col("place") / PAGE_BLOCK).cast("int")})
    placed.repartition("bucket", "block").sortWithinPartitions("source_path", "place").write.mode("overwrite").partitionBy("bucket", "block").parquet(f"{path}/rows")
    messages.groupBy("source_path").agg(F.count("*").alias("total")).write.mode("overwrite").parquet(f"{path}/totals")


def chat_arrays(messages: DataFrame, label: Column | None = None) -> DataFrame:
    """One JSON array per chat: ``source_path, file_key, value``; null senders become empty, a non-blank label takes the captured name's place."""
    name = F.col("chat_name") if label is None else F.coalesce(F.when(utrim(label) != "", utrim(label)), F.col("chat_name"))
    rows = messages.withColumns({"chat_name": name, "sender": F.coalesce("sender", F.lit(""))})
    parts = F.array_sort(F.collect_list(F.struct("msg_index", F.struct(*_MESSAGE).alias("m"))))
    value = F.to_json(F.transform(parts, lambda x: x["m"]), {"ignoreNullFields": "false"})
    return rows.groupBy("source_path").agg(F.min_by("chat_name", "msg_index").alias("chat_name"), value.alias("value")).select("source_path", safe_file_key(F.col("chat_name")).alias("file_key"), "value")


# K3
def chat_envelopes(messages: DataFrame, timestamp: str, extra: dict[str, str] | None = None) -> DataFrame:
    """One JSON object per chat with its count and messages; extra entries never replace these."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("msg_index", F.struct(*_MESSAGE).alias("m")))), lambda x: x["m"])
    core = {"chat_name", "message_count", "timestamp", "messages"}
    more = [F.lit(v).alias(k) for k, v in (extra or {}).items() if k not in core]
    out = messages.groupBy("source_path").agg(F.min_by("chat_name", "msg_index").alias("chat_name"), F.count("*").alias("message_count"), parts.alias("messages"))
    return out.select("source_path", F.to_json(F.struct("chat_name", "message_count", F.lit(timestamp).alias("timestamp"), "messages", *more), {"ignoreNullFields": "false"}).alias("value"))


def write_text(values: DataFrame, path: str, key: str = "source_path", value: str = "value") -> None:
    values.select(key, value).write.mode("overwrite").partitionBy(key).text(path)


def write_bundles(values: DataFrame, path: str, key: str = "source_path", value: str = "value") -> None:
    """The texts of many chats in a few files, a line for each: with a file and a folder for each chat, making these takes most of the time."""
    values.select(F.col(key).alias("source_path"), F.col(value).alias("value")).write.mode("overwrite").json(path)


# K4
def append_run(run: DataFrame, path: str) -> None:
    run.write.mode("append").parquet(path)


# K5
def task_rows(chunks: DataFrame, run_id: str, kind: str = "message_extraction") -> DataFrame:
    """One task per chunk, in the order of chats and chunks, with ids ``step_<run>_<nnnn>``, numbered from 1 over the whole run."""
    placed = place_in_order(chunks, F.struct("chat_name", "chunk_index"), "__n")
    step = F.format_string("step_%s_%04d", F.lit(run_id), F.col("__n") + 1)
    return placed.withColumns({"run_id": F.lit(run_id), "step_id": step, "kind": F.lit(kind), "completed": F.lit(False)}).drop("__n")


def write_tasks(tasks: DataFrame, path: str, resume: bool = False) -> None:
    """A fresh run takes the place of pending tasks; a resumed one adds to them."""
    tasks.write.mode("append" if resume else "overwrite").parquet(path)


# K6
def transcripts(messages: DataFrame, exported_at: str, limit: int = 500, markdown: bool = True) -> DataFrame:
    """One text per chat: a header and a line for each of its first ``limit`` messages."""
    rank = F.row_number().over(W.partitionBy("source_path").orderBy("msg_index"))
    rows = messages.withColumn("__n", rank).filter(F.col("__n") <= limit)
    line = transcript_line(F.col("time"), F.col("sender"), F.col("type"), F.col("content"), markdown)
    chats = rows.groupBy("source_path").agg(F.min_by("chat_name", "msg_index").alias("chat_name"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("msg_index", line.alias("line")))).alias("lines"))
    head = F.concat(F.lit("# " if markdown else ""), "chat_name", F.lit(f"\nexported {exported_at}, "), F.col("n").cast("string"), F.lit(" messages\n\n"))
    return chats.select("source_path", F.concat(head, F.array_join("lines.line", "\n")).alias("value"))
