"""Cleaning and deduplication of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confab.functions import text as T
from confab.operators.fold import LOOKBACK, fold, lookback_step, similar_step, voice_step

KEY, ORDER = ["source_path"], ["msg_index"]


# X3
def normalize_rows(messages: DataFrame, chat_name: Column | None = None) -> DataFrame:
    """Trims, drops blank contents, sets UNKNOWN senders, null times and known types."""
    out = messages.withColumns({
        "content": T.utrim(F.col("content")),
        "sender": F.coalesce(F.nullif(T.utrim(F.col("sender")), F.lit("")), F.lit("UNKNOWN")),
        "time": F.nullif(T.utrim(F.col("time")), F.lit("")),
        "type": T.normalize_type(F.coalesce("type", F.lit("text"))),
    })
    out = out.filter(F.coalesce("content", F.lit("")) != "")
    return out if chat_name is None else out.withColumn("chat_name", chat_name)


def refine_calls(messages: DataFrame) -> DataFrame:
    kind, content = T.refined_call(F.col("type"), F.col("content"))
    return messages.withColumns({"type": kind, "content": content})


def infer_media_types(messages: DataFrame) -> DataFrame:
    return messages.withColumn("type", T.media_type(F.col("type"), F.col("content")))


# F7
def drop_time_only(messages: DataFrame) -> DataFrame:
    return messages.filter(~T.is_time_only(F.col("content")))


# D1, D2
def dedup_exact(messages: DataFrame, cross_chat: bool = False, order: list[str] | None = None) -> DataFrame:
    """The first row of each (sender, time, content, type) within its chat, or with the chat's name over all sources."""
    keys = (["chat_name"] if cross_chat else KEY) + ["sender", "time", "content", "type"]
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*(order or (KEY if cross_chat else []) + ORDER)))
    return messages.withColumn("__n", n).filter("__n = 1").drop("__n")


# D3
def dedup_adjacent(messages: DataFrame) -> DataFrame:
    """The first of adjacent rows with the same sender and content, with the first time that any of them has."""
    w = W.partitionBy(*KEY).orderBy(*ORDER)
    same = F.struct(F.coalesce("sender", F.lit("")).alias("s"), F.coalesce("content", F.lit("")).alias("c"))
    rows = messages.withColumn("__new", F.coalesce(F.lag(same).over(w) != same, F.lit(True)).cast("int"))
    rows = rows.withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy(*KEY, "__run").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = F.first(F.nullif("time", F.lit("")), ignorenulls=True).over(run)
    return rows.withColumn("time", F.coalesce(F.nullif("time", F.lit("")), first, "time")).filter("__new = 1").drop("__new", "__run")


# D4 - D7
def dedup_lookback(messages: DataFrame, k: int = LOOKBACK) -> DataFrame:
    return fold(messages, KEY, ORDER, [(lookback_step, k)])


def merge_chunks(messages: DataFrame, k: int = LOOKBACK, order: list[str] | None = None) -> DataFrame:
    """Overlapping chunks of a chat, in the order of chunks, without the messages that a chunk repeats."""
    return fold(messages, KEY, order or ["chunk_index", *ORDER], [(lambda: lookback_step(("sender", "content", "type"), fill=False), k)])


def dedup_similar(messages: DataFrame, ratio: float = 0.88, min_len: int = 30, k: int = LOOKBACK) -> DataFrame:
    return fold(messages, KEY, ORDER, [(lambda: similar_step(ratio, min_len), k)])


def drop_voice_durations(messages: DataFrame) -> DataFrame:
    return fold(messages, KEY, ORDER, [(voice_step, 1)])


# D8
def distinct_names(rows: DataFrame, name: str = "name", pos: str = "pos", key: Column | None = None) -> DataFrame:
    """The first of each name (or of each ``key``), trimmed and not blank, in order."""
    clean = rows.withColumn(name, T.utrim(F.col(name))).filter(F.col(name) != "")
    clean = clean.withColumn("__k", F.col(name) if key is None else key)
    return clean.groupBy("__k").agg(F.min_by(name, pos).alias(name), F.min(pos).alias(pos)).drop("__k")


# D9
def distinct_unread(rows: DataFrame) -> DataFrame:
    """CHATROW rows: named ones by name, unnamed ones by badge and place."""
    key = F.coalesce(F.nullif(T.utrim(F.col("name")), F.lit("")), F.concat_ws("|", F.lit("\0"), F.coalesce("badge_text", F.lit("")), F.col("row_pos").cast("string")))
    n = F.row_number().over(W.partitionBy("scan_id", key).orderBy("row_pos"))
    return rows.withColumn("__n", n).filter("__n = 1").drop("__n")


# D11
def postprocess(messages: DataFrame) -> DataFrame:
    """All cleaning steps: types, calls, media, voice durations, time lines, adjacent, recent and similar repeats.

    The column steps come first. Voice durations must see rows before time lines go, and everything after is order-dependent on what is kept,
    so the rest is one chain of windows over one sorted pass; the adjacent step is a window of one."""
    rows = infer_media_types(refine_calls(normalize_rows(messages)))
    voice = fold(rows, KEY, ORDER, [(voice_step, 1)], counted=messages)
    return fold(drop_time_only(voice), KEY, ORDER, [(lookback_step, 1), (lookback_step, LOOKBACK), (similar_step, LOOKBACK)], counted=messages)
