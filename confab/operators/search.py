"""Queries over messages: history, search, statistics, sessions, incremental changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# F1, F2, F3
def by_type(messages: DataFrame, type_: str | None) -> DataFrame:
    return messages if type_ is None else messages.filter(F.col("type") == type_)


def keyword_matches(keyword: str) -> Column:
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    return low("content").contains(keyword.lower()) | low("sender").contains(keyword.lower())


def in_chats(names: list[str] | None, *columns: str) -> Column:
    """Any of the names is part of any of the columns, whatever the case; no names allow all."""
    if not names:
        return F.lit(True)
    out = F.lit(False)
    for n in names:
        for c in columns:
            out = out | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(n.strip().lower())
    return out


# L1
def history(messages: DataFrame, chat: str | None = None, type_: str | None = None, limit: int = 50, offset: int = 0, newest_first: bool = False) -> DataFrame:
    """For each chat (or for one), rows offset .. offset + limit from its oldest (or newest) row on, with the chat's ``total``."""
    rows = by_type(messages if chat is None else messages.filter(F.col("source_path") == chat), type_)
    n = F.row_number().over(W.partitionBy("source_path").orderBy(F.desc("msg_index") if newest_first else F.asc("msg_index")))
    total = F.count("*").over(W.partitionBy("source_path"))
    return rows.withColumns({"position": n, "total": total}).filter(F.col("position").between(offset + 1, offset + limit))


def stored_history(spark: SparkSession, path: str, chat: str | None = None, limit: int = 50, offset: int = 0, newest_first: bool = False) -> DataFrame:
    """As :func:`history` of all types, from a store of :func:`confab.sources.sinks.write_pages`: rows stand in it by place, so a page of a chat of any size is a filter that reads the blocks it lies in, without a sort. The newest first: of one ``chat``."""
    from confab.sources.sinks import PAGE_BLOCK, page_bucket

    rows, totals = (spark.read.parquet(f"{path}/{x}") for x in ("rows", "totals"))
    first = offset
    if chat is not None:
        rows, totals = rows.filter((F.col("bucket") == page_bucket(F.lit(chat))) & (F.col("source_path") == chat)), totals.filter(F.col("source_path") == chat)
    if newest_first:
        if chat is None:
            raise ValueError("the newest messages are those of one chat")
        first = (totals.agg(F.max("total")).first()[0] or 0) - offset - limit
    place = F.col("place")
    rows = rows.filter(F.col("block").between(first // PAGE_BLOCK, (first + limit) // PAGE_BLOCK) & (place >= first) & (place < first + limit)).drop("bucket", "block")
    found = rows.join(totals, "source_path")
    return found.withColumn("position", F.col("total") - place if newest_first else place + 1).drop("place")


# L2
def search(messages: DataFrame, keyword: str, chats: list[str] | None = None, type_: str | None = None) -> DataFrame:
    """All matches; a page of them is :func:`page` of it."""
    return by_type(messages, type_).filter(in_chats(chats, "source_path") & keyword_matches(keyword))


def page(rows: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return rows.orderBy("source_path", "msg_index").offset(offset).limit(limit)


def page_with_total(rows: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """One row: ``total``, the number of all matches, and ``messages``, the page's rows in order; a page behind the end is empty and has the total."""
    total = rows.agg(F.count("*").alias("total"))
    of_page = F.struct(*rows.columns)
    listed = page(rows, limit, offset).agg(F.array_sort(F.collect_list(F.struct("source_path", "msg_index", of_page.alias("m")))).alias("p"))
    return total.join(F.broadcast(listed)).select("total", F.transform("p", lambda x: x["m"]).alias("messages"))  # one row each


# A1, A2
def type_breakdown(messages: DataFrame) -> DataFrame:
    counts = messages.groupBy("source_path", F.coalesce("type", F.lit("text")).alias("type")).agg(F.count("*").alias("n"))
    share = F.col("n") * 100 / F.sum("n").over(W.partitionBy("source_path"))
    return counts.withColumn("percent", F.round(share, 1))


def top_senders(messages: DataFrame, n: int = 10) -> DataFrame:
    counts = messages.groupBy("source_path", F.coalesce("sender", F.lit("?")).alias("sender")).agg(F.count("*").alias("n"), F.min("msg_index").alias("first"))
    rank = F.row_number().over(W.partitionBy("source_path").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n).drop("first")


# A3, L3
def session_summary(listing: DataFrame, messages: DataFrame) -> DataFrame:
    """Each source of ``listing`` (source_path, modified) with its number of messages, 0 where none could be read."""
    counts = messages.groupBy("source_path").agg(F.count("*").alias("n_messages"))
    return listing.join(counts, "source_path", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))


def sessions(listing: DataFrame, messages: DataFrame, limit: int = 20) -> DataFrame:
    return session_summary(listing, messages).orderBy(F.desc("modified"), "source_path").limit(limit)


# J11
def changed_sources(listing: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Sources modified since the state (source_path, modified) was taken; all of them without a state."""
    if state is None:
        return listing
    before = state.select("source_path", F.col("modified").alias("__before"))
    return listing.join(before, "source_path", "left").filter(F.col("__before").isNull() | (F.col("modified") > F.col("__before"))).drop("__before")
