"""Sources: message archives, run records, task manifests, model responses and thread lists, read by Spark."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from confab.functions.text import coerce_type, nfkc, utrim

_FIELDS = "array<struct<chat_name:string,sender:string,time:string,content:string,type:string>>"
_KEYS = ["chat_name", "content", "sender", "time", "type"]
# Files beside the chats that hold no messages; labels of the application's own controls.
STATE_FILES = r"^last_.*"
CONTROLS = ["搜索", "折叠置顶聊天", "展开置顶聊天", "公众号", "服务号"]


def _files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*").text(paths)
    return raw.select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def _bundled(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return spark.read.schema("source_path string, value string").json(paths)


def _messages(files: DataFrame, array: Column) -> DataFrame:
    return files.select("source_path", F.posexplode(array).alias("msg_index", "m")).select("source_path", "msg_index", "m.*")


# S1, S2, S3
def read_messages(spark: SparkSession, paths: list[str] | str, mode: str = "strict", bundled: bool = False) -> DataFrame:
    """MESSAGE rows of JSON files: ``strict`` fails on anything but arrays of complete messages, ``lenient`` skips files
    that hold no array, ``envelope`` reads objects with a ``messages`` array. ``bundled``: paths hold bundles of such
    files (``sinks.write_bundles``), under the names that they have there."""
    files = (_bundled if bundled else _files)(spark, paths)
    if mode == "envelope":
        kind = f"struct<chat_name:string,messages:{_FIELDS}>"
        return _messages(files, F.from_json("value", kind)["messages"])
    parsed = F.try_parse_json("value")
    is_list = F.coalesce(F.schema_of_variant(parsed).startswith("ARRAY"), F.lit(False))
    if mode == "lenient":
        return _messages(files.filter(is_list), F.from_json("value", _FIELDS))
    items = F.from_json("value", "array<string>")
    complete = F.forall(items, lambda x: F.coalesce(F.array_sort(F.json_object_keys(x)) == F.array(*map(F.lit, _KEYS)), F.lit(False)))
    checked = F.when(is_list & complete, F.from_json("value", _FIELDS)).otherwise(F.raise_error(F.concat(F.lit("not an array of complete messages: "), F.col("source_path"))))
    return _messages(files, checked).withColumn("type", coerce_type(F.col("type")))


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """``file_name, source_path, modified`` of a folder's files; their contents aren't read."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("path").alias("source_path"), F.col("modificationTime").alias("modified"))


# S4
def discover_sources(files: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Of ``files`` (file_name, ...), the chats, by name; with ``runs``, those that the latest run lists."""
    chats = files.filter(F.col("file_name").endswith(".json") & ~F.col("file_name").rlike(STATE_FILES))
    if runs is not None:
        latest = runs.agg(F.max_by("message_json_paths", "finished_at_utc").alias("paths")).select(F.explode("paths").alias("path"))
        chats = chats.join(latest.select(F.element_at(F.split("path", r"[\\/]"), -1).alias("file_name")), "file_name", "left_semi")
    return chats.orderBy("file_name")


# S5
def resolve_chat(sources: DataFrame, name: str, stem: str = "stem") -> DataFrame:
    """The one source whose stem is the name, else is it but for case, else contains it; ties by stem."""
    s, low = F.col(stem), F.lower(F.lit(name))
    rank = F.when(s == name, 0).when(F.lower(s) == low, 1).when(F.contains(F.lower(s), low), 2)
    return sources.withColumn("rank", rank).filter("rank is not null").orderBy("rank", stem).limit(1)


# S6, J9
def read_tasks(manifests: DataFrame, responses: DataFrame) -> DataFrame:
    """Tasks of manifests (one JSON text in ``value`` each) with their response texts (``file_name``, ``response_text``).

    Only tasks of the manifest's own run, where it names one; a missing or blank response is null."""
    kind = (
        "struct<run_id:string,tasks:array<struct<step_id:string,run_id:string,response_file:string,completed:boolean,"
        "metadata:struct<kind:string,chat_name:string,chunk_index:int,chunk_total:int>>>>"
    )
    m = manifests.select(F.from_json("value", kind).alias("m"))
    tasks = m.select(F.col("m.run_id").alias("run_id"), F.posexplode("m.tasks").alias("task_pos", "t"))
    own = F.coalesce(F.col("run_id"), F.lit("")) == ""
    tasks = tasks.filter(own | (F.coalesce("t.run_id", "run_id") == F.col("run_id")))
    tasks = tasks.select(
        "run_id", "task_pos", "t.step_id", "t.metadata.chat_name", "t.metadata.chunk_index", "t.metadata.chunk_total", "t.metadata.kind",
        F.coalesce("t.completed", F.lit(False)).alias("completed"), F.element_at(F.split("t.response_file", r"[\\/]"), -1).alias("file_name"),
    )
    return tasks_with_responses(tasks, responses, "file_name")


def tasks_with_responses(tasks: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    found = responses.select(key, F.when(utrim(F.col("response_text")) != "", F.col("response_text")).alias("response_text"))
    return tasks.join(found, key, "left")


# S7
#: Objects that are nested deeper than this are unreadable, as they are for Spark's JSON reader.
DEPTH = 1000
_BRACE = re.compile(r'\{(?=[ \t\n\r]*+["}])')
_JSON = re.compile(r"""[ \t\n\r]*+(?:(?P<text>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(?P<value>-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null|NaN|-?Infinity)|(?P<mark>[{}\[\],:]))""")


def _objects_from(text: str, at: int, ends: dict[int, int]) -> bool:
    """Reads the object that starts at ``at``, and puts into ``ends`` where it and each object within it end, or -1 where they don't. Returns whether one was nested too deep.

    It keeps a stack, so depth costs nothing, and each object that it meets is read once: what fails, fails for all objects that are open then."""
    opened: list[tuple[int, str]] = []  # where each open object or list starts, and its kind
    want = "value"
    while True:
        m = _JSON.match(text, at)
        if m is None:
            break
        at, mark = m.end(), m["mark"]
        if mark is None:
            if want in ("key", "key or end"):
                if m["text"] is None:
                    break
                want = ":"
            elif want in ("value", "value or end"):
                want = "next"
            else:
                break
        elif mark in "{[":
            if want not in ("value", "value or end"):
                break
            opened.append((m.start("mark"), mark))
            if len(opened) > DEPTH:
                return True
            want = "key or end" if mark == "{" else "value or end"
        elif mark in "}]":
            if (want not in ("next", "key or end") if mark == "}" else want not in ("next", "value or end")) or opened[-1][1] != ("{" if mark == "}" else "["):
                break
            start, kind = opened.pop()
            if kind == "{":
                ends[start] = at
            if not opened:
                return False
            want = "next"
        elif mark == ":":
            if want != ":":
                break
            want = "value"
        else:
            if want != "next":
                break
            want = "key" if opened[-1][1] == "{" else "value"
    for start, kind in opened:
        if kind == "{":
            ends[start] = -1
    return False


def first_object(text: str) -> str | None:
    """The first object in a text that is whole JSON, as it stands there; null if there is none, or if the text is nested too deep. Takes time that grows with the text's length."""
    ends: dict[int, int] = {}
    for m in _BRACE.finditer(text):
        at = m.start()
        if at not in ends and _objects_from(text, at, ends):
            return None
        if ends[at] > 0:
            return text[at : ends[at]]
    return None


@F.pandas_udf(StringType())
def _scan_object(texts: pd.Series) -> pd.Series:
    return texts.map(first_object, na_action="ignore")


FENCE = r"(?is)```(?:json)?\s*(.*?)\s*```"


def _fenced(text: Column) -> Column:
    return F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(utrim(text))


def _readable(inner: Column) -> Column:
    return F.when(inner.startswith("{") & F.try_parse_json(inner).isNotNull(), inner)


def _object(inner: Column, plain: Column) -> Column:
    return F.coalesce(plain, _scan_object(F.when(plain.isNull(), inner)))


def model_object(text: Column) -> Column:
    """The first JSON object in a model's answer, as JSON text; null if there is none. Python sees only what plain parsing cannot read."""
    inner = _fenced(text)
    return _object(inner, _readable(inner))


def with_model_object(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds :func:`model_object` in steps, so that an answer is searched for its fence and read once, not at each place that uses it."""
    rows = rows.withColumn("__inner", _fenced(text))
    rows = rows.withColumn("__plain", _readable(F.col("__inner")))
    return rows.withColumn(name, _object(F.col("__inner"), F.col("__plain"))).drop("__inner", "__plain")


# S8
LEADING_FENCE = r"(?is)^\s*```(?:json)?\s*\n?(.*?)\n?\s*```\s*$"


def parse_strict_response(responses: DataFrame, text: str = "response_text", unknown_type: str = "other") -> DataFrame:
    """Message rows with ``confidence`` and ``stability`` of answers that are JSON but for a leading fence; unreadable ones give no rows."""
    kind = "struct<messages:array<string>,extraction_confidence:string,boundary_stability:string>"
    body = F.when(F.col(text).rlike(LEADING_FENCE), F.regexp_extract(text, LEADING_FENCE, 1)).otherwise(F.col(text))
    r = responses.withColumn("__r", F.from_json(body, kind))
    one = F.from_json("m", "struct<sender:string,content:string,time:string,type:string>").alias("m")
    rows = r.select("*", F.posexplode("__r.messages").alias("msg_index", "m")).filter(F.col("m").startswith("{"))
    known = F.col("m.type").isin("text", "system", "link_card", "image", "other", "unsupported", "call", "video", "voice")
    return rows.select("*", one.alias("parsed")).drop("m").withColumnRenamed("parsed", "m").select(
        *responses.columns, "msg_index", F.coalesce("m.sender", F.lit("UNKNOWN")).alias("sender"), "m.content", "m.time",
        F.when(F.col("m.type").isNull(), "other").when(known, F.col("m.type")).otherwise(unknown_type).alias("type"),
        F.when(F.lower("__r.extraction_confidence").isin("high", "medium", "low"), F.lower("__r.extraction_confidence")).otherwise("low").alias("confidence"),
        F.when(F.lower("__r.boundary_stability").isin("stable", "unstable"), F.lower("__r.boundary_stability")).otherwise("unstable").alias("stability"),
    )


# F6
def not_control(name: Column) -> Column:
    return ~F.regexp_replace(nfkc(F.coalesce(name, F.lit(""))), r"(?U)\s+", "").isin(CONTROLS)


# S9
def parse_thread_list(responses: DataFrame, text: str = "response_text", scan: str = "scan_id") -> DataFrame:
    """CHATROW rows of answers that list threads, bare or under ``threads``."""
    one = "array<struct<name:string,y:double,is_group:boolean,unread:boolean,unread_badge:string,selected:boolean,is_selected:boolean>>"
    body = F.when(F.col(text).rlike(LEADING_FENCE), F.regexp_extract(text, LEADING_FENCE, 1)).otherwise(utrim(F.col(text)))
    threads = F.when(body.startswith("["), F.from_json(body, one)).otherwise(F.from_json(body, f"struct<threads:{one}>")["threads"])
    rows = responses.select(scan, F.posexplode(threads).alias("row_pos", "t")).filter(not_control(F.col("t.name")))
    badge = F.coalesce(F.when(utrim(F.col("t.unread_badge")) != "", utrim(F.col("t.unread_badge"))), F.lit("1"))
    return rows.select(
        scan, "row_pos", F.coalesce("t.name", F.lit("")).alias("name"), F.when(F.col("t.unread"), badge).alias("badge_text"), F.coalesce("t.is_group", F.lit(False)).alias("is_group"),
        F.coalesce("t.selected", "t.is_selected", F.lit(False)).alias("selected"), F.coalesce("t.y", F.lit(0.0)).cast("int").alias("y"),
    )


# U1
def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows of the parts, with ``part`` as the first key of their order."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


def numbered(df: DataFrame, by: list[str], order: list, name: str = "msg_index") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1).cast("int"))
