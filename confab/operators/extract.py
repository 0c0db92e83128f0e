"""From model responses to message rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confab.functions import text as T
from confab.functions.timeparse import cutoff, drop_chunks_before_cutoff, recent_window, with_effective_time, with_message_time
from confab.operators.clean import dedup_exact
from confab.operators.order import cut
from confab.sources.messages import with_model_object

_ITEM = "struct<chat_name:string,sender:string,time:string,content:string,type:string>"
_PAYLOAD = "struct<chat_name:string,messages:string,threads:string>"


# W3, F12
def fill_separator_times(messages: DataFrame, sequence: list[str], order: list[str]) -> DataFrame:
    """Rows that only show a time set the time of following rows that have none, and go."""
    content = T.utrim(F.coalesce("content", F.lit("")))
    mark = T.is_separator(content)
    w = W.partitionBy(*sequence).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(mark, F.coalesce(T.blank_to_null(F.col("time")), content)), ignorenulls=True).over(w)
    rows = messages.withColumns({"__mark": mark, "__seen": seen})
    return rows.filter("not __mark").withColumn("time", F.coalesce(T.blank_to_null(T.utrim(F.col("time"))), F.col("__seen"), T.utrim(F.col("time")))).drop("__mark", "__seen")


def valid_messages(messages: DataFrame) -> DataFrame:
    """Rows with content; system and recalled ones have no sender, others need one."""
    sender = T.utrim(F.col("sender"))
    sender = F.when(~sender.isin("", "null", "None"), sender)
    kind = F.coalesce(F.nullif(F.lower(T.utrim(F.col("type"))), F.lit("")), F.lit("text"))
    rows = messages.withColumns({"content": T.utrim(F.coalesce("content", F.lit(""))), "type": kind})
    silent = F.col("type").isin("system", "recalled")
    return rows.withColumn("sender", F.when(~silent, sender)).filter((F.col("content") != "") & (silent | F.col("sender").isNotNull()))


# W6
def keep_last(messages: DataFrame, n: Column, chat: list[str], order: list[str]) -> DataFrame:
    """The last n rows of each chat; a null n keeps all."""
    back = F.row_number().over(W.partitionBy(*chat).orderBy(*[F.desc(o) for o in order]))
    return messages.withColumn("__b", back).filter(n.isNull() | (F.col("__b") <= n)).drop("__b")


def response_messages(responses: DataFrame) -> DataFrame:
    """RESPONSE rows exploded into messages, ``pos`` within the response; responses without a readable object give none."""
    parsed = with_model_object(responses, F.col("response_text"), "__o").withColumn("__p", F.from_json("__o", _PAYLOAD))
    items = F.from_json("__p.messages", "array<string>")
    rows = parsed.select(*[c for c in responses.columns if c != "response_text"], F.posexplode(items).alias("pos", "__m")).filter(F.col("__m").startswith("{"))
    m = F.from_json("__m", _ITEM)
    return rows.withColumn("__i", m).select(*[c for c in rows.columns if c != "__m"], "__i.sender", "__i.time", "__i.content", "__i.type")


# M2
def extract_chat(responses: DataFrame, now: Column, hours: int = 0, max_messages: int | None = None) -> DataFrame:
    """Messages of captured chats: one row per message of ``chat_name``, in the order of chunks, times filled in, repeats gone."""
    rows = response_messages(responses)
    rows = fill_separator_times(rows, ["chat_name", "chunk_index"], ["pos"])
    rows = valid_messages(rows)
    if hours > 0:
        # read twice from here on: once for the chunks that are left out
        rows = cut(with_effective_time(rows, now, ["chat_name", "chunk_index"], ["pos"]))
        rows = recent_window(drop_chunks_before_cutoff(rows, hours, now, ["chat_name"]), hours, now).drop("event_time", "effective_time")
    rows = rows.withColumns({"source_path": F.col("chat_name"), "msg_index": F.struct("chunk_index", "pos")})
    rows = dedup_exact(rows)
    rows = keep_last(rows, F.lit(max_messages).cast("int"), ["source_path"], ["msg_index"])
    n = F.row_number().over(W.partitionBy("source_path").orderBy("msg_index")) - 1
    return rows.withColumn("msg_index", n.cast("int")).select("source_path", "msg_index", "chat_name", "sender", "time", "content", "type")


#: What is told of a failed task.
NO_OBJECT, NO_LIST = "no valid JSON object in the response", "messages must be a JSON array"


def judged_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks with ``state`` (missing, failed, completed), the ``error`` of a failed one and, for extraction tasks, their ``items``.

    A response that holds threads and no messages is complete without rows, as is a task of another kind. Of the messages, those that are objects with a content are items."""
    text = F.when(T.utrim(F.col("response_text")) != "", F.col("response_text"))
    p = with_model_object(tasks.withColumn("__text", text), F.col("__text"), "__o").withColumn("__p", F.from_json("__o", _PAYLOAD)).drop("__o")
    raw = F.coalesce(F.col("__p.messages"), F.lit("[]"))
    has_threads = F.coalesce(F.trim("__p.threads").startswith("[") & (F.trim("__p.threads") != "[]"), F.lit(False))
    other = F.coalesce(F.col("kind"), F.lit("")).isin("", "message_extraction") == F.lit(False)
    is_list = F.trim(raw).startswith("[")
    items = F.from_json(raw, "array<string>")
    items = F.filter(items, lambda x: x.startswith("{") & F.coalesce(F.array_contains(F.json_object_keys(x), "content"), F.lit(False)))
    idle = other | ((F.regexp_replace(raw, r"\s", "").isin("[]", "null", "")) & has_threads)
    state = F.when(F.col("__text").isNull(), "missing").when(F.col("__p").isNull(), "failed").when(idle, "completed").when(~is_list, "failed").otherwise("completed")
    error = F.when(F.col("__text").isNotNull() & F.col("__p").isNull(), NO_OBJECT).when(state == "failed", NO_LIST)
    p = p.withColumn("error", error)
    return p.withColumn("state", state).withColumn("items", F.when((state == "completed") & ~idle, items)).withColumn("found_name", T.blank_to_null(F.col("__p.chat_name"))).drop("__text", "__p")


#: Tasks of a block in which names are carried on.
CARRY_BLOCK = 10_000


# W4
def carried_chat_name(tasks: DataFrame, default: str = "Current Chat", by: list[str] | None = None) -> DataFrame:
    """A response's chat name holds for later readable tasks that name none; a task's own name wins.

    Names are carried within blocks of a run's tasks, and from block to block by one narrow row for each, so no task of Spark's holds a whole run."""
    by = by or ["run_id"]
    rows = tasks.withColumns({"__own": F.when(F.col("state") == "completed", F.col("found_name")), "__b": F.floor(F.col("task_pos") / CARRY_BLOCK)})
    blocks = rows.groupBy(*by, "__b").agg(F.max_by("__own", F.when(F.col("__own").isNotNull(), F.col("task_pos"))).alias("__last"))
    before = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__b").alias("__block"), F.last("__last", ignorenulls=True).over(before).alias("__from"))
    same = F.col("__b") == F.col("__block")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    within = W.partitionBy(*by, "__b").orderBy("task_pos").rowsBetween(W.unboundedPreceding, 0)
    carried = F.coalesce(F.last("__own", ignorenulls=True).over(within), F.col("__from"))
    joined = rows.join(blocks, same).withColumn("task_chat", F.coalesce(T.blank_to_null(F.col("chat_name")), carried, F.lit(default)))
    return joined.select(*tasks.columns, "task_chat")


# M3, A7
def finalized_messages(judged: DataFrame, now: Column, hours: int = 0, scope: str = "task") -> DataFrame:
    """Messages of all answered tasks (:func:`judged_tasks`), before repeats go, with ``in_window``."""
    one = F.from_json("m", _ITEM)
    rows = carried_chat_name(judged).select("run_id", "task_pos", "task_chat", F.posexplode("items").alias("pos", "m")).withColumn("i", one)
    rows = rows.select(
        "run_id", "task_pos", "pos", F.coalesce(T.blank_to_null(F.col("i.chat_name")), "task_chat").alias("chat_name"), F.coalesce("i.sender", F.lit("")).alias("sender"), F.col("i.time").alias("time"),
        F.coalesce("i.content", F.lit("")).alias("content"), T.coerce_type(F.coalesce("i.type", F.lit("text"))).alias("type"),
    )
    if hours <= 0:
        return rows.withColumn("in_window", F.lit(True))
    timed = carried_time(rows, now) if scope == "global" else with_effective_time(rows, now, ["run_id", "chat_name", "task_pos"], ["task_pos", "pos"])
    inside = F.col("effective_time").isNull() | (F.col("effective_time") >= cutoff(hours, now))
    return timed.withColumn("in_window", inside).drop("event_time", "effective_time")


# W2 over a whole run
def carried_time(rows: DataFrame, now: Column, by: list[str] | None = None) -> DataFrame:
    """As :func:`with_effective_time` over all rows of a run in the order of (task_pos, pos): within blocks of tasks, and from block to block by one narrow row for each, so no task of Spark's holds a whole run."""
    by = by or ["run_id"]
    place = F.struct("task_pos", "pos")
    parsed = with_message_time(rows, F.col("time"), now).withColumn("__b", F.floor(F.col("task_pos") / CARRY_BLOCK))
    blocks = parsed.groupBy(*by, "__b").agg(F.max_by("event_time", F.when(F.col("event_time").isNotNull(), place)).alias("__last"))
    before = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__b").alias("__block"), F.last("__last", ignorenulls=True).over(before).alias("__from"))
    same = F.col("__b") == F.col("__block")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    within = W.partitionBy(*by, "__b").orderBy("task_pos", "pos").rowsBetween(W.unboundedPreceding, 0)
    timed = parsed.join(blocks, same).withColumn("effective_time", F.coalesce(F.last("event_time", ignorenulls=True).over(within), F.col("__from")))
    return timed.select(*rows.columns, "event_time", "effective_time")


def without_repeats(rows: DataFrame) -> DataFrame:
    n = F.row_number().over(W.partitionBy("run_id", "chat_name", "sender", "time", "content", "type").orderBy("task_pos", "pos"))
    return rows.withColumn("__n", n).filter("__n = 1").drop("__n")


def failures(judged: DataFrame) -> DataFrame:
    """``run_id, task_pos, step_id, state, error`` of the tasks that are missing or failed: one row each, for runs of any size."""
    return judged.filter("state != 'completed'").select("run_id", "task_pos", "step_id", "state", "error")


def finalize_summary(judged: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per run: tasks in all and completed (flags that were set before count), ids of missing and failed ones, errors of the latter in the same order, and messages before
    the window, in it, and extracted, which is in it and not repeated. For runs with very many failures, :func:`failures` has them as rows."""
    listed = lambda state: F.array_sort(F.collect_list(F.when(F.col("state") == state, F.struct("task_pos", "step_id", "error"))))
    done = F.count_if((F.col("state") == "completed") | F.col("completed"))
    summary = judged.groupBy("run_id").agg(F.count("*").alias("total"), done.alias("completed"), listed("missing").alias("m"), listed("failed").alias("f"))
    # repeats are counted by keys, in one pass over the messages
    keys = rows.groupBy("run_id", "in_window", "chat_name", "sender", "time", "content", "type").agg(F.count("*").alias("k"))
    inside = F.col("in_window")
    counts = keys.groupBy(F.col("run_id").alias("__run")).agg(
        F.sum("k").alias("messages_before"), F.sum(F.when(inside, F.col("k"))).alias("messages_in_window"), F.count_if(inside).alias("messages_extracted")
    )
    summary = summary.join(counts, F.col("run_id").eqNullSafe(F.col("__run")), "left")
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return summary.select(
        "run_id", "total", "completed", F.array_join("m.step_id", ",").alias("missing"), F.array_join("f.step_id", ",").alias("failed"), F.array_join("f.error", "\n").alias("errors"),
        number("messages_before"), number("messages_in_window"), number("messages_extracted"), ((F.size("m") == 0) & (F.size("f") == 0)).alias("ok"),
    )


def finalize(tasks: DataFrame, now: Column, hours: int = 0, scope: str = "task") -> tuple[DataFrame, DataFrame]:
    """Messages of all answered tasks, without repeats, and one summary row per run. Answers are read once: what was found in them is a checkpoint, from which both are made."""
    judged = cut(judged_tasks(tasks).drop("response_text"))
    rows = finalized_messages(judged, now, hours, scope)
    return without_repeats(rows.filter("in_window").drop("in_window")), finalize_summary(judged, rows)


# A10
def outcomes(results: DataFrame) -> DataFrame:
    """Per-chat results of an extraction, in the order of submission."""
    ok = F.col("error").isNull()
    return results.select("submit_index", "chat_name", ok.alias("success"), F.when(ok, F.col("path")).alias("path"), F.when(ok, F.col("message_count")).otherwise(0).alias("message_count"), "error").orderBy("submit_index")
