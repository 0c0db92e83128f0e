"""The driver's tables as the tables that the operators take, each as a DataFrame and as SQL for DuckDB.

M: conversations as messages. E: events as messages of users. R: M as a model's answers, in overlapping chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The moment that relative times refer to.
NOW = "2024-01-31 12:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit("conv_"), F.col("conv_id").cast("string"))
    kind = F.when(F.col("role") == "system", "system").when(F.col("turn") % 5 == 4, "image").otherwise("text")
    return table(spark, sf_dir, "conversations").select(
        source.alias("source_path"), F.col("turn").cast("int").alias("msg_index"), source.alias("chat_name"), F.col("role").alias("sender"), F.lit(None).cast("string").alias("time"), F.col("text").alias("content"), kind.alias("type")
    )


M_SQL = """m AS (SELECT 'conv_' || conv_id AS source_path, turn::INT AS msg_index, 'conv_' || conv_id AS chat_name, role AS sender,
  NULL::VARCHAR AS time, text AS content, CASE WHEN role = 'system' THEN 'system' WHEN turn % 5 = 4 THEN 'image' ELSE 'text' END AS type FROM conversations)"""


def _naive(ts: str) -> Column:
    return F.col(ts).cast("timestamp_ntz")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MESSAGE columns, and ``event_id`` and ``ts``."""
    source = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    time = F.when(F.col("event_id") % 3 != 0, F.date_format(_naive("ts"), "yyyy-MM-dd HH:mm"))
    return table(spark, sf_dir, "events").select(
        source.alias("source_path"), n.cast("int").alias("msg_index"), source.alias("chat_name"), F.col("event_type").alias("sender"), time.alias("time"), F.col("event_type").alias("content"), F.lit("text").alias("type"),
        "event_id", _naive("ts").alias("ts"),
    )


E_SQL = """e AS (SELECT 'user_' || user_id AS source_path, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS msg_index,
  'user_' || user_id AS chat_name, event_type AS sender, CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M') END AS time,
  event_type AS content, 'text' AS type, event_id, ts::TIMESTAMP AS ts FROM events)"""


def picked(names: list[str], index: Column) -> Column:
    """The names in turn."""
    return F.element_at(F.array(*map(F.lit, names)), (index % len(names) + 1).cast("int"))


def picked_sql(names: list[str], index: str) -> str:
    quoted = ", ".join("'" + n.replace("'", "''") + "'" for n in names)
    return f"([{quoted}])[({index}) % {len(names)} + 1]"


def responses(spark: SparkSession, sf_dir: str, size: int = 4, step: int = 2) -> DataFrame:
    """RESPONSE rows: chunks of ``size`` turns, a new one every ``step`` turns, as fenced JSON in a sentence."""
    m = conversations(spark, sf_dir)
    first = F.greatest(F.floor((F.col("msg_index") - size + step) / step), F.lit(0)).cast("int")
    rows = m.withColumn("chunk_index", F.explode(F.sequence(first, F.floor(F.col("msg_index") / step).cast("int"))))
    items = F.transform(F.array_sort(F.collect_list(F.struct("msg_index", F.struct("sender", "content", "time", "type").alias("m")))), lambda x: x["m"])
    chunks = rows.groupBy("chat_name", "chunk_index").agg(F.to_json(F.struct(items.alias("messages")), {"ignoreNullFields": "false"}).alias("json"))
    text = F.concat(F.lit("Here is the result:\n```json\n"), "json", F.lit("\n```"))
    number = F.regexp_extract("chat_name", r"(\d+)", 1).cast("int")
    return chunks.select(
        F.lit("run").alias("run_id"), (number * 100 + F.col("chunk_index")).alias("task_pos"), F.format_string("step_run_%d_%04d", number, F.col("chunk_index")).alias("step_id"), "chat_name", "chunk_index",
        F.lit(None).cast("int").alias("chunk_total"), F.lit("message_extraction").alias("kind"), F.lit(False).alias("completed"), text.alias("response_text"),
    )


R_SQL = f"""{M_SQL}, r AS (SELECT DISTINCT chat_name, unnest(range(greatest((msg_index - 2) // 2, 0), msg_index // 2 + 1))::INT AS chunk_index FROM m),
  t AS (SELECT chat_name, chunk_index, regexp_extract(chat_name, '([0-9]+)', 1)::INT * 100 + chunk_index AS task_pos,
    printf('step_run_%d_%04d', regexp_extract(chat_name, '([0-9]+)', 1)::INT, chunk_index) AS step_id FROM r)"""


def spoiled(tasks: DataFrame) -> DataFrame:
    """Every 7th answer blank, every 11th broken."""
    pos = F.col("task_pos")
    return tasks.withColumn("response_text", F.when(pos % 7 == 0, " ").when(pos % 11 == 0, "no object here").otherwise(F.col("response_text")))
