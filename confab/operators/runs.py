"""Run records and their status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.functions.text import blank_to_null


# A6
def run_status(outcomes: DataFrame) -> DataFrame:
    """``outcomes``: run_id, pos, chat_name, path, stage, error. One row per run: paths, distinct failures in order, status."""
    failed = F.col("error").isNotNull()
    failures = outcomes.filter(failed).groupBy("run_id", "chat_name", "stage", "error").agg(F.min("pos").alias("pos"))
    failures = failures.groupBy("run_id").agg(F.count("*").alias("n_failures"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(": ", "chat_name", "stage", "error").alias("e")))), lambda x: x["e"]), "; ").alias("errors"))
    paths = outcomes.groupBy("run_id").agg(F.count_if(~failed & F.col("path").isNotNull()).alias("n_paths"))
    both = paths.join(failures, "run_id", "left").withColumn("n_failures", F.coalesce("n_failures", F.lit(0)))
    status = F.when(F.col("n_failures") == 0, "ok").when(F.col("n_paths") > 0, "partial").otherwise("failed")
    return both.select("run_id", "n_paths", "n_failures", F.coalesce("errors", F.lit("")).alias("errors"), status.alias("status"), (status == "ok").alias("ok"))


# A9
def task_chats(tasks: DataFrame) -> DataFrame:
    """Distinct non-blank chats of a run's extraction tasks, by first appearance."""
    rows = tasks.filter((F.col("kind") == "message_extraction") & blank_to_null(F.col("chat_name")).isNotNull())
    return rows.groupBy("run_id", "chat_name").agg(F.min("task_pos").alias("first"))
