"""Running a caller's model over pending tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.functions.text import utrim


# J10
def pending_tasks(tasks: DataFrame, responses: DataFrame, force: bool = False, skip_existing: bool = False) -> DataFrame:
    """Tasks without a non-blank response; ``force`` takes all of them unless ``skip_existing`` holds."""
    if force and not skip_existing:
        return tasks
    answered = responses.filter(utrim(F.col("response_text")) != "").select("step_id")
    return tasks.join(answered, "step_id", "left_anti")


# M1
def map_model(tasks: DataFrame, query: Callable[[str, bytes | None, int], str | None], workers: int | None = None, attempts: int = 3) -> DataFrame:
    """``tasks`` (prompt, image, max_tokens, ...) with ``response_text`` and ``error``; a failing row is tried again and never stops the others.

    Each task of Spark's runs one call at a time. ``workers`` limits how many run at once, for a model that bears no more; without it, there are as
    many as the table has partitions."""
    schema = tasks.select("*", F.lit(None).cast("string").alias("response_text"), F.lit(None).cast("string").alias("error")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers, errors = [], []
            for r in frame.itertuples(index=False):
                answer = error = None
                for _ in range(attempts):
                    try:
                        answer, error = query(r.prompt, r.image, r.max_tokens), None
                        if answer:
                            break
                        error = "empty answer"
                    except Exception as e:  # the caller's function may fail in any way
                        error = f"{type(e).__name__}: {e}"
                answers.append(answer)
                errors.append(error)
            yield frame.assign(response_text=answers, error=errors)

    return (tasks.repartition(workers) if workers else tasks).mapInPandas(run, schema)


def model_totals(results: DataFrame, pending: int, total: int) -> DataFrame:
    return results.agg(F.count_if(F.col("error").isNull()).alias("written"), F.lit(total - pending).alias("skipped"))
