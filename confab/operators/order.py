"""Places and running sums of rows in one order, over a whole table or within keys, without a task that holds a table or a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confab.streaming.scratch import scratch

#: Rows of a range, about. A table of no more is one range.
RANGE_ROWS = 200_000


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder, which Spark's cleaner deletes when nothing refers to it any more."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch(spark))
    return df.checkpoint()


def running(df: DataFrame, key: Sequence[str], order: Sequence[Column], name: str, weight: Column | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` (1, if none is given) over the rows before a row in ``order`` within its key; without a key, over the whole table.

    A table of more than RANGE_ROWS rows is cut into ranges of (key, order), whatever the keys' sizes. Sums run within a range, and from range to range over one row for each range and key. Rows that
    are equal in the order stay in one range, and stand in any order there."""
    weight = F.lit(1) if weight is None else weight
    columns = df.columns
    places = [f"__o{i}" for i in range(len(order))]
    rows = df.withColumns({"__w": weight.cast("long"), **dict(zip(places, order, strict=True))})
    before = lambda part: F.coalesce(F.sum("__w").over(part.orderBy(*places).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = -(-df.count() // RANGE_ROWS)
    if ranges <= 1:
        return rows.withColumn(name, before(W.partitionBy(*key))).select(*columns, name)
    rows = cut(rows.repartitionByRange(ranges, *key, *places).withColumn("__part", F.spark_partition_id()))
    totals = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col("__part").alias("__in")).agg(F.sum("__w").alias("__sum"))
    chain = W.partitionBy(*[f"__k{i}" for i in range(len(key))]).orderBy("__in").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("__from", F.coalesce(F.sum("__sum").over(chain), F.lit(0))).drop("__sum")
    same = F.col("__part") == F.col("__in")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rows = rows.withColumn("__within", before(W.partitionBy("__part", *key)))
    return rows.join(totals, same).withColumn(name, F.col("__from") + F.col("__within")).select(*columns, name)


def place_in_order(df: DataFrame, order: Column, name: str) -> DataFrame:
    """``df`` with each row's place, from 0, in ``order``."""
    return running(df, [], [order], name)
