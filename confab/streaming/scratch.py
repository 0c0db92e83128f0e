"""A folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only on one machine, and only where that is unset, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-confab-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that a finished stream needs no more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
