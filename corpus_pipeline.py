"""From raw documents to packed training sequences: five stages, each over all that the one before it kept.

1. quality: documents that the rule ensemble scores under the cut go.
2. exact_dedup: of equal texts, one stays.
3. near_dedup: of each component of near-duplicates, one stays.
4. pii: personal data in the texts becomes pseudonyms of the same format.
5. packing: the texts' tokens become sequences of at most 2048 tokens; one row per piece of a document.

Edge cases: a null, empty or white text passes the first stage if the model scores it so; such texts are equal to each other, so one of them stays,
near-duplicate detection keeps it, and packing gives it its end token alone. Very long texts are read whole by every stage. Of repeated rows and of ties the
second stage keeps one, as its operator says. Null ids are kept. Further columns stay up to the fourth stage, whatever their names but for those of the statistics (``s_...``),
which only the first stage forbids. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm import exact_dedup, near_dedup, packing, pii, quality, queries
from confab.llm.common import store


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = queries.quality_model(spark, docs.select("doc_id", "text"), sf_dir).score()
    return quality.with_statistics(docs, keep_text=True).filter(score >= queries.QUALITY_CUT).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, queries.pii_key(spark))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: The quality stage and the token ids can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
